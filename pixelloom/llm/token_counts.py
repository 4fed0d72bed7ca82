"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies.

1. One scan gathers the corpus frequency of every distinct pre-token (partial counts per batch, summed by Spark).
2. The pieces of each distinct pre-token are counted once, in blocks, and stored with its frequency.
3. A second scan makes the pre-token frequencies of each document. Pre-tokens above a frequency cutoff are so many at
   most as `heavy` says: their piece counts are broadcast and their part of the join is summed where the document is.
   All rarer ones are joined by shuffle on the pre-token and summed per document. No ids are ever kept.

Nulls and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each give a row.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequency_cutoff, stored, text_or_empty
from .wordbpe import Pretokenizer

#: Pre-tokens whose piece counts are broadcast, at most (about 100 bytes each in a worker).
HEAVY = 100_000
#: Distinct pre-tokens that a task counts before it hands them on.
FLUSH = 150_000


def _batch_counts(path: str):
    def run(batches):
        tokens, counts = Pretokenizer(path), Counter()

        def out():
            # a pre-token that no string can hold (a lone surrogate) doesn't occur: texts come from UTF-8
            return pa.RecordBatch.from_pydict({"piece": list(counts), "freq": pa.array(counts.values(), pa.int64())})

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for t in batch.column(0).slice(a, 256).to_pylist():
                    counts.update(tokens.split(t))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return run


def pretoken_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(piece, freq): every distinct pre-token of the corpus and how often it occurs."""
    parts = docs.select(text_or_empty(text).alias("t")).mapInArrow(_batch_counts(path), "piece string, freq long")
    return parts.groupBy("piece").agg(F.sum("freq").alias("freq"))


def with_pieces(counts: DataFrame, path: str) -> DataFrame:
    """(piece, freq, n): the library's number of tokens for each distinct pre-token."""

    def run(batches):
        tokens = Pretokenizer(path)
        for batch in batches:
            n = [len(x) for x in tokens.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["piece", "freq", "n"])

    return counts.mapInArrow(run, "piece string, freq long, n long")


def _document_rows(path: str, heavy):
    def run(batches):
        tokens, known = Pretokenizer(path), heavy.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                row, doc, text = (batch.column(i).slice(a, 256).to_pylist() for i in range(3))
                totals, words, freqs, many = [], [], [], []
                for t in text:
                    total, before = 0, len(words)
                    for w, n in Counter(tokens.split(t)).items():
                        if (c := known.get(w)) is None:
                            words.append(w)
                            freqs.append(n)
                        else:
                            total += n * c
                    totals.append(total)
                    many.append(len(words) - before)
                # a row's own key keeps its join partner unique, so that no task gets all of them
                none = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((row, np.repeat(row, many)))), pa.concat_arrays([pa.array(doc, pa.int64()), none]),
                    pa.concat_arrays([pa.array([len(t.encode("utf-8", "surrogatepass")) for t in text], pa.int64()), none]),
                    pa.array([f"\x00{r}" for r in row] + words), pa.array([0] * len(row) + freqs, pa.int64()), pa.array(totals + [0] * len(words), pa.int64()),
                ], schema=_ROWS)

    return run


_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("piece", pa.string()), ("freq", pa.int64()), ("summed", pa.int64())])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, heavy: int = HEAVY) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(with_pieces(pretoken_counts(docs, path), path), "pieces")
    cutoff = frequency_cutoff(pieces, "freq", heavy)
    known = {r["piece"]: r["n"] for r in pieces.where(F.col("freq") >= cutoff).select("piece", "n").collect()}
    shared = spark.sparkContext.broadcast(known)
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
        .mapInArrow(_document_rows(path, shared), "row long, doc_id long, n_bytes long, piece string, freq long, summed long")
    )
    rare = pieces.where(F.col("freq") < cutoff).select("piece", "n")
    joined = rows.join(rare.hint("merge"), "piece", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("summed") + F.coalesce(F.col("freq") * F.col("n"), F.lit(0))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
