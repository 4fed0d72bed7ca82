"""Content-addressed WARC archive.

Payload bytes are stored once, gzip-compressed, under their SHA-256. Record headers are stored apart, byte for byte, one
row per record. Reading joins the two on the digest and rebuilds the records: whole `response` records for the first
capture of a payload, `revisit` records (identical-payload-digest) that name it for the others, and, for either, the
payload. Every payload is digested anew when it is read; a mismatch fails the job instead of giving wrong bytes.

Two captures have equal payloads if SHA-256, SHA-1 and length are equal.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(raw: Column) -> Column:
    """Upper-case base32 of the SHA-1: forty hex digits in four groups of ten, each eight digits of radix 32."""
    digits = F.translate(F.concat(*(F.lpad(F.conv(F.substring(F.sha1(raw), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4))),
                         "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return digits


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, raw (UTF-8 payload; null html: empty), payload_bytes, sha256, sha1 and a row key."""
    raw = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), raw.alias("raw")).select(
        "page_id", "url", "raw", F.octet_length("raw").cast("long").alias("payload_bytes"), F.sha2("raw", 256).alias("sha256"), base32_sha1(F.col("raw")).alias("sha1")
    )


def header(kind: Column, page_id: Column, row: Column, url: Column, date: str, length: Column, sha1: Column, refers_to: Column, lead: Column) -> Column:
    """The header block of a record, up to and with its empty line. URLs keep to one line: control characters are escaped.

    A record's id is that of its page and its row, as pages can repeat; a revisit names its response's."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    rid = lambda c, r: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), r.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", rid(page_id, row)), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", rid(refers_to, lead)), line("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(kind == "revisit", F.lit(0)).otherwise(length).cast("string")), F.lit(CRLF),
    )


def _gzip(batches):
    seen: set[str] = set()  # a task's copies are packed once
    for batch in batches:
        digests = batch.column(0).to_pylist()
        new = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
        packed = [zlib.compress(batch.column(1)[i].as_py(), 6, 31) for i in new]
        yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.string()), pa.array(packed, pa.binary())], names=["sha256", "packed"])


def write_archive(pages: DataFrame, path: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write pages as an archive under path (by default in the shared folder): payloads/ and records/. Gives the path.

    Of captures with equal payloads of `least` bytes or more, that with the smallest page_id (null last) is the response.
    Repeated rows with that page_id: one is the response and the others revisit it. Smaller payloads are all responses.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/pixelloom/archive-{uuid.uuid4().hex}"
    every = captures(pages)
    # one row of each payload: the row key keeps repeated rows apart without comparing payloads
    keyed = stored(every.drop("raw").withColumn("row", F.monotonically_increasing_id()), "captures")
    # both tables are stored, so that the joins are of scans, whose large groups Spark can split
    first = stored(keyed.groupBy("sha256", "sha1", "payload_bytes").agg(F.min("page_id").alias("first")), "first")
    marks = keyed.join(first, ["sha256", "sha1", "payload_bytes"])
    lead = stored(marks.where(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("sha256", "sha1", "payload_bytes").agg(F.min("row").alias("lead")), "lead")
    revisit = (F.col("payload_bytes") >= least) & (F.col("row") != F.col("lead"))
    kind = F.when(revisit, "revisit").otherwise("response")
    records = marks.join(lead, ["sha256", "sha1", "payload_bytes"]).select(
        "page_id", "sha256", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).alias("block_bytes"),
        header(kind, F.col("page_id"), F.col("row"), F.col("url"), date, F.col("payload_bytes"), F.col("sha1"), F.col("first"), F.col("lead")).alias("header"),
    )
    records.write.mode("overwrite").parquet(f"{path}/records")
    packed = every.select("sha256", "raw").mapInArrow(_gzip, "sha256 string, packed binary")
    # equal payloads are dropped where they are read, then across tasks; bytes travel compressed
    packed.dropDuplicates(["sha256"]).write.mode("overwrite").parquet(f"{path}/payloads")
    return path


def _rebuild(batches):
    """Record bytes and verified payload of each joined row."""
    for batch in batches:
        cols = batch.to_pydict()
        out = {"page_id": cols["page_id"], "record": [], "payload": []}
        for digest, block, head, packed in zip(cols["sha256"], cols["block_bytes"], cols["header"], cols["packed"]):
            payload = zlib.decompress(packed, 31) if packed is not None else None
            if payload is None or hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload {digest} is missing or damaged")
            out["record"].append(head.encode("utf-8") + payload[:block] + b"\r\n\r\n")
            out["payload"].append(payload)
        yield pa.RecordBatch.from_pydict(out, schema=_RECORD)


_RECORD = pa.schema([("page_id", pa.int64()), ("record", pa.binary()), ("payload", pa.binary())])


def read_archive(spark, path: str) -> DataFrame:
    """(page_id, record, payload): the exact records and, also for revisits, the payloads that they stand for."""
    records = spark.read.schema("page_id long, sha256 string, block_bytes long, header string").parquet(f"{path}/records")
    payloads = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads")
    return records.join(payloads.hint("merge"), "sha256", "left").select("page_id", "sha256", "block_bytes", "header", "packed").mapInArrow(_rebuild, "page_id long, record binary, payload binary")


def _digest(batches):
    for batch in batches:
        page, kinds, sizes, digests, refers = [], [], [], [], []
        for record, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            head = record.partition(b"\r\n\r\n")[0].decode("utf-8").split(CRLF)
            said = dict(x.split(": ", 1) for x in head[1:])
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if said["WARC-Payload-Digest"] != f"sha1:{sha1}":
                raise ValueError(f"record {said['WARC-Record-ID']} says {said['WARC-Payload-Digest']}")
            own, to = (said.get(name, "<urn:page:none:>").split(":")[2] for name in ("WARC-Record-ID", "WARC-Refers-To"))
            page.append(None if own == "none" else int(own))
            kinds.append(said["WARC-Type"])
            sizes.append(len(payload))
            digests.append(sha1)
            refers.append(None if to == "none" else int(to))
        yield pa.RecordBatch.from_pydict({"page_id": page, "payload_bytes": sizes, "payload_digest": digests, "record_type": kinds, "refers_to": refers}, schema=_SEEN)


_SEEN = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages, read the archive back and say what was read: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty one, a null page_id stays null; no rows give no records.
    """
    return read_archive(pages.sparkSession, write_archive(pages, least=least)).mapInArrow(
        _digest, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
