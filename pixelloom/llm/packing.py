"""Best-fit packing of token sequences with swap-based local search.

1. Every whole text is tokenized once; longer ones are cut into pieces. What is kept of a piece is its length and the
   CRC-32 of its ids, not the ids.
2. Pieces are dealt into groups of bounded size by a hash. In each group they are packed best-fit, longest first, and the
   bins that aren't full are then improved by local search: moves, one-for-one and two-for-one exchanges from an emptier
   to a fuller bin, each of which increases the sum of squared fills, until none does; emptied bins vanish.
3. Full bins are final. The pieces of all others meet anew in fewer groups, with other neighbours, and step 2 is repeated
   until they fit into one group or a round settles less than half of its pieces. Lengths, not texts, travel.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .wordbpe import IdCache

#: Pieces in a group, about: what one task packs.
GROUP = 20_000


def _pieces(path: str, room: int, end: int):
    last = end.to_bytes(4, "little")

    def run(batches):
        cache = IdCache.shared(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                out = {f.name: [] for f in _PIECE}
                docs, texts = (batch.column(i).slice(a, 64).to_pylist() for i in (0, 1))
                for doc, ids in zip(docs, cache.of_many(texts)):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[at : at + 4 * room]
                        for col, v in zip(out.values(), (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            col.append(v)
                yield pa.RecordBatch.from_pydict(out, schema=_PIECE)

    return run


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, room: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and `end`, cut every `room` ids. Null: empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).mapInArrow(
        _pieces(path, room, end), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins (lists of indexes), each piece, longest first, in the fullest bin that has room for it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_gap: dict[int, list[int]] = {}
    gaps: list[int] = []  # those that occur, ascending
    for i in order:
        n = lengths[i]
        at = bisect_left(gaps, n)
        if at < len(gaps):
            gap = gaps[at]
            held = by_gap[gap]
            b = held.pop()
            if not held:
                del by_gap[gap]
                gaps.pop(at)
        else:
            b, gap = len(bins), room
            bins.append([])
        bins[b].append(i)
        if rest := gap - n:
            if rest not in by_gap:
                by_gap[rest] = []
                insort(gaps, rest)
            by_gap[rest].append(b)
    return bins


class _Open:
    """The bins that aren't full, and all their pieces by length."""

    def __init__(self, bins: list[list[int]], lengths: list[int], room: int):
        self.bins, self.n, self.room = [list(b) for b in bins], lengths, room
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.home = {i: b for b, held in enumerate(self.bins) for i in held}
        self.sorted = sorted((lengths[i], i) for i in self.home)

    def put(self, i: int, b: int) -> None:
        a = self.home[i]
        self.bins[a].remove(i)
        self.bins[b].append(i)
        self.fill[a] -= self.n[i]
        self.fill[b] += self.n[i]
        self.home[i] = b

    def retire(self, b: int) -> None:
        for i in self.bins[b]:
            self.sorted.pop(bisect_left(self.sorted, (self.n[i], i)))

    def largest(self, most: int, least: int, b: int, fill: int):
        """The longest piece of at most `most` and over `least`, in a bin that isn't b and is no fuller than `fill`."""
        at = bisect_right(self.sorted, (most, 1 << 62)) - 1
        while at >= 0 and self.sorted[at][0] > least:
            i = self.sorted[at][1]
            if self.home[i] != b and self.fill[self.home[i]] <= fill:
                return i
            at -= 1
        return None

    def improve(self, b: int) -> bool:
        """The step that fills bin b most, taken from bins that are no fuller: every such step raises the sum of squares."""
        gap, fill, n = self.room - self.fill[b], self.fill[b], self.n
        best, gain = None, 0
        i = self.largest(gap, 0, b, fill)  # move
        if i is not None:
            best, gain = (i, ()), n[i]
        own = sorted(set(self.bins[b]), key=lambda x: n[x])
        seen = set()
        for x in own:  # one for one
            if gain == gap:
                break
            if n[x] in seen:
                continue
            seen.add(n[x])
            i = self.largest(n[x] + gap, n[x] + gain, b, fill)
            if i is not None:
                best, gain = (i, (x,)), n[i] - n[x]
        for k, x in enumerate(own):  # two of b's for one
            if gain == gap:
                break
            for y in own[k + 1 :]:
                if n[x] + n[y] + gap > self.room:
                    break
                i = self.largest(n[x] + n[y] + gap, n[x] + n[y] + gain, b, fill)
                if i is not None:
                    best, gain = (i, (x, y)), n[i] - n[x] - n[y]
                    if gain == gap:
                        break
        if best is None:
            return False
        i, back = best
        a = self.home[i]
        self.put(i, b)
        for x in back:
            self.put(x, a)
        return True


def improve(bins: list[list[int]], lengths: list[int], room: int) -> list[list[int]]:
    """Local search over bins; the fullest first. Bins that become full are done, empty ones vanish."""
    total = lambda b: sum(lengths[i] for i in b)
    done = [b for b in bins if total(b) == room]
    some = _Open([b for b in bins if total(b) < room], lengths, room)
    todo = sorted(range(len(some.bins)), key=lambda b: some.fill[b])
    while todo:
        b = todo.pop()
        while some.fill[b] < room and some.improve(b):
            pass
        some.retire(b)  # nothing improves it: the others are filled from what is left
        todo.sort(key=lambda x: some.fill[x])
    return done + [b for b in some.bins if b]


_PLACED = "row long, bin long, full boolean, offset long"


def _pack(room: int):
    def run(key, table):
        lengths = table.column("length").to_pylist()
        rows = table.column("row").to_pylist()
        # the same input order whatever order rows arrive in
        order = sorted(range(len(rows)), key=lambda i: (lengths[i], rows[i]))
        lengths, rows = [lengths[i] for i in order], [rows[i] for i in order]
        bins = improve(best_fit(lengths, room), lengths, room)
        out = {"row": [], "bin": [], "full": [], "offset": []}
        for b, held in enumerate(bins):
            full, at = sum(lengths[i] for i in held) == room, 0
            for i in held:
                for col, v in zip(out.values(), (rows[i], (key[0].as_py() << 28) + b, full, at)):
                    col.append(v)
                at += lengths[i]
        return pa.table(out, schema=pa.schema([("row", pa.int64()), ("bin", pa.int64()), ("full", pa.bool_()), ("offset", pa.int64())]))

    return run


def pack(docs: DataFrame, path: str, room: int = 4096, end: int = 1, group: int = GROUP) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are pieces of one id (`end`). Rows that repeat are packed each; a null doc_id stays null; an empty
    table gives no rows; columns besides doc_id and text are ignored.
    """
    every = stored(pieces(docs, path, room, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = every.select("row", "length")
    placed, rounds, before = None, 0, None
    while True:
        n = left.count()
        groups = max(1, -(-n // group))
        last = groups == 1 or (before is not None and 2 * n > before)  # too little became final for another round
        dealt = left.withColumn("group", F.pmod(F.xxhash64("row", F.lit(rounds)), F.lit(groups)))
        # each round numbers its bins in a range of its own
        out = dealt.groupBy("group").applyInArrow(_pack(room), _PLACED).withColumn("round", F.lit(rounds))
        out = stored(out, "packed")
        now = out if last else out.where("full")
        placed = now if placed is None else placed.unionByName(now)
        if last:
            break
        left, before, rounds = out.where("NOT full").join(every.select("row", "length"), "row").select("row", "length"), n, rounds + 1
    return every.join(placed, "row").select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("round").cast("long") * (1 << 56) + F.col("bin")).alias("sequence_id"), "offset"
    )
