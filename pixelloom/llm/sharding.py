"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed by doc_id into SLOTS slots, however many shards there are. Bytes are aggregated per slot, and a
versioned slot-to-shard map says where each slot lives. Rebalancing edits the stored map: it writes the next version, in which
slots have moved from the fullest to the emptiest shards until their sizes are near equal. A data set's first map deals
slots in turn (version 1); each call with its path edits the latest version. Law: `bytes`.

A doc_id that repeats, or is null, could fill a slot that no map can split: rows of ids (and the null rows) with more than a
SPREAD-th of a mean slot's bytes are hashed with a row number, too. What reaches the driver is one row per slot.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_or_empty

#: Virtual slots; fixed for the life of a data set, since a record's slot depends on it.
SLOTS = 4096
#: Ids with more than this part of a mean slot's bytes in several rows are spread: SPREAD * slots of them at most.
SPREAD = 16


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, stored: size is the text's UTF-8 bytes plus 8.

    A null text has no bytes and the checksum of none. Rows of an id that holds many bytes in several rows are dealt out by
    a row number as well.
    """
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # at most SPREAD * slots ids can hold so much
    heavy = per_id.where((F.col("n") > 1) & (F.col("bytes") > F.lit(total / (SPREAD * slots)))).select(F.col("doc_id").alias("heavy_id"), F.lit(True).alias("heavy"))
    marked = rows.join(F.broadcast(stored(heavy, "heavy")), rows["doc_id"].eqNullSafe(F.col("heavy_id")), "left")
    key = F.when(F.col("heavy"), F.xxhash64("doc_id", "row")).otherwise(F.xxhash64("doc_id"))
    return marked.select("doc_id", "size", "text_crc32", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def striped(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1 of a map: slots dealt in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(owner: list[int], sizes: list[int], shards: int) -> list[int]:
    """An edited copy of a map: the best single move or exchange between the fullest and the emptiest shard, as long as it
    narrows the gap between them."""
    owner, held, total = list(owner), [set() for _ in range(shards)], [0] * shards
    for s, o in enumerate(owner):
        held[o].add(s)
        total[o] += sizes[s]
    while shards > 1:
        high, low = max(range(shards), key=lambda x: (total[x], -x)), min(range(shards), key=lambda x: (total[x], x))
        gap = total[high] - total[low]
        # moving d bytes leaves |gap - 2d|: the best d is half the gap
        best, leaves = None, gap
        out = sorted((sizes[s], s) for s in held[high] if sizes[s])
        back = [(0, -1), *sorted((sizes[s], s) for s in held[low] if sizes[s])]
        at = 0
        for give, s in out:
            while at + 1 < len(back) and 2 * (give - back[at + 1][0]) >= gap:
                at += 1
            for take, t in back[at : at + 2]:
                if 0 < give - take < gap and abs(gap - 2 * (give - take)) < leaves:
                    best, leaves = (s, t), abs(gap - 2 * (give - take))
        if best is None:
            return owner
        for s, a, b in ((best[0], high, low), (best[1], low, high)):
            if s >= 0:
                held[a].remove(s)
                held[b].add(s)
                owner[s] = b
                total[a] -= sizes[s]
                total[b] += sizes[s]
    return owner


def write_map(spark, path: str, version: int, owner: list[int]) -> None:
    """Store one version of a slot-to-shard map beside the earlier ones; one that exists is never written again."""
    listed = F.from_json(F.lit(json.dumps(owner)), "array<int>")
    rows = spark.range(1).select(F.posexplode(listed).alias("virtual_slot", "shard"))
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def versions(spark, path: str) -> list[int]:
    """The versions of the map stored under path, ascending; none if there is no map."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [str(x.getPath().getName()) for x in fs.listStatus(folder)]
    return sorted(int(x.removeprefix("version=")) for x in names if x.startswith("version="))


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of a version; the latest by default."""
    version = max(versions(spark, path)) if version is None else version
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def current_owner(spark, path: str, slots: int) -> list[int] | None:
    """The latest stored map as a list of slots' shards; None if there is none."""
    if not versions(spark, path):
        return None
    owner = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path).collect()}
    if sorted(owner) != list(range(slots)):
        raise ValueError(f"the map at {path} has {len(owner)} slots, not {slots}")
    return [owner[s] for s in range(slots)]


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every row's place: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    With a path, the map stored there is edited: its latest version is rebalanced to the bytes at hand and to the number of
    shards (new shards start empty; a lower number hands their slots to the others), and stored as the next version.

    slot is the row's place in its shard, gapless from 0 in each; virtual_slot is the hash slot. grown_shard is null, as
    the law `bytes` promises nothing for another number of shards. Rows that repeat get places of their own; rows with a null
    doc_id, or with one that fills a slot, are spread; an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/pixelloom/slot-map-{uuid.uuid4().hex}"
    rows = stored(with_slots(docs, slots), "slotted")
    counted = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in slot_bytes(rows).collect()}
    sizes = [counted.get(s, (0, 0))[0] for s in range(slots)]
    latest = current_owner(spark, path, slots)
    if latest is None:
        write_map(spark, path, 1, latest := striped(shards, slots))
    version = versions(spark, path)[-1] + 1
    write_map(spark, path, version, owner := rebalanced([o if o < shards else s % shards for s, o in enumerate(latest)], sizes, shards))
    before, seen = [0] * slots, [0] * shards
    for s, o in enumerate(owner):
        before[s], seen[o] = seen[o], seen[o] + counted.get(s, (0, 0))[1]
    offsets = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(before)), "array<long>")).alias("virtual_slot", "before"))
    place = read_map(spark, path, version).join(F.broadcast(offsets), "virtual_slot")  # one row per slot: bounded
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("within", within).join(F.broadcast(place), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
