"""Arrays in .npy files, as rows. Files are read and written through Spark's own file access, so any store that Spark reads will do."""

from __future__ import annotations

import ast
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"


def parse_header(raw: bytes) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(dtype, shape, column order, data offset) of a version 1 or 2 file.

    Scalars that print their type (np.int64(3)) and dtype('<f4') are accepted. ValueError: not such a file.
    """
    if raw[:6] != MAGIC:
        raise ValueError("not an .npy file")
    major = raw[6]
    if major not in (1, 2):
        raise ValueError(f"version {major} of .npy isn't supported")
    size, at = (struct.unpack("<H", raw[8:10])[0], 10) if major == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    text = raw[at : at + size].decode("latin-1")
    text = re.sub(r"np\.\w+\((-?\d+)\)", r"\1", re.sub(r"dtype\(('[^']*')\)", r"\1", text))
    said = ast.literal_eval(text.strip())
    return np.dtype(said["descr"]), tuple(int(n) for n in said["shape"]), bool(said["fortran_order"]), at + size


def load(raw: bytes) -> np.ndarray:
    kind, shape, columns, at = parse_header(raw)
    return np.frombuffer(raw, kind, int(np.prod(shape, dtype=np.int64)), at).reshape(shape, order="F" if columns else "C")


def dump(x: np.ndarray) -> bytes:
    text = repr({"descr": np.lib.format.dtype_to_descr(x.dtype), "fortran_order": False, "shape": x.shape})
    text += " " * (-(len(text) + 11) % 64) + "\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text.encode("latin-1") + np.ascontiguousarray(x).tobytes()


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(key, shape, values): one row per file of a folder; key is the file's name. A file has to fit in a task.

    Large arrays should be converted to Parquet once; this is the way in.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = load(b.column("content")[i].as_py())
                yield pa.RecordBatch.from_pydict({"key": [b.column("key")[i].as_py()], "shape": [list(x.shape)], "values": [x.astype(float).ravel().tolist()]},
                                                 schema=pa.schema([("key", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("key"), "content").mapInArrow(run, "key string, shape array<long>, values array<double>")


def write_npy(df: DataFrame, key: str, values: str, path: str) -> None:
    """One .npy file per row, by the driver's file system handle: for small exports. Tables: write_npy_rows."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in df.select(key, values).toLocalIterator():
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/{r[0]}.npy")
        out = to.getFileSystem(conf).create(to, True)
        try:
            out.write(bytearray(dump(np.asarray(r[1], np.float32))))
        finally:
            out.close()


def write_npy_rows(df: DataFrame, key: str, values: str, path: str) -> int:
    """All rows by the executors, a file for each batch and length, of records (key, float32 values); the number of rows.

    path is a folder that every executor sees. A file's name is its partition's and batch's number, so a retried task writes its
    files again; each is moved into place when it is whole. Null values are written as arrays of no elements.
    """
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        # a path without a scheme is local; s3a and the like are not names that Arrow knows
        store, to = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else f"file://{path}")
        store.create_dir(to, recursive=True)
        task, at = TaskContext.get(), 0
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), [np.asarray(v or [], np.float32) for v in batch.column(1).to_pylist()]
            for n in sorted({len(r) for r in rows}):
                mine = [i for i, r in enumerate(rows) if len(r) == n]
                own = np.asarray([keys[i] for i in mine])
                x = np.empty(len(mine), np.dtype([("key", own.dtype), ("values", np.float32, (n,))]))
                x["key"], x["values"] = own, np.stack([rows[i] for i in mine])
                name = f"{to}/part-{task.partitionId():05d}-{at:05d}"
                with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                    out.write(dump(x))
                store.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.npy")
                at += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    return df.select(key, values).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(key, values): every record of the files that write_npy_rows wrote; key as text."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                x = load(raw.as_py())
                yield pa.RecordBatch.from_pydict({"key": [str(k) for k in x["key"].tolist()], "values": x["values"].astype(float).tolist()},
                                                 schema=pa.schema([("key", pa.string()), ("values", pa.list_(pa.float64()))]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("content").mapInArrow(run, "key string, values array<double>")
