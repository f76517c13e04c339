"""What the corpus operators share: reading tables, tables kept in the shared folder, and text as flat byte arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: A flat batch is cut into pieces of about so many bytes (one row at least), which bounds a task's numpy arrays.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, one in the warehouse,
    and only in local mode, where there are no other machines, a temporary one. A warehouse on the machines' own disks is
    refused, as executors would not see each other's files."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        path = qualified(spark, spark.conf.get("spark.sql.warehouse.dir"))
        if path.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return path.rstrip("/")
    path = getattr(spark, "_pkgloom_dir", None) or f"file://{tempfile.mkdtemp(prefix='pkgloom-')}"
    spark._pkgloom_dir = path
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that it has by default."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shared_uri(spark: SparkSession) -> str:
    """shared_dir() as other libraries than Spark's name it."""
    return qualified(spark, shared_dir(spark)).replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written once as Parquet into the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/pkgloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _tables(spark)[path] = None
    return out


def _tables(spark: SparkSession) -> dict[str, None]:
    """The paths of this session's stored tables that are still there, in the order in which they were written."""
    if not hasattr(spark, "_pkgloom_tables"):
        spark._pkgloom_tables = {}
    return spark._pkgloom_tables


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, stored; the tables that it stored on the way are deleted."""
    before = set(_tables(spark))
    out = stored(spark, make())
    for path in [p for p in _tables(spark) if p not in before and p != out._stored_at]:
        remove(spark, path)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, folder: str) -> None:
    _tables(spark).pop(folder, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that may be broadcast at most, and the longest of them.
HOT_KEYS, HOT_LENGTH = 1_000, 4_096


def join_skewed(rows: DataFrame, values: DataFrame, key: str, spread, total: int) -> DataFrame:
    """rows left joined with values (key, a string and unique; uses, how many rows have it; others) although keys may be hot.

    Keys of a thousandth of the total rows or more are at most HOT_KEYS; their values are broadcast, as far as they are no
    longer than HOT_LENGTH. Rows that found them are dealt out by spread, which names the row; no other key is hot.
    """
    names = [c for c in values.columns if c != key]
    hot = values.where((F.col("uses") >= max(2, -(-total // HOT_KEYS))) & (F.length(key) <= HOT_LENGTH))
    hot = F.broadcast(hot.select(F.col(key).alias("hot_key"), F.struct(*names).alias("hot_value")))
    rows = rows.join(hot, F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    cold = F.when(F.col("hot_value").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("#"), F.xxhash64(spread).cast("string")))
    values = values.select(F.col(key).alias("cold_key"), F.struct(*names).alias("cold_value"))
    rows = rows.withColumn("cold_key", cold).join(values.hint("merge"), "cold_key", "left")
    return rows.select(*(c for c in rows.columns if c not in ("cold_key", "hot_value", "cold_value")), *(F.coalesce(F.col("hot_value")[c], F.col("cold_value")[c]).alias(c) for c in names))


def ascii_lower(text):
    """A-Z to a-z and nothing else; lower() is right, and faster, where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batch with about limit bytes of text each: (rows, bytes, offsets)."""
    raw, at = flat(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start), raw[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True in member, cut at the row offsets."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = member[heads]
    last[at[1:][at[:-1] < at[1:]] - 1] = member[at[1:][at[:-1] < at[1:]] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_MULT, _INV = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, which: str) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.full(max(n, 2 * PIECE_BYTES), _MULT if which == "up" else _INV, np.uint64)
        base[0] = 1
        _powers[which] = have = np.cumprod(base, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One 64-bit value for each byte, from a rule.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class SpanHash:
    """64-bit hashes of any spans of raw, from one pass over it; seed gives independent functions."""

    def __init__(self, raw: np.ndarray, seed: int = 0, lower: bool = False):
        values = BYTE if not seed else mix(BYTE + np.uint64(seed))
        values = values[LOWER] if lower else values
        self.sum = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * _power(len(raw) + 1, "up")[: len(raw)], out=self.sum[1:])
        self.down = _power(len(raw) + 1, "down")

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64))


def class_runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of one nonzero value in kind, cut at the row offsets."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(len(kind), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[at[:-1][at[:-1] < len(kind)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(kind))
    keep = kind[start] != 0
    return start[keep], end[keep]


def sum_vectors(rows: DataFrame, slices: int, length: int) -> np.ndarray:
    """The sum of the tasks' vectors; rows (slice, part, counts) hold slices of them (zstd of int64). Two levels, so that
    no group has more than about the root of the number of tasks; only the fixed-size sums come to the driver."""
    import pandas as pd
    import zstandard

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in pdf["counts"])
        return pd.DataFrame([{"slice": pdf["slice"].iloc[0], "part": 0, "counts": zstandard.compress(total.tobytes(), 1)}])

    schema = "slice int, part int, counts binary"
    wide = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    some = rows.withColumn("part", F.pmod("part", F.lit(wide))).groupBy("slice", "part").applyInPandas(add, schema)
    out = np.zeros(length, np.int64)
    for r in some.groupBy("slice").applyInPandas(add, schema).collect():
        part = np.frombuffer(zstandard.decompress(r["counts"]), np.int64)
        out[r["slice"] * (length // slices) : (r["slice"] + 1) * (length // slices)] = part
    return out


def vector_rows(total: np.ndarray, slices: int) -> pa.RecordBatch:
    """A task's vector as the rows that sum_vectors() takes."""
    import zstandard
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    cut = [zstandard.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(total, slices)]
    return pa.RecordBatch.from_pydict({"slice": pa.array(range(slices), pa.int32()), "part": pa.array([part] * slices, pa.int32()), "counts": pa.array(cut, pa.binary())})
