"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: with documents of some kB a batch stays in the tens of MB.
BATCH_ROWS = 1000

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset and all runs on one machine, a folder of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if not at and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = getattr(sc, "_lodestar_dir", None)
        if at is None:
            at = sc._lodestar_dir = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends, or by drop_scratch()."""
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_scratch(path: str | None = None) -> None:
    for spark, at in [x for x in _made if path in (None, x[1])]:
        _made.remove((spark, at))
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


atexit.register(drop_scratch)


#: Spark's setting by which the shuffle files of a query go as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        out = df.write
        if partition_by:
            out = out.partitionBy(*partition_by)
        out.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Removes the tables behind results of stored() that nothing reads any more."""
    for df in tables:
        drop_scratch(df._stored_at)


def text_key() -> list[Column]:
    """Columns that tell rows of documents apart even where doc_id is null or repeated: equal keys mean equal rows."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tk")]


#: At most so many document keys are sent to each executor to pick documents by (some tens of MB); beyond, both sides are shuffled.
SENT = 500_000


def among(documents: DataFrame, keys: DataFrame, anti: bool = False) -> DataFrame:
    """The documents (with doc_id and _tk) whose key is among keys (d, t), or the others."""
    if keys.count() <= SENT:
        keys = F.broadcast(keys)
    same = documents["doc_id"].eqNullSafe(keys["d"]) & (documents["_tk"] == keys["t"])
    return documents.join(keys, same, "left_anti" if anti else "left_semi")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def texts(column: pa.Array) -> list[str]:
    """Nulls become empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the bounds of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most limit bytes together; a longer row is a run of its own."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), in a new array."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Polynomial hashes modulo 2**64 of spans of a byte array, from prefix sums over random byte codes."""

    P = np.uint64(0x9E3779B97F4A7C15 | 1)

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.codes = rng.integers(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(self.P), -1, 2**64))
            for name, base in (("up", self.P), ("down", inverse)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (prefix[ends] - prefix[starts]) * self.down[starts]
