"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, a folder of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = getattr(sc, "_lodestar_tables", None)
        if at is None:
            at = sc._lodestar_tables = "file://" + tempfile.mkdtemp(prefix="lodestar-tables-")
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back, which cuts its lineage; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    while _made:
        spark, at = _made.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass
