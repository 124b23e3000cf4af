"""Connected components of a table of edges, by alternating large and small stars; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_scratch, scratch, shuffles_dropped


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) to (node, root): root is the least node of each component; nodes without edges have no row."""
    spark = edges.sparkSession

    def store(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "stars")
        with shuffles_dropped(spark):
            df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now, path = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, new_path = store(small)
        drop_scratch(path)
        now, path, before, last = new, new_path, last, state(new)
        if last == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
