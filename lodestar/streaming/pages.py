"""Pages as a stream: files that land in a folder become occurrences, each once, and the inventory is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.text import window_context
from lodestar.operators.inventory import unique_phones
from lodestar.operators.occurrences import occurrence, text_candidates
from lodestar.sources.html import title, visible_text

PAGES = "url string, html string, fetched_at timestamp"


def read_pages(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """The rate limit of a crawl is that of files here: at most max_files in a batch."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(folder)


def stream_occurrences(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Occurrences of the pages' visible text; a page seen before, within the watermark, gives nothing anew."""
    once = pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["url"])
    rows = once.select("url", "fetched_at", title(F.col("html")).alias("title"), visible_text(F.col("html")).alias("text"))
    found, c = text_candidates(rows), F.col("c")
    cols = occurrence(F.col("url"), F.col("url"), "HTML", "TEXT", c, window_context(F.col("text"), c["start"], c["end"]), title=F.col("title"), at=F.col("fetched_at"))
    return found.select(*cols, F.struct(F.col("fetched_at").alias("a"), F.col("url").alias("u"), c["start"].alias("c")).alias("seq"))


def write_occurrences(occurrences: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends to table, a folder for each batch, which is replaced if the batch is tried again; so each row is there once."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return occurrences.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inventory_of(spark: SparkSession, table: str) -> DataFrame:
    """The inventory of all batches so far."""
    return unique_phones(spark.read.option("basePath", table).parquet(f"{table}/batch=*").drop("batch"))
