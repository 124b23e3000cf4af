"""Crawl tables made from `pages` and `documents` by rules on their ids, as inputs of queries on the driver's data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.url import normalize_url

def sitemap_urls(pages: DataFrame) -> DataFrame:
    """Two pages in three are listed; every tenth of these twice."""
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    rows = pages.where(F.col("page_id") % 3 != 0).select("url", day.alias("lastmod"), F.concat(F.lit("https://site.test/sitemap-"), F.col("page_id") % 4, F.lit(".xml")).alias("sitemap_source"), F.col("page_id").alias("seq"))
    again = rows.where(F.col("seq") % 10 == 1).select("url", F.lit("2030-01-01").alias("lastmod"), "sitemap_source", (F.col("seq") + 1_000_000_000).alias("seq"))
    return rows.unionByName(again)


def page_records(pages: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("page_id") % 11 == 0, "FAILED_HTTP")
        .when(F.col("page_id") % 11 == 1, "SKIPPED_EXTERNAL_REDIRECT")
        .when(F.col("page_id") % 11 == 2, "FAILED_TIMEOUT")
        .when(F.col("page_id") % 11 == 3, "RENDER_UNAVAILABLE")
        .when(F.col("page_id") % 11 == 4, "SKIPPED_CONTENT_TYPE")
        .when(F.col("page_id") % 11 == 5, "PDF_TEXT_UNAVAILABLE")
        .otherwise("SUCCESS")
    )
    return pages.where(F.col("page_id") % 5 != 1).select(
        F.col("url").alias("requested_url"), F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.col("url")).alias("final_url"), normalize_url(F.col("url")).alias("normalized_url"),
        F.when(F.col("page_id") % 11 == 5, "PDF").otherwise("HTML").alias("kind"), F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("http_status"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 100).alias("crawl_timestamp"),
        F.when(F.col("page_id") % 2 == 0, "html_link").otherwise("sitemap").alias("source"), F.lit(None).cast("string").alias("referring_url"), status.alias("status"),
        F.when(F.col("page_id") % 11 == 0, "HTTP 404").when(F.col("page_id") % 11 == 2, "").alias("error"), F.when(F.col("page_id") % 11 == 2, "slow").alias("notes"), (F.col("page_id") % 13 == 0).alias("rendered_js"), F.col("page_id").alias("seq"),
    )


def events(pages: DataFrame) -> DataFrame:
    status = F.when(F.col("page_id") % 2 == 0, "SKIPPED_PATTERN").when(F.col("page_id") % 3 == 0, "SKIPPED_EXTERNAL_REDIRECT").otherwise("SUCCESS")
    return pages.where(F.col("page_id") % 7 == 2).select("url", status.alias("status"), F.when(F.col("page_id") % 4 == 0, "").otherwise("exclude_pattern").alias("detail"), F.col("page_id").alias("seq"))
