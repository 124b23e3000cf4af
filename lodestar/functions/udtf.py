"""Table functions for SQL: phone_scan(text) and sitemap_urls(url, content)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodestar.functions import phone
from lodestar.schemas import PHONE_CANDIDATE
from lodestar.sources.feeds import parse_sitemap


class PhoneScan:
    def eval(self, text: str):
        for n in phone.scan(text or ""):
            yield n.raw, n.start, n.end, n.status, n.extension, n.e164, n.national, n.normalized, n.country_code, n.notes


class SitemapUrls:
    def eval(self, url: str, content: bytes):
        children, pages = parse_sitemap(url or "", bytes(content or b""))
        for c in children:
            yield "child", c, None
        for u, lastmod in pages:
            yield "page", u, lastmod


def register(spark: SparkSession) -> None:
    spark.udtf.register("phone_scan", udtf(PhoneScan, returnType=PHONE_CANDIDATE.replace("\n", " ").replace(" end ", " `end` ")))
    spark.udtf.register("sitemap_urls", udtf(SitemapUrls, returnType="kind string, url string, lastmod string"))
