"""Coverage: sitemap, crawl and exclusion events reconciled by URL; counters, summary and report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import either
from lodestar.functions.url import normalize_url
from lodestar.schemas import EXCLUDED, FAILED, REDIRECTED, SUCCEEDED


def keep_one(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def coverage_status(status: Column, in_sitemap: Column) -> Column:
    """Of a page that was tried."""
    return (
        F.when(status.isin(*SUCCEEDED), F.when(in_sitemap, "SITEMAP_AND_CRAWLED").otherwise("CRAWLED_NOT_IN_SITEMAP"))
        .when(status.isin(*REDIRECTED), "REDIRECTED")
        .when(status.isin(*EXCLUDED), "EXCLUDED")
        .otherwise("DISCOVERED_BUT_FAILED")
    )


def url_inventory(pages: DataFrame, sitemap_urls: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each URL of a sitemap, a page or an exclusion. pages, sitemap_urls and events: with seq, which orders them.

    Of a URL's sitemap entries and events the first counts, of its pages the latest; a page counts before an event."""
    s = sitemap_urls.withColumn("k", F.coalesce(normalize_url(F.col("url")), F.col("url")))
    s = keep_one(s, "k", F.col("seq")).select("k", F.col("url").alias("s_url"), F.col("lastmod").alias("s_lastmod"), F.lit(True).alias("s"))
    p = keep_one(pages.withColumn("k", either(F.col("normalized_url"), F.col("requested_url"))), "k", F.desc("crawl_timestamp"), F.desc("seq"))
    p = p.select("k", F.struct("requested_url", "final_url", "source", "status", "http_status", "referring_url", "error", "kind").alias("p"))
    e = events.where(F.col("status").isin(*EXCLUDED, *REDIRECTED)).withColumn("k", F.coalesce(normalize_url(F.col("url")), F.col("url")))
    e = keep_one(e, "k", F.col("seq")).select("k", F.struct("url", "status", "detail").alias("e"))
    rows = s.join(p, "k", "full_outer").join(e, "k", "full_outer")
    in_sitemap, page, event = F.coalesce("s", F.lit(False)), F.col("p").isNotNull(), F.col("e").isNotNull()
    pick = lambda a, b, c: F.when(page, a).when(event, b).otherwise(c)
    none = F.lit(None).cast("string")
    return rows.select(
        pick(F.col("p.requested_url"), F.col("e.url"), F.col("s_url")).alias("url"),
        F.col("k").alias("normalized_url"),
        F.col("p.final_url").alias("final_url"),
        pick(coverage_status(F.col("p.status"), in_sitemap), F.when(F.col("e.status").isin(*REDIRECTED), "REDIRECTED").otherwise("EXCLUDED"), F.lit("SITEMAP_NOT_CRAWLED")).alias("coverage_status"),
        pick(F.col("p.source"), either(F.col("e.detail"), F.lit("event")), F.lit("sitemap")).alias("discovery_source"),
        in_sitemap.alias("in_sitemap"),
        F.coalesce(F.col("p.status").isin(*SUCCEEDED), F.lit(False)).alias("crawled"),
        F.col("p.http_status").alias("http_status"),
        pick(F.col("p.status"), F.col("e.status"), none).alias("page_status"),
        F.col("s_lastmod").alias("lastmod"),
        F.col("p.referring_url").alias("referring_url"),
        pick(F.col("p.error"), F.col("e.detail"), none).alias("error"),
        F.col("p.kind").alias("kind"),
    )


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def errors(pages: DataFrame) -> DataFrame:
    bad = pages.where(F.col("status").startswith("FAILED") | (F.col("status") == "PDF_TEXT_UNAVAILABLE"))
    return bad.select(F.col("requested_url").alias("url"), "final_url", "status", "http_status", either(F.col("error"), F.col("notes")).alias("error"), "kind", "crawl_timestamp")


def iso(at: datetime | None) -> str:
    return at.isoformat() if at else ""


def summary(domain: str, start_url: str, started: datetime | None, finished: datetime | None, pages: DataFrame, phones: DataFrame, occurrences: DataFrame, inventory: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """(ord, metric, value): the metrics of a run, then its coverage counts. One aggregate for each table."""
    ok = F.col("status").isin(*SUCCEEDED)
    page = either(F.col("final_url"), F.col("source_url"))
    p = pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(ok).alias("crawled"), F.count_if(ok & (F.col("kind") == "HTML")).alias("html"), F.count_if(F.coalesce("rendered_js", F.lit(False))).alias("js"),
        F.count_if(ok & (F.col("kind") == "PDF")).alias("pdf"), F.count_if(F.col("status").startswith("FAILED")).alias("failed"),
    )
    u = phones.agg(F.count(F.lit(1)).alias("phones"), *(F.count_if(F.col("validation_status") == s).alias(s.lower()) for s in ("VALID", "POSSIBLE", "INVALID")))
    o = occurrences.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(F.when(F.col("source_type") != "PDF", page)).alias("with_phones"), F.count_distinct(F.when(F.col("source_type") == "PDF", page)).alias("pdfs_with_phones"))
    i = inventory.agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("coverage_status") == "EXCLUDED").alias("excluded"))
    s = sitemap_urls.agg(F.count(F.lit(1)).alias("sitemap"))
    one = p.crossJoin(u).crossJoin(o).crossJoin(i).crossJoin(s)  # a row each
    discovered = F.when(F.col("urls") > 0, F.col("urls")).otherwise(F.col("pages") + F.col("sitemap"))
    metrics = [
        ("Domain", F.lit(domain or start_url)),
        ("Start URL", F.lit(start_url)),
        ("Crawl start time", F.lit(iso(started))),
        ("Crawl completion time", F.lit(iso(finished))),
        ("URLs discovered", discovered),
        ("URLs crawled", F.col("crawled")),
        ("URLs from sitemap", F.col("sitemap")),
        ("HTML pages processed", F.col("html")),
        ("JavaScript-rendered pages", F.col("js")),
        ("PDFs processed", F.col("pdf")),
        ("Unique phone numbers", F.col("phones")),
        ("Total phone occurrences", F.col("occurrences")),
        ("Valid phone numbers", F.col("valid")),
        ("Possible phone numbers", F.col("possible")),
        ("Invalid candidates", F.col("invalid")),
        ("Pages containing phone numbers", F.col("with_phones")),
        ("PDFs containing phone numbers", F.col("pdfs_with_phones")),
        ("Failed URLs", F.col("failed")),
        ("Excluded URLs", F.col("excluded")),
    ]
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(m).alias("metric"), v.cast("string").alias("value")) for k, (m, v) in enumerate(metrics)))).alias("r")).select("r.*")
    by = inventory.groupBy("coverage_status").agg(F.count(F.lit(1)).alias("n"))
    extra = by.select((F.lit(len(metrics) - 1) + F.row_number().over(Window.orderBy("coverage_status"))).cast("int").alias("ord"), F.concat(F.lit("Coverage "), F.col("coverage_status")).alias("metric"), F.col("n").cast("string").alias("value"))
    return rows.unionByName(extra)


def report_counts(pages: DataFrame, occurrences: DataFrame, inventory: DataFrame) -> DataFrame:
    """(counter, value, n) of all counters of a report."""
    out = None
    for name, rows, column in (("status_counts", pages, "status"), ("validation_counts", occurrences, "validation_status"), ("source_type_counts", occurrences, "source_type"), ("page_kind_counts", pages, "kind"), ("coverage_counts", inventory, "coverage_status")):
        part = counts(rows, column).select(F.lit(name).alias("counter"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def report(run: dict, counters: DataFrame, metrics: DataFrame, sitemaps: DataFrame) -> dict:
    """The payload of a report, from small tables. run: scalars of the run."""
    out: dict = dict(run)
    for name in ("status_counts", "validation_counts", "source_type_counts", "page_kind_counts", "coverage_counts"):
        out[name] = {}
    for r in counters.orderBy("counter", "value").collect():
        out[r["counter"]][r["value"]] = r["n"]
    out["summary"] = [{"metric": r["metric"], "value": r["value"]} for r in metrics.orderBy("ord").collect()]
    out["sitemap_status"] = [{"url": r["sitemap_url"], "status": r["status"], "url_count": r["url_count"], "error": r["error"]} for r in sitemaps.orderBy("sitemap_url").collect()]
    return out


def markdown(payload: dict) -> str:
    head = [
        f"- Start URL: `{payload['start_url']}`",
        f"- Domain: `{payload.get('registrable_domain')}`",
        f"- Started: {payload.get('started_at')}",
        f"- Finished: {payload.get('finished_at')}",
        f"- Duration (s): {payload.get('duration_seconds')}",
        f"- Unique phones: **{payload['unique_phones']}** ({payload['valid_unique_phones']} valid)",
        f"- Occurrences: {payload['occurrences']}",
        f"- Pages / documents processed: {payload['pages']}",
    ]
    parts = ["# Crawl coverage report", "\n".join(head)]
    for title, name in (("Status counts", "status_counts"), ("Extraction source types", "source_type_counts"), ("Coverage", "coverage_counts")):
        parts += [f"## {title}", "\n".join(f"- `{k}`: {v}" for k, v in sorted(payload[name].items()))]
    lines = [f"- `{x['url']}` — {x['status']} ({x['url_count']} URLs)" + (f" — {x['error']}" if x.get("error") else "") for x in payload["sitemap_status"]]
    return "\n\n".join([*parts, "## Sitemaps", "\n".join(lines)]) + "\n"


__all__ = ["FAILED", "coverage_status", "counts", "errors", "keep_one", "markdown", "report", "report_counts", "summary", "url_inventory"]
