"""A run from a fetch log to all its tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import progress
from lodestar.config import CrawlConfig
from lodestar.functions.text import either
from lodestar.functions.url import Scope, file_name, normalize_url, resolve
from lodestar.operators import coverage, inventory
from lodestar.operators.occurrences import extract_pages, first_seen_labels, html_occurrences, page_links, pdf_occurrences, reconcile
from lodestar.plans.frontier import crawl
from lodestar.sources import html as H
from lodestar.schemas import FETCH_LOG
from lodestar.sources import sinks
from lodestar.sources.feeds import Robots, discover_sitemaps
from lodestar.sources.fetch import fetch, fetch_bytes, fetch_files
from lodestar.storage import stored


@dataclass
class Result:
    config: CrawlConfig
    scope: Scope
    started_at: datetime
    finished_at: datetime
    pages: DataFrame
    events: DataFrame
    sitemaps: DataFrame
    sitemap_urls: DataFrame
    occurrences: DataFrame
    phones: DataFrame
    url_inventory: DataFrame

    def summary(self) -> DataFrame:
        return coverage.summary(self.scope.registrable_domain, self.scope.start_url, self.started_at, self.finished_at, self.pages, self.phones, self.occurrences, self.url_inventory, self.sitemap_urls)

    def report(self) -> dict:
        n = self.phones.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("validation_status") == "VALID").alias("v")).first()
        run = {
            "start_url": self.scope.start_url,
            "registrable_domain": self.scope.registrable_domain,
            "started_at": self.started_at.isoformat(),
            "finished_at": self.finished_at.isoformat(),
            "duration_seconds": (self.finished_at - self.started_at).total_seconds(),
            "unique_phones": n["n"],
            "valid_unique_phones": n["v"],
            "occurrences": self.occurrences.count(),
            "pages": self.pages.count(),
            "sitemaps": self.sitemaps.count(),
        }
        return coverage.report(run, coverage.report_counts(self.pages, self.occurrences, self.url_inventory), self.summary(), self.sitemaps)

    def export(self, output: str) -> dict[str, str]:
        """All files of the run."""
        tables = {
            "phone_inventory": inventory.in_order(self.phones).drop("key", "seq"),
            "phone_occurrences": self.occurrences.drop("seq"),
            "url_inventory": self.url_inventory.orderBy("normalized_url"),
            "crawl_report": self.summary().orderBy("ord").drop("ord"),
            "crawl_errors": coverage.errors(self.pages),
            "pages": self.pages.drop("seq"),
            "sitemaps": self.sitemaps,
        }
        sinks.write_json(tables["pages"], f"{output}/pages_audit.jsonl")
        paths = sinks.export_csvs(tables, output) | sinks.export_report(self.report(), output)
        sheets = {"Summary": tables["crawl_report"], "Phone Inventory": tables["phone_inventory"], "Phone Occurrences": tables["phone_occurrences"], "URL Inventory": tables["url_inventory"], "Crawl Coverage": tables["url_inventory"], "Errors": tables["crawl_errors"]}
        top = [inventory.top_phones(self.phones), inventory.top_phones(self.phones, "unique_url_count")]
        return paths | {"workbook": sinks.export_workbook(sheets, f"{output}/phone_inventory.xlsx", top)}


def run(
    spark: SparkSession, config: CrawlConfig, fetch_log: DataFrame | None = None, sitemap_files: DataFrame | None = None, robots: str | None = None, rendered: DataFrame | None = None, visited: DataFrame | None = None, ask=None,
    live: bool = False, state: sinks.Checkpoint | None = None,
) -> Result:
    """Runs a crawl over a fetch log (url, final_url, http_status, content_type, body, response_time_ms, fail_status, error, fetched_at).

    sitemap_files: (sitemap_url, content). robots: the text of the robots file. rendered: (url, html) of pages after their scripts ran.
    live: what the log, the files and robots don't answer is fetched. state: takes each level's new answers as soon as it is done; a run that
    is given these as its log goes on where the other broke off, and fetches nothing twice."""
    started = datetime.now(UTC)
    scope = Scope.of(config.start_url, config.allow_subdomains)
    if live and robots is None and config.respect_robots:
        body, why = fetch_bytes(f"{scope.origin}/robots.txt", config, 15.0)
        robots = body.decode("utf-8", "replace") if body is not None else None
        progress.event("robots", found=body is not None, error=why)
    if fetch_log is None:
        fetch_log = spark.createDataFrame([], FETCH_LOG.replace("\n", " "))
    rules = Robots(robots if config.respect_robots else None, config.start_url)
    none = spark.createDataFrame([], "sitemap_url string, content binary")
    if config.discover_sitemaps:
        sitemaps, listed = discover_sitemaps(sitemap_files if sitemap_files is not None else none, config.start_url, scope, rules.sitemaps, config.max_sitemap_urls, config.strip_query_params, (lambda keys: fetch_files(keys, config)) if live and sitemap_files is None else None)
    else:
        sitemaps, listed = spark.createDataFrame([], "sitemap_url string, source string, status string, url_count long, lastmod string, error string, nested boolean"), spark.createDataFrame([], "url string, lastmod string, sitemap_source string")
    listed, sitemaps = stored(listed, "sitemap-urls"), stored(sitemaps, "sitemaps")
    allowed = (lambda url: rules.allowed(url, config.user_agent)) if config.respect_robots and robots is not None else None
    log = fetch_log.withColumn("bytes", F.octet_length(F.coalesce("body", F.lit(""))))
    progress.announce("DISCOVER", f"{listed.count()} URLs from sitemaps of {scope.hostname}")
    done_pages, first_level = 0, max(state.levels(), default=-1) + 1 if state is not None else 0

    def on_level(level: int, new: DataFrame | None, pages: DataFrame, scheduled: dict[str, int]) -> None:
        nonlocal done_pages
        done_pages = progress.announce_pages(pages, done_pages, sum(scheduled.values()))
        if state is not None and new is not None:
            state.save(first_level + level, fetched=new)
            progress.event("level_saved", level=level, answers=new.count())

    fetcher = (lambda urls: fetch(urls, config, rules.crawl_delay)) if live else None
    got, events = crawl(log, listed, config, scope, lambda p: page_links(p, scope), allowed, visited, fetcher, on_level)
    got, events = stored(got, "crawled"), stored(events, "events")
    at = F.coalesce("final_url", "url")
    read = got.where((F.col("status") == "SUCCESS") & (F.col("page_kind") == "HTML"))
    html = read.select(F.col("url").alias("requested_url"), at.alias("url"), at.alias("final_url"), "http_status", "referring_url", F.col("fetched_at").alias("at"), "depth", F.col("body").alias("html"))
    signals = H.spa_signals(F.col("html"))
    why = html.select("url", H.render_reason(signals, F.char_length(H.visible_text(F.col("html"))), config.render_js).alias("why"))
    due = why.where("why is not null")
    static = html_occurrences(html)
    events = events.select("url", "status", "detail", "seq")
    if rendered is not None:
        after = html.drop("html").join(rendered.select(F.col("url"), F.col("html")), "url").join(due, "url", "left_semi")
        after = stored(after, "rendered")
        done = after.select("url")
        merged = reconcile(static.join(done, F.col("source_url") == F.col("url"), "left_semi"), html_occurrences(after))
        untouched = static.join(done, F.col("source_url") == F.col("url"), "left_anti")
        merged = merged.withColumn("seq", F.col("seq.seq"))
        found = untouched.unionByName(merged)
    else:
        done = spark.createDataFrame([], "url string")
        found = static
    pdfs = got.where((F.col("page_kind") == "PDF") & (F.col("status") == "SUCCESS")).select(at.alias("url"), file_name(at).alias("filename"), "depth", F.posexplode(F.split("body", "\f")).alias("p", "text"))
    texts = pdf_occurrences(pdfs.withColumn("page_number", F.col("p") + 1)).withColumn("seq", F.struct(F.lit(0).alias("a"), F.col("source_url").alias("u"), F.lit(2).alias("b"), F.col("pdf_page_number").alias("c")))
    occurrences = stored(found.unionByName(texts.select(*found.columns)), "occurrences")
    fields = extract_pages(html).select(F.col("url").alias("f_url"), F.col("title").alias("page_title"), F.col("h1").alias("page_h1"), F.col("canonical_url").alias("canonical"), F.char_length("text").alias("visible_text_length"), "parse_error")
    links = page_links(html, scope).groupBy(F.col("url").alias("l_url")).agg(F.count_if(F.col("kind") == "HTML").alias("link_count"), F.count_if(F.col("kind") == "PDF").alias("pdf_link_count"))
    numbers = occurrences.groupBy(F.col("source_url").alias("o_url")).agg(F.count(F.lit(1)).alias("phone_count"))
    rows = got.withColumn("at", at)
    rows = rows.join(fields.dropDuplicates(["f_url"]), F.col("at") == F.col("f_url"), "left").join(links, F.col("at") == F.col("l_url"), "left").join(numbers, F.col("at") == F.col("o_url"), "left")
    rows = rows.join(due.dropDuplicates(["url"]).select(F.col("url").alias("w_url"), "why"), F.col("at") == F.col("w_url"), "left").join(done.distinct().select(F.col("url").alias("d_url")), F.col("at") == F.col("d_url"), "left")
    none_text = F.lit(None).cast("string")
    pages = rows.select(
        F.col("url").alias("requested_url"), F.col("final_url"), "normalized_url", F.col("page_kind").alias("kind"), F.col("http_status").cast("int").alias("http_status"), "content_type",
        F.round("response_time_ms", 2).alias("response_time_ms"), F.col("fetched_at").alias("crawl_timestamp"), "page_title", "page_h1", resolve(at, F.col("canonical")).alias("canonical_url"), "depth",
        "referring_url", "source", F.when(F.col("parse_error").isNotNull(), "FAILED_PARSE").when(F.col("d_url").isNotNull(), "SUCCESS_RENDERED").otherwise(F.col("status")).alias("status"), F.coalesce("parse_error", "page_error").alias("error"),
        F.coalesce("visible_text_length", F.lit(0)).alias("visible_text_length"), F.coalesce("phone_count", F.lit(0)).cast("int").alias("phone_count"), F.coalesce("link_count", F.lit(0)).cast("int").alias("link_count"),
        F.coalesce("pdf_link_count", F.lit(0)).cast("int").alias("pdf_link_count"), F.col("d_url").isNotNull().alias("rendered_js"), F.col("why").alias("js_render_reason"), F.col("bytes").cast("long").alias("bytes"), none_text.alias("notes"), "seq",
    )
    pages = stored(pages, "pages")
    progress.announce_phones(first_seen_labels(occurrences))
    missing = pages.where("js_render_reason is not null and not rendered_js").select(F.col("requested_url").alias("url"), F.lit("RENDER_UNAVAILABLE").alias("status"), F.col("js_render_reason").alias("detail"), "seq")
    events = events.unionByName(missing)
    phones = inventory.classify(inventory.unique_phones(occurrences))
    if config.classify_ai:
        if ask is None:
            progress.event("labels_skipped", reason="no key")
        phones = inventory.relabel(phones, ask)
    listed_seq = listed.withColumn("seq", F.struct(F.col("sitemap_source").alias("a"), F.col("url").alias("b")))
    urls = coverage.url_inventory(pages, listed_seq, events)
    return Result(config, scope, started, datetime.now(UTC), pages, events, sitemaps, listed, occurrences, stored(phones, "phones"), stored(urls, "url-inventory"))


def visited_of(pages: DataFrame) -> DataFrame:
    """What a later run of the same site needn't fetch again."""
    return pages.select(either(F.col("normalized_url"), normalize_url(F.col("requested_url"))).alias("normalized_url"), "kind")
