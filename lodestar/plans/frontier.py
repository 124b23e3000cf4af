"""Discovery as a fix-point over tables: each level's links meet what was seen, and the fetch log answers for the network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.config import CrawlConfig
from lodestar.functions.url import Scope, host, is_html_type, is_pdf_type, looks_like_pdf, normalize_url, skip_reason, sniff_html
from lodestar.storage import stored


def admit(found: DataFrame, config: CrawlConfig, allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds skip_status and detail to (normalized_url, depth, kind, ...): depth, then patterns, then robots."""
    url = F.col("normalized_url")
    reason = skip_reason(url, config.include_url_patterns, config.exclude_url_patterns)
    robots = allowed(url) if allowed is not None else F.lit(True)
    deep = F.col("depth") > config.max_depth
    return found.withColumns(
        {
            "skip_status": F.when(deep, "SKIPPED_MAX_DEPTH").when(reason.isNotNull(), "SKIPPED_PATTERN").when(~robots, "SKIPPED_ROBOTS"),
            "detail": F.when(deep, F.lit("max_depth")).when(reason.isNotNull(), reason).when(~robots, F.lit("robots")),
        }
    )


def capped(items: DataFrame, scheduled: dict[str, int], config: CrawlConfig) -> DataFrame:
    """The first items of each kind in the order of seq that the caps leave room for; a cap of 0 is none."""
    out = None
    for kind, cap in (("HTML", config.max_pages), ("PDF", config.max_pdfs)):
        part = items.where(F.col("kind") == kind)
        if cap:
            part = part.orderBy("seq").limit(max(0, cap - scheduled.get(kind, 0)))
        out = part if out is None else out.unionByName(part)
    return out


def route(fetched: DataFrame, scope: Scope, config: CrawlConfig) -> DataFrame:
    """Adds status, error and final kind to fetched rows (kind, final_url, http_status, content_type, body, bytes, fail_status, error).

    In this order: no answer, another site, too large, an HTTP error, PDF, not HTML, HTML."""
    final = F.coalesce("final_url", "url")
    outside = ~scope.allows(host(final))
    pdf = is_pdf_type(F.col("content_type")) | looks_like_pdf(final) | (F.col("kind") == "PDF")
    html = is_html_type(F.col("content_type")) | F.coalesce(sniff_html(F.col("body")), F.lit(False))
    status = (
        F.when(F.col("http_status").isNull(), F.coalesce("fail_status", F.lit("FAILED_NETWORK")))
        .when(outside, "SKIPPED_EXTERNAL_REDIRECT")
        .when((F.col("kind") == "HTML") & (F.col("bytes") > config.max_file_size), "SKIPPED_TOO_LARGE")
        .when(F.col("http_status") >= 400, "FAILED_HTTP")
        .when(pdf, F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "PDF_TEXT_UNAVAILABLE").otherwise("SUCCESS"))
        .when(~html, "SKIPPED_CONTENT_TYPE")
        .otherwise("SUCCESS")
    )
    error = F.when(F.col("http_status") >= 400, F.concat(F.lit("HTTP "), F.col("http_status"))).otherwise(F.col("error"))
    read = F.col("http_status").isNotNull() & ~outside & (F.col("http_status") < 400)
    return fetched.withColumns({"status": status, "page_error": error, "page_kind": F.when(read & pdf, "PDF").otherwise(F.col("kind"))})


def expand(seeds: DataFrame, edges: DataFrame, max_depth: int, seen: DataFrame | None = None) -> DataFrame:
    """Breadth-first closure: seeds (node) and edges (src, dst) to (node, depth), at the least depth; seen nodes aren't entered."""
    level = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    if seen is not None:
        level = level.join(seen.select("node"), "node", "left_anti")
    done = level
    for depth in range(1, max_depth + 1):
        step = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        step = step.join(done, "node", "left_anti")
        if seen is not None:
            step = step.join(seen.select("node"), "node", "left_anti")
        level = stored(step.withColumn("depth", F.lit(depth)), "level")
        if level.limit(1).count() == 0:
            break
        done = done.unionByName(level)
    return done


def crawl(
    fetch_log: DataFrame, sitemap_urls: DataFrame, config: CrawlConfig, scope: Scope, links_of: Callable[[DataFrame], DataFrame], allowed: Callable[[Column], Column] | None = None, visited: DataFrame | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None, on_level: Callable[[int, DataFrame | None, DataFrame, dict[str, int]], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Follows links through a fetch log, a level at a time; returns pages (routed rows with depth, referrer, source, seq) and events.

    links_of: pages (url, html) to (url, pos, link, kind). fetch: (url) to rows of a fetch log, for what the log doesn't answer.
    on_level: called with each level's number, new rows of the log (None without fetch), pages, and how many are scheduled by kind. visited: (normalized_url, kind) of an earlier run, which isn't fetched
    again and counts for the caps. Each level is written to the shared folder, so a lost executor costs one level at most."""
    spark = fetch_log.sparkSession
    log = fetch_log.withColumn("normalized_url", normalize_url(F.col("url"), strip_params=config.strip_query_params))
    log = log.withColumn("_k", F.row_number().over(Window.partitionBy("normalized_url").orderBy(F.desc("fetched_at"), "url"))).where("_k = 1").drop("_k")
    log = stored(log, "log")  # each level looks into it
    kind = lambda c: F.when(looks_like_pdf(c), "PDF").otherwise("HTML")
    none = F.lit(None).cast("string")
    start = spark.createDataFrame([(config.start_url,)], "url string").select("url", normalize_url(F.col("url")).alias("normalized_url"), F.lit(0).alias("depth"), F.lit("HTML").alias("kind"), none.alias("referring_url"), F.lit("seed").alias("source"))
    listed = sitemap_urls.select("url", normalize_url(F.col("url")).alias("normalized_url"), F.lit(0).alias("depth"), kind(F.col("url")).alias("kind"), none.alias("referring_url"), F.lit("sitemap").alias("source"))
    found = start.unionByName(listed.where(scope.internal(F.col("normalized_url")))).where("normalized_url is not null")
    scheduled: dict[str, int] = {}
    seen = None
    if visited is not None:
        seen = stored(visited.select("normalized_url", "kind"), "visited")
        scheduled = {r["kind"]: r["n"] for r in seen.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        seen = seen.select("normalized_url")
    pages = events = None
    for level in range(config.max_depth + 2):
        seq = F.struct(F.col("depth"), (F.col("source") != "seed").alias("late"), F.coalesce("referring_url", F.lit("")).alias("from"), "normalized_url").alias("seq")
        judged = stored(admit(found.withColumn("seq", seq), config, allowed), "judged")
        refused = judged.where("skip_status is not null").select("url", F.col("skip_status").alias("status"), "detail", "seq")
        events = refused if events is None else events.unionByName(refused)
        fresh = judged.where("skip_status is null")
        if seen is not None:
            fresh = fresh.join(seen, "normalized_url", "left_anti")
        fresh = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("normalized_url").orderBy("seq"))).where("_k = 1").drop("_k", "skip_status", "detail")
        taken = stored(capped(fresh, scheduled, config), "level")
        sizes = {r["kind"]: r["n"] for r in taken.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes and pages is not None:
            break
        scheduled = {k: scheduled.get(k, 0) + sizes.get(k, 0) for k in {*scheduled, *sizes}}
        seen = taken.select("normalized_url") if seen is None else seen.unionByName(taken.select("normalized_url"))
        due = taken if config.include_pdfs else taken.where("kind <> 'PDF'")
        answered, new = log, None
        if fetch is not None:
            new = stored(fetch(due.join(log.select("normalized_url"), "normalized_url", "left_anti").select("url")), "answers")
            more = new.withColumn("bytes", F.octet_length(F.coalesce("body", F.lit("")))).withColumn("normalized_url", normalize_url(F.col("url"), strip_params=config.strip_query_params))
            answered = log.unionByName(more.dropDuplicates(["normalized_url"]))
        answers = due.join(answered.drop("url"), "normalized_url", "left")
        got = stored(route(answers, scope, config), "fetched")
        if on_level is not None:
            on_level(level, new, got, scheduled)
        pages = got if pages is None else pages.unionByName(got)
        if not sizes:
            break
        read = got.where((F.col("status") == "SUCCESS") & (F.col("page_kind") == "HTML"))
        links = links_of(read.select(F.coalesce("final_url", "url").alias("url"), F.col("body").alias("html"))).select("url", "link", "kind")
        depth_of = read.select(F.coalesce("final_url", "url").alias("at"), F.col("normalized_url").alias("referrer"), "depth").dropDuplicates(["at"])
        found = links.join(depth_of, F.col("url") == F.col("at")).select(
            F.col("link").alias("url"), F.col("link").alias("normalized_url"), (F.col("depth") + 1).alias("depth"), "kind", F.col("referrer").alias("referring_url"),
            F.when(F.col("kind") == "PDF", "html_pdf_link").otherwise("html_link").alias("source"),
        )
        if not config.include_pdfs:
            found = found.where("kind <> 'PDF'")
    return pages, events
