"""Queries over the driver's tables, one or more for each operator, with SQL that says the same."""

from __future__ import annotations

import gzip
import json
import tempfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import EXCLUDE_PATTERNS, STRIP_QUERY_PARAMS, CrawlConfig
from lodestar.functions import phone
from lodestar.functions.text import join_list, truncate
from lodestar.functions.url import Scope, ensure_scheme, file_name, host, is_html_type, is_pdf_type, is_xml_type, looks_like_pdf, normalize_url, path, registrable_domain, resolve, skip_reason, sniff_html
from lodestar.operators import coverage, inventory
from lodestar.operators.occurrences import document_occurrences, extract_pages, first_seen_labels, html_occurrences, page_links, pdf_occurrences, reconcile, scan_phones, text_candidates, without_overlaps
from lodestar.plans import frontier, synthetic
from lodestar.schemas import FETCH_LOG
from lodestar.sources import feeds, sinks
from lodestar.sources import html as H
from lodestar.storage import shared_dir, stored
from lodestar.web import filter_rows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL that several queries share ---

NUMBER = r"(?:\+?1[\s.\-()]*)?(?:\(?\d{3}\)?[\s.\-]*)\d{3}[\s.\-]*\d{4}"
TAIL = r"(?:\s*(?:ext\.?|extension|x)\s*\.?\s*\d{1,6})?"
#: RE2 has no look-around: the neighbours are matched with the number, which is the second group.
BOUNDED = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({NUMBER}{TAIL})(?:$|[^\p{{L}}\p{{N}}_])"
HINTED = r"(?i)\b(zip(\s*code)?|isbn|invoice|order\s*#|student\s*id|ip\s*address|year)\b"


def cases(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


CANDIDATES = f"SELECT doc_id, unnest(regexp_extract_all(text, '{BOUNDED}', 1)) AS raw_phone FROM documents"
PARSED = rf"""
c AS ({CANDIDATES}),
b AS (SELECT doc_id, trim(raw_phone) AS raw_phone, regexp_extract(raw_phone, '(?i)(?:ext(?:ension)?\.?|x)\s*\.?\s*(\d{{1,6}})\b', 1) AS x, regexp_replace(regexp_replace(raw_phone, '(?is)(?:ext(?:ension)?\.?|x)\s*\.?\s*\d{{1,6}}.*$', ''), '\D', '', 'g') AS digits FROM c),
n AS (SELECT *, CASE WHEN length(digits) = 11 AND digits LIKE '1%' THEN substr(digits, 2) ELSE digits END AS n FROM b),
pp AS (SELECT doc_id, raw_phone, nullif(x, '') AS extension, length(n) = 10 AND regexp_matches(n, '^[2-9][0-8]\d[2-9]\d{{6}}$') AND NOT regexp_matches(n, '^(\d11|37|96)') AS valid, length(n) = 10 AS ten, n FROM n),
q AS (SELECT doc_id, raw_phone, extension, CASE WHEN valid THEN 'VALID' WHEN ten THEN 'POSSIBLE' ELSE 'INVALID' END AS validation_status,
  CASE WHEN ten THEN '+1' || n END AS e164, CASE WHEN ten THEN '(' || substr(n, 1, 3) || ') ' || substr(n, 4, 3) || '-' || substr(n, 7) END AS national,
  CASE WHEN ten THEN substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7) END AS normalized FROM pp)
"""

STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', ' ', 'gsi'), '<style\\b.*?</style\\s*>', ' ', 'gsi'), '<(?:template|noscript)\\b.*?</(?:template|noscript)\\s*>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs')"


def as_text(markup: str) -> str:
    out = f"regexp_replace({markup}, '<[^>]*>', ' ', 'gs')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def normalized(url: str) -> str:
    """SQL for absolute http(s) URLs with plain queries."""
    drop = ", ".join(f"'{p}'" for p in STRIP_QUERY_PARAMS)
    bare = f"regexp_replace({url}, '#.*$', '')"
    scheme = f"lower(regexp_extract({bare}, '^([A-Za-z]+)://', 1))"
    netloc = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^[A-Za-z]+://([^/?]*)', 1)), '(^http:.*):80$', '\\1'), '\\.+$', '')"
    raw_path = f"regexp_replace(regexp_extract({bare}, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+', '/', 'g')"
    tidy = f"CASE WHEN {raw_path} IN ('', '/') THEN '/' ELSE regexp_replace({raw_path}, '/$', '') END"
    parts = f"list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains([{drop}], lower(regexp_extract(x, '^([^=]*)', 1))))"
    query = f"array_to_string(list_sort(list_transform({parts}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&')"
    return f"({scheme} || '://' || {netloc} || ({tidy}) || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END)"


# --- phones ---


@query(
    rf"""WITH {PARSED}, k AS (SELECT *, coalesce(e164, normalized, 'raw:' || raw_phone) || '|' || coalesce(extension, '') AS key FROM q)
SELECT key, max(e164) AS e164_phone, max(normalized) AS normalized_phone, max(validation_status) AS validation_status, count(*) AS occurrence_count, count(DISTINCT doc_id) AS document_count, min(doc_id) AS first_doc FROM k GROUP BY key"""
)
def phone_inventory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which numbers do the documents publish, how often, and in how many of them? Native from scan to result."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(phone.candidates(F.col("text"))).alias("raw_phone"))
    rows = rows.withColumn("p", phone.parsed(F.col("raw_phone")))
    key = phone.dedupe_key(F.col("p.e164"), F.col("p.normalized"), F.col("p.extension"), F.trim("raw_phone")).alias("key")
    return rows.groupBy(key).agg(
        F.max("p.e164").alias("e164_phone"), F.max("p.normalized").alias("normalized_phone"), F.max("p.validation_status").alias("validation_status"),
        F.count(F.lit(1)).alias("occurrence_count"), F.count_distinct("doc_id").alias("document_count"), F.min("doc_id").alias("first_doc"),
    )


@query(CANDIDATES)
def phone_candidates_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(phone.candidates(F.col("text"))).alias("raw_phone"))


@query(f"SELECT page_id, unnest(regexp_extract_all(html, '{BOUNDED}', 1)) AS raw_phone FROM pages")
def phone_candidates_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(phone.candidates(F.col("html"))).alias("raw_phone"))


@query(rf"WITH {PARSED} SELECT doc_id, raw_phone, extension, validation_status, e164, national, normalized, CASE WHEN e164 IS NOT NULL THEN 1 END AS country_code FROM q")
def phone_status_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(phone.candidates(F.col("text"))).alias("raw_phone"))
    rows = rows.withColumn("p", phone.parsed(F.col("raw_phone")))
    return rows.select("doc_id", F.trim("raw_phone").alias("raw_phone"), *(F.col(f"p.{c}").alias(c) for c in ("extension", "validation_status", "e164", "national", "normalized", "country_code")))


LINE = "CAST(2000000 + c_custkey * 7 % 7000000 AS VARCHAR)"


@query(
    f"""WITH t AS (SELECT c_custkey AS k, c_custkey % 6 AS m, {LINE} AS n FROM customer)
SELECT k, CASE m WHEN 0 THEN 'tel:+1415' || n || ';ext=' || k % 1000 WHEN 1 THEN 'TEL:415-' || substr(n, 1, 3) || '-' || substr(n, 4) WHEN 2 THEN 'tel:(415)%20' || substr(n, 1, 3) || '-' || substr(n, 4) || ',' || k % 100 WHEN 3 THEN 'tel:911' WHEN 4 THEN 'tel:+44 20 ' || n || '9' ELSE 'tel:' || n END AS href,
  CASE m WHEN 3 THEN NULL WHEN 4 THEN '+4420' || n || '9' WHEN 5 THEN '+1' || n ELSE '+1415' || n END AS e164, CASE m WHEN 0 THEN CAST(k % 1000 AS VARCHAR) WHEN 2 THEN CAST(k % 100 AS VARCHAR) END AS extension,
  CASE m WHEN 3 THEN 'INVALID' WHEN 4 THEN 'POSSIBLE' WHEN 5 THEN 'POSSIBLE' ELSE 'VALID' END AS validation_status FROM t"""
)
def tel_links_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link for each customer, in six forms."""
    k, n = F.col("c_custkey"), (F.lit(2000000) + F.col("c_custkey") * 7 % 7000000).cast("string")
    dashed = F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 4))
    forms = [F.concat(F.lit("tel:+1415"), n, F.lit(";ext="), k % 1000), F.concat(F.lit("TEL:415-"), dashed), F.concat(F.lit("tel:(415)%20"), dashed, F.lit(","), k % 100), F.lit("tel:911"), F.concat(F.lit("tel:+44 20 "), n, F.lit("9")), F.concat(F.lit("tel:"), n)]
    href = F.lit(None).cast("string")
    for m, form in enumerate(forms):
        href = F.when(k % 6 == m, form).otherwise(href)
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), href.alias("href"))
    number, ext = phone.tel_href(F.col("href"))
    rows = rows.withColumn("p", phone.parsed(number, F.coalesce(ext, F.lit(""))))
    return rows.select("k", "href", F.col("p.e164").alias("e164"), F.col("p.extension").alias("extension"), F.col("p.validation_status").alias("validation_status"))


@query(
    rf"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)((?:^|.{{0,40}}[^\p{{L}}\p{{N}}_])(?:{NUMBER}{TAIL})(?:$|[^\p{{L}}\p{{N}}_].{{0,39}}))', 1)) AS around FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM c WHERE regexp_matches(around, '{HINTED}') GROUP BY doc_id"""
)
def phone_hint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with candidates near a word that tells against them; each candidate has a window of its own, across lines."""
    rows = text_candidates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    start = F.greatest(F.col("c.start") - phone.HINT_RADIUS, F.lit(0))
    around = F.substring("text", start + 1, F.col("c.end") + phone.HINT_RADIUS - start)
    return rows.where(around.rlike(f"(?iU){phone.HINTS}")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def occurrences_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with offsets and context; Python sees texts with digits alone."""
    return document_occurrences(table(spark, sf_dir, "documents")).drop("seq", "crawl_timestamp")


@query()
def unique_phones_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = inventory.classify(inventory.unique_phones(document_occurrences(table(spark, sf_dir, "documents"))))
    lists = ("source_urls", "source_types", "page_titles", "sample_contexts", "nearest_headings")
    return got.select(*(join_list(F.col(c)).alias(c) if c in lists else c for c in got.columns if c not in ("seq", "notes")))


@query(
    f"""WITH t AS (SELECT c_custkey AS k, c_name, {LINE} AS n FROM customer)
SELECT k, '+1 (415) ' || substr(n, 1, 3) || '.' || substr(n, 4) AS raw, length(c_name) + 7 AS start, length(c_name) + 7 + 17 AS stop, '+1415' || n AS e164, CAST(k % 900 + 1 AS VARCHAR) AS extension, 'VALID' AS status FROM t
UNION ALL SELECT k, '+49 30 ' || n, length(c_name) + 7 + 17 + length(' x' || (k % 900 + 1)) + 4, length(c_name) + 7 + 17 + length(' x' || (k % 900 + 1)) + 4 + 14, '+4930' || n, NULL, 'POSSIBLE' FROM t WHERE k % 2 = 0
UNION ALL SELECT k, '415-000-' || substr(n, 4), length(c_name) + 7 + 17 + length(' x' || (k % 900 + 1)) + 4, length(c_name) + 7 + 17 + length(' x' || (k % 900 + 1)) + 4 + 12, '+1415000' || substr(n, 4), NULL, 'POSSIBLE' FROM t WHERE k % 2 = 1"""
)
def phone_scan_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a foreign country code, and North American ones that don't overlap them, by place in a text for each customer."""
    k, n = F.col("c_custkey"), (F.lit(2000000) + F.col("c_custkey") * 7 % 7000000).cast("string")
    second = F.when(k % 2 == 0, F.concat(F.lit("+49 30 "), n)).otherwise(F.concat(F.lit("415-000-"), F.substring(n, 4, 4)))
    text = F.concat(F.col("c_name"), F.lit(" tel.: "), F.lit("+1 (415) "), F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 4), F.lit(" x"), k % 900 + 1, F.lit(" or "), second, F.lit(" today"))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.explode(scan_phones(text)).alias("c"))
    raw = F.regexp_replace("c.raw", r" x\d+$", "")
    return rows.select("k", raw.alias("raw"), F.col("c.start").cast("long").alias("start"), (F.col("c.start") + F.char_length(raw)).cast("long").alias("stop"), F.col("c.e164").alias("e164"), F.col("c.extension").alias("extension"), F.col("c.validation_status").alias("status"))


# --- URLs ---


@query(f"SELECT page_id, {normalized('url')} AS normalized_url FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("normalized_url"))


@query(
    "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) = 'blog.tionsh.example.net' AS internal, "
    "regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '(^|\\.)example\\.net$') AS related FROM pages"
)
def url_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, wide = Scope.of("https://blog.tionsh.example.net/"), Scope.of("https://blog.tionsh.example.net/", allow_subdomains=True)
    return table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"), narrow.internal(F.col("url")).alias("internal"), wide.internal(F.col("url")).alias("related"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '(?i){'|'.join(f'(?:{p})' for p in EXCLUDE_PATTERNS)}') THEN 'exclude_pattern' WHEN NOT regexp_matches(url, '(?i)/en/|/de/') THEN 'include_pattern' END AS reason FROM pages")
def url_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", skip_reason(F.col("url"), include=("/en/", "/de/")).alias("reason"))


@query(f"SELECT normalized_url, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, {normalized('url')} AS normalized_url FROM pages) GROUP BY normalized_url")
def url_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("normalized_url"))
    return rows.groupBy("normalized_url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


HREFS = ("../contact/", "c?y=2#z", "/root/./x", "//other.test/p", "?q=1", "mailto:x@y")


@query(
    """WITH t AS (SELECT page_id, 'https://site.test/a/' || page_id || '/b?x=1' AS base, page_id % 6 AS m FROM pages)
SELECT page_id, CASE m WHEN 0 THEN 'https://site.test/a/contact/' WHEN 1 THEN 'https://site.test/a/' || page_id || '/c?y=2#z' WHEN 2 THEN 'https://site.test/root/x' WHEN 3 THEN 'https://other.test/p' WHEN 4 THEN 'https://site.test/a/' || page_id || '/b?q=1' ELSE 'mailto:x@y' END AS url FROM t"""
)
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of references from a page of its own for each row."""
    href = F.element_at(F.array(*map(F.lit, HREFS)), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", resolve(F.concat(F.lit("https://site.test/a/"), F.col("page_id"), F.lit("/b?x=1")), href).alias("url"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(?:[^?#]*/)?([^?#/]*)', 1), ''), 'document.pdf') AS file_name, "
       "regexp_matches(lower(url), '^[^?#]*\\.pdf([?#]|$)') AS pdf, url AS with_scheme FROM pages")  # fmt: skip
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", path(u).alias("path"), file_name(u).alias("file_name"), looks_like_pdf(u).alias("pdf"), ensure_scheme(u).alias("with_scheme"))


# --- pages ---


@query(f"SELECT page_id, nullif({as_text(f'''regexp_extract({STRIPPED}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)''')}, '') AS title, nullif({as_text(f'''regexp_extract({STRIPPED}, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)''')}, '') AS h1 FROM pages")
def page_title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.h1(F.col("html")).alias("h1"))


@query(
    f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all({STRIPPED}, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]\\s*>', 1), lambda x: {as_text('x')}), lambda x: x <> ''), ' | ') AS headings FROM pages"
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(H.headings(F.col("html")), " | ").alias("headings"))


@query(f"SELECT page_id, {as_text(STRIPPED)} AS text FROM pages")
def page_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


def _region(tag: str) -> str:
    return f"array_to_string(list_filter(list_transform(regexp_extract_all({STRIPPED}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), lambda x: {as_text('x')}), lambda x: x <> ''), ' ')"


@query(f"SELECT page_id, {_region('nav')} AS nav, {_region('footer')} AS footer, {_region('header')} AS header FROM pages")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(H.region(F.col("html"), t).alias(t) for t in ("nav", "footer", "header")))


LINKS = f"""l AS (SELECT page_id, url, unnest(regexp_extract_all({STRIPPED}, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*"([^"]*)"', 1)) AS href FROM pages),
f AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS full_url FROM l WHERE href LIKE '/%'),
k AS (SELECT DISTINCT page_id, url, {normalized('full_url')} AS link FROM f)"""


@query(f"WITH {LINKS} SELECT url, link, regexp_matches(lower(link), '\\.pdf(\\?|$)') AS pdf FROM (SELECT DISTINCT url, link FROM k)")
def page_link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(table(spark, sf_dir, "pages")).select("url", "link", (F.col("kind") == "PDF").alias("pdf"))


@query(f"WITH {LINKS} SELECT host, count(*) AS links, count(DISTINCT link) AS targets FROM (SELECT DISTINCT url, link, regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) AS host FROM k) GROUP BY host")
def link_targets_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(table(spark, sf_dir, "pages")).groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("targets"))


@query(f"SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN length(text) > 0 AND length(text) < 250 THEN 'thin_content' END AS render_reason FROM (SELECT page_id, {as_text(STRIPPED)} AS text FROM pages)")
def spa_render_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length(H.visible_text(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n_chars"), H.render_reason(H.spa_signals(F.col("html")), n).alias("render_reason"))


# --- coverage ---

S = f"""s0 AS (SELECT url, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS lastmod, page_id AS seq FROM pages WHERE page_id % 3 <> 0),
s1 AS (SELECT * FROM s0 UNION ALL SELECT url, '2030-01-01', seq + 1000000000 FROM s0 WHERE seq % 10 = 1),
s AS (SELECT k, arg_min(url, seq) AS url, arg_min(lastmod, seq) AS lastmod FROM (SELECT *, {normalized('url')} AS k FROM s1) GROUP BY k)"""
STATUS = cases([("page_id % 11 = 0", "'FAILED_HTTP'"), ("page_id % 11 = 1", "'SKIPPED_EXTERNAL_REDIRECT'"), ("page_id % 11 = 2", "'FAILED_TIMEOUT'"), ("page_id % 11 = 3", "'RENDER_UNAVAILABLE'"), ("page_id % 11 = 4", "'SKIPPED_CONTENT_TYPE'"), ("page_id % 11 = 5", "'PDF_TEXT_UNAVAILABLE'")], "'SUCCESS'")
P = f"""p0 AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS final_url, {normalized('url')} AS k, CASE WHEN page_id % 11 = 5 THEN 'PDF' ELSE 'HTML' END AS kind, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN page_id % 2 = 0 THEN 'html_link' ELSE 'sitemap' END AS source, {STATUS} AS status, CASE WHEN page_id % 11 = 0 THEN 'HTTP 404' WHEN page_id % 11 = 2 THEN '' END AS error, CASE WHEN page_id % 11 = 2 THEN 'slow' END AS notes FROM pages WHERE page_id % 5 <> 1),
p AS (SELECT * FROM p0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id % 100 DESC, page_id DESC) = 1)"""
E = f"""e0 AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'SKIPPED_PATTERN' WHEN page_id % 3 = 0 THEN 'SKIPPED_EXTERNAL_REDIRECT' ELSE 'SUCCESS' END AS status, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'exclude_pattern' END AS detail, {normalized('url')} AS k FROM pages WHERE page_id % 7 = 2),
e AS (SELECT * FROM e0 WHERE status <> 'SUCCESS' QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1)"""
I = f"""{S}, {P}, {E}, i AS (SELECT
  CASE WHEN p.k IS NOT NULL THEN p.url WHEN e.k IS NOT NULL THEN e.url ELSE s.url END AS url, k AS normalized_url, p.final_url,
  CASE WHEN p.status IN ('SUCCESS', 'PDF_TEXT_UNAVAILABLE') THEN CASE WHEN s.url IS NOT NULL THEN 'SITEMAP_AND_CRAWLED' ELSE 'CRAWLED_NOT_IN_SITEMAP' END WHEN p.status = 'SKIPPED_EXTERNAL_REDIRECT' THEN 'REDIRECTED' WHEN p.status = 'SKIPPED_CONTENT_TYPE' THEN 'EXCLUDED'
    WHEN p.k IS NOT NULL THEN 'DISCOVERED_BUT_FAILED' WHEN e.status = 'SKIPPED_EXTERNAL_REDIRECT' THEN 'REDIRECTED' WHEN e.k IS NOT NULL THEN 'EXCLUDED' ELSE 'SITEMAP_NOT_CRAWLED' END AS coverage_status,
  CASE WHEN p.k IS NOT NULL THEN p.source WHEN e.k IS NOT NULL THEN coalesce(nullif(e.detail, ''), 'event') ELSE 'sitemap' END AS discovery_source, s.url IS NOT NULL AS in_sitemap,
  coalesce(p.status IN ('SUCCESS', 'PDF_TEXT_UNAVAILABLE'), false) AS crawled, p.http_status, CASE WHEN p.k IS NOT NULL THEN p.status ELSE e.status END AS page_status, s.lastmod, CASE WHEN p.k IS NOT NULL THEN p.error ELSE e.detail END AS error, p.kind
  FROM s FULL OUTER JOIN p USING (k) FULL OUTER JOIN e USING (k))"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return coverage.url_inventory(synthetic.page_records(pages), synthetic.sitemap_urls(pages), synthetic.events(pages))


@query(f"WITH {I} SELECT * REPLACE (CAST(http_status AS VARCHAR) AS http_status) FROM i")
def url_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).drop("referring_url").withColumn("http_status", F.col("http_status").cast("string"))


@query(f"WITH {I} SELECT coverage_status AS value, count(*) AS n FROM i GROUP BY ALL")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.counts(_inventory(spark, sf_dir), "coverage_status")


@query(f"WITH {P} SELECT status AS value, count(*) AS n FROM p0 GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.counts(synthetic.page_records(table(spark, sf_dir, "pages")), "status")


@query(f"WITH {P} SELECT url, final_url, status, http_status, coalesce(nullif(error, ''), notes) AS error, kind FROM p0 WHERE status LIKE 'FAILED%' OR status = 'PDF_TEXT_UNAVAILABLE'")
def crawl_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.errors(synthetic.page_records(table(spark, sf_dir, "pages"))).drop("crawl_timestamp")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_occurrences(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {I}, {PARSED}, o AS (SELECT *, coalesce(e164, normalized, 'raw:' || raw_phone) || '|' || coalesce(extension, '') AS key FROM q),
u AS (SELECT key, max(validation_status) AS v FROM o GROUP BY key), m AS (
SELECT 0 AS ord, 'Domain' AS metric, 'example.net' AS value UNION ALL SELECT 1, 'Start URL', 'https://example.net/' UNION ALL SELECT 2, 'Crawl start time', '' UNION ALL SELECT 3, 'Crawl completion time', ''
UNION ALL SELECT 4, 'URLs discovered', CAST(count(*) AS VARCHAR) FROM i UNION ALL SELECT 5, 'URLs crawled', CAST(count(*) FILTER (status IN ('SUCCESS', 'PDF_TEXT_UNAVAILABLE')) AS VARCHAR) FROM p0
UNION ALL SELECT 6, 'URLs from sitemap', CAST(count(*) AS VARCHAR) FROM s1 UNION ALL SELECT 7, 'HTML pages processed', CAST(count(*) FILTER (kind = 'HTML' AND status = 'SUCCESS') AS VARCHAR) FROM p0
UNION ALL SELECT 8, 'JavaScript-rendered pages', CAST(count(*) FILTER (page_id % 13 = 0) AS VARCHAR) FROM p0 UNION ALL SELECT 9, 'PDFs processed', CAST(count(*) FILTER (kind = 'PDF') AS VARCHAR) FROM p0
UNION ALL SELECT 10, 'Unique phone numbers', CAST(count(*) AS VARCHAR) FROM u UNION ALL SELECT 11, 'Total phone occurrences', CAST(count(*) AS VARCHAR) FROM o
UNION ALL SELECT 12, 'Valid phone numbers', CAST(count(*) FILTER (v = 'VALID') AS VARCHAR) FROM u UNION ALL SELECT 13, 'Possible phone numbers', CAST(count(*) FILTER (v = 'POSSIBLE') AS VARCHAR) FROM u
UNION ALL SELECT 14, 'Invalid candidates', CAST(count(*) FILTER (v = 'INVALID') AS VARCHAR) FROM u UNION ALL SELECT 15, 'Pages containing phone numbers', CAST(count(DISTINCT doc_id) AS VARCHAR) FROM o
UNION ALL SELECT 16, 'PDFs containing phone numbers', '0' UNION ALL SELECT 17, 'Failed URLs', CAST(count(*) FILTER (status LIKE 'FAILED%') AS VARCHAR) FROM p0 UNION ALL SELECT 18, 'Excluded URLs', CAST(count(*) FILTER (coverage_status = 'EXCLUDED') AS VARCHAR) FROM i)
SELECT * FROM m UNION ALL SELECT CAST(18 + row_number() OVER (ORDER BY coverage_status) AS INTEGER), 'Coverage ' || coverage_status, CAST(n AS VARCHAR) FROM (SELECT coverage_status, count(*) AS n FROM i GROUP BY ALL)"""
)
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = _occurrences(spark, sf_dir)
    return coverage.summary("example.net", "https://example.net/", None, None, synthetic.page_records(pages), inventory.unique_phones(found), found, _inventory(spark, sf_dir), synthetic.sitemap_urls(pages))


@query(
    f"""WITH {I}, {PARSED}, o AS (SELECT * FROM q) SELECT 'status_counts' AS counter, status AS value, count(*) AS n FROM p0 GROUP BY ALL UNION ALL SELECT 'validation_counts', validation_status, count(*) FROM o GROUP BY ALL
UNION ALL SELECT 'source_type_counts', 'HTML', count(*) FROM o HAVING count(*) > 0 UNION ALL SELECT 'page_kind_counts', kind, count(*) FROM p0 GROUP BY ALL UNION ALL SELECT 'coverage_counts', coverage_status, count(*) FROM i GROUP BY ALL"""
)
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.report_counts(synthetic.page_records(table(spark, sf_dir, "pages")), _occurrences(spark, sf_dir), _inventory(spark, sf_dir))


# --- windows, top lists, best rows ---


@query(f"SELECT k AS normalized_url, page_id AS seq FROM (SELECT page_id, {normalized('url')} AS k FROM pages) QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id % 100 DESC, page_id DESC) = 1")
def url_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(normalize_url(F.col("url")).alias("normalized_url"), F.col("page_id").alias("seq"), (F.col("page_id") % 100).alias("at"))
    return coverage.keep_one(rows, "normalized_url", F.desc("at"), F.desc("seq")).drop("at")


def _top(order: str) -> str:
    return rf"""WITH {PARSED}, u AS (SELECT coalesce(e164, normalized, 'raw:' || raw_phone) || '|' || coalesce(extension, '') AS key, max(e164) AS e164_phone, max(normalized) AS normalized_phone, count(*) AS occurrence_count, count(DISTINCT doc_id) AS unique_url_count FROM q GROUP BY key)
SELECT CAST(row_number() OVER (ORDER BY {order} DESC, coalesce(e164_phone, ''), occurrence_count DESC, coalesce(normalized_phone, ''), key) AS INTEGER) AS rank, e164_phone, normalized_phone, occurrence_count, unique_url_count FROM u ORDER BY rank LIMIT 15"""


@query(_top("occurrence_count"))
def top_phones_by_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.top_phones(inventory.unique_phones(_occurrences(spark, sf_dir)))


@query(_top("unique_url_count"))
def top_phones_by_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.top_phones(inventory.unique_phones(_occurrences(spark, sf_dir)), "unique_url_count")


@query(
    """SELECT l_orderkey, max_by(l_linenumber, rk) AS l_linenumber, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END, l_extendedprice, -l_linenumber) AS rk FROM lineitem) GROUP BY l_orderkey"""
)
def best_row_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a group that is best by several columns, the first at ties: one pass with partial aggregation."""
    rank = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct(rank, F.col("l_extendedprice"), -F.col("l_linenumber"))).alias("l_linenumber"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_custkey, array_to_string(list_slice(list(p ORDER BY first), 1, 3), ' | ') AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey"""
)
def ordered_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("seq", F.col("o_orderkey"))
    got = inventory.ordered_list(rows, ["o_custkey"], F.col("o_orderpriority"), "p", 3)
    return got.select("o_custkey", join_list(F.col("p")).alias("priorities"))


@query("SELECT page_id, kind FROM (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'PDF' ELSE 'HTML' END AS kind FROM pages) QUALIFY kind = 'HTML' AND row_number() OVER (PARTITION BY kind ORDER BY page_id) <= 100 OR kind = 'PDF' AND row_number() OVER (PARTITION BY kind ORDER BY page_id) <= 20")
def frontier_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caps of a run, which are the feature: the first pages and PDFs in order."""
    items = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 6 == 0, "PDF").otherwise("HTML").alias("kind"), F.col("page_id").alias("seq"))
    return frontier.capped(items, {}, CrawlConfig("https://x.test", max_pages=100, max_pdfs=20)).select("page_id", "kind")


# --- joins ---

SIDES = rf"""WITH {PARSED}, o AS (SELECT doc_id, raw_phone, coalesce(e164, normalized, 'raw:' || raw_phone) || '|' || coalesce(extension, '') AS key FROM q),
st AS (SELECT DISTINCT key FROM o WHERE doc_id % 3 <> 0), re AS (SELECT DISTINCT key FROM o WHERE doc_id % 3 <> 1)"""


@query(SIDES + " SELECT key, st.key IS NOT NULL AND re.key IS NOT NULL AS js_confirmed, CASE WHEN st.key IS NULL THEN 'JAVASCRIPT_RENDERED' ELSE 'HTML' END AS source_type FROM st FULL OUTER JOIN re USING (key)")
def reconcile_static_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the documents as one page before its scripts ran, and two thirds as the same page after."""
    page = _occurrences(spark, sf_dir).withColumn("source_url", F.lit("https://x.test/")).withColumn("n", F.col("seq.a"))
    got = reconcile(page.where("n % 3 <> 0").drop("n"), page.where("n % 3 <> 1").drop("n"))
    key = phone.dedupe_key(F.col("e164_phone"), F.col("normalized_phone"), F.col("extension"), F.col("raw_phone"))
    return got.select(key.alias("key"), "js_confirmed", "source_type")


@query(f"WITH k AS (SELECT page_id, {normalized('url')} AS normalized_url FROM pages) SELECT normalized_url, min(page_id) AS page_id FROM k WHERE normalized_url NOT IN (SELECT normalized_url FROM k WHERE page_id % 4 = 0) GROUP BY ALL")
def frontier_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("normalized_url"))
    new = rows.join(rows.where("page_id % 4 = 0").select("normalized_url"), "normalized_url", "left_anti")
    return new.groupBy("normalized_url").agg(F.min("page_id").alias("page_id"))


@query(
    f"WITH {LINKS}, n AS (SELECT page_id, {normalized('url')} AS node FROM pages) SELECT link AS normalized_url, count(DISTINCT url) AS referrers, CASE WHEN regexp_matches(link, '(?i){'|'.join(f'(?:{p})' for p in EXCLUDE_PATTERNS)}') THEN 'SKIPPED_PATTERN' END AS skip_status "
    "FROM k WHERE link NOT IN (SELECT node FROM n) GROUP BY link"
)
def frontier_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages link to, less what they are."""
    pages = table(spark, sf_dir, "pages")
    found = page_links(pages).groupBy(F.col("link").alias("normalized_url")).agg(F.count_distinct("url").alias("referrers")).withColumn("depth", F.lit(1))
    fresh = found.join(pages.select(normalize_url(F.col("url")).alias("normalized_url")), "normalized_url", "left_anti")
    return frontier.admit(fresh, CrawlConfig("https://x.test")).select("normalized_url", "referrers", "skip_status")


@query(
    """WITH RECURSIVE edges AS (SELECT c_custkey AS src, c_custkey * 2 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey * 3 FROM customer), n AS (SELECT max(c_custkey) AS top FROM customer),
r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = node, n WHERE depth < 6 AND dst <= top) SELECT node, min(depth) AS depth FROM r GROUP BY node"""
)
def crawl_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph over customers, followed from the first to depth 6."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    top = c.agg(F.max("c_custkey").alias("top"))
    edges = c.select(F.col("c_custkey").alias("src"), F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 3)).alias("dst"))
    edges = edges.crossJoin(F.broadcast(top)).where("dst <= top").drop("top")  # one row
    return frontier.expand(spark.createDataFrame([(1,)], "node long"), edges, 6)


@query("SELECT c_custkey, n_name, CASE WHEN c_custkey % 3 = 0 THEN 'running' WHEN c_custkey % 2 = 0 THEN 'complete' ELSE 'interrupted' END AS run_status FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 3 = 0")
def run_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, of which every third is live."""
    c = table(spark, sf_dir, "customer")
    runs = c.select(F.col("c_custkey").cast("string").alias("output_dir"), F.col("c_custkey").alias("mtime"), (F.col("c_custkey") % 2 == 0).alias("has_inventory"), F.lit(True).alias("has_state"))
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows
    jobs = c.where("c_custkey % 3 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("output_dir"), F.col("n_name").alias("id"), F.lit("running").alias("status"), F.lit("").alias("start_url"))
    return feeds.run_catalogue(runs, jobs).select(F.col("mtime").alias("c_custkey"), F.col("id").alias("n_name"), "run_status")


# --- classification ---

CONTEXTS = ["Contact the Office of Admissions at", "Emergency library line", "cooperator phone", "Fax and phone of the registrar", "nothing here", "Help Desk (IT support)", "school of music", "human resources facsimile", "call the main office", "Professor Smith"]


@query(
    "WITH t(context) AS (VALUES " + ", ".join(f"('{c}')" for c in CONTEXTS) + ") SELECT context, " + cases([(" OR ".join(f"contains(lower(context), '{w}')" for w in words), f"'{label}'") for label, words in inventory.RULES], "'Unknown'")
    + r" AS category, CASE WHEN regexp_matches(context, '(?i)\bfax(es|imile)?\b') THEN 'FAX' WHEN regexp_matches(context, '(?i)\b(voice|phone|tel|telephone|call|office line)\b') THEN 'VOICE' ELSE 'UNKNOWN' END AS number_kind FROM t"
)
def classify_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in CONTEXTS], "context string")
    low = F.lower("context")
    return rows.select("context", F.coalesce(inventory.label_of(low), F.lit("Unknown")).alias("category"), inventory.kind_of(low).alias("number_kind"))


@query(
    "SELECT doc_id, " + cases([(" OR ".join(f"contains(lower(text), '{w}')" for w in words), f"'{label}'") for label, words in inventory.RULES], "NULL") + " AS category, length(text) AS n_chars FROM documents"
)
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", inventory.label_of(F.lower("text")).alias("category"), F.char_length("text").cast("long").alias("n_chars"))


# --- sources ---


@query(
    "SELECT 'https://site.test/sitemap-' || page_id % 4 || '.xml' AS sitemap_source, 'page' AS kind, url, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod FROM pages"
)
def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap files written from the pages' URLs, every other one compressed, and read again."""
    esc = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.concat(F.lit("<lastmod>2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod>"))
    entry = F.concat(F.lit("<url><loc> "), esc, F.lit("</loc>"), F.when(F.col("page_id") % 2 == 0, day).otherwise(""), F.lit("</url>"))
    name = F.concat(F.lit("https://site.test/sitemap-"), F.col("page_id") % 4, F.lit(".xml"))
    return feeds.read_sitemaps(_sitemap_files(table(spark, sf_dir, "pages").select(name.alias("sitemap_url"), entry.alias("entry"))))


#: Entries of a written sitemap file; a file of the format holds 50,000 at most.
ENTRIES = 5000


def _sitemap_files(entries: DataFrame) -> DataFrame:
    """(sitemap_url, entry) to (sitemap_url, content): files of at most some thousand entries each, the names of which may repeat; every other one is compressed."""
    part = F.pmod(F.xxhash64("entry"), F.greatest(F.lit(1), F.ceil(F.col("n") / ENTRIES)))
    sizes = entries.groupBy("sitemap_url").agg(F.count(F.lit(1)).alias("n"))
    files = entries.join(sizes, "sitemap_url").groupBy("sitemap_url", part.alias("part")).agg(F.concat_ws("", F.collect_list("entry")).alias("x"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("x"), F.lit("</urlset>"))

    @F.pandas_udf("binary")
    def packed(content: pd.Series, pack: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(c.encode()) if p else c.encode() for c, p in zip(content, pack, strict=True)], dtype=object)

    return files.select("sitemap_url", packed(xml, F.pmod(F.xxhash64("x"), F.lit(2)) == 0).alias("content"))


ROBOTS = "User-agent: *\nAllow: /en/\nDisallow: /de/  # not these\nCrawl-delay: 2\nSitemap: https://site.test/sitemap.xml\n"


@query("SELECT page_id, NOT regexp_matches(url, '^[a-z]+://[^/]*/de/') AS allowed FROM pages")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", feeds.Robots(ROBOTS).allowed(F.col("url"), "lodestar").alias("allowed"))


@query(
    """SELECT page_id, field, value FROM (SELECT page_id, unnest(['user-agent', 'disallow', 'crawl-delay', 'sitemap']) AS field, unnest(['*', '/private/' || page_id, CAST(page_id % 5 AS VARCHAR), 'https://site.test/' || page_id || '.xml']) AS value FROM pages)"""
)
def robots_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file for each page."""
    k = F.col("page_id")
    content = F.concat(F.lit("User-agent: *  # all\n# a comment: none\nDisallow:/private/"), k, F.lit("\r\n  Crawl-delay : "), k % 5, F.lit("\n\nSITEMAP: https://site.test/"), k, F.lit(".xml\nno field here"))
    files = table(spark, sf_dir, "pages").select(k.cast("string").alias("url"), content.alias("content"))
    return feeds.robots_lines(files).select(F.col("url").cast("long").alias("page_id"), "field", "value")


@query(
    """WITH t AS (SELECT doc_id, string_split(CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE text END, chr(10)) AS pages FROM documents)
SELECT CAST(doc_id AS VARCHAR) || '.pdf' AS filename, CAST(len(pages) AS INTEGER) AS page_count, len(list_filter(pages, lambda x: trim(x) <> '')) = 0 AS text_unavailable, CAST(unnest(generate_series(1, len(pages))) AS INTEGER) AS page_number, unnest(pages) AS text FROM t"""
)
def pdf_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF texts, a line as a page."""
    texts = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.split(F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("text")), "\n", -1).alias("pages"))
    return feeds.pdf_pages(texts)


@query(
    """SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'FAILED_TIMEOUT' WHEN page_id % 10 = 1 THEN 'SKIPPED_EXTERNAL_REDIRECT' WHEN page_id % 10 = 2 THEN 'FAILED_HTTP' WHEN page_id % 10 = 3 THEN 'SUCCESS' WHEN length(html) > 20000 THEN 'SKIPPED_TOO_LARGE' WHEN page_id % 10 = 4 THEN 'SKIPPED_CONTENT_TYPE' ELSE 'SUCCESS' END AS status,
  CASE WHEN page_id % 10 = 3 THEN 'PDF' ELSE 'HTML' END AS kind FROM (SELECT page_id, html FROM pages)"""
)
def response_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("page_id") % 10
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.lit("https://site.test/p").alias("url"), F.when(m == 1, "https://other.test/p").otherwise("https://site.test/p").alias("final_url"), F.when(m == 0, None).when(m == 2, 503).otherwise(200).alias("http_status"),
        F.when(m == 3, "application/pdf").when(m == 4, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"), F.when(m == 4, "png").otherwise(F.col("html")).alias("body"),
        F.when(m == 3, 0).otherwise(F.char_length("html")).alias("bytes"), F.when(m == 0, "FAILED_TIMEOUT").alias("fail_status"), F.lit(None).cast("string").alias("error"), F.lit("HTML").alias("kind"),
    )
    got = frontier.route(rows, Scope.of("https://site.test/"), CrawlConfig("https://site.test/", max_file_size=20_000))
    return got.select("page_id", "status", F.col("page_kind").alias("kind"))


@query(
    """SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE regexp_replace(substr(t, 1, 99), '[\\s\\p{Z}]+$', '') || '…' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM documents)"""
)
def text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), 100).alias("short"))


# --- a site of desks: a page for each customer ---

DESK = f"""desk AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, 'https://desk.test/' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS url, CAST(2000000 + (c_custkey // 2) * 7 % 7000000 AS VARCHAR) AS n, CAST(10 + (c_custkey // 2) % 90 AS VARCHAR) AS ext,
  CAST(3000000 + c_custkey * 11 % 6000000 AS VARCHAR) AS fax, CAST(4000000 + c_custkey * 13 % 5000000 AS VARCHAR) AS main, CASE WHEN c_custkey % 4 = 0 THEN 'Registrar of ' || c_mktsegment ELSE c_mktsegment END AS heading FROM customer),
o AS (SELECT k, url, 0 AS branch, 'TEL_LINK' AS method, 'HTML_TEL_LINK' AS source_type, '+1415' || n AS raw, '+1415' || n AS e164, '415-' || substr(n, 1, 3) || '-' || substr(n, 4) AS normalized, '(415) ' || substr(n, 1, 3) || '-' || substr(n, 4) AS national, ext, name || ' in ' || seg || ' call' AS context, heading, name || ' in ' || seg || ' call' AS container, 'Desk of ' || name AS title FROM desk
  UNION ALL SELECT k, url, 2, 'TEXT', 'HTML', '415-' || substr(fax, 1, 3) || '-' || substr(fax, 4), '+1415' || fax, '415-' || substr(fax, 1, 3) || '-' || substr(fax, 4), '(415) ' || substr(fax, 1, 3) || '-' || substr(fax, 4), NULL, 'The fax of this desk is 415-' || substr(fax, 1, 3) || '-' || substr(fax, 4), heading, NULL, 'Desk of ' || name FROM desk WHERE k % 3 = 1
  UNION ALL SELECT k, url, 1, 'SCHEMA', 'HTML_SCHEMA', '+1415' || main, '+1415' || main, '415-' || substr(main, 1, 3) || '-' || substr(main, 4), '(415) ' || substr(main, 1, 3) || '-' || substr(main, 4), NULL, 'Desk of ' || name || ' ' || heading || ' ' || name || ' in ' || seg || ' call' || CASE WHEN k % 5 = 0 THEN ' again' ELSE '' END, NULL, NULL, 'Desk of ' || name FROM desk WHERE k % 3 = 2)"""


def _desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a link, a fax in text or a number in markup; every fifth has its link twice, and two pages share each number."""
    k, name, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    line = lambda first, step, room: (F.lit(first) + step % room).cast("string")
    half = F.floor(k / 2)
    tel = F.concat(F.lit("tel:+1415"), line(2000000, half * 7, 7000000), F.lit(";ext="), half % 90 + 10)
    fax, main = line(3000000, k * 11, 6000000), line(4000000, k * 13, 5000000)
    heading = F.when(k % 4 == 0, F.concat(F.lit("Registrar of "), seg)).otherwise(seg)
    html = F.concat(
        F.lit("<!doctype html><html><head><title>Desk of "), name, F.lit('</title><link rel="stylesheet canonical" href="/desks/'), k, F.lit('">'),
        F.when(k % 3 == 2, F.concat(F.lit('<script type="application/ld+json">{"a": [{"telephone": "+1415'), main, F.lit('"}]}</script>'))).otherwise(""),
        F.lit("</head><body><h2>"), heading, F.lit('</h2><div class="staff-card"><p>'), name, F.lit(" in "), seg, F.lit('</p><a href="'), tel, F.lit('">call</a></div>'),
        F.when(k % 3 == 1, F.concat(F.lit("<p>The fax of this desk is 415-"), F.substring(fax, 1, 3), F.lit("-"), F.substring(fax, 4, 4), F.lit("</p>"))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit('<a href="'), tel, F.lit('">again</a>'))).otherwise(""), F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://desk.test/"), F.lpad(k.cast("string"), 9, "0"))
    none = F.lit(None)
    return table(spark, sf_dir, "customer").select(k.alias("k"), url.alias("url"), url.alias("final_url"), F.lit(200).alias("http_status"), none.cast("string").alias("referring_url"), none.cast("timestamp").alias("at"), F.lit(0).alias("depth"), html.alias("html"))


def _desk_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(html_occurrences(_desks(spark, sf_dir)), "desk-occurrences")


@query(f"WITH {DESK} SELECT url AS source_url, method AS extraction_method, source_type, raw AS raw_phone, e164 AS e164_phone, normalized AS normalized_phone, national AS national_format, ext AS extension, 'VALID' AS validation_status, context, heading AS nearest_heading, container AS nearest_container, title AS page_title FROM o")
def desk_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, markup and text of pages to rows of occurrences, with container and heading; each number once a page and method."""
    got = sinks.flat(_desk_occurrences(spark, sf_dir).drop("seq"))
    return got.select("source_url", "extraction_method", "source_type", "raw_phone", "e164_phone", "normalized_phone", "national_format", "extension", "validation_status", "context", "nearest_heading", "nearest_container", "page_title")


@query(f"WITH {DESK} SELECT k, 'Desk of ' || name AS title, heading AS headings, '/desks/' || k AS canonical, 'tel:+1415' || n || ';ext=' || ext AS first_tel, CAST(1 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS links, CASE WHEN k % 3 = 2 THEN '+1415' || main ELSE '' END AS marked FROM desk")
def desk_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages by their tree."""
    pages = _desks(spark, sf_dir)
    got = extract_pages(pages).withColumn("k", F.regexp_extract("url", r"(\d+)$", 1).cast("long"))
    return got.select("k", "title", join_list(F.col("headings")).alias("headings"), F.col("canonical_url").alias("canonical"), F.get("tel_links", F.lit(0))["href"].alias("first_tel"), F.size("hrefs").alias("links"), join_list(F.col("schema_phones")).alias("marked"))


@query(f"WITH {DESK} SELECT url, count(*) AS n, count(DISTINCT e164) AS numbers FROM o GROUP BY url")
def desk_phone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for each page."""
    return _desk_occurrences(spark, sf_dir).groupBy(F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("e164_phone").alias("numbers"))


@query(f"WITH {DESK} SELECT DISTINCT url AS source_url, e164 AS label, title AS page_title FROM o")
def desk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the progress lines of a page would announce: each number once."""
    return first_seen_labels(_desk_occurrences(spark, sf_dir)).drop("seq")


DESK_PHONES = f"""{DESK}, g AS (SELECT e164 || '|' || coalesce(ext, '') AS key, e164, normalized, ext, count(*) AS n, min(url) AS first_url, string_agg(url, ' | ' ORDER BY url) AS urls, count(DISTINCT url) AS unique_urls, min(source_type) AS source_types, string_agg(title, ' | ' ORDER BY url) AS titles,
  string_agg(context, ' | ' ORDER BY url) AS contexts, arg_min(context, url) AS first_context, coalesce(CASE WHEN min(heading) = max(heading) THEN min(heading) ELSE string_agg(heading, ' | ' ORDER BY url) END, '') AS headings FROM o GROUP BY ALL),
c AS (SELECT *, CASE WHEN contains(contexts || titles, '911') THEN 'Emergency' WHEN contains(lower(contexts || ' ' || headings), 'registrar') THEN 'Registrar' END AS label, label IS NOT NULL AS known, CASE WHEN regexp_matches(contexts, '\\bfax\\b') THEN 'FAX' WHEN regexp_matches(contexts, '\\bcall\\b') THEN 'VOICE' ELSE 'UNKNOWN' END AS number_kind FROM g)"""
DESK_ROWS = f"""WITH {DESK_PHONES} SELECT key, e164 AS e164_phone, normalized AS normalized_phone, ext AS extension, n AS occurrence_count, unique_urls AS unique_url_count, urls AS source_urls, source_types, titles AS page_titles, contexts AS sample_contexts, headings AS nearest_headings, first_url AS first_seen_url, number_kind,
  coalesce(label, 'Unknown') AS category, CASE WHEN known THEN 'RULES' ELSE 'UNCLASSIFIED' END AS classification_source, CASE WHEN known THEN 0.7 ELSE 0.2 END::DOUBLE AS classification_confidence,
  coalesce(label, 'Unknown') || ': ' || first_context AS departments_or_context FROM c"""


def _desk_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.classify(inventory.unique_phones(_desk_occurrences(spark, sf_dir)))


@query(DESK_ROWS)
def desk_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the inventory: numbers with ordered lists of where they stand, their kind, label and context."""
    got = sinks.flat(_desk_phones(spark, sf_dir))
    return got.select("key", "e164_phone", "normalized_phone", "extension", "occurrence_count", "unique_url_count", "source_urls", "source_types", "page_titles", "sample_contexts", "nearest_headings", "first_seen_url", "number_kind", "category", "classification_source", "classification_confidence", "departments_or_context")


@query(f"WITH {DESK_PHONES} SELECT key, CASE WHEN p <= 200 THEN 'Desk' ELSE coalesce(label, 'Unknown') END AS category, CASE WHEN p <= 200 THEN 'FAX' ELSE number_kind END AS number_kind, CASE WHEN p <= 200 THEN 'AI' WHEN known THEN 'RULES' ELSE 'UNCLASSIFIED' END AS classification_source FROM (SELECT *, CASE WHEN NOT known THEN row_number() OVER (PARTITION BY known ORDER BY n DESC, e164, first_url) END AS p FROM c)")
def desk_labels_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 numbers without a rule (a limit of the operator), labelled by a function in place of a service."""
    got = inventory.relabel(_desk_phones(spark, sf_dir), lambda prompt: {"classification": "Desk", "number_kind": "fax", "confidence": 0.9})
    return got.select("key", "category", "number_kind", "classification_source")


PAGE_TEXT = "repeat('before ', 30) || c_name || ' at 415-' || substr(n, 1, 3) || '-' || substr(n, 4) || ' ext. 7' || repeat(' behind', 30)"


@query(
    f"""WITH t AS (SELECT c_custkey, c_name, {LINE} AS n FROM customer), u AS (SELECT *, {PAGE_TEXT} AS text, 30 * 7 + length(c_name) + 4 AS pl FROM t)
SELECT c_custkey, CAST(c_custkey % 9 + 1 AS INTEGER) AS pdf_page_number, c_name || '.pdf' AS pdf_filename, '+1415' || n AS e164_phone, '7' AS extension, trim(regexp_replace(substr(text, pl - 149, 150 + 19 + 150), '\\s+', ' ', 'g')) AS context FROM u"""
)
def pdf_occurrence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers on pages of PDF texts, with the text around them."""
    n = (F.lit(2000000) + F.col("c_custkey") * 7 % 7000000).cast("string")
    text = F.concat(F.lit("before " * 30), F.col("c_name"), F.lit(" at 415-"), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 4), F.lit(" ext. 7"), F.lit(" behind" * 30))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"), F.concat("c_name", F.lit(".pdf")).alias("filename"), (F.col("c_custkey") % 9 + 1).cast("int").alias("page_number"), text.alias("text"))
    return pdf_occurrences(pages).select(F.col("source_url").cast("long").alias("c_custkey"), "pdf_page_number", "pdf_filename", "e164_phone", "extension", "context")


# --- occurrences in documents ---

#: Places by cutting the text at the matches: what lies in front of a match is the parts and matches before it.
PLACES = rf"""x AS (SELECT doc_id, text, regexp_split_to_array(text, '{BOUNDED}') AS p, regexp_extract_all(text, '{BOUNDED}', 0) AS m, regexp_extract_all(text, '{BOUNDED}', 1) AS r FROM documents WHERE regexp_matches(text, '{BOUNDED}')),
y AS (SELECT doc_id, text, unnest(generate_series(1, len(m))) AS i, p, m, r FROM x),
z AS (SELECT doc_id, text, r[i] AS raw, CAST(list_sum(list_transform(list_slice(p, 1, i), lambda v: length(v))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda v: length(v))), 0) + strpos(m[i], r[i]) - 1 AS BIGINT) AS a FROM y),
w AS (SELECT doc_id, text, trim(raw) AS raw, a, a + length(raw) AS b, regexp_extract(raw, '(?i)(?:ext(?:ension)?\.?|x)\s*\.?\s*(\d{{1,6}})\b', 1) AS x, regexp_replace(regexp_replace(raw, '(?is)(?:ext(?:ension)?\.?|x)\s*\.?\s*\d{{1,6}}.*$', ''), '\D', '', 'g') AS d,
  regexp_matches(substr(text, greatest(a - 40, 0) + 1, a + length(raw) + 40 - greatest(a - 40, 0)), '{HINTED}') AS hinted FROM z),
v AS (SELECT *, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN substr(d, 2) ELSE d END AS n FROM w),
found AS (SELECT doc_id, raw, a, NOT hinted AND length(n) = 10 AND regexp_matches(n, '^[2-9][0-8]\d[2-9]\d{{6}}$') AND NOT regexp_matches(n, '^(\d11|37|96)') AS valid, NOT hinted AND length(n) = 10 AS ten, n, nullif(x, '') AS own, regexp_extract(substr(text, b + 1, 24), '(?i)(?:ext(?:ension)?\.?|x)\s*\.?\s*(\d{{1,6}})\b', 1) AS tail, hinted,
  trim(regexp_replace(CASE WHEN a > 150 THEN '…' ELSE '' END || substr(text, greatest(a - 150, 0) + 1, least(b + 150, length(text)) - greatest(a - 150, 0)) || CASE WHEN b + 150 < length(text) THEN '…' ELSE '' END, '[\s\p{{Z}}]+', ' ', 'g')) AS context FROM v),
occ AS (SELECT doc_id, 'doc:' || doc_id AS source_url, a, raw AS raw_phone, context, CASE WHEN valid THEN 'VALID' WHEN ten THEN 'POSSIBLE' ELSE 'INVALID' END AS validation_status, CASE WHEN hinted THEN NULL WHEN valid THEN coalesce(own, nullif(tail, '')) ELSE own END AS extension,
  CASE WHEN ten THEN '+1' || n END AS e164_phone, CASE WHEN ten THEN '(' || substr(n, 1, 3) || ') ' || substr(n, 4, 3) || '-' || substr(n, 7) END AS national_format, CASE WHEN ten THEN substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7) END AS normalized_phone,
  CASE WHEN hinted THEN 'false_positive_hint' WHEN valid THEN NULL WHEN ten THEN 'possible_not_fully_valid' ELSE 'invalid_number' END AS notes FROM found)"""


@query(f"WITH {PLACES} SELECT source_url, a AS start, raw_phone, context, validation_status, extension, e164_phone, national_format, normalized_phone, notes, sha256(concat_ws(chr(10), source_url, 'TEXT', raw_phone, CAST(a AS VARCHAR), '-')) AS occurrence_id FROM occ")
def occurrence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents with their place, id, context and why they are in doubt."""
    got = document_occurrences(table(spark, sf_dir, "documents"))
    return got.select("source_url", F.col("seq.c").cast("long").alias("start"), "raw_phone", "context", "validation_status", "extension", "e164_phone", "national_format", "normalized_phone", "notes", "occurrence_id")


@query(
    f"""WITH {PLACES}, k AS (SELECT *, coalesce(e164_phone, normalized_phone, 'raw:' || raw_phone) || '|' || coalesce(extension, '') AS key FROM occ),
u AS (SELECT key, source_url, min({{'d': doc_id, 'a': a}}) AS s FROM k GROUP BY ALL), c AS (SELECT key, context, min({{'d': doc_id, 'a': a}}) AS s FROM k GROUP BY ALL)
SELECT key, max(e164_phone) AS e164_phone, count(*) AS occurrence_count, arg_min(source_url, {{'d': doc_id, 'a': a}}) AS first_seen_url, (SELECT string_agg(source_url, ' | ' ORDER BY s) FROM u WHERE u.key = k.key) AS source_urls,
  (SELECT array_to_string(list_slice(list(context ORDER BY s), 1, 8), ' | ') FROM c WHERE c.key = k.key) AS sample_contexts FROM k GROUP BY key"""
)
def unique_phone_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique numbers of documents with the ordered lists of their places and contexts."""
    got = inventory.unique_phones(document_occurrences(table(spark, sf_dir, "documents")))
    return got.select("key", "e164_phone", "occurrence_count", "first_seen_url", *(join_list(F.col(c)).alias(c) for c in ("source_urls", "sample_contexts")))


SPANS = "a AS (SELECT l_orderkey AS k, CAST(l_linenumber * 10 + l_quantity % 7 AS INTEGER) AS s, l_linenumber AS line, l_returnflag = 'R' AS matcher FROM lineitem), m AS (SELECT k, s, s + 12 AS e, line FROM a WHERE matcher), r AS (SELECT k, s, s + 12 AS e, line FROM a WHERE NOT matcher)"


@query(f"WITH {SPANS} SELECT k, line, 'matcher' AS source, s AS start, e AS stop FROM m UNION ALL SELECT k, line, 'pattern', s, e FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = r.k AND m.s < r.e AND m.e > r.s)")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one source, and those of another that overlap none of them, by order as by text."""
    start = (F.col("l_linenumber") * 10 + F.col("l_quantity") % 7).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), start.alias("start"), (start + 12).alias("end"), (F.col("l_returnflag") == "R").alias("matcher"))
    first, second = rows.where("matcher").drop("matcher"), rows.where("not matcher").drop("matcher")
    both = first.withColumn("source", F.lit("matcher")).unionByName(without_overlaps(second, first, "k").withColumn("source", F.lit("pattern")))
    return both.select("k", "line", "source", "start", F.col("end").alias("stop"))


# --- a crawl over tables ---

TREE = """RECURSIVE t AS (SELECT count(*) AS n FROM customer), r AS (SELECT CAST(0 AS BIGINT) AS k, 0 AS depth, CAST(NULL AS BIGINT) AS parent UNION ALL
  SELECT unnest([2 * k + 1, 2 * k + 2]), depth + 1, k FROM r, t WHERE k < n AND k % 7 <> 3 AND depth < 4)"""


def _crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as pages, each of which links to two others and to a page that is never fetched; every seventh isn't found."""
    k = F.col("c_custkey")
    at = lambda n: F.concat(F.lit("https://tree.test/p/"), n)
    body = F.concat(F.lit('<html><a href="/p/'), k * 2 + 1, F.lit('">l</a><a href="/p/'), k * 2 + 2, F.lit('#x">r</a><a href="/login">in</a></html>'))
    gone = k % 7 == 3
    log = table(spark, sf_dir, "customer").select(
        at(k).alias("url"), at(k).alias("final_url"), F.when(gone, 404).otherwise(200).alias("http_status"), F.lit("text/html").alias("content_type"), body.alias("body"), F.lit(1.0).alias("response_time_ms"),
        F.lit(None).cast("string").alias("fail_status"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"), F.octet_length(body).alias("bytes"),
    )
    config, scope = CrawlConfig("https://tree.test/p/0", max_depth=4), Scope.of("https://tree.test/p/0")
    return frontier.crawl(log, spark.createDataFrame([], "url string"), config, scope, lambda p: page_links(p, scope))


@query(f"WITH {TREE} SELECT 'https://tree.test/p/' || k AS url, depth, CASE WHEN k >= n THEN 'FAILED_NETWORK' WHEN k % 7 = 3 THEN 'FAILED_HTTP' ELSE 'SUCCESS' END AS status, 'https://tree.test/p/' || parent AS referring_url, CASE WHEN k = 0 THEN 'seed' ELSE 'html_link' END AS source, CASE WHEN k < n AND k % 7 = 3 THEN 'HTTP 404' END AS error FROM r, t")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a crawl to depth 4, a level at a time."""
    return _crawl(spark, sf_dir)[0].select(F.col("normalized_url").alias("url"), "depth", "status", "referring_url", "source", F.col("page_error").alias("error"))


@query(f"WITH {TREE} SELECT status, detail, count(*) AS n FROM (SELECT CASE WHEN depth < 4 THEN 'SKIPPED_PATTERN' ELSE 'SKIPPED_MAX_DEPTH' END AS status, CASE WHEN depth < 4 THEN 'exclude_pattern' ELSE 'max_depth' END AS detail, unnest(generate_series(1, CASE WHEN depth < 4 THEN 1 ELSE 3 END)) FROM r, t WHERE k < n AND k % 7 <> 3) GROUP BY ALL")
def crawl_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the crawl found and didn't schedule, by reason."""
    return _crawl(spark, sf_dir)[1].groupBy("status", "detail").agg(F.count(F.lit(1)).alias("n"))


# --- sitemaps as a site ---

SITE_URLS = "l AS (SELECT page_id, page_id % 4 AS f, CASE WHEN page_id % 3 = 0 THEN 'https://other.test/' || page_id WHEN page_id % 3 = 1 THEN 'https://site.test/p/' || page_id ELSE '/p/' || page_id END AS loc FROM pages), c AS (SELECT f, 'https://site.test/' || regexp_extract(loc, '(p/\\d+)$', 1) AS url FROM l WHERE page_id % 3 <> 0)"


def _site_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("page_id")
    loc = F.when(k % 3 == 0, F.concat(F.lit("https://other.test/"), k)).when(k % 3 == 1, F.concat(F.lit("https://site.test/p/"), k)).otherwise(F.concat(F.lit("/p/"), k))
    leaves = _sitemap_files(table(spark, sf_dir, "pages").select(F.concat(F.lit("https://site.test/sitemap-"), k % 4, F.lit(".xml")).alias("sitemap_url"), F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>")).alias("entry")))
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>/sitemap-{i}.xml</loc></sitemap>" for i in (0, 1, 2, 3, 9)) + "</sitemapindex>"
    files = stored(leaves, "sitemap-leaves").unionByName(spark.createDataFrame([("https://site.test/sitemap.xml", bytearray(index.encode()))], "sitemap_url string, content binary"))
    return feeds.discover_sitemaps(files, "https://site.test/", Scope.of("https://site.test/"), ["/news.xml"], max_urls=0)


@query(
    f"""WITH {SITE_URLS}, n AS (SELECT f, count(*) AS n FROM c GROUP BY f) SELECT sitemap_url, source, status, coalesce(n, 0) AS url_count, error, nested FROM (
  SELECT 'https://site.test/sitemap.xml' AS sitemap_url, 'seed' AS source, 'SUCCESS' AS status, NULL AS error, false AS nested, -1 AS f UNION ALL SELECT 'https://site.test/sitemap_index.xml', 'seed', 'FAILED', 'no file', false, -1 UNION ALL SELECT 'https://site.test/news.xml', 'seed', 'FAILED', 'no file', false, -1
  UNION ALL SELECT 'https://site.test/sitemap-' || f || '.xml', 'https://site.test/sitemap.xml', 'SUCCESS', NULL, true, f FROM (SELECT unnest([0, 1, 2, 3]) AS f) UNION ALL SELECT 'https://site.test/sitemap-9.xml', 'https://site.test/sitemap.xml', 'FAILED', 'no file', true, -1) LEFT JOIN n USING (f)"""
)
def sitemap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each sitemap, and how many URLs of the site it lists."""
    return _site_maps(spark, sf_dir)[0].drop("lastmod").distinct()


@query(f"WITH {SITE_URLS} SELECT url, 'https://site.test/sitemap-' || f || '.xml' AS sitemap_source FROM c")
def sitemap_site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's own URLs in its sitemaps, relative ones resolved."""
    return _site_maps(spark, sf_dir)[1].select("url", "sitemap_source").distinct()


# --- rules ---


@query(
    """WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN chr(10) || '  ' || lower(html) WHEN 2 THEN substr(html, 30) ELSE repeat(' ', 600) || html END AS body, CASE page_id % 5 WHEN 0 THEN 'text/HTML; charset=x' WHEN 1 THEN 'application/x-PDF' WHEN 2 THEN 'application/xml' WHEN 3 THEN 'image/png' END AS kind FROM pages)
SELECT page_id, page_id % 4 < 2 AS sniffed, page_id % 5 = 0 AS html, page_id % 5 = 1 AS pdf, page_id % 5 = 2 AS xml FROM t"""
)
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By content type, and by how the body begins."""
    k, html = F.col("page_id"), F.col("html")
    body = F.when(k % 4 == 0, html).when(k % 4 == 1, F.concat(F.lit("\n  "), F.lower(html))).when(k % 4 == 2, F.substring(html, 30, 1 << 30)).otherwise(F.concat(F.lit(" " * 600), html))
    kind = F.when(k % 5 == 0, "text/HTML; charset=x").when(k % 5 == 1, "application/x-PDF").when(k % 5 == 2, "application/xml").when(k % 5 == 3, "image/png")
    return table(spark, sf_dir, "pages").select("page_id", sniff_html(body).alias("sniffed"), is_html_type(kind).alias("html"), is_pdf_type(kind).alias("pdf"), is_xml_type(kind).alias("xml"))


@query("SELECT page_id, CASE WHEN contains(lower(url), '/fr/') OR contains(lower(url), '/en/(') OR regexp_matches(url, '[02468]$') THEN 'exclude_pattern' END AS reason FROM pages")
def url_own_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a run's own, of which one isn't valid and is taken literally."""
    return table(spark, sf_dir, "pages").select("page_id", skip_reason(F.col("url"), exclude=("/fr/", "/en/(", "[02468]$")).alias("reason"))


@query("SELECT page_id, regexp_extract(h, CASE WHEN page_id % 3 = 2 THEN '([^.]+\\.[^.]+)$' ELSE '([^.]+\\.[^.]+\\.[^.]+)$' END, 1) AS domain FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) || CASE page_id % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.edu.au' ELSE '' END AS h FROM pages)")
def url_registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of hosts, some of them under suffixes of two labels."""
    suffix = F.when(F.col("page_id") % 3 == 0, ".co.uk").when(F.col("page_id") % 3 == 1, ".edu.au").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", registrable_domain(F.concat(host(F.col("url")), suffix)).alias("domain"))


@query("SELECT page_id, '<' || 'é – ’ A & ' || CAST(page_id AS VARCHAR) || ' ' || chr(CAST(9312 + page_id % 20 AS INTEGER)) || '>' AS text FROM pages")
def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named and numeric references of a page's markup."""
    markup = F.concat(F.lit("<p>&lt;&eacute; &ndash; &#8217; &#x41; &amp; "), F.col("page_id"), F.lit(" &#"), F.lit(9312) + F.col("page_id") % 20, F.lit(";&gt;</p>"))
    return table(spark, sf_dir, "pages").select("page_id", H.to_text(markup).alias("text"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), 'build')")
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose JSON holds a text, in either case."""
    return filter_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "BUILD", 1 << 30)


# --- sinks, read back ---


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ts, event_type || ' | ' || user_id AS tags, coalesce(props, '') AS props FROM events")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to CSV and back: lists joined, times as ISO 8601, quotes kept."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.array("event_type", F.col("user_id").cast("string")).alias("tags"), "props")
    at = sinks.write_csv(rows, _scratch(spark, "events-csv"))
    return spark.read.option("header", True).option("escape", '"').csv(at).fillna("")


@query("SELECT event_id, user_id, event_type FROM events")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of an audit, written in two parts, and read again."""
    rows, at = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), _scratch(spark, "audit")
    half = F.pmod("event_id", F.lit(2)) == 0
    sinks.write_json(rows.where(half), at, append=True)
    sinks.write_json(rows.where(~half), at, append=True)
    return spark.read.schema(rows.schema).json(at)


@query(f"SELECT DISTINCT {normalized('url')} AS normalized_url FROM pages WHERE {normalized('url')} NOT IN (SELECT {normalized('url')} FROM pages WHERE page_id % 3 = 0)")
def checkpoint_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of two saved levels of a run: found in the first, partly fetched in the second."""
    pages = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("normalized_url"))
    state = sinks.Checkpoint(spark, _scratch(spark, "state"))
    state.save(0, pending=pages.select("normalized_url"), visited=pages.select("normalized_url").limit(0))
    state.save(1, visited=pages.where("page_id % 3 = 0").select("normalized_url"))
    return state.pending()


@query("SELECT metric, value FROM (SELECT 'customers' AS metric, CAST(count(*) AS VARCHAR) AS value FROM customer UNION ALL SELECT 'in ' || c_mktsegment, CAST(count(*) AS VARCHAR) FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'quoted, \"x\"', '')")
def metrics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's metrics as CSV, and as the map that they are read into."""
    c = table(spark, sf_dir, "customer")
    rows = c.agg(F.lit("customers").alias("metric"), F.count(F.lit(1)).cast("string").alias("value")).unionByName(c.groupBy(F.concat(F.lit("in "), F.col("c_mktsegment")).alias("metric")).agg(F.count(F.lit(1)).cast("string").alias("value")))
    at = sinks.write_csv(rows.unionByName(spark.createDataFrame([('quoted, "x"', "")], "metric string, value string")), _scratch(spark, "report-csv"), single=True)
    return spark.createDataFrame(sorted(feeds.read_metrics(spark, at).items()), "metric string, value string")


@query("SELECT 'Nations' AS sheet, CAST(n_nationkey + 2 AS INTEGER) AS row, CAST(n_nationkey AS VARCHAR) AS first, n_name AS second FROM nation UNION ALL SELECT 'Regions', CAST(r_regionkey + 2 AS INTEGER), CAST(r_regionkey AS VARCHAR), r_name FROM region")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as sheets of a workbook, and what its cells hold."""
    import re
    from html import unescape

    sheets = {"Nations": table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "Regions": table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")}
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file
        with zipfile.ZipFile(sinks.export_workbook(sheets, f"{folder}/w.xlsx")) as z:
            for k, name in enumerate(sheets, 1):
                for n, cells in re.findall(r'<row r="(\d+)">(.*?)</row>', z.read(f"xl/worksheets/sheet{k}.xml").decode(), re.S)[1:]:
                    rows.append((name, int(n), *(unescape(v) for v in re.findall(r"<(?:v|t)\b[^>]*>([^<]*)</(?:v|t)>", cells))))
    return spark.createDataFrame(rows, "sheet string, row int, first string, second string")


@query(
    "SELECT 'status_counts' AS counter, o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'page_kind_counts', o_orderpriority, count(*) FROM orders GROUP BY ALL"
)
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a report, through its JSON file."""
    orders = table(spark, sf_dir, "orders")
    parts = [coverage.counts(orders, c).select(F.lit(n).alias("counter"), "value", "n") for n, c in (("status_counts", "o_orderstatus"), ("page_kind_counts", "o_orderpriority"))]
    none = spark.createDataFrame([], "ord int, metric string, value string, sitemap_url string, status string, url_count long, error string")
    scalars = dict.fromkeys(("start_url", "unique_phones", "valid_unique_phones", "occurrences", "pages"), 0)
    payload = coverage.report(scalars, parts[0].unionByName(parts[1]), none, none)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own file
        with open(sinks.export_report(payload, folder)["json"], encoding="utf-8") as f:
            got = json.load(f)
    rows = [(c, v, n) for c in ("status_counts", "page_kind_counts") for v, n in got[c].items()]
    return spark.createDataFrame(rows, "counter string, value string, n long")


@query(
    f"WITH {P} SELECT url AS requested_url, kind, status, coalesce(error, '') AS error, '2023-11-14T22:' || lpad(CAST(13 + (20 + page_id % 100) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((20 + page_id % 100) % 60 AS VARCHAR), 2, '0') || '.000000+00:00' AS crawl_timestamp FROM p0"
)
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages as a CSV holds them."""
    got = sinks.flat(synthetic.page_records(table(spark, sf_dir, "pages")))
    return got.select("requested_url", "kind", "status", F.coalesce("error", F.lit("")).alias("error"), "crawl_timestamp")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


