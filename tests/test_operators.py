"""Inventory, coverage, frontier, sources, sinks, streaming and a whole run."""

from __future__ import annotations

import gzip
import json
import threading
import time
import urllib.error
import urllib.request
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from test_functions import SAMPLE

from lodestar import ask, progress, schemas, web
from lodestar.cli import config_of, parser
from lodestar.config import EXCLUDE_PATTERNS, CrawlConfig, default_output_dir
from lodestar.functions import phone
from lodestar.functions.url import Scope
from lodestar.operators import coverage, inventory
from lodestar.operators import occurrences as operators
from lodestar.operators.occurrences import html_occurrences, page_links, pdf_occurrences, reconcile, text_candidates
from lodestar.plans import frontier
from lodestar.queries import phone_hint_documents
from lodestar.session import run, visited_of
from lodestar.sources import feeds, sinks
from lodestar.sources.fetch import fetch
from lodestar.streaming import pages as stream

OCC = schemas.PHONE_OCCURRENCE.replace("\n", " ") + ", seq int"
NAMES = [x.split()[0] for x in OCC.split(", ")]


def occurrence(seq: int, **changes) -> tuple:
    base = {
        "occurrence_id": str(seq), "raw_phone": "(415) 555-0142", "normalized_phone": "415-555-0142", "e164_phone": "+14155550142", "validation_status": "VALID", "source_url": "https://www.museum.test/a", "final_url": "https://www.museum.test/a",
        "source_type": "HTML", "page_title": "Registrar", "context": "Noor Petrov, registrar, 415-555-0142", "nearest_heading": "Registrar and collections", "extraction_method": "TEXT", "js_confirmed": False, "seq": seq,
    }
    base |= changes
    return tuple(base.get(n) for n in NAMES)


def occurrences(spark, *rows):
    return spark.createDataFrame([occurrence(i, **r) for i, r in enumerate(rows)], OCC)


def test_inventory(spark):
    b = {"source_url": "https://www.museum.test/b", "final_url": "https://www.museum.test/b"}
    got = inventory.classify(inventory.unique_phones(occurrences(spark, {}, {"raw_phone": "415.555.0142"} | b, {}))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["occurrence_count"], r["source_count"], r["unique_url_count"], r["source_urls"]) == (3, 2, 2, ["https://www.museum.test/a", "https://www.museum.test/b"])
    assert (r["classification"], r["classification_source"], r["classification_confidence"], r["number_kind"]) == ("Registrar", "RULES", 0.7, "UNKNOWN")
    assert r["departments_or_context"].startswith("Registrar: Noor Petrov") and r["first_seen_url"] == "https://www.museum.test/a"
    two = inventory.unique_phones(occurrences(spark, {}, {"extension": "321"})).collect()
    assert {r["extension"] for r in two} == {None, "321"}
    assert inventory.unique_phones(occurrences(spark)).count() == 0


def test_best_row_and_caps(spark):
    rows = [{"context": f"context {i}", "page_title": f"title {i}", "nearest_heading": " " if i else "h", "validation_status": "POSSIBLE", "national_format": str(i)} for i in range(15)]
    rows += [{"context": "c", "page_title": "title 0", "national_format": "x"}, {"context": "c", "national_format": "y", "final_url": ""}]
    r = inventory.unique_phones(occurrences(spark, *rows)).first()
    assert (r["validation_status"], r["national_format"]) == ("VALID", "x")
    assert r["sample_contexts"] == [f"context {i}" for i in range(8)] and r["page_titles"] == [f"title {i}" for i in range(12)] and r["nearest_headings"] == ["h", "Registrar and collections"]


def test_classification(spark):
    texts = [("Phone and fax 415", "FAX", "Unknown"), ("emergency library", "UNKNOWN", "Emergency"), ("the cooperator calls", "UNKNOWN", "General Information"), ("call us", "VOICE", "Unknown")]
    df = spark.createDataFrame([(t,) for t, _, _ in texts], "t string").select("t", inventory.kind_of(F.lower("t")), F.coalesce(inventory.label_of(F.lower("t")), F.lit("Unknown")))
    assert [tuple(r) for r in df.collect()] == texts


def test_relabel(spark):
    phones = inventory.classify(inventory.unique_phones(occurrences(spark, {}, {"e164_phone": "+1", "context": "x", "page_title": None, "nearest_heading": None}, {"e164_phone": "+2", "context": "boom", "page_title": None, "nearest_heading": None})))
    assert inventory.relabel(phones, None) is phones

    def ask(prompt: str) -> dict:
        if "boom" in prompt:
            raise RuntimeError
        return {"classification": "Bursar", "number_kind": "fax", "confidence": 0}

    got = {r["e164_phone"]: r for r in inventory.relabel(phones, ask).collect()}
    assert (got["+1"]["category"], got["+1"]["number_kind"], got["+1"]["classification_confidence"], got["+1"]["classification_source"]) == ("Bursar", "FAX", 0.5, "AI")
    assert got["+2"]["category"] == "Unknown" and got["+14155550142"]["category"] == "Registrar"


def test_top_phones_and_order(spark):
    phones = inventory.unique_phones(occurrences(spark, {"e164_phone": "+2"}, {"e164_phone": "+1"}, {"e164_phone": None, "normalized_phone": "9"}, {"e164_phone": "+2"}))
    assert [(r["rank"], r["e164_phone"]) for r in inventory.top_phones(phones, limit=3).orderBy("rank").collect()] == [(1, "+2"), (2, None), (3, "+1")]
    assert [r["key"] for r in inventory.in_order(phones).collect()] == ["+2|", "+1|", "9|"]


def test_reconcile(spark):
    short, other = {"context": "short"}, {"e164_phone": "+1", "context": "only static"}
    static = occurrences(spark, short, other, {"extraction_method": "TEL_LINK", "source_type": "HTML_TEL_LINK"})
    rendered = occurrences(spark, {"context": "a longer context", "nearest_heading": ""}, {"e164_phone": "+2", "source_type": "HTML_TEL_LINK", "extraction_method": "TEL_LINK"}, {"context": "the longest of all contexts", "nearest_heading": "h"})
    got = {r["e164_phone"]: r for r in reconcile(static, rendered).collect()}
    assert len(got) == 3
    r = got["+14155550142"]
    assert (r["js_confirmed"], r["context"], r["source_type"], r["nearest_heading"]) == (True, "the longest of all contexts", "HTML", "h")
    assert (got["+2"]["source_type"], got["+2"]["extraction_method"], got["+2"]["js_confirmed"]) == ("JAVASCRIPT_RENDERED", "JS_TEXT", False)
    assert (got["+1"]["js_confirmed"], got["+1"]["context"]) == (False, "only static")
    r = reconcile(occurrences(spark, {"context": "the longer one"}), occurrences(spark, short)).first()
    assert (r["js_confirmed"], r["context"]) == (True, "the longer one")


PAGE = "requested_url string, final_url string, normalized_url string, kind string, http_status int, crawl_timestamp timestamp, referring_url string, source string, status string, error string, notes string, rendered_js boolean, seq int"


def page(path: str, status: str, seq: int, at: int = 0) -> tuple:
    u = f"https://x.edu{path}"
    return u, u, u, "HTML", 200, datetime(2026, 1, 1, 0, 0, at), None, "html_link", status, None, "n", False, seq


def test_coverage(spark):
    pages = spark.createDataFrame([page("/", "SUCCESS", 0), page("/directory", "SUCCESS", 1), page("/broken", "FAILED_HTTP", 2), page("/old", "SKIPPED_EXTERNAL_REDIRECT", 3), page("/late", "FAILED_HTTP", 4), page("/late", "SUCCESS", 5), page("/js", "RENDER_UNAVAILABLE", 6), page("/scan", "PDF_TEXT_UNAVAILABLE", 7)], PAGE)
    listed = spark.createDataFrame([(f"https://x.edu{p}", m, "s", i) for i, (p, m) in enumerate([("/", "2026-01-01"), ("/#x", "later"), ("/missing", None), ("/broken", None), ("/both", None)])], "url string, lastmod string, sitemap_source string, seq int")
    events = spark.createDataFrame([("https://x.edu/login", "SKIPPED_PATTERN", "exclude_pattern", 0), ("https://x.edu/both", "SKIPPED_ROBOTS", "", 1), ("https://x.edu/", "SKIPPED_PATTERN", "x", 2), ("https://x.edu/ok", "SUCCESS", None, 3)], "url string, status string, detail string, seq int")
    rows = coverage.url_inventory(pages, listed, events)
    got = {r["normalized_url"].removeprefix("https://x.edu"): r for r in rows.collect()}
    assert {k: r["coverage_status"] for k, r in got.items()} == {
        "/": "SITEMAP_AND_CRAWLED", "/missing": "SITEMAP_NOT_CRAWLED", "/directory": "CRAWLED_NOT_IN_SITEMAP", "/broken": "DISCOVERED_BUT_FAILED", "/old": "REDIRECTED", "/login": "EXCLUDED",
        "/both": "EXCLUDED", "/late": "CRAWLED_NOT_IN_SITEMAP", "/js": "DISCOVERED_BUT_FAILED", "/scan": "CRAWLED_NOT_IN_SITEMAP",
    }
    assert got["/"]["lastmod"] == "2026-01-01" and got["/both"]["in_sitemap"] and got["/both"]["discovery_source"] == "event" and got["/login"]["error"] == "exclude_pattern"
    assert {r["status"] for r in coverage.errors(pages).collect()} == {"FAILED_HTTP", "PDF_TEXT_UNAVAILABLE"}
    found = occurrences(spark, {}, {"source_type": "PDF", "final_url": "https://x.edu/scan"})
    rows_of = {r["metric"]: r["value"] for r in coverage.summary("x.edu", "https://x.edu", None, None, pages, inventory.unique_phones(found), found, rows, listed).collect()}
    assert (rows_of["URLs discovered"], rows_of["URLs crawled"], rows_of["Excluded URLs"], rows_of["Coverage EXCLUDED"], rows_of["PDFs containing phone numbers"]) == ("10", "4", "2", "2", "1")
    n = sum(r["n"] for r in coverage.counts(rows, "coverage_status").collect())
    assert n == rows.count()


def test_frontier_rules(spark):
    config = CrawlConfig("https://x.edu", max_depth=2, max_pages=2, max_pdfs=0)
    rows = spark.createDataFrame([("https://x.edu/a", 2, "HTML", 0), ("https://x.edu/b", 3, "HTML", 1), ("https://x.edu/login", 1, "HTML", 2), ("https://x.edu/c", 1, "HTML", 3), ("https://x.edu/d", 1, "PDF", 4), ("https://x.edu/e", 1, "HTML", 5)], "normalized_url string, depth int, kind string, seq int")
    got = {r["normalized_url"][-2:]: r["skip_status"] for r in frontier.admit(rows, config).collect()}
    assert got == {"/a": None, "/b": "SKIPPED_MAX_DEPTH", "in": "SKIPPED_PATTERN", "/c": None, "/d": None, "/e": None}
    assert sorted(r["seq"] for r in frontier.capped(rows, {"HTML": 1}, config).collect()) == [0, 4]
    assert frontier.capped(rows, {}, CrawlConfig("https://x.edu", max_pages=0)).count() == 6


def test_expand(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (9, 10)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in frontier.expand(seeds, edges, 2).collect()} == {(1, 0), (2, 1), (3, 2), (4, 2)}
    seen = spark.createDataFrame([(2,)], "node long")
    assert {tuple(r) for r in frontier.expand(seeds, edges, 9, seen).collect()} == {(1, 0)}


def test_sitemaps(spark):
    leaf = b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- c --><url><loc> https://www.museum.test/ </loc><lastmod>2026-01-01</lastmod></url><url><loc>https://other.test/out</loc></url><url><loc>/near</loc></url></urlset>'
    index = b"<sitemapindex><sitemap><loc>https://www.museum.test/sitemap-rooms.xml</loc></sitemap><sitemap><loc>/sitemap-people.xml</loc></sitemap></sitemapindex>"
    assert feeds.parse_sitemap("x", gzip.compress(leaf))[1][0] == ("https://www.museum.test/", "2026-01-01")
    assert feeds.parse_sitemap("x", index) == (["https://www.museum.test/sitemap-rooms.xml", "/sitemap-people.xml"], [])
    assert feeds.parse_sitemap("x", b"<urlset><loc>a</loc>") == ([], []) and feeds.parse_sitemap("x", b"<urlset><loc>a</loc></urlset>") == ([], [("a", None)])
    assert feeds.gunzip("x.gz", b"plain") == b"plain"
    files = spark.createDataFrame([("https://www.museum.test/sitemap.xml", bytearray(index)), ("https://www.museum.test/sitemap-rooms.xml", bytearray(leaf)), ("https://www.museum.test/sitemap-people.xml", bytearray(b"<bad"))], "sitemap_url string, content binary")
    scope = Scope.of("https://www.museum.test")
    records, urls = feeds.discover_sitemaps(files, scope.start_url, scope)
    assert {r["url"] for r in urls.collect()} == {"https://www.museum.test/", "https://www.museum.test/near"}
    told = {r["sitemap_url"].rpartition("/")[2]: (r["source"].rpartition("/")[2], r["status"], r["url_count"], r["error"], r["nested"]) for r in records.collect()}
    assert told == {
        "sitemap.xml": ("seed", "SUCCESS", 0, None, False), "sitemap_index.xml": ("seed", "FAILED", 0, "no file", False),
        "sitemap-rooms.xml": ("sitemap.xml", "SUCCESS", 2, None, True), "sitemap-people.xml": ("sitemap.xml", "SUCCESS", 0, None, True),
    }
    assert feeds.discover_sitemaps(files, scope.start_url, scope, max_urls=1)[1].count() == 1


def test_sitemaps_that_nest_too_deeply(spark, monkeypatch):
    monkeypatch.setattr(feeds, "MAX_SITEMAP_DEPTH", 1)
    index = lambda child: bytearray(f"<sitemapindex><sitemap><loc>{child}</loc></sitemap></sitemapindex>".encode())
    files = spark.createDataFrame([("https://x.test/sitemap.xml", index("/b.xml")), ("https://x.test/b.xml", index("/c.xml")), ("https://x.test/c.xml", index("/b.xml"))], "sitemap_url string, content binary")
    got = {r["sitemap_url"][15:]: r["status"] for r in feeds.discover_sitemaps(files, "https://x.test/", Scope.of("https://x.test"))[0].collect()}
    assert got == {"sitemap.xml": "SUCCESS", "sitemap_index.xml": "FAILED", "b.xml": "SUCCESS", "c.xml": "SKIPPED_DEPTH"}


def test_robots(spark):
    rules = feeds.Robots("User-agent: *\nAllow: /\nDisallow: /secret\nCrawl-delay: 1\ncrawl-delay: 2.5\nSitemap: https://x.edu/s.xml\n")
    assert rules.sitemaps == ["https://x.edu/s.xml"] and rules.crawl_delay == 2.5
    df = spark.createDataFrame([("https://x.edu/secret",)], "u string")
    assert df.select(rules.allowed(F.col("u"), "bot")).first()[0] and df.select(feeds.Robots(None).allowed(F.col("u"), "bot")).first()[0]
    assert not df.select(feeds.Robots("User-agent: *\nDisallow: /secret").allowed(F.col("u"), "bot")).first()[0]


def test_pdf(spark):
    rows = spark.createDataFrame([("plan.pdf", ["Plan: ask (415) 555-0142 ext 542 for keys."]), ("scanned.pdf", [" "]), ("none.pdf", [])], "filename string, pages array<string>")
    got = {r["filename"]: r for r in feeds.pdf_pages(rows).collect()}
    assert got["plan.pdf"]["page_count"] == 1 and got["scanned.pdf"]["text_unavailable"] and got["none.pdf"]["page_count"] == 0
    found = pdf_occurrences(feeds.pdf_pages(rows).where("text is not null").withColumn("url", F.concat(F.lit("https://x.edu/"), "filename"))).collect()
    assert [(r["e164_phone"], r["extension"], r["pdf_page_number"], r["source_type"]) for r in found] == [("+14155550142", "542", 1, "PDF")]
    assert feeds.pdf_text(b"%PDF stream\nBT (Ask \\(415\\) 555-0142) Tj ET\nendstream") == ["Ask (415) 555-0142"]


def site(spark):
    home = '<html><body><h1>Harbour Museum</h1><p>Ring the front desk at (415) 555-0101</p><a href="/visit/people">s</a><a href="/login">l</a><a href="https://other.test/about">o</a><a href="/gone">g</a></body></html>'
    rows = [("https://www.museum.test/", 200, "text/html", home), ("https://www.museum.test/visit/people", 200, "text/html; charset=utf-8", SAMPLE), ("https://www.museum.test/secret", 200, "text/html", "<p>415-555-9999</p>"), ("https://www.museum.test/gone", 404, "text/plain", "missing")]
    log = spark.createDataFrame([(u, u, s, t, b, 1.5, None, None, datetime(2026, 1, 1)) for u, s, t, b in rows], schemas.FETCH_LOG.replace("\n", " "))
    xml = "<urlset><url><loc>https://www.museum.test/</loc></url><url><loc>https://www.museum.test/visit/people</loc></url></urlset>"
    return log, spark.createDataFrame([("https://www.museum.test/sitemap.xml", bytearray(xml.encode()))], "sitemap_url string, content binary"), "User-agent: *\nAllow: /\nDisallow: /secret\nSitemap: /sitemap.xml\n"


@pytest.fixture(scope="module")
def result(spark):
    log, files, robots = site(spark)
    return run(spark, CrawlConfig("https://www.museum.test/", max_pages=10, max_pdfs=0, max_depth=3, include_pdfs=False, render_js="off"), log, files, robots)


def test_run(result):
    crawled = {r["normalized_url"]: r["status"] for r in result.pages.collect()}
    assert crawled == {"https://www.museum.test/": "SUCCESS", "https://www.museum.test/visit/people": "SUCCESS", "https://www.museum.test/gone": "FAILED_HTTP"}
    phones = {r["e164_phone"]: r for r in result.phones.collect()}
    assert {"+14155550101", "+14155550142"} <= set(phones) and any("Noor Petrov" in c for c in phones["+14155550142"]["sample_contexts"])
    statuses = {r["normalized_url"].removeprefix("https://www.museum.test"): r["coverage_status"] for r in result.url_inventory.collect()}
    assert statuses == {"/": "SITEMAP_AND_CRAWLED", "/visit/people": "SITEMAP_AND_CRAWLED", "/gone": "DISCOVERED_BUT_FAILED", "/login": "EXCLUDED"}
    n = result.occurrences.count()
    assert sum(r["occurrence_count"] for r in result.phones.collect()) == n
    methods = {r["extraction_method"] for r in result.occurrences.where("e164_phone = '+14155550142'").collect()}
    assert methods == {"TEL_LINK", "TEXT"}


def test_export(result, tmp_path, spark):
    paths = result.export(str(tmp_path))
    assert set(paths) == {*sinks.TABLES, "json", "markdown", "workbook"}
    payload = json.loads((tmp_path / "crawl_report.json").read_text())
    assert payload["pages"] == 3 and payload["status_counts"] == {"FAILED_HTTP": 1, "SUCCESS": 2} and "# Crawl coverage report" in (tmp_path / "crawl_report.md").read_text()
    metrics = feeds.read_metrics(spark, f"{tmp_path}/crawl_report.csv")
    assert metrics["URLs crawled"] == "2" and metrics["Domain"] == "museum.test"
    rows = feeds.read_csv(spark, f"{tmp_path}/phone_inventory.csv", "normalized_phone string, e164_phone string", 2)
    assert rows.count() == 2
    with zipfile.ZipFile(paths["workbook"]) as z:
        assert z.testzip() is None and "Phone Inventory" in z.read("xl/workbook.xml").decode() and "+14155550142" in z.read("xl/worksheets/sheet2.xml").decode()


def test_resume(spark, result):
    log, files, robots = site(spark)
    again = run(spark, CrawlConfig("https://www.museum.test/", max_pages=10, render_js="off", resume=True), log, files, robots, visited=visited_of(result.pages))
    assert again.pages.count() == 0


def test_rendering(spark):
    log, files, robots = site(spark)
    shown = spark.createDataFrame([("https://www.museum.test/", "<html><body><p>Ring the front desk of the museum, in the morning and at night, at (415) 555-0101 or (415) 555-7777</p></body></html>")], "url string, html string")
    got = run(spark, CrawlConfig("https://www.museum.test/", render_js="always"), log, files, robots, rendered=shown)
    status = {r["normalized_url"][23:]: r["status"] for r in got.pages.collect()}
    assert status["/"] == "SUCCESS_RENDERED" and status["/visit/people"] == "SUCCESS"
    by = {(r["source_url"][23:], r["e164_phone"]): r for r in got.occurrences.collect()}
    assert by["/", "+14155550101"]["js_confirmed"] and by["/", "+14155557777"]["source_type"] == "JAVASCRIPT_RENDERED"
    assert {r["status"] for r in got.events.collect()} >= {"RENDER_UNAVAILABLE"}


def test_occurrences_of_a_page(spark):
    df = spark.createDataFrame([("https://x.edu/a", "https://x.edu/a", 200, None, datetime(2026, 1, 1), SAMPLE, 0)], "url string, final_url string, http_status int, referring_url string, at timestamp, html string, depth int")
    rows = html_occurrences(df).orderBy("seq").collect()
    assert [(r["extraction_method"], r["e164_phone"], r["extension"]) for r in rows][:2] == [("TEL_LINK", "+14155550142", None), ("SCHEMA", "+14155550188", None)]
    assert ("TEXT", "+14155550101", "77") in [(r["extraction_method"], r["e164_phone"], r["extension"]) for r in rows]
    assert len({r["occurrence_id"] for r in rows}) == len(rows) and rows[0]["nearest_container"] == rows[0]["context"]
    links = page_links(df, Scope.of("https://x.edu")).collect()
    assert [(r["link"], r["kind"]) for r in links] == [("https://x.edu/files/floor-plan.pdf", "PDF")]


def test_pages_of_one_file_are_read_once_and_by_many_tasks(spark):
    df = spark.range(400).select(F.concat(F.lit("https://x.edu/"), "id").alias("url"), F.lit(SAMPLE).alias("html")).coalesce(1)
    assert operators.extract_pages(df).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    none = F.lit(None)
    pages = df.select("url", F.col("url").alias("final_url"), F.lit(200).alias("http_status"), none.cast("string").alias("referring_url"), none.cast("timestamp").alias("at"), "html", F.lit(0).alias("depth"))
    plan = html_occurrences(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Broadcast" not in plan


def test_rows_that_skip_python_have_no_candidates(spark):
    """Wide gaps, digits that aren't ASCII, and white space that Java doesn't know."""
    gaps = ["", "-", ".", " " * 5, "\t" * 9, "\n\n", "\x1c", "\xa0\u3000", " - . - "]
    texts = [f"call {a}{g}{b}{h}{c} now" for g in gaps for h in gaps for a, b, c in (("415", "555", "1234"), ("(415)", "555", "1234"), ("٦١٤", "٥٥٥", "١٢٣٤"))] + ["no number", "12 34", ""]
    texts = ["+44 20 7946 0958", "at +(353) 1 234 5678", *texts]
    want = sorted((i, n.start, n.raw) for i, t in enumerate(texts) for n in phone.scan(t))
    got = text_candidates(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).select("i", "c.start", "c.raw").collect()
    assert len(want) == len(texts) - 3 and sorted(tuple(r) for r in got) == want


def test_hints_count_for_each_candidate(spark, tmp_path):
    """Brute force: the 40 characters on both sides of each candidate, which may hold other candidates and line ends."""
    a, b = "415-555-0142", "415-555-9999"
    texts = [f"{a}{' .' * 17} {b}{' .' * 15}invoice", f"invoice\n{a}\n{b}", f"{a} {b} {a} zip code", f"{a}\n\n\nISBN", f"{'x ' * 30}{a}{' .' * 20} year", f"😀 year {a}", a, "year", None]
    want = {}
    for i, t in enumerate(texts):
        n = sum(phone._hints.search(t[max(0, c.start - 40) : c.end + 40]) is not None for c in phone.scan(t or ""))
        want |= {i: n} if n else {}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = phone_hint_documents(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want and want[0] == 1 and want[1] == 2 and want[2] == 3


def test_checkpoint(spark, tmp_path):
    state = sinks.Checkpoint(spark, f"file://{tmp_path}/state")
    assert state.levels() == [] and state.pending() is None
    items = spark.createDataFrame([("u1",), ("u2",)], "normalized_url string")
    state.save(0, pending=items, visited=items.limit(0))
    assert state.pending().count() == 2
    state.save(1, pending=items.limit(0), visited=items.where("normalized_url = 'u1'"))
    assert [r[0] for r in state.pending().collect()] == ["u2"] and state.levels() == [0, 1]
    state.set_meta(a="1")
    state.set_meta(b="2")
    assert state.meta() == {"a": "1", "b": "2"}


def test_streaming(spark, tmp_path):
    page = "<html><title>T</title><body>Call 415-555-0142 now</body></html>"
    rows = [("https://x.edu/a", page, datetime(2026, 1, 1)), ("https://x.edu/b", page, datetime(2026, 1, 1))]
    spark.createDataFrame(rows, stream.PAGES).write.parquet(f"{tmp_path}/in/1")
    for _ in range(2):
        q = stream.write_occurrences(stream.stream_occurrences(stream.read_pages(spark, f"{tmp_path}/in/*")), f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination(120)
        spark.createDataFrame([*rows[:1], ("https://x.edu/c", page, datetime(2026, 1, 1))], stream.PAGES).write.mode("overwrite").parquet(f"{tmp_path}/in/2")
    r = stream.inventory_of(spark, f"{tmp_path}/out").first()
    assert (r["occurrence_count"], r["unique_url_count"], r["e164_phone"]) == (3, 3, "+14155550142")


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        tries: dict[str, int] = {}

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/slow":
                time.sleep(2)
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/ok")
                self.end_headers()
                return
            body = b"<p>\xfc</p>"
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch(spark, server):
    config = CrawlConfig(server, delay=0, retries=1, timeout=0.5)
    urls = spark.createDataFrame([(f"{server}{p}",) for p in ("/ok", "/gone", "/moved", "/slow")] + [("http://127.0.0.1:9/",)], "url string")
    got = {r["url"].removeprefix(server): r for r in fetch(urls, config).collect()}
    assert (got["/ok"]["http_status"], got["/ok"]["body"]) == (200, "<p>ü</p>") and got["/gone"]["http_status"] == 404
    assert got["/moved"]["final_url"].endswith("/ok") and got["/slow"]["fail_status"] == "FAILED_TIMEOUT" and got["http://127.0.0.1:9/"]["fail_status"] == "FAILED_NETWORK"


PAGES = {
    "/": "<html><title>Home</title><a href='/a'>a</a><a href='/b'>b</a><a href='/login'>l</a> 415-555-0101</html>",
    "/a": "<html><title>A</title><a href='/c'>c</a> 415-555-0142</html>",
    "/b": "<html><title>B</title> nothing</html>",
    "/c": "<html><title>C</title> 415-555-0177</html>",
    "/robots.txt": "User-agent: *\nDisallow: /private\n",
    "/sitemap.xml": "<urlset><url><loc>/d</loc></url></urlset>",
    "/d": "<html><title>D</title><a href='/private'>p</a></html>",
}


@pytest.fixture
def live():
    """A small site, which counts what it is asked for, and which can be told to break off a crawl."""
    asked: list[str] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            asked.append(self.path)
            body = PAGES.get(self.path, "").encode()
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/html" if body.startswith(b"<html") else "text/plain")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_live_crawl_that_breaks_off_goes_on_where_it_was(spark, live, tmp_path):
    root, asked = live
    config = CrawlConfig(f"{root}/", delay=0, concurrency=2, retries=1, timeout=5, render_js="off", max_depth=4)

    class Breaking(sinks.Checkpoint):
        def save(self, level, **tables):
            super().save(level, **tables)
            if level == 1:
                raise KeyboardInterrupt

    lines = []
    with progress.listening(lambda tag, message: lines.append((tag, message))), pytest.raises(KeyboardInterrupt):
        run(spark, config, live=True, state=Breaking(spark, f"file://{tmp_path}/state"))
    state = sinks.Checkpoint(spark, f"file://{tmp_path}/state")
    assert state.levels() == [0, 1] and {"/", "/a", "/b", "/d"} <= set(asked) and "/c" not in asked
    assert ("CRAWL", f"1/2 {root}/") in lines and any(tag == "DISCOVER" for tag, _ in lines)
    asked.clear()
    result = run(spark, config, state.load("fetched"), live=True, state=state)
    assert {p for p in asked if p != "/robots.txt" and "sitemap" not in p} == {"/c"}
    assert {r["normalized_url"][len(root) :]: r["status"] for r in result.pages.collect()} == {p: "SUCCESS" for p in ("/", "/a", "/b", "/c", "/d")}
    assert {r["e164_phone"] for r in result.phones.collect()} == {"+14155550101", "+14155550142", "+14155550177"}
    assert {(r["url"][len(root) :], r["status"]) for r in result.events.collect()} == {("/login", "SKIPPED_PATTERN"), ("/private", "SKIPPED_ROBOTS")}
    assert {r["status"] for r in result.sitemaps.collect()} == {"SUCCESS", "FAILED"} and state.levels()[-1] == 4


def test_a_page_that_cannot_be_read_is_one_failed_page(spark, monkeypatch):
    monkeypatch.setattr(operators, "_page", lambda url, html: 1 / 0)
    row = operators._read("u", "<p>")
    assert row[0] == "u" and row[-1] == "ZeroDivisionError: division by zero" and row[-2] == []
    df = spark.createDataFrame([("u", "<p>415-555-0142"), ("v", None)], "url string, html string")
    assert [(r["url"], len(r["numbers"]), r["parse_error"]) for r in operators.extract_pages(df).orderBy("url").collect()] == [("u", 1, None), ("v", 0, None)]


def test_spans_without_overlaps(spark):
    one = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5), (3, 2, 3)], "k int, start int, end int")
    two = spark.createDataFrame([(1, 4, 5), (3, 0, 2), (3, 3, 9), (4, 0, 9)], "k int, start int, end int")
    assert sorted(tuple(r) for r in operators.without_overlaps(one, two, "k").collect()) == [(1, 5, 9), (2, 0, 5), (3, 2, 3)]


def test_labels_of_a_page_are_announced_once(spark, capsys):
    rows = occurrences(spark, {}, {}, {"source_url": "u2", "page_title": None}, {"e164_phone": "", "normalized_phone": "7"})
    progress.announce_phones(operators.first_seen_labels(rows))
    assert capsys.readouterr().out.splitlines() == ["[PHONE] +14155550142 — Registrar", "[PHONE] +14155550142 — u2", "[PHONE] 7 — Registrar"]


def test_logs(tmp_path, capsys):
    progress.setup_logging(log_file=f"{tmp_path}/crawl.log")
    progress.event("crawl_event", url="u", status="SUCCESS")
    seen = []
    with progress.listening(lambda tag, message: seen.append(tag)):
        progress.announce("JS", "x")
    progress.announce("PDF", "y")
    lines = (tmp_path / "crawl.log").read_text().splitlines()
    assert json.loads(lines[0]).items() >= {"event": "crawl_event", "level": "info", "url": "u", "status": "SUCCESS"}.items()
    assert lines[1:] == ["[JS] x", "[PDF] y"] == capsys.readouterr().out.splitlines() and seen == ["JS"]
    progress.setup_logging()


def test_replies_of_a_chat_service():
    assert ask.parse_reply('{"classification": "", "number_kind": "fax", "confidence": null}') == {"classification": "Unknown", "number_kind": "FAX", "confidence": 0.5}
    for bad in ("[]", "no json"):
        with pytest.raises(ValueError):
            ask.parse_reply(bad)
    sent = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            sent.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": '{"classification": "Bursar", "confidence": 0.8}'}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    assert ask.chat({}) is None
    got = ask.chat({"OPENAI_API_KEY": "k", "OPENAI_BASE_URL": f"http://127.0.0.1:{s.server_port}/v1/"})("Number: 7")
    s.shutdown()
    assert got == {"classification": "Bursar", "number_kind": "UNKNOWN", "confidence": 0.8}
    assert sent[0][:2] == ("/v1/chat/completions", "Bearer k") and "Number: 7" in sent[0][2]["messages"][1]["content"]


def test_long_tables_go_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 4)
    path = sinks.export_workbook({"Rows": spark.range(7).orderBy("id"), "None": spark.range(0)}, f"{tmp_path}/w.xlsx")
    with zipfile.ZipFile(path) as z:
        names = [x.split('"')[1] for x in z.read("xl/workbook.xml").decode().split("<sheet ")[1:]]
        held = [z.read(f"xl/worksheets/sheet{k}.xml").decode().count("<row ") - 1 for k in range(1, 5)]
    assert names == ["Rows", "Rows (2)", "Rows (3)", "None"] and held == [3, 3, 1, 0]


def test_output_folder():
    at = datetime(2026, 1, 2, 3, 4, 5)
    assert default_output_dir("https://User@Museum.test:80/x", at=at) == "output/museum.test_20260102_030405"
    assert default_output_dir("//a.test", "r", at) == "r/a.test_20260102_030405" and default_output_dir(" ", at=at).startswith("output/site_")


def test_downloads_and_dashboard(tmp_path):
    jobs = web.Jobs(str(tmp_path), lambda config, job: {})
    run_dir = tmp_path / "r1"
    (run_dir / "phone_inventory.csv").mkdir(parents=True)
    (run_dir / "phone_inventory.csv" / "part-0.csv").write_text("a,b\n1,2\n")
    (run_dir / "phone_inventory.csv" / "part-1.csv").write_text("a,b\n3,4\n")
    (run_dir / "crawl.log").write_text("x")
    s = web.serve(jobs, None, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{path}", timeout=5)
    assert get("/api/crawls/r1/files/phone_inventory.csv").read() == b"a,b\n1,2\n3,4\n" and get("/api/crawls/r1/files/crawl.log").read() == b"x"
    with pytest.raises(urllib.error.HTTPError):
        get("/api/crawls/r1/files/crawl_report.md")
    shown = get("/").read().decode()
    s.shutdown()
    assert "clean(r[n])" in shown and "1500" in shown and all(f in shown for f in web.FILES) and "POLL_MS" not in shown


def test_web(tmp_path):
    gate = threading.Event()

    def execute(config, job):
        job.log("start")
        gate.wait(10)
        if "bad" in config.start_url:
            raise RuntimeError("broke")
        return {"Unique phone numbers": "1"}

    jobs = web.Jobs(str(tmp_path), execute)
    call = lambda *a: web.handle(jobs, None, *a)
    assert call("GET", "/api/health") == (200, {"status": "ok"})
    assert call("POST", "/api/crawls", {"start_url": " "})[0] == 422 and call("POST", "/api/crawls", {"start_url": "x", "output_dir": "../y"})[0] == 422
    status, job = call("POST", "/api/crawls", {"start_url": "https://x.edu", "max_pages": 5})
    assert status == 200 and call("POST", "/api/crawls", {"start_url": "https://y.edu"})[0] == 409
    gate.set()
    for _ in range(100):
        if call("GET", f"/api/crawls/{job['id']}")[1]["status"] == "complete":
            break
        time.sleep(0.05)
    assert call("GET", f"/api/crawls/{job['id']}")[1]["summary"] == {"Unique phone numbers": "1"} and call("GET", "/api/runs")[1][0]["status"] == "complete"
    assert call("GET", f"/api/crawls/{job['id']}/files/secret")[0] == 422 and call("GET", "/api/nothing")[0] == 404
    waiting = web.Jobs(str(tmp_path), execute, wait=True)
    assert web.handle(waiting, None, "POST", "/api/crawls", {"start_url": "https://bad.edu"})[1]["error"] == "broke"
    tight = web.hosted(CrawlConfig("https://x.edu", max_pages=0, delay=0))
    assert (tight.max_pages, tight.delay, tight.render_js) == (40, 0.25, "off")
    s = web.serve(jobs, None, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/api/health", timeout=5) as r:
        assert json.load(r) == {"status": "ok"}
    s.shutdown()


def test_config():
    c = config_of(parser().parse_args(["https://x.edu", "--fetch-log", "f", "--exclude-url", "/z", "--no-include-pdfs", "--country", "us"]))
    assert c.exclude_url_patterns == (*EXCLUDE_PATTERNS, "/z") and not c.include_pdfs and c.country == "US"
    assert CrawlConfig("x", exclude_url_patterns=()).exclude_url_patterns == EXCLUDE_PATTERNS
    for bad in ({"concurrency": 0}, {"max_pages": -1}, {"render_js": "x"}):
        with pytest.raises(ValueError):
            CrawlConfig("x", **bad)
