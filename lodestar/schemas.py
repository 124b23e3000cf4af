"""Schemas of all tables, as DDL, and the domains of status columns."""

from __future__ import annotations

PHONE_OCCURRENCE = """occurrence_id STRING, raw_phone STRING, normalized_phone STRING, e164_phone STRING, national_format STRING, extension STRING,
country_code INT, validation_status STRING, source_url STRING, final_url STRING, source_type STRING, page_title STRING, page_h1 STRING,
context STRING, nearest_heading STRING, nearest_container STRING, pdf_page_number INT, pdf_filename STRING, referring_url STRING,
crawl_timestamp TIMESTAMP, http_status INT, extraction_method STRING, js_confirmed BOOLEAN, notes STRING"""
UNIQUE_PHONE = """normalized_phone STRING, e164_phone STRING, national_format STRING, extension STRING, country_code INT, validation_status STRING,
occurrence_count BIGINT, unique_url_count BIGINT, source_count BIGINT, source_urls ARRAY<STRING>, source_types ARRAY<STRING>,
page_titles ARRAY<STRING>, sample_contexts ARRAY<STRING>, nearest_headings ARRAY<STRING>, number_kind STRING, category STRING,
classification STRING, classification_source STRING, classification_confidence DOUBLE, departments_or_context STRING,
first_seen_url STRING, notes STRING"""
URL_INVENTORY = """url STRING, normalized_url STRING, final_url STRING, coverage_status STRING, discovery_source STRING, in_sitemap BOOLEAN,
crawled BOOLEAN, http_status INT, page_status STRING, lastmod STRING, referring_url STRING, error STRING, kind STRING"""
PAGE_RECORD = """requested_url STRING, final_url STRING, normalized_url STRING, kind STRING, http_status INT, content_type STRING,
response_time_ms DOUBLE, crawl_timestamp TIMESTAMP, page_title STRING, page_h1 STRING, canonical_url STRING, depth INT, referring_url STRING,
source STRING, status STRING, error STRING, visible_text_length INT, phone_count INT, link_count INT, pdf_link_count INT,
rendered_js BOOLEAN, js_render_reason STRING, bytes BIGINT, notes STRING"""
SITEMAP_RECORD = "sitemap_url STRING, source STRING, status STRING, url_count BIGINT, lastmod STRING, error STRING, nested BOOLEAN"
SITEMAP_URL = "url STRING, lastmod STRING, sitemap_source STRING"
CRAWL_EVENT = "timestamp TIMESTAMP, url STRING, status STRING, detail STRING, extra MAP<STRING,STRING>"
QUEUE_ITEM = "url STRING, normalized_url STRING, depth INT, kind STRING, referring_url STRING, source STRING"
PHONE_CANDIDATE = """raw_phone STRING, start INT, end INT, validation_status STRING, extension STRING, e164 STRING, national STRING,
normalized STRING, country_code INT, notes STRING"""
FETCH_LOG = """url STRING, final_url STRING, http_status INT, content_type STRING, body STRING, response_time_ms DOUBLE, fail_status STRING,
error STRING, fetched_at TIMESTAMP"""

# Domains of the status columns.
VALIDATION_STATUS = ("VALID", "POSSIBLE", "INVALID")
SOURCE_TYPE = ("HTML", "HTML_TEL_LINK", "HTML_SCHEMA", "JAVASCRIPT_RENDERED", "PDF")
NUMBER_KIND = ("VOICE", "FAX", "UNKNOWN")
CLASSIFICATION_SOURCE = ("RULES", "AI", "UNCLASSIFIED")
EXTRACTION_METHOD = ("TEL_LINK", "SCHEMA", "TEXT", "JS_TEXT", "PDF_TEXT")
SUCCEEDED = ("SUCCESS", "SUCCESS_RENDERED", "PDF_TEXT_UNAVAILABLE")
FAILED = ("FAILED_HTTP", "FAILED_TIMEOUT", "FAILED_NETWORK", "FAILED_PARSE")
REDIRECTED = ("SKIPPED_EXTERNAL_REDIRECT",)
EXCLUDED = (
    "SKIPPED_ROBOTS",
    "SKIPPED_PATTERN",
    "SKIPPED_EXTERNAL",
    "SKIPPED_CONTENT_TYPE",
    "SKIPPED_MAX_PAGES",
    "SKIPPED_MAX_DEPTH",
    "SKIPPED_TOO_LARGE",
)
PAGE_STATUS = (*SUCCEEDED, *FAILED, *REDIRECTED, *EXCLUDED, "RENDER_UNAVAILABLE")
COVERAGE_STATUS = ("SITEMAP_AND_CRAWLED", "SITEMAP_NOT_CRAWLED", "CRAWLED_NOT_IN_SITEMAP", "DISCOVERED_BUT_FAILED", "EXCLUDED", "REDIRECTED")
