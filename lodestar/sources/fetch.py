"""Fetching over HTTP into a fetch log: a source for frontiers. All else reads the log alone."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame

from lodestar.config import CrawlConfig
from lodestar.schemas import FETCH_LOG
from lodestar.sources.feeds import gunzip, pdf_text

#: Seconds between attempts: this times powers of two, within bounds.
WAIT, LEAST, MOST = 0.6, 0.6, 8.0


def fetch_one(url: str, config: CrawlConfig) -> tuple:
    """A row of the log. Time-outs and network errors are tried again; an HTTP error is an answer."""
    began, fail, error = time.monotonic(), None, None
    for attempt in range(max(1, config.retries)):
        if attempt:
            time.sleep(min(MOST, max(LEAST, WAIT * 2 ** (attempt - 1))))
        try:
            request = urllib.request.Request(url, headers={"User-Agent": config.user_agent, "Accept": "text/html,application/xhtml+xml,application/pdf,*/*;q=0.8"})
            try:
                answer = urllib.request.urlopen(request, timeout=config.timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                data, kind, status, final = answer.read(), answer.headers.get("Content-Type", ""), answer.status, answer.url
            charset = answer.headers.get_content_charset() or "utf-8"
            if "pdf" in kind.lower():
                body = "\f".join(pdf_text(data))
            else:
                try:
                    body = gunzip(final, data).decode(charset, "replace")
                except LookupError:
                    body = data.decode("utf-8", "replace")
            return url, final, status, kind, body, (time.monotonic() - began) * 1000, None, None, datetime.now(UTC)
        except TimeoutError as e:
            fail, error = "FAILED_TIMEOUT", str(e) or "timeout"
        except OSError as e:
            reason = getattr(e, "reason", e)
            fail, error = ("FAILED_TIMEOUT" if isinstance(reason, TimeoutError) else "FAILED_NETWORK"), str(reason)
        except ValueError as e:
            fail, error = "FAILED_NETWORK", str(e)
            break
    return url, None, None, None, None, (time.monotonic() - began) * 1000, fail, error, datetime.now(UTC)


def fetch(urls: DataFrame, config: CrawlConfig, delay: float | None = None) -> DataFrame:
    """(url) to a fetch log. URLs are dealt to as many tasks as the run may have requests at a time, each of which waits between its own."""
    pause = max(config.delay, delay or 0.0)
    names = [x.split()[0] for x in FETCH_LOG.replace("\n", " ").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            for url in batch["url"]:
                if not first:
                    time.sleep(pause)
                first = False
                yield pd.DataFrame([fetch_one(url, config)], columns=names)

    return urls.select("url").repartition(config.concurrency, "url").mapInPandas(run, FETCH_LOG.replace("\n", " "))


def fetch_bytes(url: str, config: CrawlConfig, timeout: float = 30.0) -> tuple[bytes | None, str | None]:
    """The body of an answer, or why there is none."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": config.user_agent})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read(), None
    except urllib.error.HTTPError as e:
        return None, f"HTTP {e.code}"
    except (OSError, ValueError) as e:
        return None, str(getattr(e, "reason", e)) or type(e).__name__


def fetch_files(urls: DataFrame, config: CrawlConfig) -> DataFrame:
    """(key) to (key, sitemap_url, content, error): sitemap files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(u, u, *fetch_bytes(u, config)) for u in batch["key"]], columns=["key", "sitemap_url", "content", "error"])

    return urls.select("key").repartition(config.concurrency, "key").mapInPandas(run, "key string, sitemap_url string, content binary, error string")
