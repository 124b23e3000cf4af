"""Progress lines of a run, and its structured log: driver side, from small tables."""

from __future__ import annotations

import contextlib
import json
import logging
import sys
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of progress lines.
TAGS = ("DISCOVER", "CRAWL", "PHONE", "PDF", "JS", "ERROR", "RESUME")
#: Lines of a kind that are written for a level; the rest is counted in one line.
LINES = 500

_listener: ContextVar[Callable[[str, str], None] | None] = ContextVar("lodestar_progress", default=None)
_lines_to: list[str] = []


class JsonLines(logging.Formatter):
    """A record as one line of JSON: event, level, logger, timestamp and its fields."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"event": record.getMessage(), "level": record.levelname.lower(), "logger": record.name, "timestamp": datetime.fromtimestamp(record.created, UTC).isoformat()}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out | getattr(record, "fields", {}), default=str, ensure_ascii=False)


def setup_logging(debug: bool = False, log_file: str | None = None) -> logging.Logger:
    """JSON lines to log_file; to standard error as well if debug, or if there is no file."""
    logger = logging.getLogger("lodestar")
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.FileHandler(log_file, encoding="utf-8")] if log_file else []
    if debug or not handlers:
        handlers.append(logging.StreamHandler(sys.stderr))
    for h in handlers:
        h.setFormatter(JsonLines())
        logger.addHandler(h)
    logger.setLevel(logging.DEBUG if debug else logging.INFO)
    logger.propagate = False
    _lines_to[:] = [log_file] if log_file else []
    return logger


def event(name: str, level: int = logging.INFO, **fields: object) -> None:
    logging.getLogger("lodestar").log(level, name, extra={"fields": fields})


@contextlib.contextmanager
def listening(callback: Callable[[str, str], None]) -> Iterator[None]:
    """While it lasts, callback(tag, message) gets each line of this context."""
    token = _listener.set(callback)
    try:
        yield
    finally:
        _listener.reset(token)


def announce(tag: str, message: str) -> None:
    """One line, to standard output, the log file and the listener."""
    line = f"[{tag}] {message}"
    print(line, flush=True)
    for path in _lines_to:
        with open(path, "a", encoding="utf-8") as f:
            f.write(line + "\n")
    if (callback := _listener.get()) is not None:
        callback(tag, message)


def announce_pages(pages: DataFrame, before: int, scheduled: int) -> int:
    """Lines for the pages of a level (url, status, http_status, page_kind), in their order; returns how many pages there are by now."""
    n = pages.count()
    for i, r in enumerate(pages.orderBy("seq").select("url", "status", "http_status", "page_kind").limit(LINES).collect(), 1):
        announce("CRAWL", f"{before + i}/{max(1, scheduled)} {r['url']}")
        if r["page_kind"] == "PDF":
            announce("PDF", r["url"])
        if r["status"].startswith("FAILED") or (r["http_status"] or 0) >= 400:
            announce("ERROR", f"{r['http_status'] or r['status']} {r['url']}")
    if n > LINES:
        announce("CRAWL", f"{before + n}/{max(1, scheduled)} and {n - LINES} pages more")
    return before + n


def announce_phones(labels: DataFrame) -> None:
    """Lines for the numbers that each page shows, once a page (source_url, label, page_title, seq)."""
    for r in labels.orderBy("seq").limit(LINES).collect():
        announce("PHONE", f"{r['label']} — {r['page_title'] or r['source_url']}")
    if (n := labels.count()) > LINES:
        announce("PHONE", f"and {n - LINES} more")


def status_lines(events: DataFrame) -> dict[str, int]:
    """How often each status occurs among events, for the log."""
    return {r["status"]: r["n"] for r in events.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
