"""Run configuration."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

# URL patterns that are never fetched, and query parameters that don't tell pages apart.
EXCLUDE_PATTERNS = (
    r"/logout(?:/|$|\?)",
    r"/log-out(?:/|$|\?)",
    r"/sign[-_]?out(?:/|$|\?)",
    r"/login(?:/|$|\?)",
    r"/log-in(?:/|$|\?)",
    r"/sign[-_]?in(?:/|$|\?)",
    r"/sso(?:/|$|\?)",
    r"/cas/login",
    r"/shibboleth",
    r"/wp-login",
    r"/wp-admin",
    r"/cart(?:/|$|\?)",
    r"/basket(?:/|$|\?)",
    r"/checkout(?:/|$|\?)",
    r"/calendar(?:/|$|\?)",
    r"[?&](?:cid|calendar[_-]?id)=",
    r"[?&](?:day|month|year|date)=",
    r"[?&]ical=",
    r"\.ics(?:$|\?)",
    r"/search(?:/|$|\?)",
    r"[?&](?:s|q|query|search)=",
    r"/print(?:/|$|\?)",
    r"[?&](?:print|format=print)=",
    r"[?&](?:sessionid|session_id|sid|jsessionid|phpsessid)=",
    r"/cgi-bin/",
    r"/feed(?:/|$|\?)",
    r"/comment-page-",
    r"[?&]replytocom=",
    r"/cdn-cgi/",
)
STRIP_QUERY_PARAMS = (
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "gclid",
    "fbclid",
    "mc_cid",
    "mc_eid",
    "_ga",
    "sessionid",
    "session_id",
    "sid",
    "jsessionid",
    "phpsessid",
)


def default_output_dir(start_url: str, root: str = "output", at: datetime | None = None) -> str:
    """A folder for a run: its host and the time."""
    m = re.match(r"(?:(?:https?:)?//)?(?:[^/?#@]*@)?([^/?#:@]+)", start_url.strip(), re.I)
    return os.path.join(root, f"{m[1].lower() if m else 'site'}_{(at or datetime.now()):%Y%m%d_%H%M%S}")


# Names and defaults of the options.
@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a run; a cap of 0 means no cap, an empty list of exclude patterns or parameters the defaults."""

    start_url: str
    output_dir: str = ""
    country: str = "US"
    max_pages: int = 25_000
    max_pdfs: int = 5_000
    max_depth: int = 10
    concurrency: int = 6
    timeout: float = 20.0
    delay: float = 0.35
    include_pdfs: bool = True
    render_js: str = "auto"
    discover_sitemaps: bool = True
    respect_robots: bool = True
    allow_subdomains: bool = False
    include_url_patterns: tuple[str, ...] = ()
    exclude_url_patterns: tuple[str, ...] = EXCLUDE_PATTERNS
    strip_query_params: tuple[str, ...] = STRIP_QUERY_PARAMS
    user_agent: str = "lodestar/1.0"
    max_file_size: int = 50 << 20
    classify_ai: bool = False
    retries: int = 3
    resume: bool = False
    max_sitemap_urls: int = 100_000
    debug: bool = False
    started_at: datetime = field(default_factory=lambda: datetime.now(UTC))

    def __post_init__(self) -> None:
        object.__setattr__(self, "country", self.country.upper())
        if not 1 <= self.concurrency <= 32:
            raise ValueError("concurrency must be from 1 to 32")
        if min(self.max_pages, self.max_pdfs, self.max_depth) < 0:
            raise ValueError("caps must not be negative")
        if self.render_js not in ("off", "auto", "always"):
            raise ValueError("render_js must be off, auto or always")
        if not self.exclude_url_patterns:
            object.__setattr__(self, "exclude_url_patterns", EXCLUDE_PATTERNS)
        if not self.strip_query_params:
            object.__setattr__(self, "strip_query_params", STRIP_QUERY_PARAMS)
