"""URL algebra as native columns. One RFC 3986 pattern splits a URL; nothing raises on a malformed one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.config import EXCLUDE_PATTERNS, STRIP_QUERY_PARAMS
from lodestar.functions.text import strip

_AUTHORITY = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Second-level labels that country domains keep for kinds of holders, so that a.b.co.uk belongs to b.co.uk.
SECOND_LEVEL = "ac co com edu gen go gob gouv gov govt gub id idf ind info kr ltd me mi mil muni ne net nic nom or org plc pro re sch school web".split()


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _AUTHORITY, n)


def ensure_scheme(url: Column) -> Column:
    """https for URLs without http(s) scheme; null for empty ones."""
    u = strip(url)
    return F.when(u == "", None).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(_part(url, 2)), r"\.+$", "")


def path(url: Column) -> Column:
    """The path, without parameters of its last segment."""
    return F.regexp_replace(_part(url, 4), r";[^/]*$", "")


def _remove_dots(p: Column) -> Column:
    """Resolves . and .. segments of an absolute path."""
    segments = F.split(F.substring(p, 2, 1 << 30), "/", -1)
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    tail = F.when(p.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolve(base: Column, href: Column) -> Column:
    """href relative to base; schemes other than http(s) are kept as they are."""
    h = strip(href)
    origin = F.concat(F.lower(_part(base, 1)), F.lit("://"), F.regexp_extract(base, r"(?i)^https?://([^/?#]*)", 1))
    base_path = F.when(_part(base, 4) == "", "/").otherwise(_part(base, 4))
    own_path, rest = F.regexp_extract(h, r"^([^?#]*)(.*)$", 1), F.regexp_extract(h, r"(?s)^([^?#]*)(.*)$", 2)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(h == "", base)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.lower(_part(base, 1)), F.lit(":"), h))
        .when(h.startswith("#"), F.concat(origin, _part(base, 4), query, h))
        .when(h.startswith("?"), F.concat(origin, _part(base, 4), h))
        .when(h.startswith("/"), F.concat(origin, _remove_dots(own_path), rest))
        .otherwise(F.concat(origin, _remove_dots(F.concat(F.regexp_extract(base_path, r"^(.*/)[^/]*$", 1), own_path)), rest))
    )


def _recode(c: Column) -> Column:
    """Decodes a query part and encodes it again, as form values; one with a broken escape is only encoded."""
    plain = F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_query(query: Column, strip_params: tuple[str, ...] = STRIP_QUERY_PARAMS) -> Column:
    drop = F.array(*(F.lit(p.lower()) for p in (strip_params or STRIP_QUERY_PARAMS)))
    pairs = F.transform(
        F.filter(F.split(query, "&", -1), lambda x: x != ""),
        lambda x: F.struct(_recode(F.regexp_extract(x, r"(?s)^([^=]*)", 1)).alias("k"), _recode(F.regexp_extract(x, r"(?s)^[^=]*=?(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.array_contains(drop, F.lower(p["k"]))))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def normalize_url(url: Column, base: Column | None = None, strip_params: tuple[str, ...] = STRIP_QUERY_PARAMS, keep_fragment: bool = False) -> Column:
    """The form by which URLs are told apart; null for what can't be fetched or parsed."""
    skip = url.isNull() | (url == "") | url.rlike(r"^(?:mailto|javascript|data|tel):")
    full = ensure_scheme(url if base is None else resolve(base, url))
    scheme, h, port = F.lower(_part(full, 1)), host(full), _part(full, 3)
    number = F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999")).cast("int")
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    netloc = F.when(number.isNull() | (number == 0) | default, h).otherwise(F.concat(h, F.lit(":"), number.cast("string")))
    p = F.regexp_replace(F.when(path(full) == "", "/").otherwise(path(full)), "/+", "/")
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))
    q = normalize_query(_part(full, 5), strip_params)
    out = F.concat(scheme, F.lit("://"), netloc, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    if keep_fragment:
        out = F.concat(out, F.when(_part(full, 6) == "", "").otherwise(F.concat(F.lit("#"), _part(full, 6))))
    return F.when(skip | (h == "") | ((port != "") & ~port.rlike(r"^\d{1,5}$")), None).otherwise(out)


def looks_like_pdf(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r";[^/]*$", "")).endswith(".pdf") | F.lower(url).contains(".pdf?")


def file_name(url: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path(url), "/", -1), -1), F.lit("")), F.lit("document.pdf"))


def registrable(h: str) -> str:
    """Domain and public suffix of a host; addresses and single labels as they are.

    A public suffix is the last label, or by rule the last two where the last is a country's and the one before stands for a kind of holders."""
    labels = h.split(".")
    if re.fullmatch(r"[\d.]+|\[.*\]", h) or len(labels) < 3:
        return h
    return ".".join(labels[-3:] if len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else labels[-2:])


def registrable_domain(h: Column) -> Column:
    """As registrable(), native."""
    labels = F.split(h, r"\.", -1)
    n = F.size(labels)
    two = (F.char_length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    last = F.array_join(F.slice(labels, F.greatest(n - F.when(two, 2).otherwise(1), F.lit(1)), F.lit(3)), ".")
    return F.when(h.rlike(r"^(?:[\d.]+|\[.*\])$") | (n < 3), h).otherwise(last)


@dataclass(frozen=True)
class Scope:
    """Hosts that belong to a run."""

    start_url: str
    scheme: str
    hostname: str
    registrable_domain: str
    allow_subdomains: bool
    port: int | None

    @classmethod
    def of(cls, start_url: str, allow_subdomains: bool = False) -> Scope:
        url = start_url.strip()
        if not url:
            raise ValueError("URL is empty")
        url = "https:" + url if url.startswith("//") else url if re.match("(?i)https?://", url) else "https://" + url
        m = re.match(_AUTHORITY, url)
        h = (m[2] if m else "").lower().rstrip(".")
        if not h:
            raise ValueError("URL has no host")
        port = int(m[3]) if m[3] else None
        scheme = m[1].lower()
        return cls(url, scheme, h, registrable(h), allow_subdomains, None if port == {"http": 80, "https": 443}[scheme] else port)

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.hostname}" + (f":{self.port}" if self.port else "")

    def allows(self, h: Column) -> Column:
        same = h == self.hostname
        if self.allow_subdomains:
            same = same | (h == self.registrable_domain) | h.endswith("." + self.registrable_domain)
        return F.coalesce(same, F.lit(False))

    def internal(self, url: Column) -> Column:
        return self.allows(host(url))


def alternation(patterns: tuple[str, ...]) -> str:
    """One case-insensitive pattern for all; those that aren't valid are taken literally."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            p = re.escape(p)
        out.append(f"(?:{p})")
    return "(?i)" + "|".join(out)


def skip_reason(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = EXCLUDE_PATTERNS) -> Column:
    out = F.when(url.rlike(alternation(exclude or EXCLUDE_PATTERNS)), "exclude_pattern")
    return out.when(~url.rlike(alternation(include)), "include_pattern") if include else out


# Media types.
def is_html_type(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)text/html|application/xhtml\+xml"), F.lit(False))


def is_pdf_type(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)application/pdf|application/x-pdf"), F.lit(False))


def is_xml_type(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)xml|gzip"), F.lit(False))


def sniff_html(body: Column) -> Column:
    return F.substring(body, 1, 512).rlike(r"(?is)^\s*<(?:!doctype html|html)")
