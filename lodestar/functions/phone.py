"""North American phone numbers as native columns, and as plain Python for spans in text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of a number, an extension, and of what only looks like a number.
NUMBER = r"(?:\+?1[\s.\-()]*)?(?:\(?\d{3}\)?[\s.\-]*)\d{3}[\s.\-]*\d{4}"
EXTENSION_TAIL = r"(?:\s*(?:ext\.?|extension|x)\s*\.?\s*\d{1,6})?"
EXTENSION = r"(?:ext(?:ension)?\.?|x)\s*\.?\s*(\d{1,6})\b"
HINTS = r"\b(?:zip(?:\s*code)?|isbn|invoice|order\s*#|student\s*id|ip\s*address|year)\b"
ADDRESS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
DATE = r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2}\b"
#: Characters around a candidate in which a hint counts, and behind it in which an extension does.
HINT_RADIUS, TAIL = 40, 24
#: Area codes by the numbering plan: no N11, no N9X, no 37X and 96X, which are kept free.
AREA = r"(?!\d11|37|96)[2-9][0-8]\d"
# Country calling codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

CANDIDATE = rf"(?iU)(?<!\w){NUMBER}{EXTENSION_TAIL}(?!\w)"


def candidates(text: Column) -> Column:
    """array<string>: non-overlapping candidates in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CANDIDATE})"), F.lit(1))


def parsed(raw: Column, extension: Column | None = None) -> Column:
    """struct of a raw number: extension, validation_status, e164, national, normalized, country_code, notes."""
    raw = F.trim(raw)
    own = F.nullif(F.regexp_extract(raw, f"(?i){EXTENSION}", 1), F.lit(""))
    ext = own if extension is None else F.coalesce(F.nullif(extension, F.lit("")), own)
    body = F.when(own.isNotNull() & (ext == own), F.regexp_replace(raw, f"(?is){EXTENSION}.*$", "")).otherwise(raw) if extension is None else raw
    digits = F.regexp_replace(body, r"\D", "")
    foreign = body.rlike(r"^\s*\+") & ~digits.startswith("1")
    n = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    ten, seven = ~foreign & (F.length(n) == 10), ~foreign & (F.length(n) == 7)
    valid = ten & n.rlike(rf"^{AREA}[2-9]\d{{6}}$")
    abroad = foreign & F.length(digits).between(8, 15)
    possible = ten | seven | abroad
    status = F.when(valid, "VALID").when(possible, "POSSIBLE").otherwise("INVALID")
    notes = F.when(F.length(digits) < 2, "parse_failed").when(valid, None).when(possible, "possible_not_fully_valid").otherwise("invalid_number")
    code = F.regexp_extract(digits, f"^({'|'.join(sorted(SHORT_CODES, key=len, reverse=True))}|\\d{{3}})", 1)
    rest = F.substring(digits, F.length(code) + 1, F.lit(15))
    e164 = F.when(ten | seven, F.concat(F.lit("+1"), n)).when(abroad, F.concat(F.lit("+"), digits))
    part = lambda a, k: F.substring(n, a, k)
    national = (
        F.when(ten, F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4)))
        .when(seven, F.concat(part(1, 3), F.lit("-"), part(4, 4)))
        .when(abroad, rest)
    )
    normalized = (
        F.when(ten, F.concat_ws("-", part(1, 3), part(4, 3), part(7, 4)))
        .when(abroad & (F.length(rest) == 10), F.concat_ws("-", F.substring(rest, 1, 3), F.substring(rest, 4, 3), F.substring(rest, 7, 4)))
        .otherwise(national)
    )
    country = F.when(ten | seven, F.lit(1)).when(abroad, code.cast("int"))
    return F.struct(ext.alias("extension"), status.alias("validation_status"), e164.alias("e164"), national.alias("national"), normalized.alias("normalized"), country.alias("country_code"), notes.alias("notes"))


def tel_href(href: Column) -> tuple[Column, Column]:
    """Number and extension of a tel: link."""
    raw = F.replace(F.trim(F.regexp_replace(href, "(?i)^tel:", "")), F.lit("%20"), F.lit(" "))
    number, tail = F.regexp_extract(raw, r"^([^;,]*)", 1), F.regexp_extract(raw, r"^[^;,]*[;,](.*)$", 1)
    ext = F.coalesce(F.nullif(F.regexp_extract(tail, r"(?i)ext(?:ension)?=(\d{1,6})", 1), F.lit("")), F.nullif(F.regexp_extract(tail, r"(\d{1,6})", 1), F.lit("")))
    return number, ext


def false_positive(raw: Column, around: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    return raw.rlike(f"{ADDRESS}|{DATE}") | (F.length(digits).between(4, 5) & ~F.trim(raw).startswith("+")) | around.rlike(f"(?i){HINTS}")


def dedupe_key(e164: Column, normalized: Column, extension: Column, raw: Column) -> Column:
    """Numbers group by e164, else by the normalized form, else by the raw text; each with the extension."""
    number = F.coalesce(F.nullif(e164, F.lit("")), F.nullif(normalized, F.lit("")), F.concat(F.lit("raw:"), raw))
    return F.concat(number, F.lit("|"), F.coalesce(F.trim(extension), F.lit("")))


def status_rank(status: Column) -> Column:
    return F.when(status == "VALID", 3).when(status == "POSSIBLE", 2).otherwise(1)


# --- the same for one text, with spans ---

#: What may stand between the digits of a number with a country code, at most four at a place.
MARKS = r"[ \xa0\xad\u200b\u2060\u3000()（）\[\]［］.\-‐-―−/~]"
#: A plus and 8 to 15 digits, of which the first isn't 1; it ends before a North American number.
FOREIGN = rf"(?<![\w+])\+{MARKS}{{0,4}}[2-9](?:{MARKS}{{0,4}}\d){{7}}(?:(?!{MARKS}{{1,4}}{NUMBER}(?!\w)){MARKS}{{0,4}}\d){{0,7}}(?!\w)"

_foreign = re.compile(FOREIGN)
_candidate = re.compile(rf"(?<!\w){NUMBER}{EXTENSION_TAIL}(?!\w)", re.I)
_extension, _hints, _not_number = re.compile(EXTENSION, re.I), re.compile(HINTS, re.I), re.compile(f"{ADDRESS}|{DATE}")
_valid = re.compile(rf"{AREA}[2-9]\d{{6}}")


@dataclass
class Number:
    raw: str
    extension: str | None = None
    status: str = "INVALID"
    e164: str | None = None
    national: str | None = None
    normalized: str | None = None
    country_code: int | None = None
    notes: str | None = None
    start: int | None = None
    end: int | None = None


def parse_number(raw: str, extension: str | None = None) -> Number:
    out = Number(raw.strip(), extension or None)
    body = out.raw
    if not out.extension and (m := _extension.search(body)):
        out.extension, body = m[1], body[: m.start()].strip()
    digits = re.sub(r"[^0-9]", "", body)
    if len(digits) < 2:
        out.notes = "parse_failed"
        return out
    if body.startswith("+") and digits[0] != "1":
        if not 8 <= len(digits) <= 15:
            out.notes = "invalid_number"
            return out
        code = next((digits[:k] for k in (2, 1) if digits[:k] in SHORT_CODES), digits[:3])
        rest = digits[len(code) :]
        out.e164, out.national, out.country_code = f"+{digits}", rest, int(code)
        out.normalized = f"{rest[:3]}-{rest[3:6]}-{rest[6:]}" if len(rest) == 10 else rest
    else:
        n = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        if len(n) not in (7, 10):
            out.notes = "invalid_number"
            return out
        out.e164, out.country_code = f"+1{n}", 1
        if len(n) == 10:
            out.national, out.normalized = f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}"
            if _valid.fullmatch(n):
                out.status = "VALID"
                return out
        else:
            out.national = out.normalized = f"{n[:3]}-{n[3:]}"
    out.status, out.notes = "POSSIBLE", "possible_not_fully_valid"
    return out


def scan(text: str) -> list[Number]:
    """Candidates of a text in order: numbers with a foreign country code, and North American ones that don't overlap them. Valid and
    foreign numbers may take an extension from the characters behind them; candidates near a hint are kept as invalid."""
    foreign = [(m.start(), m.end(), True) for m in _foreign.finditer(text)] if "+" in text else []
    spans = [(m.start(), m.end(), False) for m in _candidate.finditer(text)]
    if foreign:
        spans = sorted(foreign + [(a, b, f) for a, b, f in spans if not any(a < y and b > x for x, y, _ in foreign)])
    out = []
    for start, end, abroad in spans:
        raw = text[start:end]
        around = text[max(0, start - HINT_RADIUS) : end + HINT_RADIUS]
        digits = re.sub(r"\D", "", raw)
        if _not_number.search(raw) or (len(digits) in (4, 5) and not raw.strip().startswith("+")) or _hints.search(around):
            out.append(Number(raw, notes="false_positive_hint", start=start, end=end))
            continue
        got = parse_number(raw)
        if (abroad or got.status == "VALID") and got.extension is None:
            tail = text[end : end + TAIL]
            found = _extension.match(tail.strip()) or _extension.search(tail)
            got.extension = found[1] if found else None
        got.start, got.end = start, end
        out.append(got)
    return out
