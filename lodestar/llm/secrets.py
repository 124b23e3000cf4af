"""Secret scan: fixed credential patterns, and a guess-cost dynamic programme over values in credential contexts.

guess_bits(value) is the cost in bits of the cheapest segmentation of value into common words (with case and look-alike
variants), dates, repeats, keyboard walks and brute-force spans. A value that stands behind a credential key and
costs at least min_bits becomes a span of kind guess, beside the base kinds assign, access and hex.

Null and empty texts give no spans, an empty table no rows. Rows are scanned one by one, so repeated rows give repeated results; texts of any
length are scanned whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import texts, tuned

# Fixed values of the contract: patterns and least lengths of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of [A-Z0-9] is taken whole, so runs that are too short can be passed over at once
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
KINDS = ("assign", "access", "hex", "guess")

#: A key that announces a credential (a word of its own, or a capitalised part of one), a separator, then a quoted value or a run without white space.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=(?-i:[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer)"""
    r"""["']?[ \t]*(?::=?|=>?)[ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'`,;]+))""",
    re.I | re.A,
)

#: Common password words by rank (fixed values).
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login hello princess sunshine shadow football baseball "
    "superman michael batman trustno iloveyou secret test root guest default user changeme summer winter spring autumn love angel "
    "freedom whatever ninja flower cookie computer internet server database access system example sample token key public private "
    "demo dev prod stage local home work office money king queen star tiger lion eagle bear wolf horse silver golden orange apple "
    "banana cherry coffee pepper ginger chocolate magic power killer hunter ranger soldier charlie jordan thomas robert daniel "
    "george andrew joshua matthew jessica ashley nicole hannah london paris berlin madrid the and you that this with for are not "
    "from have they will what when there which your said one all can out about time people year day way thing man world life"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
LONGEST = max(map(len, RANK))
LOOKALIKE = str.maketrans("4@310$57!", "aaeiossti")

#: Rows of a keyboard; keys are neighbours if their places differ by at most one row and one column.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (y, x) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
KEYS = sum(map(len, KEYBOARD))

#: Dates in all their lengths: year first, year last in four or two digits, a year alone.
DATES = tuple(
    re.compile(x)
    for x in (
        r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
        r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?\d\d",
        r"(?:19|20)\d\d",
    )
)
YEARS = 130
DAY_BITS, YEAR_BITS = math.log2(366) + 1.0, math.log2(YEARS)

#: Bits for each further segment, which an attacker has to place; for each further key of a walk, and each repeated character.
SEGMENT_BITS, WALK_BITS, REPEAT_BITS = 1.0, 1.5, 0.25
#: Least lengths of walks, and of repeats, which have two units at least.
LEAST_RUN = 3
UNITS = (1, 2, 3, 4)


def _class_bits(c: str, mixed: bool = False) -> float:
    """Brute force for a character: of ten digits, 26 letters (52 if both cases occur), 33 ASCII marks or a thousand others."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 * (1 + mixed) if c.isalpha() else 33)
    return math.log2(1000)


def _mixed(value: str) -> bool:
    return any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)


def _word_bits(part: str) -> float | None:
    low, extra = part.lower(), 0.0
    if part != low:
        extra = 1.0 if part[1:] == low[1:] or part.isupper() else 1.0 + sum(c.isupper() for c in part)
    if low in RANK:
        return math.log2(RANK[low] + 1) + extra
    folded = low.translate(LOOKALIKE)
    return math.log2(RANK[folded] + 1) + extra + 1.5 if folded in RANK else None


def _beside(a: str, b: str) -> bool:
    """If a walk goes from key a to key b."""
    if a == b or a not in PLACE or b not in PLACE:
        return False
    (y, x), (v, u) = PLACE[a], PLACE[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1


def segment(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """The least cost in bits of a segmentation of value, and its segments as (kind, start, end).

    best[i] is the least cost of value[:i]. Segments of any length have a state of their own: the least cost, and the start, if value[i - 1]
    belongs to a brute-force span, to a walk of at least LEAST_RUN keys, or to a repeat of a unit of 1 to 4 characters with at least two
    units. Each state goes on from the one before or starts anew, whichever is cheaper; so all starts and ends are covered, and the
    work is linear in the length but for the longest word.
    """
    n, low, none = len(value), value.lower(), (math.inf, 0)
    mixed = _mixed(value)
    bits = [_class_bits(c, mixed) for c in value]
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    loose = walk = none
    repeat, same = dict.fromkeys(UNITS, none), dict.fromkeys(UNITS, 0)
    steps = 0  # of the walk that ends here, whatever its start

    def fresh(i: int) -> float:
        """The cost of a segment's start at i."""
        return best[i] + (SEGMENT_BITS if i else 0.0)

    def offer(end: int, cost: float, kind: str, start: int) -> None:
        if cost < best[end]:
            best[end], back[end] = cost, (kind, start)

    for i in range(n):
        end, here = i + 1, fresh(i)
        for stop in range(i + 2, min(n, i + LONGEST) + 1):
            if (w := _word_bits(value[i:stop])) is not None:
                offer(stop, here + w, "word", i)
        if value[i].isdigit():
            for date in DATES:
                if m := date.match(value, i):
                    offer(m.end(), here + YEAR_BITS + (DAY_BITS if m.end() - i > 4 else 0.0), "date", i)
        loose = min((loose[0] + bits[i], loose[1]), (here + bits[i], i))
        offer(end, loose[0], "brute", loose[1])
        steps = steps + 1 if i and _beside(low[i - 1], low[i]) else 0
        if steps + 1 >= LEAST_RUN:
            start = end - LEAST_RUN
            walk = min((walk[0] + WALK_BITS, walk[1]), (fresh(start) + math.log2(KEYS) + WALK_BITS * (LEAST_RUN - 1), start))
            offer(end, walk[0], "walk", walk[1])
        else:
            walk = none
        for unit in UNITS:
            same[unit] = same[unit] + 1 if i >= unit and value[i] == value[i - unit] else 0
            least = max(LEAST_RUN, 2 * unit)
            if same[unit] >= least - unit:
                start = end - least
                began = fresh(start) + sum(bits[start : start + unit]) + REPEAT_BITS * (least - unit)
                repeat[unit] = min((repeat[unit][0] + REPEAT_BITS, repeat[unit][1]), (began, start))
                offer(end, repeat[unit][0], "repeat", repeat[unit][1])
            else:
                repeat[unit] = none
    out, i = [], n
    while i:
        kind, start = back[i]
        out.append((kind, start, i))
        i = start
    return best[n], out[::-1]


def guess_bits(value: str) -> float:
    return segment(value)[0]


#: Eight random characters of both cases, digits and marks reach it; eight lower-case letters don't.
MIN_BITS = 40.0


def find_secrets(text: str, min_bits: float = MIN_BITS, min_length: int = 8) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    keyed = text if "=" in text or ":" in text else ""  # both patterns with keys need a separator
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(keyed) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(keyed):
        value = m[m.lastindex]
        if len(value) >= min_length and guess_bits(value) >= min_bits:
            out.append((*m.span(m.lastindex), 3))
    return [(a, b, KINDS[k]) for a, k, b in sorted((a, k, b) for a, b, k in out)]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scan_secrets(documents: DataFrame, min_bits: float = MIN_BITS, min_length: int = 8) -> DataFrame:
    """One row for each row of documents (doc_id, text)."""
    tuned(documents.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                found = find_secrets(text, min_bits, min_length)
                named = [(f"{k}:{a}:{b}", k) for a, b, k in found]
                base = ",".join(x for x, k in named if k != "guess")
                count = [sum(k == kind for _, k in named) for kind in KINDS]
                rows.append((*count[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x, _ in named), count[3]))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names=names)

    return documents.select("doc_id", "text").mapInArrow(scan, SCHEMA)
