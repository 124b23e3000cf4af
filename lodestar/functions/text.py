"""Text expressions: white space, truncation, context windows, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_ws(c: Column) -> Column:
    """Runs of white space (Unicode) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nonblank(c: Column) -> Column:
    """Null for empty strings, which count as absent."""
    return F.nullif(c, F.lit(""))


def either(*cs: Column) -> Column:
    """The first that is neither null nor empty; else the last as it is."""
    return F.coalesce(*(nonblank(c) for c in cs[:-1]), cs[-1])


def truncate(c: Column, limit: int) -> Column:
    flat = collapse_ws(c)
    short = F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(short)


def window_context(text: Column, start: Column, end: Column, radius: int = 150) -> Column:
    """The text around [start, end), with marks where it is cut."""
    left = F.greatest(start - radius, F.lit(0))
    right = F.least(end + radius, F.char_length(text))
    cut = F.substring(text, left + 1, right - left)
    marked = F.concat(F.when(left > 0, "…").otherwise(""), cut, F.when(right < F.char_length(text), "…").otherwise(""))
    return F.when(start.isNull() | end.isNull(), truncate(text, 2 * radius)).otherwise(collapse_ws(marked))


def page_window(text: Column, start: Column, end: Column, radius: int = 150) -> Column:
    """As window_context, without marks."""
    left = F.greatest(start - radius, F.lit(0))
    cut = F.substring(text, left + 1, F.least(end + radius, F.char_length(text)) - left)
    return collapse_ws(F.when(start.isNull() | end.isNull(), F.substring(text, 1, 2 * radius)).otherwise(cut))


def join_list(c: Column) -> Column:
    return F.coalesce(F.array_join(c, " | "), F.lit(""))
