"""Scalar text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v


def stripped(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, repeats kept; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def fiscal_year_of(html: Column) -> Column:
    """The year of the first date-like run in the first 5,000 characters, or ``unknown``."""
    found = F.regexp_extract(F.substring(html, 1, 5000), r"(20\d{2})\d{2}\d{2}", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def compact_markdown(md: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(md, "-{3,}", "---"), " {2,}", " ")


def is_real_table(md: Column) -> Column:
    """Three line ends or more, over 15 digits, over 80 characters."""
    digits = F.length(F.regexp_replace(md, "[^0-9]", ""))
    return F.coalesce((F.regexp_count(md, F.lit("\n")) >= 3) & (digits > 15) & (F.length(md) > 80), F.lit(False))


def keeps_piece(kind: Column, text: Column) -> Column:
    """Prose over 100 characters, tables over 20."""
    return F.length(text) > F.when(kind == "table", v.MIN_TABLE_CHARS).otherwise(v.MIN_PROSE_CHARS)


def chunk_id(company: Column, year: Column, section: Column, kind: Column, text: Column, digits: int = 8) -> Column:
    return F.concat_ws("-", company, year, section, kind, F.substring(F.md5(text), 1, digits))


def find_sections(text: Column, patterns: tuple[tuple[str, str], ...] = v.SECTIONS) -> Column:
    """Sorted (start, tag) of the last match of each pattern; offsets from 0."""

    def last(tag: str, pattern: str) -> Column:
        # The greedy prefix of a match is as long as can be, so it ends where the last match starts.
        prefix = F.regexp_extract(text, f"(?is)^(.*){pattern}", 1)
        return F.when(text.rlike(f"(?i){pattern}"), F.struct(F.length(prefix).alias("start"), F.lit(tag).alias("tag")))

    return F.array_sort(F.array_compact(F.array(*(last(t, p) for t, p in patterns))))


def section_at(pos: Column, bounds: Column) -> Column:
    """The tag of the last boundary at or before a position; ``other`` before all of them or without a position."""
    before = F.filter(bounds, lambda b: b["start"] <= pos)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["tag"], F.lit("other"))


def slice_prose(text: Column, bounds: Column) -> Column:
    """(tag, segment) between boundaries; what leads up to the first is ``other`` if over 200 characters."""
    none = F.size(bounds) == 0
    first = F.try_element_at(bounds, F.lit(1))["start"]
    end = lambda i: F.coalesce(F.get(bounds, i + 1)["start"], F.length(text))
    parts = F.transform(bounds, lambda b, i: F.struct(b["tag"].alias("tag"), F.substring(text, b["start"] + 1, end(i) - b["start"]).alias("segment")))
    other = lambda part: F.array(F.struct(F.lit("other").alias("tag"), part.alias("segment")))
    lead = F.when(first > v.LEAD_OTHER_CHARS, other(F.substring(text, F.lit(1), first))).otherwise(F.filter(other(text), lambda _: F.lit(False)))
    return F.when(none, other(text)).otherwise(F.concat(lead, parts))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
