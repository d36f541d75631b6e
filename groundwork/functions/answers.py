"""What answers and labels say: citations, refusals, numbers, expected sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v


def bare(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_refusal(text: Column, sentinel: str = v.REFUSAL_TEXT) -> Column:
    return F.coalesce(bare(text) == re.sub("[^a-z0-9]", "", sentinel.lower()), F.lit(False))


def cited_numbers(text: Column) -> Column:
    """Distinct numbers in ``[n]`` marks, sorted; numbers beyond a long are left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def citation_split(numbers: Column, excerpts: Column) -> tuple[Column, Column]:
    """(numbers of given excerpts, numbers of none)."""
    real = lambda n: (n >= 1) & (n <= excerpts)
    return F.filter(numbers, real), F.filter(numbers, lambda n: ~real(n))


def primary_number(text: Column) -> Column:
    """The longest number of at least four digits and commas, without commas; the first of equals; else null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]{3,})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.aggregate(found, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))


def numeric_match(reference: Column, response: Column) -> Column:
    target = primary_number(reference)
    return F.coalesce(F.contains(F.replace(response, F.lit(","), F.lit("")), target), F.lit(False))


def parse_relevant(spec: Column) -> Column:
    """(company, year, section) of each well-formed part of ``CO FYyyyy section; ...``."""
    pattern = r"(?s)^([A-Z]+)\s+FY(\d{4})\s+(\w+)"
    parts = F.filter(F.transform(F.split(spec, ";"), lambda p: F.regexp_replace(p, r"(?U)^\s+", "")), lambda p: p.rlike(pattern))
    part = lambda p, i: F.regexp_extract(p, pattern, i)
    return F.transform(parts, lambda p: F.struct(part(p, 1).alias("company"), part(p, 2).alias("fiscal_year"), part(p, 3).alias("section")))
