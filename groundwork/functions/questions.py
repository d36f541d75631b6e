"""What a question asks for: companies, years, metrics, route, scopes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v
from groundwork.functions.text import tokenize

SCOPES = "array<struct<company:string,fiscal_year:string>>"


def companies_in(question: Column, aliases: dict[str, str] = v.COMPANY_ALIASES) -> Column:
    """Sorted tickers of the aliases that are words of the question."""
    tokens = tokenize(question)
    names: dict[str, list[str]] = {}
    for alias, ticker in aliases.items():
        names.setdefault(ticker, []).append(alias)
    found = (F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(ticker)) for ticker, words in sorted(names.items()))
    return F.array_compact(F.array(*found))


def years_in(question: Column, valid: tuple[str, ...] = v.VALID_YEARS) -> Column:
    """Sorted valid years named in the question; where it spans a range, also those between the first and the last."""
    q = F.lower(question)
    allowed = F.array(*map(F.lit, valid))
    named = F.array_intersect(F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), F.lit(1)), allowed)
    spans = (F.size(named) >= 2) & q.rlike(rf"\b20\d{{2}}\s*{v.RANGE_WORDS}\s*20\d{{2}}\b")
    between = F.filter(allowed, lambda y: (y >= F.array_min(named)) & (y <= F.array_max(named)))
    return F.array_sort(F.when(spans, F.array_union(named, between)).otherwise(named))


def metrics_in(question: Column, phrases: tuple = v.METRIC_PHRASES) -> Column:
    """Codes of the phrases that occur as whole words, in the order of the list."""
    q = F.lower(question)
    one = lambda words: reduce(lambda a, b: a | b, (q.rlike(rf"\b{re.escape(w)}\b") for w in words))
    return F.array_compact(F.array(*(F.when(one(words), F.lit(code)) for code, words in phrases)))


def scopes_of(companies: Column, years: Column, most: int = v.MAX_SCOPES) -> Column:
    """(company, year) filters in order, the first twelve; null stands for any."""
    scope = lambda c, y: F.struct(c.cast("string").alias("company"), y.cast("string").alias("fiscal_year"))
    none = F.lit(None)
    both = F.flatten(F.transform(companies, lambda c: F.transform(years, lambda y: scope(c, y))))
    some = F.when((F.size(companies) > 0) & (F.size(years) > 0), both).when(F.size(companies) > 0, F.transform(companies, lambda c: scope(c, none)))
    return F.slice(some.otherwise(F.transform(years, lambda y: scope(none, y))), 1, most)


def route_of(question: Column, companies: Column, years: Column, metrics: Column) -> Column:
    """TABLE for a figure of a company and year, HYBRID for a figure with its reasons, else TEXT."""
    causal, topical, has = question.rlike(v.CAUSAL), question.rlike(v.QUALITATIVE), F.size(metrics) > 0
    return (
        F.when(question.rlike(v.DESCRIPTIVE) & ~causal, "TEXT")
        .when(~has, "TEXT")
        .when(causal | topical, "HYBRID")
        .when((F.size(companies) > 0) & (F.size(years) > 0), "TABLE")
        .otherwise("TEXT")
    )


def scope_key(scopes: Column) -> Column:
    """The set of scopes as a string, in one order; empty for none."""
    name = lambda s: F.concat_ws("/", F.coalesce(s["company"], F.lit("*")), F.coalesce(s["fiscal_year"], F.lit("*")))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(scopes, name))), ";")


def understood(df: DataFrame, question_col: str = "question", aliases: dict[str, str] = v.COMPANY_ALIASES, valid: tuple[str, ...] = v.VALID_YEARS) -> DataFrame:
    """``df`` with ``companies``, ``years``, ``metrics``, ``needs_explanation``, ``route`` and ``scopes``."""
    q = F.coalesce(F.col(question_col), F.lit(""))
    df = df.withColumns({"companies": companies_in(q, aliases), "years": years_in(q, valid), "metrics": metrics_in(q), "needs_explanation": q.rlike(v.CAUSAL)})
    return df.withColumns({"route": route_of(q, F.col("companies"), F.col("years"), F.col("metrics")), "scopes": scopes_of(F.col("companies"), F.col("years"))})


def query_filters(line: Column) -> Column:
    """``struct<question, company, fiscal_year>``: ``key=value`` words are filters, the last of a kind counting; the rest is the question."""
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    key = lambda w: F.lower(F.substring_index(w, "=", 1))
    value = lambda w: F.substring(w, F.locate("=", w) + 1, F.length(w))
    last = lambda names: value(F.try_element_at(F.filter(words, lambda w: F.contains(w, F.lit("=")) & key(w).isin(*names)), F.lit(-1)))
    return F.struct(
        F.array_join(F.filter(words, lambda w: ~F.contains(w, F.lit("="))), " ").alias("question"),
        F.upper(last(["company"])).alias("company"),
        last(["year", "fiscal_year"]).alias("fiscal_year"),
    )
