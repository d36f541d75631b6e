"""Facts: from tables to an exact, deduplicated store, and back to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import tables
from groundwork.functions import vocabulary as v
from groundwork.operators.ordering import numbered

FACT_COLUMNS = ["ticker", "fiscal_year", "fiscal_period", "line_item_standardized", "line_item_raw", "metric_value", "unit", "source_company_fy", "source_section", "source_table_id"]
ORDER = ["piece_index", "row_no", "year_no"]


def table_to_facts(pieces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One fact for each row and year of every table piece that has a canonical grid.

    ``pieces``: company, fiscal_year, section, type, text and ``piece_index``,
    the piece's place in the whole list, and columns to ``keep``. Facts keep their order in ``ORDER``.
    """
    grids = tables.canonical(pieces.where(F.col("type") == "table"), "text").where(F.col("canon").isNotNull())
    rows = grids.select(*keep, "company", "fiscal_year", "section", "piece_index", "canon.years", "canon.unit", F.posexplode("canon.rows").alias("row_no", "row"))
    values = rows.select("*", F.posexplode("row.vals").alias("year_no", "metric_value"))
    return values.select(
        F.col("company").alias("ticker"),
        F.get("years", F.col("year_no")).alias("fiscal_year"),
        F.lit("FY").alias("fiscal_period"),
        F.col("row.standardized").alias("line_item_standardized"),
        F.col("row.raw_label").alias("line_item_raw"),
        "metric_value",
        "unit",
        F.concat("company", F.lit(" FY"), "fiscal_year").alias("source_company_fy"),
        F.col("section").alias("source_section"),
        F.concat_ws("-", "company", "fiscal_year", F.col("piece_index").cast("string")).alias("source_table_id"),
        *ORDER,
        *keep,
    )


def dedup(facts: DataFrame) -> DataFrame:
    """One fact for each ticker, year, label (whatever its case) and value.

    The first one whose filing is of the value's own year stays, else the first.
    Pre-aggregated by key, so a value restated everywhere costs no skew. The
    place of a key's first fact is kept as ``first_seen``.
    """
    own = F.endswith("source_company_fy", F.concat(F.lit("FY"), F.col("fiscal_year")))
    place = F.struct(*ORDER)
    key = [F.col("ticker"), F.col("fiscal_year"), F.lower("line_item_raw").alias("_label"), F.col("metric_value")]
    best = facts.groupBy(*key).agg(F.min(place).alias("first_seen"), F.min_by(F.struct(*FACT_COLUMNS), F.struct(~own, place)).alias("fact"))
    return best.select("fact.*", "first_seen")


def with_entry_ids(facts: DataFrame) -> DataFrame:
    """Surrogate ``entry_id`` from 1, by the first place of each fact."""
    flat = facts.select(*FACT_COLUMNS, *(F.col(f"first_seen.{c}").alias(f"_{c}") for c in ORDER))
    return numbered(flat, [f"_{c}" for c in ORDER], "entry_id").select("entry_id", *FACT_COLUMNS)


def store_counts(facts: DataFrame) -> DataFrame:
    """Rows, rows with a code, tables."""
    return facts.agg(F.count("*").alias("n_rows"), F.count("line_item_standardized").alias("n_standardized"), F.count_distinct("source_table_id").alias("n_tables"))


def lookup(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that answer questions without ambiguity.

    ``questions``: question_id, scopes, metrics. A scope counts with both a
    company and a year; a fact counts when all values of its cell are equal to
    two decimals. Label, unit and source are those of the least entry_id.
    """
    wanted = (
        questions.select("question_id", F.posexplode("scopes").alias("scope_no", "scope"), "metrics")
        .where(F.col("scope.company").isNotNull() & F.col("scope.fiscal_year").isNotNull())
        .select("question_id", "scope_no", F.col("scope.company").alias("company"), F.col("scope.fiscal_year").alias("year"), F.posexplode("metrics").alias("metric_no", "metric"))
    )
    # A cell is settled once for all questions, before the join.
    cells = (
        facts.where(F.col("line_item_standardized").isNotNull())
        .groupBy(F.col("ticker").alias("company"), F.col("fiscal_year").alias("year"), F.col("line_item_standardized").alias("metric"))
        .agg(
            F.count_distinct(F.round("metric_value", 2)).alias("n"),
            F.min_by(F.struct(F.col("line_item_raw").alias("row_label"), F.col("metric_value").alias("value"), "unit", F.concat_ws(", ", "source_company_fy", "source_section").alias("source")), "entry_id").alias("cell"),
        )
        .where("n = 1")
        .select("company", "year", "metric", "cell.*")
    )
    return wanted.join(cells, ["company", "year", "metric"]).select("question_id", "scope_no", "metric_no", "company", "year", "metric", "row_label", "value", "unit", "source")


def to_excerpts(found: DataFrame) -> DataFrame:
    """One citable excerpt for each question, company and year, with an infinite score."""
    line = F.concat("company", F.lit(" FY"), "year", F.lit(" — "), "row_label", F.lit(": "), F.format_number("value", 0), F.coalesce(F.concat(F.lit(" "), F.nullif("unit", F.lit(""))), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("scope_no", "metric_no", line.alias("line"))))
    return found.groupBy("question_id", "company", F.col("year").alias("fiscal_year")).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines")).select(
        "question_id",
        F.concat(F.lit("tablestore::"), "company", F.lit(":"), "fiscal_year").alias("id"),
        F.concat(F.lit(v.FACTS_HEADING + "\n"), "lines").alias("text"),
        "company",
        "fiscal_year",
        F.lit("financial_data").alias("section"),
        F.lit(float("inf")).alias("rerank_score"),
    )
