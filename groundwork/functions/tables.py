"""Markdown tables of figures: cells, years, numbers, and the canonical grid.

Everything is built-in expressions on arrays. A canonical grid is
``struct<years: array<string>, unit: string, rows: array<struct<raw_label,
vals: array<double>, standardized>>>``, with ``vals`` by position of ``years``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v
from groundwork.functions.text import stripped


def markdown_rows(md: Column) -> Column:
    """Rows of trimmed cells of the lines that start with a pipe; separator rows are left out."""
    lines = F.filter(F.transform(F.split(md, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]"), stripped), lambda x: F.startswith(x, F.lit("|")))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), stripped))
    return F.filter(cells, lambda row: F.exists(row, lambda c: ~c.rlike("^[-: ]*$")))


def as_year(cell: Column) -> Column:
    """The year that a header cell names by itself or in a date, from 2018 to 2027; else null."""
    s = stripped(cell)
    year = F.when(s.rlike(r"^20\d{2}$"), s).when(s.rlike("[A-Za-z]"), F.regexp_extract(s, r"\b(20\d{2})\b", 1)).try_cast("int")
    return F.when(year.between(v.YEAR_MIN, v.YEAR_MAX), year)


def parse_number(cell: Column) -> Column:
    """An amount; null for what is none, for percentages and for what looks like a year."""
    s = stripped(cell)
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), "[$,]", ""))
    number = bare.try_cast("double")
    year = F.when(bare.rlike(r"^20\d{2}$"), bare.try_cast("int"))
    fits = s.rlike(r"^\(?-?\$?\s?[\d,]+(?:\.\d+)?\)?$") & ~F.coalesce(year.between(v.YEAR_MIN, v.YEAR_MAX), F.lit(False))
    return F.when(fits, F.when(F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")")), -number).otherwise(number))


def detect_unit(md: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(md, r"(?i)in\s+(thousands|millions|billions)", 1)), F.lit(""))


def clean_label(cell: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(cell, r"(?U)\s+", " "), r"^[ .:*†()]+|[ .:*†()]+$", "")


def standardize_line_item(label: Column, items: tuple = v.LINE_ITEMS, excluded: tuple = v.EXCLUDED_LABEL_TERMS, max_words: int = 10) -> Column:
    """The code of a row label; null for other kinds of numbers and for sentences."""
    low = F.lower(label)
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    code = F.lit(None).cast("string")
    for name, words in reversed(items):
        code = F.when(any_of(words), name).otherwise(code)
    words = F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""))
    return F.when(~any_of(excluded) & (words <= max_words), code)


def year_columns(read: Column) -> Column:
    """``struct<row, years>`` of the first row with most years, when none comes back after another; null if under two.

    ``read``: rows of cells that have a ``year``.
    """

    def years_of(row: Column, i: Column) -> Column:
        found = F.filter(F.transform(row, lambda c: c["year"]), lambda y: y.isNotNull())
        once = F.filter(found, lambda y, j: (j == 0) | (y != F.get(found, j - 1)))
        return F.struct(F.size(once).alias("n"), (-i).alias("back"), once.alias("years"))

    rows = F.filter(F.transform(read, years_of), lambda r: (r["n"] >= 2) & (F.size(F.array_distinct(r["years"])) == r["n"]))
    best = F.array_max(rows)
    return F.when(F.size(rows) > 0, F.struct((-best["back"]).alias("row"), F.transform(best["years"], lambda y: y.cast("string")).alias("years")))


def canonical(df: DataFrame, md_col: str = "text", out: str = "canon") -> DataFrame:
    """``df`` with the canonical grid of a Markdown table, or null.

    A row counts when it has a label and as many numbers as there are year
    columns. A table with a first figure of 100.0 in a row of totals holds shares,
    and is dropped whole.
    """
    cell = lambda c: F.struct(c.alias("text"), as_year(c).alias("year"), parse_number(c).alias("number"))
    read = df.withColumn("_gw_cells", F.transform(markdown_rows(F.col(md_col)), lambda row: F.transform(row, cell)))
    read = read.withColumn("_gw_header", year_columns(F.col("_gw_cells")))

    def grid_row(row: Column) -> Column:
        names = F.filter(row, lambda c: (c["text"] != "") & c["number"].isNull() & c["year"].isNull())
        label = clean_label(F.try_element_at(names, F.lit(1))["text"])
        return F.struct(label.alias("raw_label"), F.filter(F.transform(row, lambda c: c["number"]), lambda n: n.isNotNull()).alias("vals"))

    body = F.slice("_gw_cells", F.col("_gw_header.row") + 2, F.greatest(F.size("_gw_cells"), F.lit(1)))
    read = read.withColumn("_gw_rows", F.filter(F.transform(body, grid_row), lambda r: (F.length(r["raw_label"]) >= 2) & (F.size(r["vals"]) == F.size("_gw_header.years"))))
    shares = F.exists("_gw_rows", lambda r: (F.abs(r["vals"][0] - 100.0) < 0.01) & F.lower(r["raw_label"]).rlike("revenue|net sales|total"))
    rows = F.transform("_gw_rows", lambda r: F.struct(r["raw_label"].alias("raw_label"), r["vals"].alias("vals"), standardize_line_item(r["raw_label"]).alias("standardized")))
    grid = F.struct(F.col("_gw_header.years").alias("years"), detect_unit(F.col(md_col)).alias("unit"), rows.alias("rows"))
    return read.withColumn(out, F.when((F.size("_gw_rows") > 0) & ~shares, grid)).drop("_gw_cells", "_gw_header", "_gw_rows")


def headline_rows(rows: Column, most: int = 8) -> Column:
    """Rows with a code first, then the others, each in table order."""
    return F.slice(F.concat(F.filter(rows, lambda r: r["standardized"].isNotNull()), F.filter(rows, lambda r: r["standardized"].isNull())), 1, most)


def caption(canon: Column, company: Column, year: Column, section: Column, most: int = 8) -> Column:
    """A sentence about a table from its own figures; the year shown is that of the last column."""
    latest = F.element_at(canon["years"], -1)
    figure = lambda r: F.concat(r["raw_label"], F.lit(" "), F.format_number(F.element_at(r["vals"], -1), 0), F.lit(" ("), latest, F.lit(")"))
    unit = F.coalesce(F.concat(F.lit(" (in "), canon["unit"], F.lit(")")), F.lit(""))
    return F.concat(
        company, F.lit(" FY"), year, F.lit(" "), section, F.lit(" table"), unit, F.lit(". Years: "), F.array_join(canon["years"], ", "), F.lit(". "),
        F.array_join(F.transform(headline_rows(canon["rows"], most), figure), "; "),
    )
