"""Filings and pieces: reading, extracting, writing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions import text as t
from groundwork.functions import vocabulary as v
from groundwork.operators.ordering import running_total
from groundwork.sources import html as h

#: Characters of extracted text that a task gathers before it passes them on.
HELD = 8 << 20

PIECES = ["path", "company", "fiscal_year", "section", "type", "text", "piece_no"]


def read_filings(spark: SparkSession, root: str, glob: str = "*/*/*/primary-document.html") -> DataFrame:
    """``path, company, accession, html`` of the documents below ``root/<company>/<form>/<accession>/``."""
    files = spark.read.text(f"{root}/{glob}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return files.select("path", part(-4).alias("company"), part(-2).alias("accession"), "html")


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces from one JSON list, or from what ``write_pieces`` wrote."""
    if path.endswith(".json"):
        return spark.read.json(path, multiLine=True, schema="company string, fiscal_year string, section string, type string, text string")
    return spark.read.parquet(path)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """By company and year; rebalanced first, so that a task writes few partitions and a large one is split."""
    pieces.hint("rebalance", "company", "fiscal_year").write.mode("overwrite").partitionBy("company", "fiscal_year").parquet(path)


def write_fact_store(facts: DataFrame, path: str) -> None:
    """Full refresh, by ticker and year; files are ordered by code, so that lookups skip."""
    facts.repartition("ticker", "fiscal_year").sortWithinPartitions("ticker", "fiscal_year", "line_item_standardized", "entry_id").write.mode("overwrite").partitionBy("ticker", "fiscal_year").parquet(path)


def write_chunk_index(chunks: DataFrame, path: str) -> None:
    """Drop and rebuild; the same input gives the same index."""
    chunks.hint("rebalance", "company", "fiscal_year").write.mode("overwrite").partitionBy("company", "fiscal_year").parquet(path)


def latest_filings(filings: DataFrame, n: int = 3, by: str = "company", order: tuple[str, ...] = ("filed",)) -> DataFrame:
    """The n most recent filings of each company."""
    w = Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order))
    return filings.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def parsed(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """``filings`` without the page, with ``full_text``, ``prose_text`` and ``tables`` (``md``, ``lead``)."""
    rest = [c for c in filings.columns if c != html_col]
    schema = ", ".join([*(f"`{c}` {filings.schema[c].dataType.simpleString()}" for c in rest), "full_text string, prose_text string, tables array<struct<md:string,lead:string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("full_text", pa.string()), ("prose_text", pa.string()), ("tables", pa.list_(pa.struct([("md", pa.string()), ("lead", pa.string())])))])
        for batch in batches:
            pages, done, start, held = batch.column(len(rest)), [], 0, 0

            def out(stop: int, start: int, done: list) -> pa.RecordBatch:
                texts = [pa.array([d[i] for d in done], kinds.types[i]) for i in range(3)]
                return pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, stop - start) for i in range(len(rest))), *texts], [*rest, *kinds.names])  # noqa: B023

            for i in range(len(pages)):
                # A page is parsed, read off and let go before the next one.
                page = h.Page(pages[i].as_py())
                tables = [{"md": h.to_markdown(h.clean_table(h.grid(x))), "lead": " ".join(x.text)} for x in page.tables]
                done.append((" ".join(page.words), " ".join(page.prose), tables))
                held += sum(map(len, done[-1][:2])) + sum(len(x["md"]) for x in tables)
                if held >= HELD:
                    yield out(i + 1, start, done)
                    done, start, held = [], i + 1, 0
            if done:
                yield out(len(pages), start, done)

    # The page is the last column; Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch).
    return filings.select(*rest, html_col).mapInArrow(run, schema)


def extract_pieces(filings: DataFrame, patterns: tuple = v.SECTIONS) -> DataFrame:
    """Pieces of every filing (``path, company, html``): its tables, then its prose by section, numbered from 0."""
    years = filings.withColumn("fiscal_year", t.fiscal_year_of(F.col("html")))
    pages = parsed(years).withColumns({"full_bounds": t.find_sections(F.col("full_text"), patterns), "prose_bounds": t.find_sections(F.col("prose_text"), patterns)})
    lead = lambda x: F.substring(x["lead"], 1, v.TABLE_LOCATE_PREFIX)
    piece = lambda section, kind, text: F.struct(section.alias("section"), F.lit(kind).alias("type"), text.alias("text"))

    def table(x: Column) -> Column:
        # A table is located by the first characters of its text, if it has ten or more.
        at = F.when(F.length(x["lead"]) >= 10, F.call_function("instr", F.col("full_text"), lead(x)))
        return piece(t.section_at(F.when(at > 0, at - 1), F.col("full_bounds")), "table", x["md"])

    tables = F.transform("tables", table)
    prose = F.transform(t.slice_prose(F.col("prose_text"), F.col("prose_bounds")), lambda s: piece(s["tag"], "prose", t.stripped(s["segment"])))
    kept = F.filter(F.concat(tables, prose), lambda p: t.keeps_piece(p["type"], p["text"]))
    return pages.select("path", "company", "fiscal_year", F.posexplode(kept).alias("piece_no", "p")).select("path", "company", "fiscal_year", "p.*", "piece_no")


def first_piece_index(pieces: DataFrame) -> DataFrame:
    """``path, piece_index``: how many pieces stand before those of a path. Only counts by filing are added up."""
    return running_total(pieces.groupBy("path").agg(F.count("*").alias("n")), "path", "n", "piece_index").drop("n")


def with_piece_index(pieces: DataFrame) -> DataFrame:
    """``piece_index``: the place of a piece in the list of all, by path and number."""
    return pieces.join(first_piece_index(pieces), "path").withColumn("piece_index", F.col("piece_index") + F.col("piece_no"))


def profile(pieces: DataFrame, sections: tuple[str, ...] = (*(s for s, _ in v.SECTIONS), "other")) -> DataFrame:
    """Pieces, tables, characters and pieces by section of every filing."""
    return pieces.groupBy("path", "company", "fiscal_year").agg(
        F.count("*").alias("n_pieces"),
        F.count_if(F.col("type") == "table").alias("n_tables"),
        F.sum(F.length("text")).alias("n_chars"),
        *(F.count_if(F.col("section") == s).alias(f"n_{s}") for s in sections),
    )
