"""Numbered evidence for questions, and checks of supplied answers against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import answers as a
from groundwork.functions import vocabulary as v

HIT = ["question_id", "id", "text", "company", "fiscal_year", "section", "rerank_score"]


def evidence_union(excerpts: DataFrame, hits: DataFrame) -> DataFrame:
    """Fact excerpts by company and year, then text hits by ``pos``; positions 1..n for each question."""
    first = excerpts.select(*HIT, F.lit(0).alias("_from"), F.lit(0).alias("_pos"))
    then = hits.select(*HIT, F.lit(1).alias("_from"), F.col("pos").alias("_pos"))
    order = Window.partitionBy("question_id").orderBy("_from", "_pos", "company", "fiscal_year")
    return first.unionByName(then).withColumn("pos", F.row_number().over(order)).drop("_from", "_pos")


def context_block(evidence: DataFrame) -> DataFrame:
    """``question_id, context, n_excerpts``: ``[n] (CO FYyyyy, section)`` and the text, blank lines between."""
    block = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] ("), "company", F.lit(" FY"), "fiscal_year", F.lit(", "), "section", F.lit(")\n"), "text")
    blocks = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    return evidence.groupBy("question_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"), F.count("*").alias("n_excerpts"))


def verify(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``answers`` (question_id, text) with ``answer``, ``refused``, ``cited``, ``hallucinated``; without evidence the answer is the refusal."""
    counts = evidence.groupBy("question_id").agg(F.count("*").alias("n_excerpts"))
    joined = answers.join(counts, "question_id", "left").withColumn("n_excerpts", F.coalesce("n_excerpts", F.lit(0)))
    text = F.when(F.col("n_excerpts") == 0, F.lit(v.REFUSAL_TEXT)).otherwise(F.coalesce("text", F.lit("")))
    joined = joined.withColumn("answer", text).withColumn("refused", a.is_refusal(F.col("answer"))).withColumn("_numbers", a.cited_numbers(F.col("answer")))
    cited, wrong = a.citation_split(F.col("_numbers"), F.col("n_excerpts"))
    return joined.withColumns({"cited": cited, "hallucinated": wrong}).drop("_numbers", "text")


def citation_sources(verified: DataFrame, evidence: DataFrame) -> DataFrame:
    """The source of every valid citation; none for refusals."""
    numbers = verified.where(~F.col("refused")).select("question_id", F.explode("cited").alias("n"))
    sources = evidence.select("question_id", F.col("pos").cast("long").alias("n"), "company", "fiscal_year", "section", F.col("id").alias("chunk_id"))
    return numbers.join(sources, ["question_id", "n"])


def inspector_view(evidence: DataFrame) -> DataFrame:
    exact = F.coalesce(F.col("rerank_score") == float("inf"), F.lit(False))
    return evidence.select(
        "question_id", F.col("pos").alias("n"), F.when(exact, "sql").otherwise("text").alias("source"), "company", "fiscal_year", "section",
        F.when(~exact, F.round("rerank_score", 3)).alias("score"), F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, 220).alias("preview"),
    )
