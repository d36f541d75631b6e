"""Conversations: question and answer pairs, and what came before a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def turns_in_order() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("turn")


def qa_pairs(turns: DataFrame) -> DataFrame:
    """User turns with the assistant's turn that follows: ``conv_id, turn, question, answer``."""
    said = turns.withColumns({"_role": F.lead("role").over(turns_in_order()), "answer": F.lead("text").over(turns_in_order())})
    return said.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def recent_history(pairs: DataFrame, most: int = 3, answer_chars: int = 200) -> DataFrame:
    """``pairs`` with ``history``: up to ``most`` pairs before, as Q and A lines; blank questions are left out after the cut."""
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    window = turns_in_order().rowsBetween(-most, -1)
    before = F.collect_list(F.struct(trim(F.col("question")).alias("q"), F.substring(trim(F.col("answer")), 1, answer_chars).alias("a"))).over(window)
    lines = F.transform(F.filter("_before", lambda p: p["q"] != ""), lambda p: F.concat(F.lit("Q: "), p["q"], F.lit("\nA: "), p["a"]))
    return pairs.withColumn("_before", before).withColumn("history", F.array_join(lines, "\n")).drop("_before")
