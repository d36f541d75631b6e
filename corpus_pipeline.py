"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the one before it kept. All but the last
return the columns of ``documents``; the last returns the pieces of packed
sequences. Rows without an id stay if their texts do, and their pieces have no
id. Empty input gives empty output at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import exact, mixing, near, packing, quality
from groundwork.llm.common import table, written
from groundwork.llm.queries import MIX_LEVELS, MIX_WEIGHTS, mix_rows, tokenizer_path

#: The mixture keeps this share of all tokens, and no document more than once.
MIX = {"budget_share": 0.8, "max_epochs": 1, "seed": 17}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the strict policy."""
    return quality.accepted(docs, "strict-1")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the one with the least id."""
    return near.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target weights of domains, languages and sources."""
    # Ids may be null or repeated, so each row has a key of its own, fixed by writing it.
    docs = written(docs.withColumn("_gw_row", F.monotonically_increasing_id()), "mix-docs")
    rows = written(mix_rows(docs, "_gw_row"), "mix-rows")
    return mixing.selected(docs, mixing.drawn(rows, MIX_LEVELS, MIX_WEIGHTS, **MIX, row_col="_gw_row"), "_gw_row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    return packing.packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids are not to be had in SQL; tests hold the result against a plain version instead.
ORACLE_SQL = None
