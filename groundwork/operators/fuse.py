"""Fusing, reranking and merging ranked lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v

WORD = re.compile("[a-z0-9]+")

#: Pairs (question, text) to scores, a batch at a time.
PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def token_overlap(question: pd.Series, text: pd.Series) -> pd.Series:
    """Stand-in for a cross-encoder: the share of a question's distinct words that the text has. Each distinct string of a batch is read once."""
    words = {x: set(WORD.findall((x or "").lower())) for x in {*question, *text}}
    return pd.Series([len(words[q] & words[t]) / max(1, len(words[q])) for q, t in zip(question, text, strict=True)], dtype="float64")


def rrf(dense: DataFrame, sparse: DataFrame, by: list[str], k: int = v.RRF_K) -> DataFrame:
    """``by, id, rrf_score, dense_rank, sparse_rank, rank`` from two ranked lists; ties as in the dense list, then the sparse one."""
    one = lambda df, name: df.select(*by, "id", *(F.col("rank").alias(c) if c == name else F.lit(None).cast("int").alias(c) for c in ("dense_rank", "sparse_rank")))
    both = one(dense, "dense_rank").unionByName(one(sparse, "sparse_rank")).groupBy(*by, "id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    order = Window.partitionBy(*by).orderBy(F.col("rrf_score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return both.withColumn("rrf_score", part("dense_rank") + part("sparse_rank")).withColumn("rank", F.row_number().over(order))


def rerank(fused: DataFrame, scorer: PairScorer | None, top_k: int, by: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """The ``top_k`` of each group by the scorer, ties in fused order; without a scorer in fused order, with null scores.

    ``fused``: by, id, rank, question, text. Columns to ``drop`` leave the task that scores them no more.
    """
    if scorer is None:
        scored = fused.drop(*drop).withColumn("rerank_score", F.lit(None).cast("double"))
        order = [F.col("fused_rank")]
    else:
        kinds = [f for f in fused.schema if f.name not in drop]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(rerank_score=scorer(batch["question"], batch["text"])).drop(columns=list(drop))

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "rerank_score double"])
        scored = fused.mapInPandas(run, schema)
        order = [F.col("rerank_score").desc(), F.col("fused_rank")]
    scored = scored.withColumnRenamed("rank", "fused_rank")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top_k)


def merge_scopes(hits: DataFrame, n_scopes: DataFrame | None = None) -> DataFrame:
    """One list a question from its scopes' lists: in scope order, the first occurrence of an id counting. ``pos`` from 1."""
    first = F.row_number().over(Window.partitionBy("question_id", "id").orderBy("scope_no", "rank"))
    once = hits.withColumn("_first", first).where("_first = 1").drop("_first")
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy("scope_no", "rank")))


def provenance(fused: DataFrame, by: list[str]) -> DataFrame:
    """``found_by`` (``D#r+S#r``) and the numbers of dense and sparse hits of the list."""
    mark = F.concat_ws("+", F.concat(F.lit("D#"), F.col("dense_rank").cast("string")), F.concat(F.lit("S#"), F.col("sparse_rank").cast("string")))
    w = Window.partitionBy(*by)
    return fused.withColumns({"found_by": mark, "n_dense": F.count("dense_rank").over(w), "n_sparse": F.count("sparse_rank").over(w)})
