"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of levels, here domain, language and source. At
each node it is shared among the children by weight. A child that cannot use its
share, because all leaves below it are short even after ``max_epochs`` passes,
takes what it can; its shortage goes to its siblings by weight. Only what a
whole family cannot use goes up and is shared among the parent's siblings.

With capacities summed up the tree beforehand, one pass down does this: children
are taken in order of capacity by weight, and the water level of a family is the
largest of (budget left) / (weight left) along that order. Each child gets the
lesser of its capacity and weight times level, in whole tokens.

A leaf with budget b and n tokens is read in full b div n times; the b mod n
tokens that are left are a prefix of its next epoch, in an order seeded by the
epoch's number. A prefix is found by running sums over ranges of that order
first, then inside ranges, so a leaf with a third of all rows is spread over
``RANGES`` tasks.

Defined results: null level values count as the name ``unknown``; a null text
has no tokens, and rows without tokens are never drawn. Unlisted children have
weight 1, and a weight of 0 draws nothing. Of fully repeated rows each is a row
of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import written

#: Ranges of the seeded order, by the first three hexadecimal digits.
RANGES = 4096


def leaf_rows(df: DataFrame, levels: dict[str, Column], tokens: Column, id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """Id (and ``row_col``), level names and ``n_tokens`` of every row of ``df``: all that mixing needs of the texts."""
    named = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(name) for name, c in levels.items()]
    return df.select(F.col(id_col), *([row_col] if row_col else []), *named, F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


def seeded(seed: int, epoch: Column, id_col: Column) -> Column:
    """Place of a row in its leaf's order of one epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_col.cast("string")))


def allocate(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (the levels and ``tokens``) with ``budget``: tokens to draw from each leaf.

    ``weights``: by level, the weight of a child name. One row for each node of
    the tree takes part; windows are by parent, so the children of one node, two
    numbers each, are put in order by one task. Leaves are not gathered.
    """
    tree = leaves.withColumn("_gw_cap", F.col("tokens") * max_epochs).withColumn("_gw_given", budget)
    for depth, level in enumerate(levels):
        parent, node = levels[:depth], levels[: depth + 1]
        listed = weights.get(level, {})
        weight = F.lit(1).cast("long")
        if listed:
            weight = F.coalesce(*(F.when(F.col(level) == name, F.lit(w).cast("long")) for name, w in listed.items()), weight)
        nodes = tree.groupBy(*node).agg(F.sum("_gw_cap").alias("_gw_c"), F.max("_gw_given").alias("_gw_b")).withColumn("_gw_w", weight)
        order = [F.expr("case when _gw_w > 0 then _gw_c / _gw_w end").asc_nulls_last(), F.col(level)]
        family = Window.partitionBy(*parent) if parent else Window.partitionBy()
        before = family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        after = family.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
        level_here = F.expr("(_gw_b - _gw_before) / nullif(_gw_left, 0)")
        nodes = (
            nodes.withColumn("_gw_before", F.coalesce(F.sum("_gw_c").over(before), F.lit(0)))
            .withColumn("_gw_left", F.sum("_gw_w").over(after))
            .withColumn("_gw_level", F.max(level_here).over(family))
            .select(*node, F.least("_gw_c", F.floor(F.coalesce(F.col("_gw_level"), F.lit(0.0)) * F.col("_gw_w"))).cast("long").alias("_gw_given"))
        )
        tree = tree.drop("_gw_given").join(nodes, node)
    return tree.drop("_gw_cap").withColumnRenamed("_gw_given", "budget")


def drawn(rows: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget_share: float, max_epochs: int, seed: int, id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """``rows`` (id, levels, ``n_tokens``) with ``full_epochs``, ``prefix_tokens`` of the next epoch, and ``drawn_tokens``.

    The budget is ``budget_share`` of all tokens. ``rows`` is read more than
    once and should be a written table. A ``row_col`` orders rows that share an id.
    """
    leaves = written(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    budget = math.floor((leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share)
    budgets = (
        allocate(leaves, levels, weights, F.lit(budget).cast("long"), max_epochs)
        .withColumn("full_epochs", F.expr("case when tokens > 0 then budget div tokens else 0 end"))
        .withColumn("_gw_prefix", F.expr("case when tokens > 0 then budget % tokens else 0 end"))
        .select(*levels, "full_epochs", "_gw_prefix")
    )
    # No broadcast hint: Spark measures the budgets (a row for each leaf), and otherwise splits a hot leaf of the join.
    ordered = rows.join(budgets, levels).withColumn("_gw_key", seeded(seed, F.col("full_epochs"), F.col(id_col))).withColumn("_gw_range", F.substring("_gw_key", 1, 3))
    cell = [*levels, "_gw_range"]
    starts = (
        ordered.groupBy(*cell)
        .agg(F.sum("n_tokens").alias("_gw_sum"))
        .withColumn("_gw_start", F.coalesce(F.sum("_gw_sum").over(Window.partitionBy(*levels).orderBy("_gw_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_gw_sum")
    )
    inside = Window.partitionBy(*cell).orderBy("_gw_key", "n_tokens", *([row_col] if row_col else [])).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_gw_prefix") - F.col("_gw_start") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return (
        ordered.join(starts, cell)
        .withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), left)).cast("long"))
        .withColumn("drawn_tokens", F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens"))
        .select(*rows.columns, "full_epochs", "prefix_tokens", "drawn_tokens")
    )


def selected(df: DataFrame, draws: DataFrame, row_col: str) -> DataFrame:
    """The rows of ``df`` of which tokens were drawn, without ``row_col``: one copy for each epoch, of the last one too if only begun.

    ``row_col`` tells the rows of ``df`` and ``draws`` apart and is never null.
    Whole texts are kept, also the one that the end of a leaf's budget cuts.
    """
    copies = F.col("full_epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0)
    taken = draws.where("drawn_tokens > 0").select(row_col, copies.cast("int").alias("_gw_copies"))
    own = [c for c in df.columns if c != row_col]
    each = F.explode(F.array_repeat(F.lit(0), F.col("_gw_copies"))).alias("_gw_copy")
    return df.join(taken, row_col).select(*own, each).select(*own)
