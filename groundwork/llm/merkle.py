"""A Merkle manifest of a dataset: leaves, subroots by group, one root, and a proof for every row.

Every row is a leaf; each group's leaves in id order make a tree, and the groups'
roots make another. Trees are built block by block. A block is an aligned run of
nodes, ``fan ** depth`` of them at most, and keeps each of its levels as one string
of fixed-width digests: a parent is the hash of a substring as wide as its
children, and a node's siblings are the substrings at its flanks. No block needs
another one for that, as blocks are aligned. The roots of blocks are the nodes of the
next round, so rounds grow with the logarithm of the rows to base ``fan ** depth``. Places
are counted in range partitions, so a group may hold any share of the rows, and no task
holds more than a block.

Proofs are put together from the top: the row of a block gets the path from its own
root to the whole's root once, and only then are its nodes told apart.

Defined results: a field of a leaf is ``-`` if null, else its length in bytes, a colon
and its value. Null groups come first, null ids come first in a group; rows with equal
ids are ordered by their leaves, and which of two identical rows has which place cannot
be told apart. Only the columns named are read, so others may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import written
from groundwork.operators.ordering import numbered

#: Hexadecimal digits of a digest.
WIDTH = 64


def hashed(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts (binary), concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return hashed(*(field(x).cast("binary") for x in values))


def _levels(nodes: Column, n: Column, fan: int, depth: int) -> Column:
    """A block's levels as strings, from its nodes up: ``depth`` more of them if its group has other blocks, else until one node remains."""
    block = fan**depth

    def parents(level: Column) -> Column:
        runs = F.sequence(F.lit(0), ((F.octet_length(level) - 1) / (WIDTH * fan)).cast("int"))
        return F.array_join(F.transform(runs, lambda i: hashed(F.substring(level, i * (WIDTH * fan) + 1, F.lit(WIDTH * fan)))), "").cast("binary")

    def grown(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when((n > block) | (F.octet_length(last) > WIDTH), F.concat(levels, F.array(parents(last)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(nodes), grown)


def _path(levels: Column, place: Column, fan: int) -> Column:
    """Left and right siblings of the node at a place of a block (from 0), level by level; the block's root has none."""

    def flanks(i: Column) -> Column:
        level = F.element_at(levels, i + 1)
        j = F.floor(place / F.pow(F.lit(float(fan)), i)).cast("int")
        first = j - j % fan
        return F.struct(
            F.substring(level, first * WIDTH + 1, (j - first) * WIDTH).alias("left"),
            F.substring(level, (j + 1) * WIDTH + 1, (first + fan - 1 - j) * WIDTH).alias("right"),
        )

    return F.transform(F.slice(F.sequence(F.lit(0), F.size(levels)), F.lit(1), F.size(levels) - 1), flanks)


def _rounds(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """Tables of blocks, from the nodes up: ``key, n, block, members, levels, top``. ``nodes``: key, n (nodes of the key), pos, node, and what members carry."""
    block = fan**depth
    out = []
    while True:
        member = F.struct("pos", *(c for c in nodes.columns if c not in ("key", "n", "pos")))
        blocks = nodes.groupBy("key", "n", F.floor(F.col("pos") / block).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
        string = F.array_join(F.transform("members", lambda x: x["node"]), "").cast("binary")
        blocks = blocks.withColumn("levels", _levels(string, F.col("n"), fan, depth)).withColumn("top", F.element_at("levels", -1).cast("string"))
        out.append(written(blocks, f"merkle-blocks{len(out)}"))
        more = out[-1].where(F.col("n") > block)
        if more.isEmpty():
            return out
        nodes = more.select("key", F.ceil(F.col("n") / block).alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"))


def _tops(rounds: list[DataFrame], block: int) -> DataFrame:
    """``key, top``: the root of each key, which is that of the one block of its last round."""
    done = [r.where(F.col("n") <= block).select("key", "top") for r in rounds]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _proven(rounds: list[DataFrame], ends: DataFrame, fan: int, depth: int) -> DataFrame:
    """Each member of the first round with ``path``, and the columns of ``ends`` for its key. ``ends``: key, ``path`` above the key's root, and others."""
    block = fan**depth
    carry = [c for c in ends.columns if c not in ("key", "path")]
    above = None
    for level in reversed(rounds):
        last = level.where(F.col("n") <= block).join(ends, "key")
        if above is not None:
            inner = level.where(F.col("n") > block).join(above.withColumnRenamed("pos", "block"), ["key", "block"])
            last = last.unionByName(inner.select(*last.columns))
        # Siblings are taken from a block's strings in the block's own row; only what belongs to a node leaves it.
        own = lambda x: F.concat(_path(F.col("levels"), (x["pos"] % block).cast("int"), fan), F.col("path"))
        pairs = F.transform("members", lambda x: F.struct(x.alias("member"), own(x).alias("path")))
        out = last.select("key", *carry, pairs.alias("pairs")).select("key", *carry, F.explode("pairs").alias("x")).select("key", *carry, "x.member.*", "x.path")
        if level is rounds[0]:
            return out
        above = out.select("key", "pos", "path", *carry)
    raise ValueError("no rounds")


def manifest(df: DataFrame, leaf: Column, presented: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", fan: int = 2, depth: int = 10) -> DataFrame:
    """``id, leaf, subroot, root, path, presented`` of every row of ``df``.

    ``path``: the left and right siblings of each level, from the leaf to the
    root. ``presented``: another leaf that someone shows for the row, to be held
    against the path; the leaf itself where null.
    """
    block = fan**depth
    other = F.lit(None).cast("string") if presented is None else presented
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = df.select(F.col(id_col).alias("id"), key.alias("key"), leaf.alias("node"), F.nullif(other, leaf).alias("presented"))
    leaves = written(leaves.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")
    placed = written(numbered(leaves, ["key", "id", "node", "_tie"], "no", 0).drop("_tie"), "merkle-places")
    sizes = placed.groupBy("key").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    nodes = placed.join(sizes, "key").select("key", "n", (F.col("no") - F.col("first")).alias("pos"), "node", "id", "presented")
    # Written, so that blocks are dealt out by themselves and not by the key that the join has dealt by.
    rounds = _rounds(written(nodes, "merkle-nodes"), fan, depth)

    tops = written(_tops(rounds, block), "merkle-subroots")
    whole = numbered(tops, ["key"], "pos", 0).select(F.lit("").alias("key"), F.lit(tops.count()).cast("long").alias("n"), "pos", F.col("top").alias("node"), F.col("key").alias("name"))
    upper = _rounds(whole, fan, depth)
    none = F.transform(F.array().cast("array<int>"), lambda _: F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right")))
    root = _tops(upper, block).select("key", none.alias("path"), F.col("top").alias("root"))
    ends = written(_proven(upper, root, fan, depth).select(F.col("name").alias("key"), "path", F.col("node").alias("subroot"), "root"), "merkle-ends")
    return _proven(rounds, ends, fan, depth).select("id", F.col("node").alias("leaf"), "subroot", "root", "path", F.coalesce("presented", "node").alias("presented"))


def siblings(path: Column) -> Column:
    """All siblings of a path as one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"]).cast("string")), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, x: hashed(x["left"], node.cast("binary"), x["right"]))
