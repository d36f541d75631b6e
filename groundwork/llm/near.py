"""Near-duplicate classes: BagMinHash signatures, bands, and verified multiset overlap.

1. Each row gets a digest of its shingle multiset and its band hashes. Rows with
   equal multisets share a digest and go on as one: exact copies never meet.
2. Rows that share a band are candidates. Their elements (occurrences of
   shingles) are counted over all candidates. Elements that no other candidate
   has cannot overlap with anything, and the others are counted in ``GROUPS`` by
   hash. Two rows overlap by no more than the sum of the lesser counts, so rows
   and pairs that cannot reach the threshold are out, with certainty.
3. A bucket compares its members with its centre only, the member with the
   smallest share of elements of its own. Pairs that overlap by ``threshold`` are
   links; connected components follow.
4. Where a bucket still holds several components, its members are told apart by
   their differences from the centre: the elements that only one of the two has.
   Two members differ by what their differences do not share, so a member that
   is no link of the centre can only link to one with which it shares a
   difference, and that one must share nearly half of its own (``needed``). First
   each difference compares its holders with the one nearest to the centre; then
   what is still apart is joined on differences, of which one side offers just so
   few, rarest first, that no link can be missed. Two that share too little for a
   link do not come out of that join: their places in that one order bound it.

So a class of near copies costs a few comparisons a member, what all copies have
in common is no key of any join, and no pair that shares a band and could still
join two classes is left out.

Overlap is exact: weighted Jaccard of multisets is the plain Jaccard of their
elements. Two rows at similarity s share one of the 30 bands of 5 components
with probability 1 - (1 - s^5)^30: above 0.99999 from 0.8 on.

Why differences decide: for sets x, y and a centre c let Dx be the symmetric
difference of x and c. That of x and y has |Dx| + |Dy| - 2 |Dx & Dy| elements,
and x and y are a link if it has at most k (|x| + |y|), k = (1 - threshold) / (1 +
threshold). If x is no link of c, |Dx| > k (|x| + |c|), so a link of x and y needs
2 |Dx & Dy| > |Dy| + k (|c| - |y|). Elements that c alone has are in all
differences; they are taken off on both sides. As c has the least share of
elements of its own, at least one other common difference is always needed.

Defined results: a null text counts as empty; a text without words is a class by
itself. A text of one to four words has one shingle, all its words. The row with
the least id of a class stays (null ids are the largest); of fully repeated rows
one stays. Columns that start with ``_gw_`` are taken; all others are carried,
whatever their case. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm import bagminhash as bag
from groundwork.llm.common import carried, having, written
from groundwork.llm.components import components

BANDS, ROWS = 30, 5

#: Pairs of one hub are dealt out by so many salts, and the hub's elements sent once to each that occurs.
SALTS = 64

#: Groups of elements by hash, for the bound on overlaps.
GROUPS = [f"g{i}" for i in range(32)]


def _as_longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds key, digest, number of shingles and band hashes."""
    key = TaskContext.get().partitionId() << 33
    for whole in batches:
        for start, length in bag.slices(whole.column(1)):
            batch = whole.slice(start, length)
            doc, shingle, weight = bag.shingles(batch.column(1))
            bands = bag.band_hashes(bag.signatures(doc, shingle, weight, length, BANDS * ROWS), ROWS)
            digests = []
            for salt in (1, 2):
                each = bag.mixed(bag.mixed(shingle ^ np.uint64(salt << 60)) + weight.astype(np.uint64))
                total = np.zeros(length, np.uint64)
                np.add.at(total, doc, each)
                digests.append(total)
            n = np.bincount(doc, weights=weight, minlength=length).astype(np.int64)
            offsets = pa.array(np.arange(length + 1, dtype=np.int32) * BANDS)
            added = [pa.array(np.arange(key, key + length)), *map(_as_longs, digests), pa.array(n), pa.ListArray.from_arrays(offsets, _as_longs(bands.ravel()))]
            key += length
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_gw_key", "_gw_d1", "_gw_d2", "_gw_n", "_gw_bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, elements) of each row."""
    for whole in batches:
        for start, length in bag.slices(whole.column(1)):
            batch = whole.slice(start, length)
            doc, element = bag.occurrences(*bag.shingles(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=length))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), _as_longs(element))], ["key", "elements"])


def _element_sets(rows: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """``key, elements`` of the rows with these keys. Their texts alone are read again."""
    texts = having(rows.select("_gw_key", text_col), keys, "_gw_key")
    return written(texts.mapInArrow(_elements, "key long, elements array<long>"), "near-sets")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, elements, own elements) as (key, number of elements, elements without the own ones, counts by group)."""
    for batch in batches:
        n, kept, counts = [], [], []
        for elements, own in zip(batch.column(1), batch.column(2), strict=True):
            values = elements.values.to_numpy()
            n.append(len(values))
            if own.is_valid:
                values = np.setdiff1d(values, own.values.to_numpy(), assume_unique=True)
            kept.append(values)
            counts.append(np.bincount(values & (len(GROUPS) - 1), minlength=len(GROUPS)))
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in kept])]).astype(np.int32)
        arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))
        by_group = np.array(counts, np.int32).reshape(-1, len(GROUPS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), arrays, *(pa.array(np.ascontiguousarray(by_group[:, i])) for i in range(len(GROUPS)))], ["key", "n", "elements", *GROUPS])


def _common_elements(sets: DataFrame) -> DataFrame:
    """``key, n, elements, g0..``: of each candidate the number of its elements, those that others have, and these by group."""
    single = sets.select("key", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1")
    own = single.groupBy("key").agg(F.collect_list("e").alias("own"))
    schema = "key long, n int, elements array<long>, " + ", ".join(f"{g} int" for g in GROUPS)
    return written(sets.join(own, "key", "left").select("key", "elements", "own").mapInArrow(_shared, schema), "near-common")


def _beside(pairs: DataFrame, hub: str, other: str, table: DataFrame) -> DataFrame:
    """``pairs`` joined with ``table`` on ``hub``, which may stand in any share of them."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    copies = salted.select(hub, "_salt").distinct().join(table, hub)
    return salted.join(copies, [hub, "_salt"]).drop("_salt")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a``, a hub, and ``b``) with the sizes and sets of both and ``both``, their exact overlap."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"{x}_n"), F.col("elements").alias(f"{x}_set"))
    return _beside(pairs.join(side("b"), "b"), "a", "b", side("a")).withColumn("both", F.size(F.array_intersect("a_set", "b_set")))


def _reach(both: Column, threshold: float) -> Column:
    """Whether an overlap makes a link. Bounds use this form too, so that a pair of exactly the threshold is not lost to rounding."""
    return both >= threshold * (F.col("a_n") + F.col("b_n") - both)


def _fitting(pairs: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, a hub, and ``b``) that sizes and group counts allow to be links."""
    side = lambda x: counts.select(*(F.col(c).alias(x if c == "rep" else f"{x}_{c}") for c in counts.columns))
    bound = _reach(F.least("a_common", "b_common"), threshold) & _reach(reduce(add, (F.least(f"a_{g}", f"b_{g}") for g in GROUPS)), threshold)
    return _beside(pairs.join(side("b"), "b"), "a", "b", side("a")).where(bound).select("a", "b")


def _linked(pairs: DataFrame, counts: DataFrame, sets: DataFrame, threshold: float, labels: DataFrame | None) -> DataFrame:
    """Labels of the components that the links among ``pairs`` make of those of ``labels``."""
    # Both steps use their pairs twice: unless these are written, one plan has four times all that finds them.
    pairs = written(pairs.distinct(), "near-pairs")
    if labels is not None and pairs.isEmpty():
        return labels
    found = _compared(written(_fitting(pairs, counts, threshold), "near-fitting"), sets)
    links = written(found.where(_reach(F.col("both"), threshold)).select("a", "b"), "near-links")
    if labels is not None:
        if links.isEmpty():
            return labels
        links = links.unionByName(labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))
    return components(links)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _open(rows: DataFrame, by: str) -> DataFrame:
    """The rows (with ``label``) of groups that hold more than one component."""
    return rows.join(rows.groupBy(by).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(by), by)


def _differences(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``centre, rep, dn, needed, far, d`` of each pair of a centre and a member.

    ``d``: the elements, other than those of one row alone, that only one of the
    two has; ``dn``: the number of all that only one has; ``far``: no link; ``needed``:
    how many of ``d`` a far member must share with this one to be its link; ``s0``,
    ``s1``: which remainders of 64 the elements of ``d`` and their upper bits have.
    """
    k = (1 - threshold) / (1 + threshold)
    own = F.col("a_n") - F.size("a_set")
    # The small term is on the safe side of rounding.
    needed = F.floor((F.col("dn") + k * (F.col("a_n") - F.col("b_n"))) / 2 - 1e-9) + 1 - own
    out = _compared(pairs.select(F.col("centre").alias("a"), F.col("rep").alias("b")), sets)
    out = out.withColumn("dn", F.col("a_n") + F.col("b_n") - 2 * F.col("both")).select(
        F.col("a").alias("centre"),
        F.col("b").alias("rep"),
        "dn",
        needed.cast("int").alias("needed"),
        (~_reach(F.col("both"), threshold)).alias("far"),
        F.col("b_n").alias("n"),
        own.alias("own"),
        F.concat(F.array_except("a_set", "b_set"), F.array_except("b_set", "a_set")).alias("d"),
    )
    bits = lambda shift: F.aggregate("d", F.lit(0).cast("long"), lambda s, e: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(e, shift), F.lit(64)).cast("int"))))
    return written(out.withColumns({"s0": bits(0), "s1": bits(6)}), "near-differences")


def _share_enough(threshold: float, *bounds: Column) -> Column:
    """Whether ``a`` and ``b`` of one centre can share as many differences as a link needs, if they share no more than ``bounds``.

    What one has in a remainder that the other has not is not shared.
    """
    k = (1 - threshold) / (1 + threshold)
    only = lambda x, y, s: F.bit_count(F.col(f"{x}_{s}").bitwiseAND(F.bitwise_not(f"{y}_{s}")))
    most = F.least(*(F.col(f"{x}_m") - only(x, y, s) for x, y in ("ab", "ba") for s in ("s0", "s1")), *bounds)
    return 2 * (most + F.col("a_own")) >= F.col("a_dn") + F.col("b_dn") - k * (F.col("a_n") + F.col("b_n")) - 1e-9


#: What is told of a member beside each of its differences.
FACTS = ["rep", "label", "far", "n", "own", "dn", "m", "s0", "s1"]


def _listed(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each difference ``e`` of each member that can still be someone's link.

    A member that is no far one meets far ones alone, and is out where it has
    fewer differences than these must share with it. Members are dealt out
    first, since those of a large bucket come out of one task.
    """
    able = rows.withColumn("m", F.size("d")).where("far or needed <= m")
    return able.repartition("centre", "rep").select("centre", *FACTS, *more, F.explode("d").alias("e"))


def _nearest_holders(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of each far member and the holder of each of its differences that is nearest to the centre."""
    each = _listed(rows)
    nearest = each.groupBy("centre", "e").agg(*(F.min_by(c, "dn").alias(f"a_{c}") for c in FACTS), F.bool_or("far").alias("any")).where("any").drop("any")
    holds = each.where("far").select("centre", "e", *(F.col(c).alias(f"b_{c}") for c in FACTS))
    met = holds.join(nearest, ["centre", "e"]).where((F.col("a_label") != F.col("b_label")) & _share_enough(threshold))
    return met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def _with_main(rows: DataFrame) -> DataFrame:
    """``rows`` with ``main``, the largest component of each centre."""
    sizes = rows.groupBy("centre", "label").agg(F.count("*").alias("k"))
    return rows.join(sizes.groupBy("centre").agg(F.max_by("label", F.struct("k", "label")).alias("main")), "centre")


def _meeting(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """Members ``a`` and ``b`` (far) of two components beside each difference that they share and that ``a`` must offer.

    Only differences that two components hold can be shared with another one, so only
    these are counted and offered. Members of a centre's largest component meet
    those of the others alone: the members of a family never meet.

    With a threshold, a member offers and holds a difference only where those from its
    place on (``rest``) suffice for a link with that holder which needs the fewest. The
    places of all members are in one order, so this holds for the first one that two share.
    """
    each = _listed(rows, "main", "needed")
    holders, of_member = Window.partitionBy("centre", "e"), Window.partitionBy("centre", "rep")
    counts = {"many": F.count_if("far").over(holders), "lo": F.min("label").over(holders), "hi": F.max("label").over(holders)}
    if threshold is not None:
        lacks = F.col("dn") - (1 - threshold) / (1 + threshold) * F.col("n")
        counts |= {"least": F.min(lacks).over(holders), "least_far": F.min(F.when(F.col("far"), lacks)).over(holders)}
    shared = each.withColumns(counts).where("lo <> hi and many > 0").drop("lo", "hi")
    placed = shared.withColumns({"place": F.row_number().over(of_member.orderBy("many", "e")), "held": F.count("*").over(of_member)})
    placed = placed.withColumns({"rest": (F.col("held") - F.col("place") + 1).cast("int"), "offers": F.expr("place <= held - needed + 1"), "holds": F.col("far")})
    if threshold is not None:
        suffice = lambda least: 2 * (F.col("rest") + F.col("own")) >= lacks + F.col(least) - 1e-9
        placed = placed.withColumns({"offers": F.col("offers") & suffice("least_far"), "holds": F.col("holds") & suffice("least")})
    placed = written(placed.where("offers or holds").select("centre", "e", *FACTS, "rest", "main", "offers", "holds"), "near-placed")
    side = lambda df, x: df.select("centre", "e", *(F.col(c).alias(f"{x}_{c}") for c in [*FACTS, "rest"]))
    offered, holds = placed.where("offers"), placed.where("holds")
    met = side(offered.where("label <> main"), "a").join(side(holds, "b"), ["centre", "e"])
    return met.unionByName(side(offered.where("label = main"), "a").join(side(holds.where("label <> main"), "b"), ["centre", "e"]))


def _sharing(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a far member and any other of another component whose first shared difference leaves them enough to share."""
    enough = _share_enough(threshold, F.col("a_rest"), F.col("b_rest"))
    met = _meeting(rows, threshold).where(F.expr("a_label <> b_label and (not a_far or a_rep < b_rep)") & enough)
    return met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


RESULTS = ["class_id", "class_size", "kept"]


def _classified(df: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Every row with its columns, and the results by digest, both under names of our own (``_gw_``)."""
    rest = carried(df, id_col, text_col)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, text_col, *rest)), "_gw_key long, _gw_d1 long, _gw_d2 long, _gw_n long, _gw_bands array<long>"])
    rows = written(df.select(id_col, text_col, *rest).mapInArrow(_sign, schema), "near-rows")

    least = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_gw_key").alias("key")))
    digests = written(rows.where("_gw_n > 0").groupBy("_gw_d1", "_gw_d2").agg(F.min("_gw_key").alias("rep"), least.alias("least"), F.count("*").alias("n")), "near-digests")

    signed = rows.select(F.col("_gw_key").alias("rep"), "_gw_bands").join(digests.select("rep"), "rep", "left_semi")
    banded = signed.select("rep", F.explode("_gw_bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    meeting = written(banded.join(shared, "bucket"), "near-meeting")
    sets = _element_sets(rows, meeting.select(F.col("rep").alias("_gw_key")).distinct(), text_col)
    sets = _common_elements(sets)
    sizes = sets.select(F.col("key").alias("rep"), "n", F.size("elements").alias("common")).where(F.col("common") >= threshold * F.col("n"))
    members = written(meeting.join(sizes, "rep"), "near-members")
    counts = sets.select(F.col("key").alias("rep"), "n", F.size("elements").alias("common"), *GROUPS)

    centre = F.min_by("rep", (F.col("n") - F.col("common")) / F.col("n")).alias("centre")
    centred = written(members.join(members.groupBy("bucket").agg(centre, F.count("*").alias("c")).where("c > 1").drop("c"), "bucket").select("bucket", "centre", "rep"), "near-centred")
    star = centred.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    labels = _linked(star, counts, sets, threshold, None)
    apart = written(_open(_labelled(centred, labels), "bucket").where("rep <> centre").select("centre", "rep").distinct(), "near-apart")
    if not apart.isEmpty():
        differences = _differences(apart, sets, threshold)
        for candidates in (_nearest_holders, _sharing):
            # Written, so that what follows is dealt by differences and not by centre.
            left = written(_with_main(_open(_labelled(differences, labels), "centre")), "near-left")
            labels = _linked(candidates(left, threshold), counts, sets, threshold, labels)

    named = digests.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    classes = named.groupBy("label").agg(F.min("least").alias("best"), F.sum("n").alias("class_size"))
    by_digest = named.select("_gw_d1", "_gw_d2", "label").join(classes, "label").select("_gw_d1", "_gw_d2", F.col("best").alias("_gw_best"), F.col("class_size").alias("_gw_class_size"))
    return rows, by_digest


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Every row of ``df`` with ``class_id`` (the least id of its class), ``class_size`` and ``kept``; columns of ``df`` with these names, in any case, give way."""
    own = [c for c in df.columns if c.lower() not in RESULTS]
    rows, by_digest = _classified(df, id_col, text_col, threshold)
    filled = rows.where("_gw_n > 0").join(by_digest, ["_gw_d1", "_gw_d2"])
    out = filled.select(*own, F.col("_gw_best.id").alias("class_id"), F.col("_gw_class_size").alias("class_size"), (F.col("_gw_best.key") == F.col("_gw_key")).alias("kept"))
    alone = rows.where("_gw_n = 0").select(*own, F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each class, with the columns of ``df``."""
    rows, by_digest = _classified(df, id_col, text_col, threshold)
    best = by_digest.select(F.col("_gw_best.key").alias("_gw_key")).distinct()
    return having(rows.where("_gw_n > 0"), best, "_gw_key").unionByName(rows.where("_gw_n = 0")).select(*df.columns)
