"""URL filters: rules first, then a path-template tree with labelled purity.

Every URL is cut into host and path. A list of rules (a policy file, so small)
decides where one fits. For the rest, paths become templates. Digit runs within
a segment are one wildcard ``#``; then, from the host down to the last segment,
siblings are merged by what their labelled pages say. Levels without a branch are
passed over at once, so rounds follow how often paths branch and not how long they are:

- A branch needs ``least_labels`` labelled pages to be compared. Those with fewer,
  as the slugs of a variable segment have, are one wildcard of their own: nothing
  is known of each, so they are merged with one another and with no other.
- The others are on the side above or below their common share of bad pages. If
  the sides differ by more than ``z`` standard errors they stay apart, as ``*!`` and
  ``*``. A branch that differs so from its side's other members keeps its name,
  however many siblings there are; the others are one wildcard.

A template is blocked when it has ``least_labels`` labelled pages and the share of
bad among them, smoothed by ``strength`` pages of the overall share, is over
``threshold``.

Pages are first summed by host and digit-free path, so the tree works on counts.
Its totals are partial aggregates and joins, never windows, so a host with a
third of all pages is summed before it moves. Only DataFrame operations are used.

Defined results: a null URL or one without ``://`` has empty host and path, and
is allowed unless the empty host's template is impure. Slashes in a row are one,
and those at the end of a path count for nothing. Pages without a label
count for no purity. Several labels of a page count once each. Repeated rows get
a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest of ``rules`` (verdict, host with path) that fits the host or a parent domain of it."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decided)).otherwise(verdict)
    return name, verdict


def _levels(path: Column) -> Column:
    """All segments, with digit runs as ``#``; one empty segment for an empty path."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", ""), "[0-9]+", "#")
    return F.split(plain, "/")


def _apart(n1: str, b1: str, n2: str, b2: str, z: float) -> Column:
    """Whether the shares b1 of n1 and b2 of n2 differ by more than ``z`` standard errors, pooled; false if there is nothing to compare."""
    error = f"sqrt(cast({b1} + {b2} as double) * ({n1} + {n2} - {b1} - {b2}) * {n1} * {n2} / nullif({n1} + {n2}, 0))"
    return F.expr(f"coalesce(abs(cast({b1} as double) * {n2} - cast({b2} as double) * {n1}) > {z}D * {error}, false)")


def _named(children: DataFrame, z: float, least_labels: int) -> DataFrame:
    """``host, prefix, child, name, leaves`` of siblings (with counts ``cn`` and ``cb``): the name of their branch of the tree."""
    by = ["host", "prefix"]
    # Branches with enough labels are on the side above or below their common share.
    seen = (F.col("child") != "") & (F.col("cn") >= least_labels)
    if_seen = lambda c: F.when(F.col("seen"), F.col(c))
    nodes = children.withColumn("seen", seen)
    parents = nodes.groupBy(*by).agg(F.sum(if_seen("cn")).alias("en"), F.sum(if_seen("cb")).alias("eb"), F.count_if(F.col("seen")).alias("ek"), F.count_if((F.col("child") != "") & ~F.col("seen")).alias("rare"))
    nodes = nodes.join(parents, by).withColumn("high", F.col("seen") & (F.col("cb").cast("double") * F.col("en") > F.col("eb").cast("double") * F.col("cn")))
    high = lambda c: F.coalesce(F.sum(F.when(F.col("high"), F.col(c))), F.lit(0))
    sides = nodes.groupBy(*by).agg(high("cn").alias("hn"), high("cb").alias("hb"), F.count_if("high").alias("hk"))
    nodes = nodes.join(sides, by).withColumns({"ln": F.col("en") - F.col("hn"), "lb": F.col("eb") - F.col("hb"), "lk": F.col("ek") - F.col("hk")})
    nodes = nodes.withColumn("split", _apart("hn", "hb", "ln", "lb", z))
    # The siblings that a branch may be merged with: those of its side, or all if the sides do not differ.
    own = lambda h, low, e: F.when(~F.col("split"), F.col(e)).when(F.col("high"), F.col(h)).otherwise(F.col(low))
    nodes = nodes.withColumns({"rn": own("hn", "ln", "en") - F.col("cn"), "rb": own("hb", "lb", "eb") - F.col("cb"), "rk": own("hk", "lk", "ek")})
    merged = F.when(F.col("split") & F.col("high"), "*!").otherwise("*")
    low_merged = F.when(F.col("split"), F.col("lk")).otherwise(F.col("ek")) > 1
    name = (
        F.when(F.col("child") == "", "")
        .when(~F.col("seen"), F.when(F.col("rare") == 1, F.col("child")).when(low_merged, "*?").otherwise("*"))
        .when((F.col("rk") == 1) | _apart("cn", "cb", "rn", "rb", z), F.col("child"))
        .otherwise(merged)
    )
    return nodes.select(*by, "child", name.alias("name"), "leaves")


def _descended(tree: DataFrame) -> DataFrame:
    """``tree`` (host, levels, prefix, depth) with every node's unbranched run behind it: an only child keeps its name, so such levels need no round.

    What the least and the greatest of a node's paths have in common, all of them have.
    """
    rest = F.slice("levels", F.col("depth") + 1, F.greatest(F.size("levels") - F.col("depth"), F.lit(0)))
    ends = tree.groupBy("host", "prefix").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    differs = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False).cast("int")
    run = F.when(F.coalesce(F.get("lo", F.lit(0)), F.lit("")) == "", 0).when(differs > 0, differs - 1).otherwise(F.size("lo"))
    ends = ends.select("host", "prefix", run.alias("run"))
    passed = F.when(F.col("run") > 0, F.concat_ws("/", "prefix", F.slice("levels", F.col("depth") + 1, F.col("run")))).otherwise(F.col("prefix"))
    return tree.join(ends, ["host", "prefix"]).withColumns({"prefix": passed, "depth": F.col("depth") + F.col("run")}).drop("run")


def templates(pages: DataFrame, z: float, least_labels: int) -> DataFrame:
    """Host, digit-free ``levels``, and ``template`` for ``pages`` (host, path, bad: true, false or null) with counts.

    Returns one row for each distinct host and levels.
    """
    one = lambda cond: F.count(F.when(cond, 1))
    tree = pages.groupBy("host", _levels(F.col("path")).alias("levels")).agg(one(F.col("bad").isNotNull()).alias("n"), one(F.col("bad")).alias("b"))
    # Each round reads the one before more than once, hence the written tables; they hold counts, not pages.
    tree = written(tree.withColumns({"prefix": F.lit(""), "depth": F.lit(0)}), "url-tree")
    rounds = []
    while True:
        node = _descended(tree)
        # A path that has ended is its parent's child without a name.
        node = node.withColumn("child", F.coalesce(F.get("levels", F.col("depth")), F.lit("")))
        children = node.groupBy("host", "prefix", "child").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb"), F.count("*").alias("leaves"))
        joined = F.when(F.col("child") == "", F.col("prefix")).otherwise(F.concat_ws("/", "prefix", "name"))
        named = _named(children, z, least_labels).select("host", "prefix", "child", "leaves", joined.alias("next"))
        # Below a node with one leaf every child is an only child, so that the rest of its path is known.
        crowded = named.where("child <> ''").groupBy("host", "next").agg(F.sum("leaves").alias("all")).where("all > 1").select("host", "next", F.lit(True).alias("crowded"))
        named = named.join(crowded, ["host", "next"], "left").withColumn("open", (F.col("child") != "") & F.coalesce("crowded", F.lit(False)))
        rest = F.slice("levels", F.col("depth") + 2, F.greatest(F.size("levels") - (F.col("depth") + 1), F.lit(0)))
        place = F.when(F.col("open") | (F.col("child") == ""), F.col("next")).otherwise(F.concat_ws("/", "next", rest))
        tree = written(node.join(named, ["host", "prefix", "child"]).select("host", "levels", "n", "b", place.alias("prefix"), (F.col("depth") + 1).alias("depth"), "open"), "url-tree")
        rounds.append(tree.drop("depth"))
        tree = tree.where("open").drop("open")
        if tree.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds).where("not open").drop("open").withColumnRenamed("prefix", "template")


def judged(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    z: float = 2.58,
    strength: float = 5.0,
    threshold: float = 0.5,
    least_labels: int = 5,
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``template`` and whether that is ``impure``, of every page.

    ``labels``: ``id_col`` and ``bad`` (boolean) of some pages; without them, a page that a rule fits has the rule's verdict as its label.
    """
    cut = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if labels is None:
        known = cut.withColumn("bad", verdict == "block")
    else:
        known = cut.join(labels.where(F.col("bad").isNotNull()).select(id_col, "bad"), id_col, "left")
    tree = templates(known, z, least_labels)
    overall = tree.agg(F.sum("b") / F.nullif(F.sum("n"), F.lit(0))).first()[0] or 0.0
    pure = tree.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    blocked = pure.where((F.col("tn") >= least_labels) & ((F.col("tb") + strength * overall) / (F.col("tn") + strength) > threshold)).select("host", "template", F.lit(True).alias("impure"))
    decided = tree.select("host", "levels", "template").join(blocked, ["host", "template"], "left")
    impure = F.coalesce("impure", F.lit(False))
    return (
        cut.withColumn("levels", _levels(F.col("path")))
        .join(decided, ["host", "levels"])
        .select(id_col, "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(impure, "block").otherwise("allow")).alias("verdict"), "template", impure.alias("impure"))
    )
