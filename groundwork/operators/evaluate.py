"""Scores of a run against labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions import answers as a
from groundwork.operators.ordering import running_total


def golden_guard(golden: DataFrame, allowed: DataFrame) -> DataFrame:
    """Golden rows of companies outside the allowed ones (``company``)."""
    return golden.join(allowed, "company", "left_anti")


def load_golden(golden: DataFrame, allowed: DataFrame) -> DataFrame:
    """``golden`` as it is, if all its companies are allowed; else an error that names some."""
    wrong = [r["company"] for r in golden_guard(golden, allowed).select("company").distinct().orderBy("company").take(5)]
    if wrong:
        raise ValueError(f"golden rows of companies that are not allowed: {wrong}")
    return golden


GOLDEN = "question string, ground_truth string, company string, year string, type string, expected_route string, relevant string"


def read_golden(spark: SparkSession, path: str, allowed: DataFrame) -> DataFrame:
    """A golden set under the guard: JSON, one row a line or one list, or a YAML list where a YAML library is installed.

    YAML has no distributed reader; such a set is hand-labelled and small, and is read by the driver.
    """
    if path.endswith((".yaml", ".yml")):
        import yaml

        texts = spark.read.text(path, wholetext=True).take(1)
        rows = yaml.safe_load(texts[0]["value"]) if texts else []
        names = [x.split()[0] for x in GOLDEN.split(", ")]
        golden = spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows or []], GOLDEN)
    else:
        golden = spark.read.json(path, schema=GOLDEN, multiLine=path.endswith(".json"))
    return load_golden(golden, allowed)


def retrieval_first_rank(specs: DataFrame, contexts: DataFrame) -> DataFrame:
    """``question_id, rank_strict, rank_lenient, hit_strict, hit_lenient, mrr_strict`` of every question in ``specs``.

    ``specs``: question_id and relevant, an array of (company, fiscal_year,
    section). ``contexts``: question_id, pos, company, fiscal_year, section.
    """
    wanted = specs.select("question_id", F.explode("relevant").alias("s")).select("question_id", F.col("s.company").alias("company"), F.col("s.fiscal_year").alias("fiscal_year"), F.col("s.section").alias("wanted"))
    found = wanted.join(contexts, ["question_id", "company", "fiscal_year"])
    ranks = found.groupBy("question_id").agg(F.min(F.when(F.col("section") == F.col("wanted"), F.col("pos"))).alias("rank_strict"), F.min("pos").alias("rank_lenient"))
    return specs.where(F.size("relevant") > 0).select("question_id").join(ranks, "question_id", "left").select(
        "question_id", "rank_strict", "rank_lenient",
        F.col("rank_strict").isNotNull().cast("int").alias("hit_strict"), F.col("rank_lenient").isNotNull().cast("int").alias("hit_lenient"),
        F.coalesce(F.lit(1.0) / F.col("rank_strict"), F.lit(0.0)).alias("mrr_strict"),
    )


def mean(c: Column) -> Column:
    """To three decimals; 0 of nothing."""
    return F.coalesce(F.round(F.avg(c), 3), F.lit(0.0))


def refusal_scores(rows: DataFrame) -> DataFrame:
    """``rows``: should_refuse, refused."""
    s, r = F.col("should_refuse"), F.col("refused")
    n = rows.agg(F.count_if(s & r).alias("tp"), F.count_if(s & ~r).alias("fn"), F.count_if(~s & r).alias("fp"), F.count_if(~s & ~r).alias("tn"))
    share = lambda x, y: F.coalesce(F.round(F.try_divide(x, y), 3), F.lit(0.0))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return n.select("tp", "fn", "fp", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(tp + tn, tp + fn + fp + tn).alias("accuracy"))


def retrieval_scores(ranks: DataFrame) -> DataFrame:
    return ranks.agg(mean(F.col("hit_strict")).alias("hit_strict"), mean(F.col("hit_lenient")).alias("hit_lenient"), mean(F.col("mrr_strict")).alias("mrr_strict"), F.count("*").alias("n"))


def hit_by_type(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("type").agg(mean(F.col("hit_lenient")).alias("hit_lenient"))


def numeric_accuracy(rows: DataFrame) -> DataFrame:
    """``rows``: type, should_refuse, reference, response."""
    asked = rows.where((F.col("type") == "numeric") & ~F.col("should_refuse"))
    return asked.agg(mean(a.numeric_match(F.col("reference"), F.col("response")).cast("int")).alias("numeric_accuracy"), F.count("*").alias("n"))


def hallucination_rate(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("should_refuse")).agg(mean(F.col("hallucinated").cast("int")).alias("hallucination_rate"), F.count("*").alias("n"))


def routing_scores(rows: DataFrame) -> DataFrame:
    """Accuracy of the intent where a route is expected, and the distributions of intent and executed route, as ``kind, name, value``."""
    labelled = rows.where(F.col("expected_route").isNotNull())
    right = F.coalesce((F.col("routed_intent") == F.col("expected_route")).cast("int"), F.lit(0))
    accuracy = labelled.agg(mean(right).alias("accuracy"), F.count("*").cast("double").alias("n"))
    out = accuracy.select(F.explode(F.array(*(F.struct(F.lit("score").alias("kind"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("accuracy", "n")))).alias("r")).select("r.*")
    for kind in ("routed_intent", "route"):
        out = out.unionByName(rows.groupBy(F.coalesce(kind, F.lit("?")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(kind).alias("kind"), "name", "value"))
    return out


def latency_median(rows: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """The upper median: of n values in order, the one numbered n div 2 from 0.

    Values are counted first; counts are added up over range partitions.
    """
    counts = rows.where(F.col(latency).isNotNull()).groupBy(F.col(latency).alias("value")).agg(F.count("*").alias("n"))
    placed = running_total(counts, "value", "n", "before")
    half = placed.agg(F.expr("coalesce(sum(n), 0) div 2")).first()[0]
    return placed.where(F.col("before") + F.col("n") > half).agg(F.min("value").alias("latency_median"))


def mean_numeric_columns(scores: DataFrame) -> DataFrame:
    numeric = [f.name for f in scores.schema if isinstance(f.dataType, T.NumericType)]
    return scores.agg(*(F.round(F.avg(c), 3).alias(c) for c in numeric))


def evaluate_run(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """All scores as ``kind, name, value``.

    ``rows``: question_id, type, should_refuse, refused, reference, response,
    relevant, hallucinated, routed_intent, route, expected_route, latency_ms.
    """

    def melted(kind: str, df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns))
        return df.select(F.lit(kind).alias("kind"), F.explode(pairs).alias("p")).select("kind", "p.*")

    specs = rows.where(~F.col("should_refuse")).select("question_id", a.parse_relevant(F.coalesce("relevant", F.lit(""))).alias("relevant"))
    ranks = retrieval_first_rank(specs, contexts).join(rows.select("question_id", "type"), "question_id")
    by_type = hit_by_type(ranks).select(F.lit("hit_by_type").alias("kind"), F.col("type").alias("name"), F.col("hit_lenient").alias("value"))
    out = melted("refusal", refusal_scores(rows)).unionByName(melted("retrieval", retrieval_scores(ranks))).unionByName(by_type)
    out = out.unionByName(melted("numeric", numeric_accuracy(rows))).unionByName(melted("hallucination", hallucination_rate(rows)))
    return out.unionByName(routing_scores(rows)).unionByName(melted("latency", latency_median(rows)))


def write_eval(scores: DataFrame, rows: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/rows")
