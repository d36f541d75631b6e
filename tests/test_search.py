"""Ranked search against plain versions: block maxima, scopes of every shape."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundwork.operators import sparse
from groundwork.operators.sparse import Bm25Index
from groundwork.operators.texts import TextTable
from groundwork.plans import search

SCOPES = "array<struct<company:string,fiscal_year:string>>"


def plain_scores(corpus, question, k1=1.5, b=0.75):
    counts = {i: Counter((t or "").split()) for i, t, *_ in corpus}
    long = {i: sum(c.values()) for i, c in counts.items()}
    average = sum(long.values()) / len(corpus)
    df = Counter(t for c in counts.values() for t in c)
    raw = {t: math.log(len(corpus) - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else floor for t, x in raw.items()}
    out = Counter()
    for t in question.split():
        for i, c in counts.items():
            if c[t]:
                out[i] += idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * long[i] / average))
    return out


@pytest.fixture
def corpus(spark):
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(900)]
    rows = []
    for i in range(1500):
        words = rng.choices(common, k=rng.randrange(5, 25)) + rng.choices(rare, k=rng.randrange(4))
        rows.append((i, None if i % 97 == 0 else " ".join(words), f"co{i % 7}" if i % 11 else None, str(2020 + i % 3)))
    rows[40] = (40, "r1 r2 r3 c0 " * 3, "co1", "2021")
    return rows


def test_block_maxima_give_all_of_the_best(spark, corpus, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK", 16)
    df = spark.createDataFrame(corpus, "id long, text string, company string, fiscal_year string").repartition(4)
    index = Bm25Index(df, carry=("company", "fiscal_year"))
    asked = {1: "r1 r2 r3 c0", 2: "c1 c1 c2", 3: "r7 c5", 4: "nothing here", 5: "", 6: "c0 c1 c2 c3 c4 c5 r9 r9"}
    questions = spark.createDataFrame([(q, t, [] if q != 6 else [("co3", None), (None, "2022"), ("co1", "2021"), ("gone", None)]) for q, t in asked.items()], f"question_id long, question string, scopes {SCOPES}")
    best = lambda scores, n: [(i, round(s, 6)) for i, s in sorted(((i, round(s, 9)) for i, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:n]]
    got = {}
    for r in index.topk(questions, 10).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["id"], round(r["score"], 6)))
    assert got == {q: best(plain_scores(corpus, t), 10) for q, t in asked.items() if q not in (4, 5)}
    scoped = {}
    fits = lambda: search.in_scope(F.col("scopes"), F.col("company"), F.col("fiscal_year"))
    for r in index.topk(questions, 10, fits).orderBy("question_id", "scope_no", "rank").collect():
        scoped.setdefault((r["question_id"], r["scope_no"]), []).append((r["id"], round(r["score"], 6)))
    of = {i: (c, y) for i, _, c, y in corpus}
    expected = {}
    for q, t in asked.items():
        scores = plain_scores(corpus, t)
        for no, (company, year) in enumerate([(None, None)] if q != 6 else [("co3", None), (None, "2022"), ("co1", "2021"), ("gone", None)]):
            inside = {i: s for i, s in scores.items() if company in (None, of[i][0]) and year in (None, of[i][1])}
            if found := best(inside, 10):
                expected[q, no] = found
    assert scoped == expected
    # A question with rare words reads a small part of its words' postings.
    one = questions.where("question_id = 1")
    every = index.laid[0].join(index._asked(one), "term").count()
    read = index._read(index.reached(one, 1)).count()
    assert 0 < read < every / 4


def test_counts_within_rows_taken_in_parts(spark, monkeypatch):
    rows = [(i, "a b a " * (i % 5) + ("x" * i if i % 2 else "")) for i in range(40)] + [(40, None), (41, "A Ünï b")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    expected = {(i, t, n) for i, text in rows for t, n in Counter("".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()).items()}
    assert {(r["id"], r["term"], r["tf"]) for r in sparse.postings(df).collect()} == expected
    monkeypatch.setattr(sparse, "AT_ONCE", 3)
    assert {(r["id"], r["term"], r["tf"]) for r in sparse.postings(df).collect()} == expected
    assert sparse.postings(df.limit(0)).count() == 0
    empty = Bm25Index(df.limit(0))
    assert empty.stats().count() == 0 and empty.topk(spark.createDataFrame([(1, "a")], "question_id long, question string"), 3).count() == 0


def test_scopes_of_every_shape(spark):
    chunks = [(i, f"co{i % 3}" if i % 5 else None, str(2020 + i % 2) if i % 7 else None) for i in range(60)]
    asked = [(1, [("co1", "2021"), ("co2", None), (None, "2020"), (None, None), ("", "")]), (2, []), (3, None), (4, [("none", None)])]
    questions = spark.createDataFrame(asked, f"question_id long, scopes {SCOPES}")
    got = search.scoped_candidates(questions, spark.createDataFrame(chunks, "id long, company string, fiscal_year string"))
    expected = {(q, no, i) for q, scopes in asked for no, (company, year) in enumerate(scopes or [(None, None)]) for i, c, y in chunks if company in (None, c) and year in (None, y)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected) and {q for q, *_ in rows} == {1, 2, 3}
    assert search.scoped_candidates(questions.limit(0), spark.createDataFrame(chunks, "id long, company string, fiscal_year string")).count() == 0


def test_texts_stay_where_they_are(spark):
    chunks = spark.createDataFrame([(i, f"text {i}", f"co{i % 3}") for i in range(500)], "id long, text string, company string").repartition(3)
    texts = TextTable(chunks, buckets=5)
    hits = spark.createDataFrame([(q, i) for q in range(20) for i in (q, 7 * q, 9999)], "question_id long, id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = texts.with_text(hits, "text", "company")
        plan = found._jdf.queryExecution().executedPlan().toString()
        # One exchange, that of the hits; the scan of the texts is bucketed.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert sorted(map(tuple, found.select("question_id", "id", "text", "company").collect())) == sorted((q, i, f"text {i}", f"co{i % 3}") for q in range(20) for i in (q, 7 * q))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
