"""Scoped search without moving postings, texts or pairs of vectors: results against plain versions, and what is written."""

import pytest
from pyspark.sql import functions as F

from groundwork import queries
from groundwork.operators import dense, fuse, texts
from groundwork.operators.sparse import Bm25Index
from groundwork.plans import search
from tests.oracle import assert_same
from tests.test_search import SCOPES, corpus, plain_scores  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limits", [{}, {"SENT_ASKED": 3}, {"WIDE": 0}, {"SENT_ASKED": 5, "WIDE": 0}])
def test_scoped_scores_however_they_are_met(spark, corpus, monkeypatch, limits):  # noqa: F811
    for name, value in limits.items():
        monkeypatch.setattr(search, name, value)
    index = Bm25Index(spark.createDataFrame(corpus, "id long, text string, company string, fiscal_year string").repartition(3), carry=("company", "fiscal_year"))
    both = [("co1", "2021"), (None, "2022"), (None, None), ("gone", None)]
    asked = [(1, "r1 r2 c0", both), (2, "c1 c1 c2", []), (3, "c1 c1 c2", []), (4, "c1 c1 c2", [("co3", None)]), (5, None, both), (6, "r1 r2 c0", both), (7, "nothing here", None), (8, "r7 c5", None)]
    got = {}
    rows = search.scoped_sparse(index, spark.createDataFrame(asked, f"question_id long, question string, scopes {SCOPES}"), None, 7)
    for r in rows.orderBy("question_id", "scope_no", "rank").collect():
        got.setdefault((r["question_id"], r["scope_no"]), []).append((r["id"], r["rank"], round(r["score"], 6)))
    of, expected = {i: (c, y) for i, _, c, y in corpus}, {}
    for q, text, scopes in asked:
        scores = plain_scores(corpus, text or "")
        for no, (company, year) in enumerate(scopes or [(None, None)]):
            inside = [(-round(s, 9), i) for i, s in scores.items() if s > 0 and company in (None, of[i][0]) and year in (None, of[i][1])]
            if inside:
                expected[q, no] = [(i, rank, round(-s, 6)) for rank, (s, i) in enumerate(sorted(inside)[:7], 1)]
    assert got == expected and len(got) > 8
    assert (index._laid is None) == ("WIDE" not in limits)
    nobody = spark.createDataFrame([], f"question_id long, question string, scopes {SCOPES}")
    assert search.scoped_sparse(index, nobody, None, 7).count() == 0


def test_questions_of_one_text_are_met_once(spark, monkeypatch):
    met = []
    real = Bm25Index._asked
    monkeypatch.setattr(Bm25Index, "_asked", lambda self, q: met.append(q.count()) or real(self, q))
    index = Bm25Index(spark.createDataFrame([(i, f"a b{i}", "x", "2020") for i in range(9)], "id long, text string, company string, fiscal_year string"), carry=("company", "fiscal_year"))
    asked = spark.createDataFrame([(i, f"b{i % 2} a", [("x", None)]) for i in range(50)], f"question_id long, question string, scopes {SCOPES}")
    assert search.scoped_sparse(index, asked, None, 1).count() == 50 and met == [2]


def test_questions_vectors_are_sent_in_turns(spark, monkeypatch):
    chunks = queries.searched_chunks(spark, SF)
    shown = lambda: sorted(map(tuple, dense.topk(chunks, queries.asked_vectors(spark, SF), 5, scoped=True).collect()))
    once = shown()
    monkeypatch.setattr(dense, "SENT_BYTES", 2000)
    monkeypatch.setattr(dense, "GROUP", 8)
    assert shown() == once and once


def test_texts_of_hits_only_are_moved(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string")
    hits = spark.createDataFrame([(q, i) for q in range(3) for i in (q, 7, 999)], "question_id long, id long")
    expected = sorted((q, i, f"text {i}") for q in range(3) for i in (q, 7))
    shown = lambda: sorted(map(tuple, search.with_text(hits, chunks, "text").select("question_id", "id", "text").collect()))
    assert shown() == expected
    monkeypatch.setattr(search, "SENT_HITS", 0)
    assert shown() == expected
    scored = fuse.rerank(hits.select("question_id", "id", F.lit(1).alias("rank"), F.lit("q").alias("question"), F.lit("t").alias("text")), fuse.token_overlap, 9, ["question_id"], drop=("question", "text"))
    assert scored.columns == ["question_id", "id", "fused_rank", "rerank_score", "rank"] and scored.count() == 9


@pytest.fixture
def nothing_whole(monkeypatch):
    """Neither all postings nor all texts are laid out anew."""

    def refuse(*_, **__):
        raise AssertionError("laid out whole")

    monkeypatch.setattr(Bm25Index, "laid", property(refuse))
    monkeypatch.setattr(texts.TextTable, "__init__", refuse)


@pytest.mark.parametrize("name", ["rrf_fuse", "hit_provenance", "retriever_rank", "candidate_text", "rerank_topk", "scoped_merge", "batch_search", "gather_evidence"])
def test_search_lays_out_nothing_whole(spark, nothing_whole, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.SQL[name])
