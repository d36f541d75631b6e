"""Operators on small inputs."""

import hashlib
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork import queries
from groundwork.functions import vocabulary
from groundwork.operators import cache, chunks, dense, evaluate, evidence, facts, fuse, history
from groundwork.operators.ordering import numbered, running_total
from groundwork.operators.sparse import Bm25Index
from groundwork.plans import build, search
from groundwork.sources import filings, html
from groundwork.streaming import jobs

SF = "/root/testdata/sf0.001"

PAGE = """<html><head><title>T &amp; Co</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<div style="DISPLAY : none">x</div><div style="display: none">20200131 hidden<br><b>junk</b></div><!-- c -->
<p>Filed 20240131</p><p>Item 1. Business %s</p>
<table><tr><th></th><th colspan="2">2023</th><th colspan="2">2024</th></tr>
<tr><td>Total revenues</td><td>$</td><td>1,200.0</td><td>$</td><td>1,500</td></tr><tr><td></td></tr>
<tr><td>Net income</td><td>$</td><td>(20)</td><td>$</td><td>30</td></tr></table></body></html>""" % ("word " * 40)


def test_clean_table_rule_by_rule():
    clean = html.clean_table
    assert clean([["a", "", "1.0"], ["", "", ""], ["b", "", "2.50"]]) == [["a", "1"], ["b", "2.50"]]  # empty rows and columns, whole numbers
    assert clean([["x.0", "1,200.0", "-3.0", "0.0"]]) == [["x.0", "1,200.0", "-3.0", "0"]]  # only plain digits lose the suffix
    assert clean([["2023", "2023", "5"], ["1", "1", "6"]]) == [["2023", "5"], ["1", "6"]]  # equal columns
    assert clean([["a", "$", "1"], ["b", "", "2"], ["c", "%", "3"]]) == [["a", "1"], ["b", "2"], ["c", "3"]]  # signs alone
    assert clean([["$"], ["1"], ["2"]]) == [] and clean([["$"], ["1"], ["2"], ["3"]]) == [["$"], ["1"], ["2"], ["3"]]  # half of the cells, rounded down
    assert clean([["a", ""], ["", "$"]]) == [["a"]]  # a row that only a dropped column filled
    assert clean([]) == clean([[]]) == clean([[" ", ""]]) == []


def test_spans_and_noscript():
    page = html.Page("<noscript>kept</noscript><table><tr><td rowspan=2000>a</td><td>0</td></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(1, 1500)) + "</table>")
    rows = html.grid(page.tables[0])
    assert page.prose == ["kept"] and len(rows) == 1500 and {r[0] for r in rows} == {"a"} and rows[-1][1] == "1499"


def test_ingest_equals_one_build(spark, tmp_path):
    # Two batches and a replay; company AA comes in both, a chunk comes again with an earlier path, a filing comes twice.
    page = lambda year, words, amount: f"<p>{year}1231</p><p>Item 7. Management {words}</p><table><tr><th></th><th>2023</th><th>2024</th></tr><tr><td>Net income</td><td>{amount}</td><td>20,000</td></tr><tr><td>Total assets</td><td>30,001</td><td>{amount}</td></tr><tr><td>Other things owned</td><td>55,555</td><td>66,666</td></tr></table>"
    words = " ".join(f"word{i}" for i in range(900))
    first = [("p5", "AA", page(2023, words, "1,000")), ("p7", "BB", page(2024, words + " b", "7,000"))]
    second = [("p2", "AA", page(2023, words, "1,000")), ("p5", "AA", page(2020, "other " * 60, "9")), ("p6", "CC", page(2024, "c " * 80, "3,000")), ("p9", "AA", page(2024, words + " a", "4,000"))]
    schema = "path string, company string, html string"
    root, source = f"file://{tmp_path}/store", tmp_path / "in"
    stream = lambda: jobs.incremental_ingest(spark.readStream.schema(schema).parquet(str(source)), spark, root).option("checkpointLocation", f"{root}-state").trigger(availableNow=True)
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream().start().awaitTermination()
    shutil.copytree(tmp_path / "store", tmp_path / "before")
    for commit in ("1", ".1.crc"):  # the second batch is not known to have ended, and is run again
        (tmp_path / "store-state" / "commits" / commit).unlink()
    stream().start().awaitTermination()

    whole = spark.createDataFrame([*first, *(x for x in second if x[0] != "p5")], schema)
    pieces = filings.with_piece_index(filings.extract_pieces(whole))
    shown = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for store in (root, f"file://{tmp_path}/before"):
        assert shown(jobs.stored_pieces(spark, store)) == shown(pieces.drop("piece_index"))
        found = jobs.stored_facts(spark, store)
        assert shown(found) == shown(build.build_fact_store(pieces)) and found.count() == found.select("entry_id").distinct().count() > 6
        assert found.select("ticker").distinct().count() == 3
        chunks_of = jobs.stored_chunks(spark, store)
        assert shown(chunks_of) == shown(build.build_chunk_index(pieces)) and chunks_of.where("embedding is null").count() == 0


def test_ingest_that_is_cut_short_is_not_seen(spark, tmp_path):
    schema = "path string, company string, html string"
    root, source = f"file://{tmp_path}/store", tmp_path / "in"
    page = lambda n: f"<html>20240131<p>{'Word ' * 40}{n}</p></html>"

    def ingest(embedder):
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.incremental_ingest(stream, spark, root, embedder=embedder).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start().awaitTermination()

    def broken(texts):
        raise RuntimeError("no embedder")

    first, second = [("p1", "A", page(1)), ("p2", "B", page(2)), ("p2", "B", page(2))], [("p3", "A", page(3))]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(str(source))
    ingest(build.hashed_embedder)
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(str(source))
    paths = lambda: [sorted(r["path"] for r in stored(spark, root).collect()) for stored in (jobs.stored_pieces, jobs.stored_chunks)]
    before = paths()
    with pytest.raises(Exception, match="no embedder"):
        ingest(broken)  # pieces and facts are written by then, chunks are not
    assert paths() == before == [["p1", "p2"]] * 2
    assert {r["path"] for r in jobs._all(spark, root, "pieces").collect()} == {"p1", "p2", "p3"}
    ingest(build.hashed_embedder)
    assert paths() == [["p1", "p2", "p3"]] * 2


def test_html(spark):
    page = html.Page(PAGE)
    assert "hidden" not in " ".join(page.words) and "no" not in page.words and page.words[0] == "T & Co"
    rows = html.clean_table(html.grid(page.tables[0]))
    assert rows == [["", "2023", "2024"], ["Total revenues", "1,200.0", "1,500"], ["Net income", "(20)", "30"]]
    df = spark.createDataFrame([("p1", "CO", PAGE), ("p2", "CO", None), ("p3", "CO", "")], "path string, company string, html string")
    pieces = filings.extract_pieces(df).orderBy("piece_no").collect()
    assert [(p["type"], p["section"], p["fiscal_year"]) for p in pieces] == [("table", "business", "2020"), ("prose", "business", "2020")]  # the first date-like run, hidden or not
    store = build.build_fact_store(filings.with_piece_index(filings.extract_pieces(df))).orderBy("entry_id").collect()
    assert [(f["entry_id"], f["fiscal_year"], f["line_item_standardized"], f["metric_value"]) for f in store] == [
        (1, "2023", "TOTAL_REVENUE", 1200.0), (2, "2024", "TOTAL_REVENUE", 1500.0), (3, "2023", "NET_INCOME", -20.0), (4, "2024", "NET_INCOME", 30.0),
    ]


def _fact(entry, year, label, value, filing, code="NET_INCOME"):
    return ("CO", year, "FY", code, label, value, None, f"CO FY{filing}", "mda", f"CO-{filing}-0", entry, 0, 0)


FACT = "ticker string, fiscal_year string, fiscal_period string, line_item_standardized string, line_item_raw string, metric_value double, unit string, source_company_fy string, source_section string, source_table_id string, piece_index long, row_no int, year_no int"


def test_fact_dedup_and_lookup(spark):
    rows = [_fact(0, "2023", "Net Income", 5.0, "2024"), _fact(1, "2023", "net income", 5.0, "2023"), _fact(2, "2022", "Net income", 1.001, "2024"), _fact(3, "2022", "Income, net", 1.002, "2024"), _fact(4, "2021", "Net income", 1.0, "2024"), _fact(5, "2021", "Net income", 2.0, "2024")]
    store = facts.with_entry_ids(facts.dedup(spark.createDataFrame(rows, FACT)))
    got = store.orderBy("entry_id").collect()
    assert [(r["entry_id"], r["line_item_raw"], r["source_company_fy"]) for r in got][0] == (1, "net income", "CO FY2023") and len(got) == 5
    scope = [("CO", "2023"), ("CO", "2022"), ("CO", "2021"), ("CO", None)]
    asked = spark.createDataFrame([(1, scope, ["NET_INCOME", "TOTAL_ASSETS"])], "question_id long, scopes array<struct<company:string,fiscal_year:string>>, metrics array<string>")
    found = facts.lookup(asked, store).orderBy("scope_no").collect()
    assert [(f["year"], f["row_label"], f["value"]) for f in found] == [("2023", "net income", 5.0), ("2022", "Net income", 1.001)]
    excerpt = facts.to_excerpts(facts.lookup(asked, store)).orderBy("fiscal_year").first()
    assert excerpt["rerank_score"] == float("inf") and excerpt["text"].endswith("CO FY2022 — Net income: 1")


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert [r["n"] for r in numbered(df, ["x"], "n").orderBy("x").collect()] == list(range(1, 1001))
    total = running_total(df, "x", "x", "before").orderBy("x").collect()
    assert all(r["before"] == r["x"] * (r["x"] - 1) // 2 for r in total)


def test_bm25_negative_weight_floor(spark):
    corpus = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a a d"), (4, ""), (5, None)], "id long, text string")
    index = Bm25Index(corpus)
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    assert idf["a"] == pytest.approx(0.25 * index.average_idf) and index.n == 5
    asked = spark.createDataFrame([(1, "b b zzz"), (2, ""), (3, None)], "question_id long, question string")
    assert [(r["question_id"], r["id"], r["rank"]) for r in index.topk(asked, 3).collect()] == [(1, 1, 1)]


def test_dense_limits(spark):
    chunks_df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "question_id long, embedding array<double>")
    assert [(r["id"], r["rank"]) for r in dense.topk(chunks_df, asked, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert dense.topk(chunks_df, asked.limit(0), 2).count() == 0


def test_dense_blocks_ties_and_missing_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (90, 3)).astype(float)  # many equal directions
    rows = [(f"c{i:02}", v.tolist() if i % 9 else None, f"co{i % 3}", str(2020 + i % 2)) for i, v in enumerate(vectors)]
    queries = [(i, rng.integers(-2, 3, 3).astype(float).tolist() if i % 7 else None, [] if i % 4 else [("co1", None), (None, "2021"), ("co9", None)]) for i in range(60)]
    chunks_df = spark.createDataFrame(rows, "id string, embedding array<double>, company string, fiscal_year string").repartition(4)
    asked = spark.createDataFrame(queries, "question_id long, embedding array<double>, scopes array<struct<company:string,fiscal_year:string>>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    expected = set()
    for q, e, scopes in queries:
        for no, (company, year) in enumerate(scopes or [(None, None)]) if e else ():
            fits = [(-round(float(unit(v) @ unit(e)), 9), i) for i, v, c, y in rows if v and company in (None, c) and year in (None, y)]
            expected |= {(q, no, i, rank) for rank, (_, i) in enumerate(sorted(fits)[:5], 1)}
    exact = lambda df: {(r["question_id"], r["scope_no"], r["id"], r["rank"]) for r in df.collect()}
    whole, blocks = exact(dense.topk(chunks_df, asked, 5, scoped=True)), exact(dense.topk(chunks_df, asked, 5, scoped=True, block=7))
    assert whole == blocks == expected  # equal directions tie, wherever they stand


def test_dense_bounds_rule_blocks_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    near = lambda n: (centres[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, 16)))
    vectors, wanted = near(4000), near(30)
    chunks_df = spark.createDataFrame([(i, v.tolist(), f"co{i % 2}", "2024") for i, v in enumerate(vectors)], "id long, embedding array<double>, company string, fiscal_year string").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist(), [("co1", None)]) for i, v in enumerate(wanted)], "question_id long, embedding array<double>, scopes array<struct<company:string,fiscal_year:string>>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(wanted) @ unit(vectors).T, 12)
    for scoped in (False, True):
        index = dense.DenseIndex(chunks_df, scoped, block=50)
        kept = np.where(np.arange(4000) % 2 == 1, scores, -np.inf) if scoped else scores
        expected = {(q, i, rank) for q, row in enumerate(kept) for rank, i in enumerate(np.lexsort((np.arange(4000), -row))[:7].tolist(), 1)}
        assert {(r["question_id"], r["id"], r["rank"]) for r in index.topk(asked, 7).collect()} == expected
        # Of one question, no more than a quarter of all blocks is read: its own cluster's.
        groups, pairs = index.reached(asked.where("question_id = 3"), 7)
        assert groups.count() == 1 and 0 < pairs.count() <= index.blocks.count() / 4


def test_dense_ten_thousand_questions(spark):
    rng = np.random.default_rng(1)
    chunks_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(10_000, 8)))], "question_id long, embedding array<double>")
    out = dense.topk(chunks_df, asked, 3)
    assert out.count() == 30_000 and out.select("question_id").distinct().count() == 10_000


def test_merge_and_rerank_off(spark):
    fused = spark.createDataFrame([(1, 0, "a", 1, "q", "t"), (1, 0, "b", 2, "q", "t"), (1, 1, "a", 1, "q", "t"), (1, 1, "c", 2, "q", "t")], "question_id long, scope_no int, id string, rank int, question string, text string")
    kept = fuse.rerank(fused, None, 2, ["question_id", "scope_no"])
    assert [(r["pos"], r["id"], r["rerank_score"]) for r in fuse.merge_scopes(kept).orderBy("pos").collect()] == [(1, "a", None), (2, "b", None), (3, "c", None)]


def test_chunks(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {i} |" for i in range(200))
    parts = chunks.split_table(table, "sum")
    assert len(parts) > 1 and all(chunks.count_tokens(p) <= 500 and p.startswith("[Table summary: sum]\n\n| a | b |") for p in parts)
    assert sum(p.count("| row ") for p in parts) == 200
    words = [f"w{i}" for i in range(2000)]
    split = chunks.split_prose(" ".join(words))
    assert all(chunks.count_tokens(p) <= 450 for p in split) and {w for p in split for w in p.split()} == set(words)
    assert set(split[0].split()) & set(split[1].split())
    assert chunks.split_prose("x" * 10) == ["x" * 10] and chunks.split_prose("") == []
    pieces = spark.createDataFrame([("p", "CO", "2024", "mda", "prose", " ".join(words), 0), ("p", "CO", "2024", "mda", "prose", " ".join(words), 1), ("p", "CO", "2024", "mda", "table", "| a |", 2)], "path string, company string, fiscal_year string, section string, type string, text string, piece_no int")
    built = chunks.build_chunks(pieces)
    rows = built.collect()
    assert len({r["id"] for r in rows}) == len(rows) == len(split) and chunks.budget_check(built).first()["n_over"] == 0


def test_splitters_on_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts = {}
    for r in queries.split_prose(spark, SF).collect():
        parts.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["text"]
    assert set(parts) == {d for d, t in docs.items() if t and t.strip()}
    for doc, numbered_parts in parts.items():
        start, end = -1, 0
        for no in range(len(numbered_parts)):
            part = numbered_parts[no]
            assert 0 < chunks.count_tokens(part) <= 450
            upto = end + len(docs[doc][end:]) - len(docs[doc][end:].lstrip())
            at = docs[doc].rfind(part, start + 1, upto + len(part))  # the last place that loses nothing
            assert at >= 0
            # Parts follow each other with nothing but blanks lost between them, and share up to 60 tokens.
            assert not docs[doc][end:at].strip() and chunks.count_tokens(docs[doc][at:end]) <= 60
            start, end = at, at + len(part)
        assert not docs[doc][end:].strip()

    def plain_table(text):
        head = "[Table summary: lines]\n\n| text |\n|---|"
        rows = [f"| {x} |" for x in text.split("\n")]
        if chunks.count_tokens("\n".join([head, *rows])) <= 500 or len(rows) < 1:
            return ["\n".join([head, *rows])]
        out = []
        for row in rows:
            if out and chunks.count_tokens("\n".join([head, *out[-1], row])) <= 500:
                out[-1].append(row)
            else:
                out.append([row])
        return ["\n".join([head, *x]) for x in out]

    found = {}
    for r in queries.split_table(spark, SF).collect():
        found.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["text"]
    for doc, text in docs.items():
        whole = [found[doc][i] for i in range(len(found[doc]))]
        plain = plain_table(text)
        if all(chunks.count_tokens(x) <= 512 for x in plain):
            assert whole == plain
        assert all(chunks.count_tokens(x) <= 512 for x in whole)
    counts = queries.chunk_build_counts(spark, SF).first()
    index = queries.build_chunk_index(spark, SF)
    assert counts["n_chunks"] == index.count() == index.select("id").distinct().count() and counts["n_captioned"] == 125


def test_chunk_index_is_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {}
    for d in sorted(docs, key=lambda d: str(d["doc_id"])):  # paths are in order of their characters
        for no, part in enumerate(chunks.split_prose(d["text"] or "")):
            key = f"{d['source']}-{d['lang']}-other-prose-{hashlib.md5(part.encode()).hexdigest()[:8]}"
            vector = np.array(build.hashed_embedder([part])[0], np.float32).tolist()
            expected.setdefault(key, (str(d["doc_id"]), no, part, d["source"], d["lang"], vector))
    index = queries.build_chunk_index(spark, SF)
    got = {r["id"]: (r["path"], r["chunk_no"], r["text"], r["company"], r["fiscal_year"], r["embedding"]) for r in index.where("type = 'prose'").collect()}
    assert got == expected
    tables = index.where("type = 'table'").collect()
    assert len(tables) >= 125 and all(r["captioned"] and r["text"].startswith("[Table summary: ") and len(r["embedding"]) == 64 for r in tables)
    shown = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.withColumn("fiscal_year", F.col("fiscal_year").cast("string")).collect())
    assert shown(queries.write_chunk_index(spark, SF)) == shown(index)
    counts = queries.chunk_build_counts(spark, SF).first()
    assert (counts["n_chunks"], counts["n_captioned"]) == (len(expected) + len(tables), len({(r["path"], r["piece_no"]) for r in tables}))


def test_seams(spark):
    # The caller's embedder and counter are called with whole texts, questions with the search prefix, in batches.
    texts = spark.createDataFrame([(i, "w" * i) for i in range(70)] + [(70, None)], "id long, text string").coalesce(1)

    def embedder(batch):
        return [[float(len(x)), float(len(batch))] for x in batch]

    got = {r["id"]: r["embedding"] for r in build.embedded(texts, "text", embedder).collect()}
    assert all(got[i][0] == i for i in range(70)) and got[70][0] == 0.0 and max(e[1] for e in got.values()) == 32.0
    prefix = len(vocabulary.QUERY_PREFIX)
    assert [r["embedding"][0] for r in build.embedded(texts.where("id < 3"), "text", embedder, query=True).orderBy("id").collect()] == [prefix, prefix + 1.0, prefix + 2.0]
    counted = chunks.budget_check(texts, limit=60, count=len).first()
    assert (counted["n_chunks"], counted["n_over"], counted["most"]) == (71, 9, 69)


def test_a_model_is_made_once_a_worker_and_reads_equal_texts_once(spark, tmp_path):
    def load():
        import os

        (tmp_path / f"made-{os.getpid()}-{os.urandom(4).hex()}").touch()

        def encode(texts):
            (tmp_path / f"read-{os.urandom(4).hex()}").write_text("\n".join(texts))
            return [[float(len(x))] for x in texts]

        return encode

    texts = spark.createDataFrame([(i, "same" if i % 2 else "w" * (i % 40)) for i in range(400)], "id long, text string").repartition(12)
    model = build.Loaded("test-model", load)
    for _ in range(2):  # two jobs of twelve tasks each
        got = {r["id"]: r["embedding"][0] for r in build.embedded(texts, "text", model).collect()}
        assert got == {i: 4.0 if i % 2 else float(i % 40) for i in range(400)}
    made = [p.name.split("-")[1] for p in tmp_path.iterdir() if p.name.startswith("made")]
    assert len(made) == len(set(made)) <= 12  # never twice in a worker
    read = [x.read_text().split("\n") for x in tmp_path.iterdir() if x.name.startswith("read")]
    assert all(len(x) == len(set(x)) for x in read) and sum(map(len, read)) <= 24 * 21
    assert chunks.budget_check(texts, limit=10, count=build.Loaded("test-counter", lambda: len)).first()["most"] == 38


def test_many_large_pages_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(filings, "HELD", 50_000)
    page = lambda i: f"<html><p>page {i} " + "lorem ipsum " * 2000 + "</p><table><tr><td>a</td><td>1</td></tr></table></html>"
    df = spark.createDataFrame([(f"p{i:03}", "CO", page(i) if i % 5 else None) for i in range(60)], "path string, company string, html string").coalesce(1)
    got = filings.parsed(df).collect()
    assert [r["path"] for r in got] == [f"p{i:03}" for i in range(60)]
    assert all(r["full_text"].startswith(f"page {i} lorem") and len(r["tables"]) == 1 if i % 5 else r["full_text"] == "" for i, r in enumerate(got))


def test_written_index_is_the_built_one(spark, tmp_path):
    pieces = spark.createDataFrame([(f"p{i}", f"C{i % 2}", "2024", "mda", "prose", f"text {i} " * 200, 0) for i in range(6)], "path string, company string, fiscal_year string, section string, type string, text string, piece_no int")
    built = build.build_chunk_index(pieces, id_digits=32)
    filings.write_chunk_index(built, f"file://{tmp_path}/index")
    shown = lambda df: sorted(map(str, df.withColumn("fiscal_year", F.col("fiscal_year").cast("string")).select(*sorted(df.columns)).collect()))
    assert shown(spark.read.parquet(f"file://{tmp_path}/index")) == shown(built)
    assert all(len(r["id"].rsplit("-", 1)[1]) == 32 for r in built.collect())


def test_history(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f" t{i} " if i != 2 else "  ") for i in range(10)] + [(2, 0, "assistant", "x"), (2, 1, "user", "y")]
    pairs = history.qa_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = history.recent_history(pairs).orderBy("turn").collect()
    assert [r["history"] for r in rows] == ["", "Q: t0\nA: t1", "Q: t0\nA: t1", "Q: t0\nA: t1\nQ: t4\nA: t5", "Q: t4\nA: t5\nQ: t6\nA: t7"]


def test_cache(spark):
    rows = [(1, "a", [1.0, 0.0], "p1"), (2, "a", [1.0, 0.01], "p2"), (3, "b", [1.0, 0.0], "p3"), (4, "a", [0.0, 1.0], "p4"), (5, "a", [0.0, 0.0], "p5"), (6, None, [1.0, 0.0], "p6")]
    out = cache.answer_cache(spark.createDataFrame(rows, "seq long, scope_key string, embedding array<double>, payload string")).orderBy("seq").collect()
    assert [(r["hit"], r["payload"]) for r in out] == [(False, "p1"), (True, "p1"), (False, "p3"), (False, "p4"), (False, "p5"), (False, "p6")]
    empty = spark.createDataFrame([], "seq long, scope_key string, embedding array<double>, payload string")
    assert cache.cache_stats(cache.answer_cache(empty)).first()["hit_rate"] == 0.0


def test_cache_without_vectors(spark):
    rows = [(1, "a", None, "p1"), (2, "a", [1.0, 0.0], "p2"), (3, "a", None, "p3"), (4, "a", [2.0, 0.0], "p4")]
    out = cache.answer_cache(spark.createDataFrame(rows, "seq long, scope_key string, embedding array<double>, payload string")).orderBy("seq").collect()
    assert [(r["hit"], r["payload"], r["similarity"]) for r in out] == [(False, "p1", None), (False, "p2", None), (False, "p3", None), (True, "p2", 1.0)]


def test_golden_files(spark, tmp_path):
    allowed = spark.createDataFrame([("AA",)], "company string")
    rows = [{"question": "q: 1?", "company": "AA", "year": 2024}, {"question": "q2", "company": "AA", "relevant": "AA FY2024 mda"}]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    (tmp_path / "g.yaml").write_text("- question: 'q: 1?'\n  company: AA\n  year: 2024\n- question: q2\n  company: AA\n  relevant: AA FY2024 mda\n")
    pytest.importorskip("yaml")
    for name in ("g.json", "g.yaml"):
        got = evaluate.read_golden(spark, f"file://{tmp_path}/{name}", allowed).orderBy("question").collect()
        assert [(r["question"], r["year"], r["relevant"]) for r in got] == [("q2", None, "AA FY2024 mda"), ("q: 1?", "2024", None)]
    with pytest.raises(ValueError, match="AA"):
        evaluate.read_golden(spark, f"file://{tmp_path}/g.json", allowed.limit(0))


def test_answers_without_evidence(spark):
    answers = spark.createDataFrame([(1, "See [1] and [4]."), (2, "Sure [1].")], "question_id long, text string")
    found = spark.createDataFrame([(1, 1, "c", "t", "CO", "2024", "mda", None)], "question_id long, pos int, id string, text string, company string, fiscal_year string, section string, rerank_score double")
    rows = {r["question_id"]: r for r in evidence.verify(answers, found).collect()}
    assert (rows[1]["cited"], rows[1]["hallucinated"], rows[2]["refused"], rows[2]["cited"]) == ([1], [4], True, [])
    assert [r["chunk_id"] for r in evidence.citation_sources(evidence.verify(answers, found), found).collect()] == ["c"]


def test_scores(spark):
    one = lambda *ms: evaluate.latency_median(spark.createDataFrame([(m,) for m in ms], "latency_ms long")).first()[0]
    assert (one(1, 2, 3), one(1, 2, 3, 4), one(5, 5, 1)) == (2, 3, 5)
    none = evaluate.refusal_scores(spark.createDataFrame([(False, False)], "should_refuse boolean, refused boolean")).first()
    assert (none["precision"], none["recall"], none["accuracy"]) == (0.0, 0.0, 1.0)
    golden = spark.createDataFrame([("AA",), ("BB",)], "company string")
    with pytest.raises(ValueError, match="BB"):
        evaluate.load_golden(golden, golden.where("company = 'AA'"))


def test_gather_routes(spark):
    chunks_df = spark.createDataFrame([(f"c{i}", f"net sales text {i}", "AAPL" if i % 2 else "MSFT", "2024", "mda") for i in range(12)], "id string, text string, company string, fiscal_year string, section string")
    chunks_df = build.embedded(chunks_df)
    store = facts.with_entry_ids(facts.dedup(spark.createDataFrame([("AAPL", "2024", "FY", "TOTAL_REVENUE", "Total net sales", 9.0, "millions", "AAPL FY2024", "mda", "t", 0, 0, 0)], FACT)))
    asked = spark.createDataFrame([(1, "What was apple revenue in 2024?"), (2, "What was microsoft revenue in 2024?"), (3, "general outlook")], "question_id long, question string")
    from groundwork.functions.questions import understood

    found, routes = search.gather_evidence(understood(asked), store, chunks_df)
    assert {r["question_id"]: (r["intent"], r["executed"]) for r in routes.collect()} == {1: ("TABLE", "TABLE"), 2: ("TABLE", "TEXT"), 3: ("TEXT", "TEXT")}
    rows = found.orderBy("question_id", "pos").collect()
    first = [r for r in rows if r["question_id"] == 1]
    assert first[0]["section"] == "financial_data" and len(first) == 4 and all(r["company"] == "AAPL" for r in first)
    assert len([r for r in rows if r["question_id"] == 2]) == 5
