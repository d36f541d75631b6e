"""The pipeline against a plain version, and stages on odd input."""

import zlib

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from groundwork.llm import mixing, quality, queries
from groundwork.llm.tokens import TokenCounter
from tests.llm.test_near_mix_shard_pack import plain_classes

SF = "/root/testdata/sf0.001"


def plain(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    rules = []
    for r in rows:
        m = dict(zip(quality.MEASURES, quality.measure(r["text"]), strict=True))
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"] or 10 * m["n_dup_lines"] > 3 * m["n_lines"]
        failed = failed or 10 * m["n_capitals"] > 3 * m["n_letters"] or m["word_chars"] > 25 * m["n_words"]
        if not failed:
            rules.append(r)
    best = {}
    for r in rules:
        key = r["text"].encode().lower()
        if key not in best or r["doc_id"] > best[key]["doc_id"]:
            best[key] = r
    kept = list(best.values())
    classes = dict(plain_classes([(r["doc_id"], r["text"]) for r in kept]))
    return rules, kept, [r for r in kept if classes[r["doc_id"]] == r["doc_id"]]


def test_stages_against_plain(spark):
    rules, exact_kept, near_kept = plain(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_stage = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.written(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
        assert docs.columns == columns
        by_stage.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert docs.count() == len(by_stage[-1])
    assert by_stage[:3] == [{r["doc_id"] for r in x} for x in (rules, exact_kept, near_kept)]
    # The mixture: what it keeps is the prefix of each leaf's seeded order.
    kept = spark.createDataFrame(near_kept)
    draws = mixing.drawn(queries.written(queries.mix_rows(kept), "test-mix"), queries.MIX_LEVELS, queries.MIX_WEIGHTS, **corpus_pipeline.MIX).collect()
    assert by_stage[3] == {r["doc_id"] for r in draws if r["drawn_tokens"] > 0} and 0 < len(by_stage[3]) < len(by_stage[2])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    counter = TokenCounter(queries.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in near_kept if r["doc_id"] in by_stage[3]}
    ids = {d: [*x.tolist(), 0] for d, x in zip(texts, counter.encode(pa.array(list(texts.values()))), strict=True)}
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        part = b"".join(i.to_bytes(4, "little") for i in ids[p["doc_id"]][p["start"] : p["start"] + p["length"]])
        assert zlib.crc32(part) == p["ids_crc32"]


def test_run_gives_the_same_pieces(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.columns[:3] == ["doc_id", "start", "length"] and pieces.count() > 0


def test_stages_on_odd_input(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    good = " ".join(f"wort{i}" for i in range(60))
    rows = [(None, good, None, None, None), (1, None, "en", "src1", 0), (2, "", None, "src", 0), (3, good + " mehr", "en", "src3", 1), (3, good + " mehr", "en", "src3", 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
            count = frame.count()
        assert count in (0, 2, 1)


def test_rows_without_ids_at_every_stage(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = lambda i: " ".join(f"wort{i}x{j}" for j in range(60))
    rows = [(None if i % 2 else i, text(i), "en", "src1", 0) for i in range(40)] + [(None, text(i).upper(), "en", "src1", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.written(stage(spark, docs, SF), "test-null-ids")
        counts.append((docs.count(), docs.where("doc_id is null").count()))
    # Capitals fail a rule; each text is its own class; four fifths of the tokens are drawn.
    assert counts[:3] == [(40, 20)] * 3 and counts[3][0] == 32 and counts[3][1] >= 12
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("start = 0").count() == 32
    low = spark.createDataFrame([(d, t.lower(), *rest) for d, t, *rest in rows], schema).repartition(5)
    kept = queries.written(corpus_pipeline.exact_dedup(spark, low, SF), "test-null-ids").collect()
    assert len(kept) == 40 and sum(r["doc_id"] is None for r in kept) == 20
    copies = spark.createDataFrame([(None, text(i % 4) + f" {i}", "en", "src1", 0) for i in range(12)] + [(7, text(0) + " x", "en", "src1", 0)], schema).repartition(3)
    near_kept = corpus_pipeline.near_dedup(spark, copies, SF).collect()
    assert len(near_kept) == 4 and sorted(r["doc_id"] is None for r in near_kept) == [False, True, True, True]


def test_clash_of_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"key": F.lit(1), "label": F.lit("x"), "n": F.lit(2), "kept": F.lit(False), "size": F.lit(0), "domain": F.lit("d"), "Class_Id": F.lit(3), "KEEP_ID": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_mixing_keeps_rows_without_an_id(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None if i % 2 else 7, f"text {i} " + "wort " * 20, "en", "src1", 0) for i in range(40)]
    kept = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, schema), SF).collect()
    # Four fifths of the tokens of equally long texts; each row is drawn for itself.
    assert len(kept) == len({r["text"] for r in kept}) == 32
    assert any(r["doc_id"] is None for r in kept)


def test_selected_repeats_epochs(spark):
    docs = spark.createDataFrame([(0, None, "a"), (1, 5, "b"), (2, 5, "c")], "row long, doc_id long, text string")
    draws = spark.createDataFrame([(0, 2, 3, 13), (1, 1, 0, 5), (2, 0, 0, 0)], "row long, full_epochs long, prefix_tokens long, drawn_tokens long")
    out = mixing.selected(docs, draws, "row")
    assert out.columns == ["doc_id", "text"] and sorted(r["text"] for r in out.collect()) == ["a", "a", "a", "b"]
