"""Quality ledger and exact deduplication against plain versions."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.llm import common, exact, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(3)})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t  é#A", max_size=60))
def test_measures(text):
    got = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and got["n_dup_lines"] == len(lines) - len(set(lines))
    assert got["n_repeat_words"] == plain_repeats(text)


def test_ledger_policies_and_ablation(spark):
    clean = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, clean, 0), (2, None, 0), (3, "", 0), (4, "a b c " * 40, 0), (5, "UP " + clean.upper(), 0), (6, " ".join(f"x{i}#" for i in range(60)), 0), (1, clean, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    led = quality.ledger(df)
    got = {(r["doc_id"], r["failed"]) for r in led.collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 16), (6, 4)}
    assert quality.accepted(df, "strict-1").columns == df.columns
    assert sorted(r["doc_id"] for r in quality.accepted(df, "strict-1").collect()) == [1, 1]
    assert sorted(r["doc_id"] for r in quality.accepted(df, "base-1").collect()) == [1, 1, 5, 6]
    table = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in quality.ablation(led, "strict-1").collect()}
    assert table["few_words"] == (2, 2, 4) and table["symbols"] == (1, 1, 3) and table["long_words"] == (0, 0, 2)
    assert quality.ledger(df.limit(0)).count() == 0


def plain_groups(rows):
    by = {}
    for doc, text in rows:
        by.setdefault("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""), []).append(doc)
    return {(doc, max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for doc in ids}


def test_exact_groups_and_levels(spark):
    rng = random.Random(3)
    texts = ["", None, "Ä", "ä", "A b", "a B", "long " * 3000] + [f"t{rng.randrange(60)}" * 50 for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(900)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keep_me string").repartition(3)
    expected = plain_groups(rows)
    for room in (32 << 20, 900):  # one level, and many
        out = exact.grouped(df, table_bytes=room)
        got = out.collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == expected
        assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    kept = exact.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len({e[1] for e in expected})


def test_exact_edges(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (5, "b"), (5, "B"), (5, "c")], "doc_id long, text string")
    out = exact.grouped(df).collect()
    assert sum(r["kept"] for r in out) == 3 and {r["keep_id"] for r in out} == {None, 5}
    assert exact.grouped(df.limit(0)).count() == 0


def test_exact_rows_without_ids(spark):
    # Ids are null in several partitions and slices; no group loses all of its rows.
    rows = [(None if i % 3 else i, f"text {i % 40}") for i in range(600)] + [(None, f"own {i}") for i in range(50)] + [(0, "own 0"), (0, "own 0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for room in (32 << 20, 500):
        out = exact.grouped(df, table_bytes=room).collect()
        assert len(out) == len(rows)
        groups = {}
        for r in out:
            groups.setdefault(r["text"], []).append(r)
        for text, part in groups.items():
            ids = [d for d, t in rows if t == text]
            best = max((d for d in ids if d is not None), default=None)
            assert sum(r["kept"] for r in part) == 1 and {r["keep_id"] for r in part} == {best} and {r["group_size"] for r in part} == {len(ids)}
            assert next(r["doc_id"] for r in part if r["kept"]) == best
        assert exact.deduplicated(df, table_bytes=room).count() == 90


def test_exact_columns_of_other_case(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "A", False)], "doc_id long, text string, Kept boolean")
    out = exact.grouped(df)
    assert [c for c in out.columns if c.lower() == "kept"] == ["kept"] and {(r["doc_id"], r["kept"]) for r in out.collect()} == {(1, False), (2, True)}
    assert exact.deduplicated(df).columns == df.columns and exact.deduplicated(df).first()["Kept"] is False


def test_table_compares_contents():
    table = exact.ContentTable(10_000)
    numbers = [table.place(c, 7) for c in (b"a", b"b", b"a", b"c")]  # one hash for all
    assert numbers == [0, 1, 0, 2]
    assert [table.place(str(i).encode(), i) for i in range(2000)].count(-1) > 0


def test_levels_follow_overflow_and_not_bytes(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    levels = []
    real = exact._buckets

    def counted(left, table_bytes, level):
        levels.append(level)
        return real(left, table_bytes, level)

    monkeypatch.setattr(exact, "_buckets", counted)
    shown = lambda df: sorted(map(repr, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    whole = shown(exact.grouped(docs))
    assert levels == [1]
    for room in (400_000, 25_000):  # a hundredth of all bytes: buckets overflow, and only these are split again
        levels.clear()
        assert shown(exact.grouped(docs, table_bytes=room)) == whole and len(levels) <= 3


def test_keys_sent_or_shuffled_choose_the_same_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text {i % 37}") for i in range(300)], "doc_id long, text string").repartition(4)
    sent = sorted(map(tuple, exact.deduplicated(df).collect()))
    monkeypatch.setattr(common, "SENT_KEYS", 0)
    assert sorted(map(tuple, exact.deduplicated(df).collect())) == sent == [(i, f"text {i % 37}") for i in range(263, 300)]
