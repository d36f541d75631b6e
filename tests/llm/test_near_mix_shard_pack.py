"""Near duplicates, mixing, sharding and packing against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.llm import bagminhash as bag
from groundwork.llm import common, components, mixing, near, packing, queries, sharding
from groundwork.llm.tokens import TokenCounter

BLANKS = " \t\n\x0b\x0c\r"


def multiset(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ")
    words = [w for w in words if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_classes(rows):
    sets = [multiset(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, either = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if either and both >= 0.8 * either:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {(doc, least[find(i)]) for i, (doc, _) in enumerate(rows)}


def near_copies(seed=5, base_words=120, copies=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(base_words)]
    texts = ["", None, "a b", "A  B", "a b c", "x " * 300, "x " * 280, " ".join(base)]
    for _ in range(copies):  # a class whose members differ among themselves by more than the threshold
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(60)] + base[:50]))
    return [(i, t) for i, t in enumerate(texts)]


def test_classes_and_links(spark):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    out = near.classified(df).collect()
    assert {(r["doc_id"], r["class_id"]) for r in out} == plain_classes(rows)
    assert len(out) == len(rows) and all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)
    sizes = Counter(r["class_id"] for r in out)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in out)


def test_links_past_the_centre(spark):
    # Copies with so many edits that most are no link of any one text, in two groups that share half of their words.
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    half = [word() for _ in range(60)]
    rows = []
    for base in ([*half, *(word() for _ in range(70))], [*half, *(word() for _ in range(50))]):
        edits = [(rng.randrange(len(base)), word()) for _ in range(12)]
        for _ in range(90):
            t = list(base)
            for at, new in rng.sample(edits, rng.randrange(0, 7)):
                kind = rng.randrange(3)
                t[min(at, len(t) - 1) : min(at, len(t) - 1) + (kind < 2)] = [new] if kind else []
            rows.append((len(rows), " ".join(t)))
    out = near.classified(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = plain_classes(rows)
    assert {(r["doc_id"], r["class_id"]) for r in out} == expected
    assert 3 < len({c for _, c in expected}) < 100


def differences(spark, members):
    """Rows as ``near._meeting`` takes them, from (rep, label, far, needed, differences)."""
    rows = [(0, rep, label, far, 100, 0, len(d), needed, 0, 0, sorted(d)) for rep, label, far, needed, d in members]
    return near._with_main(spark.createDataFrame(rows, "centre long, rep long, label long, far boolean, n int, own int, dn int, needed int, s0 long, s1 long, d array<long>"))


def test_families_do_not_meet_themselves(spark):
    # All of a family differ from the centre in one passage, as do a few of other components; a member also has differences of its own.
    counts = []
    for m in (200, 400, 800):
        family = [(i, 1, True, 16, {*range(30), 1000 + i}) for i in range(1, m + 1)]
        others = [(5000 + i, 5000 + i, True, 16, {*range(30), 9000 + i}) for i in range(3)]
        met = near._meeting(differences(spark, family + others)).select("a_rep", "b_rep").collect()
        assert {frozenset(pair) for pair in met} >= {frozenset((a, 5000 + i)) for a in range(1, m + 1) for i in range(3)}
        counts.append(len(met))
    assert counts[1] < 2.2 * counts[0] and counts[2] < 2.2 * counts[1]
    assert near._meeting(differences(spark, family)).count() == 0


def test_meeting_loses_no_pair(spark):
    rng = random.Random(6)
    members = []
    for i in range(1, 90):
        base = {rng.randrange(40) for _ in range(rng.randrange(2, 14))}
        members.append((i, rng.choice([1, 1, 1, 2, 2, i + 100]), rng.random() < 0.8, rng.randrange(1, len(base) + 1), base))
    met = {(r["a_rep"], r["b_rep"]) for r in near._meeting(differences(spark, members)).collect()}
    for a, la, _, needed, da in members:
        for b, lb, far, _, db in members:
            if la != lb and far and len(da & db) >= needed:
                assert (a, b) in met


def test_families_that_share_too_little_do_not_meet(spark):
    # Two families share a passage of differences that is too short for a link, and each member has as many of its own.
    k = 0.2 / 1.8
    for m in (20, 40):
        members = [(1000 * f + i, f, True, 25, {*range(30), *range(10_000 * f + 20 * i, 10_000 * f + 20 * i + 20)}) for f in (1, 2) for i in range(m)]
        assert 2 * 30 < 50 + 50 - k * 200
        assert near._sharing(differences(spark, members), 0.8).count() <= m
    # With a longer passage all of them are links.
    members = [(1000 * f + i, f, True, 25, {*range(40), *range(10_000 * f + 10 * i, 10_000 * f + 10 * i + 10)}) for f in (1, 2) for i in range(9)]
    met = {(r["a"], r["b"]) for r in near._sharing(differences(spark, members), 0.8).collect()}
    assert met >= {(1000 + i, 2000 + j) for i in range(9) for j in range(9)}


def test_sharing_loses_no_link(spark):
    # Texts and centre of 100 elements; far members have more than 200 k differences.
    rng, k, members = random.Random(9), 0.2 / 1.8, []
    for i in range(1, 120):
        f = rng.randrange(6)
        d = {e for e in range(30 * f, 30 * f + 36) if rng.random() < 0.85} | {rng.randrange(300) for _ in range(rng.randrange(9))}
        d = d if rng.random() < 0.9 else set(sorted(d)[: rng.randrange(12, 22)])
        members.append((i, rng.choice([1, 1, 2, i + 100]), len(d) > 200 * k, math.floor(len(d) / 2 - 1e-9) + 1, d))
    met = {frozenset((r["a"], r["b"])) for r in near._sharing(differences(spark, members), 0.8).collect()}
    links = {frozenset((a, b)) for a, la, _, _, da in members for b, lb, far, _, db in members if la != lb and far and 2 * len(da & db) >= len(da) + len(db) - 200 * k}
    assert len(links) > 50 and links <= met
    assert len(met) < 0.6 * len(members) * (len(members) - 1) / 2


def test_components_stop_at_stars(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or common.written(df, name))
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(40)]
    graphs = {"star": [(9, i) for i in range(9)], "loops": [(3, 3)], "chain": chain, "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]}
    for name, edges in graphs.items():
        least = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in least:
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        rounds.clear()
        got = [(r["node"], r["label"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert sorted(got) == sorted(least.items())
        assert name not in ("star", "loops") or len(rounds) == 1


def test_plans_find_their_pairs_once(spark, monkeypatch):
    scans = []

    def counting(df, name):
        if name in ("near-pairs", "near-fitting", "near-links"):
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return common.written(df, name)

    monkeypatch.setattr(near, "written", counting)
    near.classified(spark.createDataFrame(near_copies(), "doc_id long, text string")).count()
    assert len(scans) > 3 and max(scans) <= 6


def test_near_edges(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (4, None), (4, "")], "doc_id long, text string")
    kept = near.deduplicated(df).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, text), (4, None), (4, "")], key=str)
    assert near.classified(df.limit(0)).count() == 0
    assert near.classified(df.where("doc_id = 4")).count() == 2


def test_exactly_the_threshold_is_a_link(spark):
    # 36 shingles of which 32 are shared with each other copy: 32 / 40 is 0.8.
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:36], *(f"x{i}y{j}" for j in range(4))])) for i in range(6)]
    assert {r["class_id"] for r in near.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


@pytest.mark.parametrize("top", [1, 5, 40, 300])
def test_signatures_are_unbiased(top):
    rng = np.random.default_rng(top)
    shingle = rng.integers(0, 1 << 48, 300, dtype=np.uint64)
    a = rng.integers(1, top + 1, 300)
    b = np.maximum(0, a + rng.integers(-1, 2, 300))
    b[:40] = 0
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    zero = lambda n: np.zeros(n, np.int64)
    one = bag.signatures(zero(300), shingle, a, 1, 8000)
    two = bag.signatures(zero((b > 0).sum()), shingle[b > 0], b[b > 0], 1, 8000)
    assert abs((one == two).mean() - truth) < 5 * np.sqrt(truth * (1 - truth) / 8000) + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=40), max_size=6))
def test_shingles(texts):
    doc, _, weight = bag.shingles(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert sorted(weight[doc == i].tolist()) == sorted(multiset(t).values())


# ---------------------------------------------------------------- mixing


def plain_budget(tree, weights, levels, budget, path=()):
    """Water filling by repeated passes: whoever is full leaves, its shortage goes to its siblings."""
    if len(path) == len(levels):
        return {path: budget}
    children = {}
    for leaf, cap in tree.items():
        if leaf[: len(path)] == path:
            children[leaf[len(path)]] = children.get(leaf[len(path)], 0) + cap
    weight = {c: weights.get(levels[len(path)], {}).get(c, 1) for c in children}
    given, open_, left = {}, set(children), budget
    while open_:
        total = sum(weight[c] for c in open_)
        full = {c for c in open_ if total == 0 or children[c] <= left * weight[c] / total}
        if not full:
            given |= {c: left * weight[c] / total for c in open_}
            break
        for c in full:
            given[c] = children[c] if weight[c] else 0
            left -= given[c]
        open_ -= full
    out = {}
    for c, b in given.items():
        out |= plain_budget(tree, weights, levels, int(b + 1e-9), (*path, c))
    return out


def test_budgets(spark):
    rng = random.Random(1)
    levels = ["domain", "lang", "source"]
    weights = {"domain": {"d0": 5, "d1": 3}, "lang": {"l0": 4, "l2": 0}}
    tree = {(f"d{i}", f"l{j}", f"s{k}"): rng.randrange(1, 500) for i in range(3) for j in range(3) for k in range(2)}
    leaves = spark.createDataFrame([(*k, n) for k, n in tree.items()], "domain string, lang string, source string, tokens long")
    for budget, epochs in ((1000, 1), (3000, 1), (9000, 3), (0, 1)):
        got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.allocate(leaves, levels, weights, F.lit(budget), epochs).collect()}
        expected = plain_budget({k: n * epochs for k, n in tree.items()}, weights, levels, budget)
        assert all(abs(got[k] - expected.get(k, 0)) <= 2 for k in tree)
        assert all(got[k] <= tree[k] * epochs for k in tree) and sum(got.values()) <= budget


def test_draws(spark):
    rows = [(i, "d", "l" if i % 3 else None, f"s{i % 2}", 10 + i % 7) for i in range(400)] + [(1, "d", "l", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    rows_in = mixing.leaf_rows(docs, {c: F.col(c) for c in ("domain", "lang", "source")}, F.col("n_tokens"))
    out = mixing.drawn(rows_in, ["domain", "lang", "source"], {"source": {"s0": 9}}, 0.9, 2, 5).collect()
    assert len(out) == len(rows) and {r["lang"] for r in out} == {"l", "unknown"}
    total = sum(r[4] for r in rows)
    drawn = sum(r["drawn_tokens"] for r in out)
    assert 0.9 * total - 10 <= drawn <= 0.9 * total
    for r in out:
        assert r["drawn_tokens"] == r["full_epochs"] * r["n_tokens"] + r["prefix_tokens"] and 0 <= r["prefix_tokens"] <= r["n_tokens"]
    leaves = {}
    for r in out:
        leaves.setdefault((r["lang"], r["source"]), []).append(r)
    for part in leaves.values():  # at most one row of a leaf is cut
        assert sum(0 < r["prefix_tokens"] < r["n_tokens"] for r in part) <= 1
    assert mixing.drawn(rows_in.limit(0), ["domain", "lang", "source"], {}, 0.9, 2, 5).count() == 0


# ---------------------------------------------------------------- sharding


def test_shards(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(500), "é" * rng.randrange(300)) for _ in range(700)] + [(7, None), (None, "x"), (7, None)]
    sized = sharding.sized(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    out = sharding.byte_shards(sized, 6).collect()
    ordered = sorted(((-1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows))
    total, before = sum(x[1] for x in ordered), 0
    expected = Counter()
    for doc, size, crc in ordered:
        expected[(doc, size, crc, min(5, (2 * before + size) * 6 // (2 * total)))] += 1
        before += size
    got = Counter((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in out)
    assert {k[0] for k in got} == {k[0] for k in expected}
    by_shard = {}
    for r in out:
        by_shard.setdefault(r["shard"], []).append(r)
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 6) <= max(x[1] for x in ordered)
    first = {s: min(-1 if r["doc_id"] is None else r["doc_id"] for r in p) for s, p in by_shard.items()}
    last = {s: max(-1 if r["doc_id"] is None else r["doc_id"] for r in p) for s, p in by_shard.items()}
    assert all(last[s] <= first[s + 1] for s in range(5))
    assert sharding.byte_shards(sized.limit(0), 6).count() == 0


# ---------------------------------------------------------------- packing


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    counter = TokenCounter(queries.tokenizer_path())
    texts = ["", None, " x", "x ", "a  b\n\n c \n", "   ", "it's 12,3  \t x", "<|endoftext|> hi", "a\x1c b \x1cc", "x y  z", "a \x85b", "日本 語  テ", "'s 'll x's", "word word, word."]
    texts += ["a <|endoftext|>b  <|endoftext|>", "<|endoftext|>", "<|endoftext", " " * 1_000_000, "x" + "\n" * 1_000_000 + "y", "x \u3000" * 1500 + "z", "b" * 200_000, "tail" + " " * 999, "tail" + " " * 1000]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab .,'s1é\n\t  ") for _ in range(rng.randrange(60))) for _ in range(300)]
    for text, ids in zip(texts, counter.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_differencing(sizes):
    dealt = packing.windows_for(sizes, 100)
    assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in w) for w in dealt]
    assert max(sums) <= 100
    whole = packing.difference(sizes, 3)
    assert sorted(i for _, w in whole for i in w) == list(range(len(sizes))) and all(t == sum(sizes[i] for i in w) for t, w in whole)
    if len(whole) == 3:
        assert max(t for t, _ in whole) - min(t for t, _ in whole) <= max(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(0, 20))
def test_cuts_only_what_does_not_fit(sizes, slack):
    windows = packing.windows_with_cuts(sizes, 100, slack)
    least = -(-sum(sizes) // 100)
    assert len(windows) <= least + least * slack // 100
    parts = {}
    for window in windows:
        assert 0 < sum(length for _, _, length in window) <= 100
        for i, start, length in window:
            parts.setdefault(i, []).append((start, length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_fill_and_whole_tails(spark):
    pieces = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), queries.tokenizer_path())
    tails = pieces.where("length < 1024").groupBy("doc_id").agg(F.count("*").alias("n"))
    shares = tails.agg(F.avg((F.col("n") == 1).cast("double")), F.avg("n")).first()
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used")).agg(F.avg("used")).first()[0] / 1024
    assert fill > 0.97 and shares[0] > 0.75 and shares[1] < 1.4
    odd = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (None, "<|endoftext|>"), (3, None)], "doc_id long, text string")
    out = packing.packed(odd, queries.tokenizer_path())
    assert {(r["doc_id"], r["doc_tokens"]) for r in out.collect()} == {(1, 1_000_001), (2, 500_001), (None, 2), (3, 1)}


def test_pieces_round_trip(spark):
    rng = random.Random(6)
    texts = ["", None, "word " * 5000] + [" ".join(f"t{rng.randrange(999)}" for _ in range(rng.randrange(1500))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, "again", 1)], "doc_id long, text string, length int").repartition(2)
    pieces = packing.packed(df, queries.tokenizer_path(), block=64).collect()
    counter = TokenCounter(queries.tokenizer_path())
    ids = {i: np.append(x, np.uint32(0)) for i, x in enumerate(counter.encode(pa.array(texts)))}
    again = np.append(counter.encode(pa.array(["again"]))[0], np.uint32(0))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert len(by_doc) == len(texts) + 1
    for (doc, n), parts in by_doc.items():
        own = again if n == len(again) and doc == 2 else ids[doc]
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and zlib.crc32(own[at : at + p["length"]].astype("<u4").tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == n == len(own)
    used = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        used += at
    assert used / (1024 * len(by_sequence)) > 0.9
    assert packing.packed(df.limit(0), queries.tokenizer_path()).count() == 0
