"""Cuts by boundary sets, Merkle manifests and ball hashing against plain versions."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwork.llm import infill, merkle, queries, simhash

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- cuts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé€😀 \n\x00", max_size=80), st.sampled_from(["char", "word", "line"]))
def test_boundaries_part_the_text(text, unit):
    raw = text.encode()
    places = infill.boundaries(raw, unit)
    offsets = [places.select(k) for k in range(len(places))]
    parts = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:], strict=False)]
    assert offsets[-1] == len(raw) and "".join(parts) == text
    if unit == "char":
        assert parts == list(text)
    if unit == "line":
        assert parts == [x for x in text.replace("\n", "\n\x01").split("\x01") if x]


@pytest.mark.parametrize("kind", ["array", "bitmap", "run", "mixed"])
def test_containers_select_what_they_hold(kind):
    rng = np.random.default_rng(5)
    every = {
        "array": np.sort(rng.choice(400_000, 900, replace=False)),
        "bitmap": np.flatnonzero(rng.random(300_000) < 0.5),
        "run": np.concatenate([np.arange(10, 70_000), np.arange(140_000, 140_100), np.arange(200_000, 270_000)]),
        "mixed": np.concatenate([np.arange(65_536), 65_536 + np.flatnonzero(rng.random(65_536) < 0.4), [200_000, 200_007, 262_143, 262_144]]),
    }[kind]
    found = infill.BoundarySet(every)
    kinds = {type(c).__name__ for c in found.containers}
    assert kinds == {"array": {"ArrayContainer"}, "bitmap": {"BitmapContainer"}, "run": {"RunContainer"}, "mixed": {"RunContainer", "BitmapContainer", "ArrayContainer"}}[kind]
    assert len(found) == len(every)
    for k in [0, 1, len(every) // 3, len(every) // 2, len(every) - 2, len(every) - 1, *rng.integers(0, len(every), 300)]:
        assert found.select(int(k)) == every[k]


def plain_cut(doc, text, unit="char"):
    text = text or ""
    digits = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, suf + pre + mid) if h4 % 100 < 20 else (n, "psm", a, b - a, pre + suf + mid)


def test_transform_and_its_inverse(spark):
    rng = random.Random(2)
    odd = [None, "", "x", "a <S> b", "<P", "<M>", "é😀" * 70_000, "tail<S", ">>head<", "\x00\x00a", "a\nb\n"]
    rows = [(i, odd[i % len(odd)] if i < 60 else "".join(rng.choice("abé€😀 <SPM>") for _ in range(rng.randrange(200)))) for i in range(400)]
    rows += [(None, "no id at all"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in rows], "doc_id long, text string, Form string, `odd name` int").repartition(3)
    got = infill.transformed(df)
    assert got.columns == ["doc_id", "odd name", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = got.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((repr(r["doc_id"]), r["n"], r["form"], repr(r["prefix_chars"]), repr(r["middle_chars"]), r["output"]) for r in out) == sorted(
        (repr(i), *(x if k not in (2, 3) else repr(x) for k, x in enumerate(plain_cut(i, t)))) for i, t in rows
    )
    assert sorted((repr(r["doc_id"]), r["again"]) for r in out) == sorted((repr(i), t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"} and {r["odd name"] for r in out} == {5}
    assert infill.transformed(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_are_cut_where_they_start(spark, unit):
    rows = [(i, "".join(random.Random(i).choice("ab \né") for _ in range(80))) for i in range(60)]
    cut = infill.transformed(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, rate=100, spm=0).collect()
    texts = dict(rows)
    for r in cut:
        _, pre, suf, mid = [r["output"].split("<")[0], *(r["output"].split(m)[1].split("<")[0] for m in ("<P>", "<S>", "<M>"))]
        text = texts[r["doc_id"]]
        assert pre + mid + suf == text
        for at in (len(pre), len(pre) + len(mid)):
            assert at in (0, len(text)) or (text[at - 1] in " \n" and text[at] not in " \n" if unit == "word" else text[at - 1] == "\n")


# ---------------------------------------------------------------- manifests


def plain_field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(nodes, fan):
    """(root, path of each node: (left, right) by level)"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(at):
            first = j - j % fan
            paths[i].append(("".join(nodes[first:j]), "".join(nodes[j + 1 : first + fan])))
        nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [j // fan for j in at]
    return nodes[0], paths


def plain_manifest(rows, fan=2):
    """rows: (doc_id, source, lang, n_chars, text)"""
    leaf = lambda r: sha("".join(plain_field(r[i]) for i in range(5)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in order:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = plain_tree([leaf(r) for r in groups[k]], fan)
    root, upper = plain_tree([trees[k][0] for k in order], fan)
    out = []
    for k, top in zip(order, upper, strict=True):
        for r, path in zip(groups[k], trees[k][1], strict=True):
            path = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(r) if not bad else sha("".join(plain_field(x + 1 if i == 3 else x) for i, x in enumerate(r)))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), trees[k][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def op12(df, fan=2, depth=10):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(tampered, merkle.leaf_hash([F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in queries.LEAF]))
    rows = merkle.manifest(df, merkle.leaf_hash([F.col(c) for c in queries.LEAF]), changed, fan=fan, depth=depth)
    folded = merkle.folded(F.col("presented"), F.col("path"))
    return rows.select("id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256), folded, folded == F.col("root")).collect()


@pytest.mark.parametrize(("fan", "depth"), [(2, 1), (2, 2), (3, 1), (2, 10)])
def test_manifest_in_blocks_of_any_size(spark, fan, depth):
    rng = random.Random(fan * 10 + depth)
    langs = [None, "", "en", "en", "en", "Z", "é", "😀", "solo"]
    rows = [(i, rng.choice(["s1", None, ""]), langs[i % 8], rng.choice([None, 0, 9, 10**9]), rng.choice(["", None, "é1:", "x" * 500])) for i in range(90)]
    rows += [(None, "s", "en", 1, "a"), (None, "s", "en", 2, "b"), (5, "s", "en", 3, "again"), (5, "s", "en", 3, "again"), (900, "s", "solo", 1, "lone leaf")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    got = op12(df, fan, depth)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, plain_manifest(rows, fan)))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, path string, id int"
    one = spark.createDataFrame([(3, None, None, None, None, "own", 1)], schema)
    leaf, proof = sha("1:3" + "-" * 4), sha("")
    assert [tuple(r) for r in op12(one)] == [(3, leaf, leaf, leaf, proof, leaf, True)]
    assert op12(one.limit(0)) == []


# ---------------------------------------------------------------- fingerprints


def plain_print(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        folded = folded.replace(blank, " ")
    words = [w for w in folded.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, radius=2):
    prints = [(doc, plain_print(text)) for doc, text in rows]
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for doc, p in prints:
        if doc is not None:
            least[root(p)] = min(doc, least.get(root(p), doc))
    return sorted(repr((doc, f"{p:016x}", least.get(root(p)))) for doc, p in prints)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té€", max_size=40)), max_size=6))
def test_fingerprints(texts):
    assert simhash.fingerprints(texts).tolist() == [plain_print(t) for t in texts]


def test_bits_are_counted_in_parts(monkeypatch):
    texts = ["a b c d e f g " * 20, "", "one two", "x y z " * 50]
    whole = simhash.fingerprints(texts).tolist()
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprints(texts).tolist() == whole


def test_every_link_at_two_bits_or_fewer(spark):
    rng = random.Random(4)
    near = []
    for _ in range(60):
        p = rng.getrandbits(64)
        near += [p, *(p ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 1, 2, 2, 3))]
    chain = [0]
    for i in range(0, 60, 2):
        chain.append(chain[-1] ^ (3 << i))
    signed = [p - (1 << 64) if p >> 63 else p for p in {*near, *chain, (1 << 64) - 1}]
    df = spark.createDataFrame([(p,) for p in signed], "p long")
    for radius in (1, 2):
        links = [tuple(r) for r in simhash.ball_links(df, radius).collect()]
        wanted = {(a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
        assert set(links) <= wanted and len(links) == len(set(links))
        group = {p: p for p in signed}

        def root(p, group=group):
            while group[p] != p:
                p = group[p]
            return p

        for a, b in links:
            group[root(a)] = root(b)
        assert all(root(a) == root(b) for a, b in wanted)


def test_components_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base + f" tail{i % 9}") for i in range(5, 50)] + [(100 + i, t) for i, t in enumerate([None, "", " \n", "a", "A", "a b", "lone text of five words"])]
    rows += [(None, base), (None, "nobody has this one"), (7, "twice here"), (7, "twice here"), (200, "word " * 40_000)]
    df = spark.createDataFrame([(i, t, 1, "own") for i, t in rows], "doc_id long, text string, Fingerprint int, keep_me string").repartition(4)
    got = simhash.classified(df)
    assert got.columns == ["doc_id", "keep_me", "fingerprint", "component_id"]
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got.collect()) == plain_components(rows)
    assert simhash.classified(df.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.op13_simhash(spark, SF).collect()) == plain_components(rows)
