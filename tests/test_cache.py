"""The answer cache by blocks and as a stream against running through the requests."""

import numpy as np
import pandas as pd
import pytest

from groundwork.operators import cache
from groundwork.streaming import jobs

SCHEMA = "seq long, scope_key string, embedding array<double>, payload string"


def shown(df):
    return sorted((r["scope_key"], r["seq"], r["hit"], r["payload"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in df.collect())


def requests(n, seed):
    """Crowds of like vectors, copies, chains of which each is near the next only, zero and missing vectors."""
    rng = np.random.default_rng(seed)
    crowd = rng.normal(size=(6, 4))
    rows = []
    for i in range(n):
        kind = i % 10
        if kind < 4:
            v = (crowd[rng.integers(6)] + rng.normal(size=4) * rng.choice([0.0, 0.02, 0.2])).tolist()
        elif kind < 7:
            angle = 0.2 * rng.integers(32)  # neighbours are 0.2 apart: cosine 0.98
            v = [float(np.cos(angle)), float(np.sin(angle)), 0.0, 0.0]
        else:
            v = [None, [0.0] * 4, rng.integers(-1, 2, 4).astype(float).tolist()][kind - 7]
        rows.append((i * 3, ["hot", "hot", "hot", "small", None][i % 5], v, f"p{i}"))
    return rows


@pytest.mark.parametrize(("few", "block"), [(0, 16), (40, 33), (7, 1000)])
def test_blocks_answer_as_the_order_does(spark, few, block):
    df = spark.createDataFrame(requests(240, few), SCHEMA).repartition(3)
    expected = shown(cache.answer_cache(df))
    assert shown(cache.answer_cache(df, few=few, block=block)) == expected
    assert {r[2] for r in expected} == {True, False}


def test_a_chain_is_settled_in_rounds(spark):
    angles = [0.2 * i for i in range(14)]  # each reaches the next only: every other one misses
    df = spark.createDataFrame([(i, "s", [float(np.cos(a)), float(np.sin(a))], f"p{i}") for i, a in enumerate(angles)], SCHEMA)
    got = shown(cache.answer_cache(df, few=0, block=5))
    assert [r[2] for r in got] == [i % 2 == 1 for i in range(14)] and got == shown(cache.answer_cache(df))


def test_a_crowd_makes_no_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "hot", (np.array([1.0, 0, 0]) + 0.01 * rng.normal(size=3)).tolist(), f"p{i}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = cache._blocks(df, 100)
    assert cache._before(blocks, blocks, 0.97).count() == 599  # not 600 * 599 / 2
    assert shown(cache.answer_cache(df, few=10, block=100)) == shown(cache.answer_cache(df))


def run_stream(spark, path, **options):
    """Answers what is there and ends."""
    stream = jobs.answer_cache_stream(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), **options)
    started = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append")
    if options:  # with a time to live, batches without data follow each other, so the stream is stopped
        started = started.start()
        started.processAllAvailable()
        started.stop()
    else:
        started = started.trigger(availableNow=True).start()
        assert started.awaitTermination(120)
    return spark.read.schema(cache.OUT).parquet(f"{path}/out")


def test_stream_equals_batch_and_adds_blocks_only(spark, tmp_path):
    rows = requests(120, 3)
    for part in range(3):  # three batches in order of arrival
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = shown(run_stream(spark, tmp_path))
    assert got == shown(cache.answer_cache(spark.createDataFrame(rows, SCHEMA)))


class Handle:
    """List state as a plain list, for what is written to it."""

    def __init__(self):
        self.held, self.written = [], []

    def getListState(self, name, schema, ttl):
        return self

    def get(self):
        return iter(self.held)

    def appendValue(self, value):
        self.held.append(value)
        self.written.append(len(value[1]))


def test_a_batch_writes_only_what_it_stores():
    handle, scope = Handle(), jobs._ScopeCache(0.97, None)
    scope.init(handle)
    answered = []
    for batch in range(4):
        part = [r for r in requests(80, 5)[batch * 20 : batch * 20 + 20] if r[1] == "hot"]
        answered += list(scope.handleInputRows(("hot",), iter([pd.DataFrame(part[::-1], columns=["seq", "scope_key", "embedding", "payload"])]), None))
    out = pd.concat(answered)
    stored = int((~out["hit"] & out["seq"].isin([r[0] for r in requests(80, 5) if r[2] is not None])).sum())
    assert sum(handle.written) == stored and len(handle.written) <= 4 and len(out) == len([r for r in requests(80, 5) if r[1] == "hot"])
