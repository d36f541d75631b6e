"""Reusing answers: a similarity cache that never crosses scopes.

Requests are answered in order of arrival. A request hits when the best cosine
over the entries of its own scope reaches the threshold; the latest entry wins a
tie, and a hit stores nothing. Cosines are rounded to twelve decimals, so that
ties are ties however they are computed.

Scopes are independent. One of up to ``IN_ORDER`` requests is run through in order by
one task. A larger one is laid in blocks of ``BLOCK`` vectors, and pairs of blocks are
compared by many tasks at once:

1. Only the first request of each vector can be a miss; its copies always hit.
2. A first request is a miss if no earlier one that is still open reaches the
   threshold with it. An open one that an earlier miss reaches is a hit. Both are told
   by one row a request and pair of blocks, so a crowd of like vectors makes no
   pairs; rounds go on with those still open, and when a scope has few
   enough of them left they are settled in order.
3. Every request finds its best among the misses before it.

The result is that of the order, whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v
from groundwork.sources.shared import written

#: Requests of a scope that one task runs through in order.
IN_ORDER = 20_000
#: Vectors of a block.
BLOCK = 2048
DECIMALS = 12

OUT = "seq long, scope_key string, hit boolean, payload string, similarity double"


class Entries:
    """The stored vectors and payloads of one scope."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.vectors, self.payloads = np.zeros((0, 0)), []

    def add(self, vectors: np.ndarray, payloads: list[str | None]) -> None:
        """Entries that were stored before, as unit vectors."""
        used = len(self.payloads)
        self.vectors = np.concatenate([self.vectors[:used].reshape(used, vectors.shape[1]), vectors])
        self.payloads = [*self.payloads, *payloads]

    def ask(self, vector: list[float] | None, payload: str | None) -> tuple[bool, str | None, float | None]:
        """(hit, payload, similarity); a miss stores the payload. Without a vector there is no hit, and nothing is stored."""
        if vector is None:
            return False, payload, None
        vector = np.asarray(vector, np.float64)
        norm = np.linalg.norm(vector)
        unit = vector / norm if norm else vector
        used = len(self.payloads)
        best = None
        if used:
            scores = np.round(self.vectors[:used] @ unit, DECIMALS)
            at = used - 1 - int(scores[::-1].argmax())
            best = float(scores[at])
            if best >= self.threshold:
                return True, self.payloads[at], best
        if used == len(self.vectors):
            grown = np.zeros((max(64, 2 * used), len(unit)))
            grown[:used] = self.vectors[:used] if used else grown[:0]
            self.vectors = grown
        self.vectors[used] = unit
        self.payloads.append(payload)
        return False, payload, best


def in_order(rows: DataFrame, threshold: float) -> DataFrame:
    """Answers by running through each scope's requests. Rows are sorted within partitions of whole scopes and stream through, so a scope is never gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, entries = object(), Entries(threshold)
        for batch in batches:
            out = []
            for seq, key, vector, payload in batch.itertuples(index=False):
                if key != scope:
                    scope, entries = key, Entries(threshold)
                out.append((seq, key, *entries.ask(vector, payload)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return rows.select("seq", "scope_key", "embedding", "payload").repartition("scope_key").sortWithinPartitions("scope_key", "seq").mapInPandas(run, OUT)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """``scope_key, block, first, last, seqs, vectors``: unit vectors of one scope in order of arrival, cut from sorted range partitions."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, scope, seqs, vectors = TaskContext.get().partitionId() << 33, None, [], []

        def out() -> pd.DataFrame:
            x = np.array(vectors, np.float64)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            return pd.DataFrame([{"scope_key": scope, "block": number, "first": seqs[0], "last": seqs[-1], "seqs": seqs, "vectors": unit.tobytes()}])

        for batch in batches:
            for key, seq, vector in batch.itertuples(index=False):
                if seqs and (key != scope or len(seqs) == block):
                    yield out()
                    number, seqs, vectors = number + 1, [], []
                scope = key
                seqs.append(seq)
                vectors.append(vector)
        if seqs:
            yield out()

    ranged = rows.select("scope_key", "seq", "embedding").repartitionByRange("scope_key", "seq").sortWithinPartitions("scope_key", "seq")
    return written(ranged.mapInPandas(cut, "scope_key string, block long, first long, last long, seqs array<long>, vectors binary"), "cache-blocks")


def _before(asking: DataFrame, entries: DataFrame, threshold: float | None) -> DataFrame:
    """``scope_key, seq, similarity, entry``: of each vector of ``asking`` the best of the earlier ones of ``entries``, the latest of equal ones, if it reaches the threshold.

    Pairs of blocks of a scope are compared where some entry comes before some
    request; each gives one row a request at most.
    """
    a = asking.select("scope_key", F.col("block").alias("a"), "last")
    b = entries.select("scope_key", F.col("block").alias("b"), "first")
    pairs = a.join(b, "scope_key").where("first < last").select("a", "b")
    side = lambda df, x: df.select(F.col("block").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("scope_key", "seqs", "vectors")))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                asks, holds = np.array(row.a_seqs), np.array(row.b_seqs)
                shape = lambda raw, n: np.frombuffer(raw, np.float64).reshape(n, -1)
                scores = np.round(shape(row.a_vectors, len(asks)) @ shape(row.b_vectors, len(holds)).T, DECIMALS)
                scores[holds[None, :] >= asks[:, None]] = -np.inf
                at = len(holds) - 1 - scores[:, ::-1].argmax(axis=1)
                found = scores[np.arange(len(asks)), at]
                kept = found >= (-2 if threshold is None else threshold)
                yield pd.DataFrame({"scope_key": row.a_scope_key, "seq": asks[kept], "similarity": found[kept], "entry": holds[at[kept]]})

    met = pairs.join(side(asking, "a"), "a").join(side(entries, "b"), "b")
    each = met.mapInPandas(best, "scope_key string, seq long, similarity double, entry long")
    top = each.groupBy("scope_key", "seq").agg(F.max(F.struct("similarity", "entry")).alias("best"))
    return top.select("scope_key", "seq", "best.*")


def _misses(firsts: DataFrame, threshold: float, few: int, block: int) -> DataFrame:
    """``scope_key, seq``: the requests that are stored, of those that bring a vector first (``scope_key, seq, embedding``)."""
    key = ["scope_key", "seq"]
    left, out = firsts, None
    while True:
        blocks = _blocks(left, block)
        later = written(_before(blocks, blocks, threshold).select(*key), "cache-later")
        missed = written(left.join(later, key, "left_anti"), "cache-missed")
        out = missed.select(*key) if out is None else out.unionByName(missed.select(*key))
        waiting = written(left.join(later, key, "left_semi"), "cache-waiting")
        hit = _before(_blocks(waiting, block), _blocks(missed, block), threshold).select(*key)
        left = written(waiting.join(hit, key, "left_anti"), "cache-left")
        most = left.groupBy("scope_key").count().agg(F.max("count")).first()[0] or 0
        if most <= few:
            settled = in_order(left.withColumn("payload", F.lit(None).cast("string")), threshold)
            return written(out.unionByName(settled.where("not hit").select(*key)), "cache-misses")


def in_blocks(rows: DataFrame, threshold: float, few: int, block: int) -> DataFrame:
    """Answers by comparing blocks of vectors: rows as for ``in_order``, with the same result."""
    rows = written(rows, "cache-rows")
    known = rows.where(F.col("embedding").isNotNull())
    firsts = written(known.groupBy("scope_key", "embedding").agg(F.min("seq").alias("seq")).select("scope_key", "seq", "embedding"), "cache-firsts")
    key = ["scope_key", "seq"]
    missed = _misses(firsts, threshold, few, block)
    stored = written(known.join(missed, key, "left_semi"), "cache-stored")
    best = written(_before(_blocks(known, block), _blocks(stored, block), None), "cache-best")
    payloads = stored.select("scope_key", F.col("seq").alias("entry"), F.col("payload").alias("stored"))
    named = best.where(F.col("similarity") >= threshold).join(payloads, ["scope_key", "entry"], "left").select(*key, F.lit(True).alias("hit"), "stored")
    out = rows.select(*key, "payload").join(best.select(*key, "similarity"), key, "left").join(named, key, "left")
    hit = F.coalesce("hit", F.lit(False))
    return out.select("seq", "scope_key", hit.alias("hit"), F.when(hit, F.col("stored")).otherwise(F.col("payload")).alias("payload"), "similarity")


def answer_cache(requests: DataFrame, threshold: float = v.CACHE_THRESHOLD, few: int = IN_ORDER, block: int = BLOCK) -> DataFrame:
    """``seq, scope_key, hit, payload, similarity`` of every request (``seq, scope_key, embedding, payload``; ``seq`` tells a scope's requests apart).

    ``similarity`` is the best over the scope's entries at that time, null for
    the first and for requests without a vector, which neither hit nor are stored.
    Scopes of more than ``few`` requests are compared by blocks.
    """
    rows = requests.select(F.col("seq").cast("long").alias("seq"), F.coalesce("scope_key", F.lit("")).alias("scope_key"), "embedding", "payload")
    large = written(rows.groupBy("scope_key").count().where(F.col("count") > few).select("scope_key"), "cache-large")
    if large.isEmpty():
        return in_order(rows, threshold)
    ordered = in_order(rows.join(large, "scope_key", "left_anti"), threshold)
    return ordered.unionByName(in_blocks(rows.join(large, "scope_key", "left_semi"), threshold, few, block))


def cache_stats(answered: DataFrame) -> DataFrame:
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return answered.agg(misses.alias("entries"), hits.alias("hits"), misses.alias("misses"), F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)).alias("hit_rate"))
