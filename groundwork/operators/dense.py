"""Exact nearest chunks by embedding, over blocks that bounds can rule out.

Chunks are written once in blocks of like vectors (``DenseIndex``): in range order by
scope and nearest pivots, a few hundred rows a block, each with its centroid and
radius. Questions are put in groups in the same way, so any number of them meets
all chunks in one job. Angles on the sphere obey the triangle inequality, so no
chunk of a block scores better than the cosine of (angle to the centroid - radius).

1. Every group meets the pages of block summaries, and each question names the
   ``SEEDS`` blocks in its scope with the best bounds.
2. Those blocks are read; the n-th best score is a floor that the answer reaches.
3. Groups meet the summaries again; only blocks whose bound reaches the floor of
   some question of the group, and hold something of its scope, are read.

Scopes prune blocks by company and year in the same step. Questions are never
collected; groups, blocks and pages are rows of tables that Spark joins. Where no n
chunks are in scope there is no floor, and all blocks in scope are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.operators.sparse import ranked
from groundwork.sources.shared import written

#: Rows of a block of chunks, questions (with scope) of a group; a page has 2 ** ``PAGE_BITS`` summaries.
BLOCK, GROUP, PAGE_BITS = 1024, 512, 10
#: Blocks that a question's floor is taken from.
SEEDS = 3
#: Vectors that like ones are put together by, a bounded sample of the chunks. Results do not depend on it.
PIVOTS = 64
#: Pages are read in so many parts.
PARTS = 16
#: Bytes of questions' vectors that are sent to all blocks at once; more are taken in turns.
SENT_BYTES = 32 << 20
#: Bounds are this much on the safe side of rounding.
SAFE = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.array(vectors.tolist(), np.float64))


def _packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.float64).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def _chained(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest of the rest."""
    left, order = list(range(1, len(pivots))), [0]
    while left:
        order.append(left.pop(int(np.argmax(pivots[left] @ pivots[order[-1]]))))
    return pivots[order]


def _nearest_two(pivots: np.ndarray):
    """Numbers of the two nearest pivots of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = np.argsort(-(_matrix(batch["embedding"]) @ pivots.T), axis=1)[:, :2] if len(batch) else np.zeros((0, 1), np.int64)
            yield batch.assign(p1=order[:, 0], p2=order[:, -1])

    return run


def _in_blocks(rows: DataFrame, pivots: np.ndarray, size: int, names: list[str]) -> DataFrame:
    """``block, n, vectors`` and an array of each column of ``names``: rows with like vectors, ``size`` of them at most.

    A block is cut from a sorted range partition, so nothing is shuffled twice.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*names, "embedding"))
    placed = rows.select(*names, "embedding").mapInPandas(_nearest_two(pivots), f"{schema}, p1 int, p2 int")
    order = [*(c for c in ("company", "fiscal_year") if c in names), "p1", "p2", names[0], *names[1:2]]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 33, []

        def out(part: pd.DataFrame) -> dict:
            return {"block": number, "n": len(part), "vectors": _packed(_matrix(part["embedding"])), **{c: part[c].tolist() for c in names}}

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < size:
                continue
            whole = pd.concat(held, ignore_index=True)
            start, made = 0, []
            turns = np.flatnonzero(whole["p1"].to_numpy()[1:] != whole["p1"].to_numpy()[:-1]) + 1
            while start + size <= len(whole):
                # A block ends with its pivot's rows, if it has an eighth of its rows by then.
                at = int(np.searchsorted(turns, start + max(1, size // 8)))
                end = min([start + size, *turns[at : at + 1].tolist()])
                made.append(out(whole.iloc[start:end]))
                start, number = end, number + 1
            yield pd.DataFrame(made)
            held = [whole.iloc[start:]]
        whole = pd.concat(held, ignore_index=True) if held else ()
        if len(whole):
            turns = np.flatnonzero(whole["p1"].to_numpy()[1:] != whole["p1"].to_numpy()[:-1]) + 1
            for part in np.split(np.arange(len(whole)), [t for i, t in enumerate(turns) if t - (turns[i - 1] if i else 0) >= size // 8]):
                yield pd.DataFrame([out(whole.iloc[part])])
                number += 1

    arrays = ", ".join(f"`{c}` array<{kinds[c]}>" for c in names)
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, f"block long, n int, vectors binary, {arrays}")


def _summaries(scoped: bool):
    """Blocks as ``block, centroid, radius`` and, if scoped, their distinct companies and years."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch.itertuples():
                x = _unpacked(b.vectors, b.n)
                centroid = _unit(x.mean(axis=0, keepdims=True))[0]
                # A zero vector has no direction; its block is never ruled out.
                radius = float(np.arccos(np.clip(x @ centroid, -1, 1).min())) if x.any(axis=1).all() and centroid.any() else math.pi
                scope = {c: sorted({v for v in getattr(b, c) if v is not None}) for c in ("company", "fiscal_year")} if scoped else {}
                rows.append({"block": b.block, "centroid": centroid.tolist(), "radius": radius, **scope})
            if rows:
                yield pd.DataFrame(rows)

    return run


def _fits(asked: list, held: list[list]) -> np.ndarray:
    """(questions, blocks): the block holds the value that is asked for, or none is."""
    out = np.array([[x is None] for x in asked], bool).repeat(len(held), axis=1)
    where: dict = {}
    for i, values in enumerate(held):
        for v in values:
            where.setdefault(v, []).append(i)
    for j, x in enumerate(asked):
        if x is not None:
            out[j, where.get(x, [])] = True
    return out


def _bounds(row, scoped: bool) -> np.ndarray:
    """(questions, blocks) of a group and a page: no chunk of the block that is in scope scores better; minus infinity if none is."""
    q, c = _unpacked(row.g_vectors, row.g_n), np.array([list(x) for x in row.centroid])
    angle = np.arccos(np.clip(q @ c.T, -1, 1)) - np.array(row.radius)[None, :]
    bound = np.cos(np.maximum(angle, 0)) + SAFE
    if scoped:
        bound[~(_fits(list(row.g_company), row.company) & _fits(list(row.g_fiscal_year), row.fiscal_year))] = -np.inf
    return bound


def _best_blocks(scoped: bool):
    """A group's questions with their ``SEEDS`` best blocks of a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                bound = _bounds(row, scoped)
                best = np.argsort(-bound, axis=1)[:, :SEEDS]
                job = np.repeat(np.arange(len(bound)), best.shape[1])
                at = best.ravel()
                kept = bound[job, at] > -np.inf
                yield pd.DataFrame({"grp": row.grp, "job": job[kept], "block": np.array(row.block)[at[kept]], "bound": bound[job, at][kept]})

    return run


def _reaching_blocks(scoped: bool):
    """Blocks of a page whose bound reaches the floor of some question of the group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                floor = np.full(row.g_n, -np.inf)
                for f in row.floors if row.floors is not None else ():
                    floor[f["job"]] = f["floor"]
                bound = _bounds(row, scoped)
                yield pd.DataFrame({"grp": row.grp, "block": np.array(row.block)[((bound >= floor[:, None]) & (bound > -np.inf)).any(axis=0)]})

    return run


def _equal(asked: list, values: list) -> np.ndarray:
    """(questions, rows): the row has the value that is asked for, or none is."""
    codes, names = pd.factorize(pd.Series(values, dtype=object))
    code = {name: i for i, name in enumerate(names)}
    own = np.array([-2 if x is None else code.get(x, -3) for x in asked])
    return (own[:, None] == codes[None, :]) | (own[:, None] == -2)


def _scored(n: int, scoped: bool):
    """The n best of a block for each question of a group, no worse than its floor: ``grp, job, id, score``; ties by id.

    Scores are rounded to twelve decimals, so that equal vectors tie wherever they stand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                scores = np.round(_unpacked(row.g_vectors, row.g_n) @ _unpacked(row.vectors, row.n).T, 12)
                if scoped:
                    scores[~(_equal(list(row.g_company), list(row.company)) & _equal(list(row.g_fiscal_year), list(row.fiscal_year)))] = -np.inf
                bar = np.full(row.g_n, -np.inf)
                for f in row.floors if row.floors is not None else ():
                    bar[f["job"]] = f["floor"]
                if row.n > n:
                    bar = np.maximum(bar, np.partition(scores, row.n - n, axis=1)[:, row.n - n])
                job, at = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
                found = pd.DataFrame({"grp": row.grp, "job": job, "id": pd.Series(list(row.id), dtype=object).to_numpy()[at], "score": scores[job, at]})
                if row.n > n:  # more than n only where scores tie
                    found = found.sort_values(["job", "score", "id"], ascending=[True, False, True]).groupby("job").head(n)
                yield found

    return run


class DenseIndex:
    """Chunks (``id``, ``embedding``; ``company`` and ``fiscal_year`` when ``scoped``) in written blocks; rows without an embedding are left out."""

    def __init__(self, chunks: DataFrame, scoped: bool = False, block: int = BLOCK) -> None:
        self.scoped, self.names = scoped, ["id", *(["company", "fiscal_year"] if scoped else [])]
        rows = chunks.where(F.col("embedding").isNotNull()).select(*self.names, "embedding")
        self.kind = rows.schema["id"].dataType.simpleString()
        sample = rows.select("embedding").orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(PIVOTS).collect()
        self.pivots = _chained(_unit(np.array([r[0] for r in sample], np.float64))) if sample else np.zeros((1, 1))
        self.blocks = written(_in_blocks(rows, self.pivots, block, self.names), "dense-blocks") if sample else None
        if sample:
            scope = ", company array<string>, fiscal_year array<string>" if scoped else ""
            each = self.blocks.mapInPandas(_summaries(scoped), f"block long, centroid array<double>, radius double{scope}")
            columns = [F.collect_list(c).alias(c) for c in ("block", "centroid", "radius", *self.names[1:])]
            # Blocks of a page lie together, so that pages are like their blocks.
            page = F.shiftright("block", PAGE_BITS).alias("page")
            self.pages = written(each.groupBy(page).agg(*columns).withColumn("part", F.pmod("page", F.lit(PARTS))).drop("page"), "dense-pages")

    def _groups(self, questions: DataFrame) -> DataFrame:
        """``grp, g_n, g_vectors`` and the questions of each group in arrays, in order of their job numbers."""
        asked = questions.where(F.col("embedding").isNotNull())
        if self.scoped:
            none = F.array(F.struct(F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("fiscal_year")))
            whole = F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(none)
            asked = asked.select("question_id", "embedding", F.posexplode(whole).alias("scope_no", "s")).select("question_id", "scope_no", F.col("s.company").alias("company"), F.col("s.fiscal_year").alias("fiscal_year"), "embedding")
        else:
            asked = asked.select("question_id", F.lit(0).alias("scope_no"), "embedding")
        grouped = _in_blocks(asked, self.pivots, GROUP, ["question_id", "scope_no", *self.names[1:]])
        return grouped.select(F.col("block").alias("grp"), F.col("n").alias("g_n"), F.col("vectors").alias("g_vectors"), "question_id", "scope_no", *(F.col(c).alias(f"g_{c}") for c in self.names[1:]))

    def _facing(self, groups: DataFrame) -> DataFrame:
        """Every group beside every page of summaries, which are few: one for a million chunks."""
        return self.pages.repartition(PARTS, "part").crossJoin(F.broadcast(groups.drop("question_id", "scope_no")))

    def _scores(self, pairs: DataFrame, groups: DataFrame, n: int) -> DataFrame:
        """Blocks move once, to the pairs that name them; questions' vectors are sent there, so that no pair's vectors are shuffled."""
        met = pairs.join(self.blocks, "block").join(F.broadcast(groups.drop("question_id", "scope_no")), "grp")
        return met.mapInPandas(_scored(n, self.scoped), f"grp long, job int, id {self.kind}, score double")

    def reached(self, questions: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """(groups with ``floors``, pairs of a group and a block that has to be read)."""
        return self._reached(written(self._groups(questions), "dense-groups"), n)

    def _reached(self, groups: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        seeds = self._facing(groups).mapInPandas(_best_blocks(self.scoped), "grp long, job int, block long, bound double")
        chosen = written(ranked(seeds, ["grp", "job"], SEEDS, "bound", "block").select("grp", "block").distinct(), "dense-seeds")
        first = self._scores(chosen, groups.withColumn("floors", F.lit(None).cast("array<struct<job:int,floor:double>>")), n)
        floors = ranked(first, ["grp", "job"], n).where(F.col("rank") == n).groupBy("grp").agg(F.collect_list(F.struct("job", F.col("score").alias("floor"))).alias("floors"))
        groups = written(groups.join(floors, "grp", "left"), "dense-floors")
        return groups, written(self._facing(groups).mapInPandas(_reaching_blocks(self.scoped), "grp long, block long"), "dense-pairs")

    def topk(self, questions: DataFrame, n: int) -> DataFrame:
        """``question_id[, scope_no], id, score, rank``: the n chunks of the largest cosine, ties by id.

        ``questions``: question_id, embedding, and scopes when ``scoped`` (no scope:
        all chunks). Those without an embedding are not answered.
        """
        out = ["question_id", "scope_no", "id", "score", "rank"] if self.scoped else ["question_id", "id", "score", "rank"]
        if self.blocks is None:
            schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, scope_no int, id {self.kind}, score double, rank int"
            return questions.sparkSession.createDataFrame([], schema).select(*out)
        groups = written(self._groups(questions), "dense-groups")
        held = groups.agg(F.sum(F.octet_length("g_vectors"))).first()[0] or 0
        turns = max(1, -(-held // SENT_BYTES))
        best = None
        for turn in range(turns):
            asked, pairs = self._reached(groups.where(F.pmod(F.xxhash64("grp"), F.lit(turns)) == turn) if turns > 1 else groups, n)
            some = ranked(self._scores(pairs, asked, n), ["grp", "job"], n)
            some = written(some, "dense-best") if turns > 1 else some
            best = some if best is None else best.unionByName(some)
        names = groups.select("grp", F.posexplode(F.arrays_zip("question_id", "scope_no")).alias("job", "x")).select("grp", "job", "x.*")
        return best.join(names, ["grp", "job"]).select(*out)


def topk(chunks: DataFrame, questions: DataFrame, n: int, scoped: bool = False, block: int = BLOCK) -> DataFrame:
    """``DenseIndex.topk`` over an index made for the purpose."""
    return DenseIndex(chunks, scoped, block).topk(questions, n)
