"""Exact deduplication by recursive (Grace) hash partitioning.

Records are dealt out by a hash of their content to as many buckets as their counted
bytes ask for, each half a table full. A bucket feeds an open-addressing table that
compares complete contents and holds at most ``table_bytes`` of them. Copies of a
content in the table are absorbed; what a bucket still has too much goes on,
unresolved, to the next level, which counts it and deals it out again by other bits
to buckets that are to be filled less. So levels are one or two at any size, and only
what overflows is ever moved again. Spark's shuffle and the tables written in the
shared folder are the spill files, so every level survives lost executors, and no
bucket of any size has to fit a task.

Before the first deal each slice of a few MB of texts is deduplicated by itself. A
group of copies that makes up a third of all rows thus sends one record a slice,
and the rows are matched to the final groups by the key of that record, which
stands for the copies within one slice only. A record that meets its content in
the table is passed on at once with the key of the content's first record, so a
table holds contents and one best record each, and no step gathers a group.

Defined results: ids are whole numbers. Null counts as the empty text. Texts are equal when identical
after lower-casing A-Z only. The row with the largest id stays (null ids are the
smallest), and of rows with that id, or without any, exactly one stays. Other
columns are carried along, whatever their case, unless they start with ``_gw_``.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.bagminhash import slices
from groundwork.llm.common import carried, having, written

LEAST, MASK = -(1 << 63), (1 << 64) - 1


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; ``bytes.lower`` changes nothing else."""
    return (text or "").encode().lower()


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of a content, compared in full."""

    def __init__(self, table_bytes: int) -> None:
        self.slots, self.hashes, self.contents = [-1] * 1024, [], []
        self.room = table_bytes

    def place(self, content: bytes, h: int) -> int:
        """The number of this content; -1 if it is new and there is no room for it."""
        size = len(self.slots) - 1
        at = h & size
        while (number := self.slots[at]) >= 0:
            if self.hashes[number] == h and self.contents[number] == content:
                return number
            at = (at + 1) & size
        if self.contents and len(content) + 100 > self.room:
            return -1
        self.room -= len(content) + 100
        self.slots[at] = number = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > size:
            self._grow()
        return number

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        size = len(self.slots) - 1
        for number, h in enumerate(self.hashes):
            at = h & size
            while self.slots[at] >= 0:
                at = (at + 1) & size
            self.slots[at] = number


def _slice_groups(table_bytes: int):
    """Adds, by slice of a batch: the key of the row's local group, that group's size, whether the row leads it, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in (whole.slice(*part) for whole in batches for part in slices(whole.column(1))):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            table, numbers, hashes, sizes, lead, count = ContentTable(table_bytes), [], [], [], {}, {}
            for row, text in enumerate(texts):
                h = xxhash.xxh3_64_intdigest(content := normalised(text))
                hashes.append(h)
                sizes.append(len(content))
                number = table.place(content, h)
                if number < 0:
                    number = -1 - row  # no room: a group of its own here, met again by its copies at the next step
                numbers.append(number)
                count[number] = count.get(number, 0) + 1
                best = lead.setdefault(number, row)
                if (LEAST if ids[row] is None else ids[row]) > (LEAST if ids[best] is None else ids[best]):
                    lead[number] = row
            keys = {number: first + row for number, row in lead.items()}
            first += len(texts)
            added = [
                pa.array([keys[n] for n in numbers], pa.int64()),
                pa.array([count[n] for n in numbers], pa.int64()),
                pa.array([lead[n] == row for row, n in enumerate(numbers)], pa.bool_()),
                pa.array(np.array(hashes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "_gw_key", "_gw_n", "_gw_lead", "_gw_hash", "_gw_size"])

    return run


#: A row of a level is a record that found no room (with ``_gw_text``), a record that met its content (``_gw_group``), or a content
#: (with the results), which stands for its first record too.
LEVEL_SCHEMA = "_gw_key long, _gw_id long, _gw_n long, _gw_hash long, _gw_text string, _gw_size long, _gw_group long, _gw_keep_key long, _gw_keep_id long, _gw_group_size long, _gw_text_sha256 string"
RECORD = ["_gw_key", "_gw_id", "_gw_n", "_gw_hash", "_gw_text", "_gw_size"]


def _level(table_bytes: int):
    """Resolves what fits the table; passes the rest on with its content."""
    fields = [x.split() for x in LEVEL_SCHEMA.split(", ")]
    kinds = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, best, count = ContentTable(table_bytes), [], [], []
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        for batch in (whole.slice(*part) for whole in batches for part in slices(whole.column(4))):
            rows = []
            for key, doc, n, h, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                number = table.place(normalised(text), h & MASK)
                if number < 0:
                    rows.append((key, doc, n, h, text or "", len(normalised(text)), None, None, None, None, None))
                    continue
                record = (LEAST if doc is None else doc, -key, doc)
                if number == len(first):
                    first.append(key)
                    best.append(record)
                    count.append(n)
                    continue
                rows.append((key, None, n, None, None, None, first[number], None, None, None, None))
                best[number] = max(best[number], record, key=lambda x: x[:2])
                count[number] += n
            if rows:
                yield out(rows)
        for start in range(0, len(first), 5000):
            rows = []
            for number in range(start, min(start + 5000, len(first))):
                _, key, doc = best[number]
                rows.append((first[number], None, None, None, None, None, first[number], -key, doc, count[number], hashlib.sha256(table.contents[number]).hexdigest()))
            yield out(rows)

    return run


def _buckets(left: DataFrame, table_bytes: int, level: int) -> int:
    """How many buckets what is left is dealt out to: counted bytes by the share of a table that they are to fill, a half at first."""
    filled = left.agg(F.sum(F.col("_gw_size") + 100)).first()[0] or 0
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) if level == 1 else 1
    return max(least, -(-filled * 2**level // table_bytes))


RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def _grouped(df: DataFrame, id_col: str, text_col: str, table_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its columns, and the results by key of a slice's group, both under names of our own (``_gw_``)."""
    rest = carried(df, id_col, text_col)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, text_col, *rest)]
    schema = ", ".join([*fields, "_gw_key long", "_gw_n long", "_gw_lead boolean", "_gw_hash long", "_gw_size long"])
    rows = written(df.select(id_col, text_col, *rest).mapInArrow(_slice_groups(table_bytes), schema), "exact-rows")
    left = rows.where("_gw_lead").select("_gw_key", F.col(id_col).cast("long").alias("_gw_id"), "_gw_n", "_gw_hash", F.col(text_col).alias("_gw_text"), "_gw_size")
    found: DataFrame | None = None
    level = 1
    while True:
        dealt = left.repartition(_buckets(left, table_bytes, level), F.xxhash64("_gw_hash", F.lit(level))).select(*RECORD)
        level_rows = written(dealt.mapInArrow(_level(table_bytes), LEVEL_SCHEMA), f"exact-level{level}")
        results = [f"_gw_{c}" for c in ("keep_key", "keep_id", "group_size", "text_sha256")]
        contents = level_rows.where("_gw_keep_key is not null").select("_gw_key", *results)
        others = level_rows.where("_gw_group is not null and _gw_keep_key is null").select(F.col("_gw_key").alias("_gw_other"), F.col("_gw_group").alias("_gw_key"))
        done = contents.unionByName(others.join(contents, "_gw_key").select(F.col("_gw_other").alias("_gw_key"), *results))
        found = done if found is None else found.unionByName(done)
        left = level_rows.where("_gw_group is null").select(*RECORD)
        if left.isEmpty():
            break
        level += 1
    return rows, found


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 32 << 20) -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; columns of ``df`` with these names, in any case, give way.

    ``table_bytes`` bounds the contents that one table holds, and with it the
    memory of a task.
    """
    own = [c for c in df.columns if c.lower() not in RESULTS]
    rows, found = _grouped(df, id_col, text_col, table_bytes)
    joined = rows.join(found, "_gw_key").withColumn("_gw_kept", F.col("_gw_lead") & (F.col("_gw_key") == F.col("_gw_keep_key")))
    return joined.select(*own, *(F.col(f"_gw_{c}").alias(c) for c in RESULTS))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    rows, found = _grouped(df, id_col, text_col, table_bytes)
    return having(rows.where("_gw_lead"), found.where("_gw_key = _gw_keep_key"), "_gw_key").select(*df.columns)
