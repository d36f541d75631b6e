"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document's ids are followed by an end id. Full windows are cut off first and
stand alone; the tail that is left joins, whole, a block of tails that the
differencing method deals to windows: each tail starts as a partial partition of
its own, and the two partial partitions with the largest imbalance are merged
again and again, the fuller windows of one with the emptier of the other. When a
window of the result exceeds the capacity, the block is dealt again to one window
more, up to ``slack`` windows in a hundred more than its ids need. Only what is
then still over the capacity of its window is cut off, and fills the room that
others have.

Blocks are formed from the rows that a task streams, so there is no shuffle and
no group; memory is a slice of a few MB of texts (one text at least) and one block.

Defined results: a null text counts as empty and has only the end id. Repeated
rows are packed once each. Sequence ids are unique but not gapless: the upper
bits are the task's. Other columns do not matter. An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from groundwork.llm.bagminhash import slices
from groundwork.llm.tokens import TokenCounter

#: Texts are encoded in slices of so many bytes: the larger a slice, the fewer words are encoded twice.
ENCODED_BYTES = 8 << 20
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Deal pieces to at most ``windows`` windows by multiway differencing: (sum, piece numbers) of each non-empty window.

    A partial partition is the list of its non-empty windows, largest first; the missing ones are empty.
    """
    heap = [(-size, i, [(size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        apart = max(0, windows - len(b))  # the windows of `a` from here on meet a window of `b`
        merged = a[:apart] + b[: max(0, windows - len(a))]
        for x, y in zip(a[apart:], reversed(b[windows - len(a) :] if len(a) < windows else b), strict=False):
            merged.append((x[0] + y[0], (x[1], y[1])))
        merged.sort(key=itemgetter(0), reverse=True)
        imbalance = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        tie += 1
        heapq.heappush(heap, (-imbalance, tie, merged))
    out = []
    for total, tree in heap[0][2] if heap else []:
        numbers, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                numbers.append(node)
            else:
                stack.extend(node)
        out.append((total, sorted(numbers)))
    return out


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Pieces by window, none over capacity, from the least number of windows upwards."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, count)
        if all(total <= capacity for total, _ in dealt):
            return [numbers for _, numbers in dealt]
        count += 1


def windows_with_cuts(sizes: list[int], capacity: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """(piece number, start in it, length) by window: whole pieces, but for what no window within ``slack`` percent more can take."""
    least = max(1, -(-sum(sizes) // capacity))
    for count in range(least, least + least * slack // 100 + 1):
        dealt = difference(sizes, count)
        if all(total <= capacity for total, _ in dealt):
            break
    windows = [[(i, 0, sizes[i]) for i in numbers] for _, numbers in dealt] + [[] for _ in range(count - len(dealt))]
    room, over = [], []
    for number, window in enumerate(windows):
        left = capacity - sum(length for _, _, length in window)
        while left < 0:  # the largest piece gives what is over, or all of itself
            at = max(range(len(window)), key=lambda j: window[j][2])
            i, start, length = window[at]
            given = min(-left, length)
            window[at : at + 1] = [(i, start, length - given)] if given < length else []
            over.append((i, start + length - given, given))
            left += given
        if left:
            room.append((left, number))
    # The largest first, so that few are cut once more.
    heapq.heapify(room := [(-left, number) for left, number in room])
    for i, start, length in sorted(over, key=itemgetter(2), reverse=True):
        while length:
            left, number = heapq.heappop(room)
            taken = min(-left, length)
            windows[number].append((i, start, taken))
            start, length = start + taken, length - taken
            if taken < -left:
                heapq.heappush(room, (left + taken, number))
    return [w for w in windows if w]


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, block: int = 512, slack: int = 1) -> DataFrame:
    """One row per piece; ``tokenizer`` is the path of a byte-level BPE vocabulary file, present on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sequence, tails = TokenCounter(tokenizer), TaskContext.get().partitionId() << 33, []

        def close(part: list) -> list:
            nonlocal sequence
            rows = []
            for window in windows_with_cuts([len(ids) for *_, ids in part], capacity, slack):
                offset = 0
                for i, start, length in window:
                    doc, first, n, ids = part[i]
                    rows.append((doc, first + start, length, zlib.crc32(ids[start : start + length].tobytes()), n, sequence, offset))
                    offset += length
                sequence += 1
            return rows

        def batch_of(rows: list) -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in (whole.slice(*part) for whole in batches for part in slices(whole.column(1), ENCODED_BYTES)):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), counter.encode(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[start : start + capacity].tobytes()), len(ids), sequence, 0))
                    sequence += 1
                if full < len(ids):
                    tails.append((doc, full, len(ids), ids[full:].copy()))
            while len(tails) >= block:
                rows += close(tails[:block])
                tails = tails[block:]
            if rows:
                yield batch_of(rows)
        if tails:
            yield batch_of(close(tails))

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, PIECE_SCHEMA)
