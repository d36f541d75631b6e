"""Fill-in-the-middle: texts cut twice at boundaries and put in another order.

The places where a text may be cut are a set of byte offsets in its UTF-8 form,
kept as a Roaring-style set: offsets are grouped by their upper bits, and each
group is the smallest of an array, a bitmap and a list of runs. The cardinalities
of containers are kept as running totals, so the k-th boundary is found by a
search for its container and a selection inside that: an array is indexed, a
bitmap is searched by the running totals of its words, runs by those of their
lengths. A text of ASCII letters is one run a container, whatever its length, and
a cut never walks over the text.

Units are the code points of a text, its words (a word goes with the blanks
after it) or its lines. Two draws from a keyed hash of the row's id choose the cut
places; a third and a fourth choose the form.

Defined results: a null text counts as empty. Rows without an id draw as if their
id were the empty string, repeated rows draw alike. A text that is empty or holds
one of the marks stays plain, so every output can be read back. Very long texts
are cut like any other. Columns of the input are carried, except the text (the
output holds it) and those with the names of results, in any case. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.bagminhash import slices
from groundwork.llm.common import carried

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")

#: Offsets of one container differ in these lower bits only.
LOW_BITS = 16
WORDS = (1 << LOW_BITS) // 64


class ArrayContainer:
    """Lower bits of the members, in order."""

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, i: int) -> int:
        return int(self.low[i])


class BitmapContainer:
    """A bit for every offset, and how many members lie before each word of 64."""

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits, bitorder="little").reshape(WORDS, 8)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bytes).sum(axis=1, dtype=np.int64))])

    def select(self, i: int) -> int:
        word = int(np.searchsorted(self.before, i, "right")) - 1
        members = np.flatnonzero(np.unpackbits(self.bytes[word], bitorder="little"))
        return word * 64 + int(members[i - self.before[word]])


class RunContainer:
    """Starts of runs, and how many members lie before each."""

    def __init__(self, starts: np.ndarray, before: np.ndarray) -> None:
        self.starts, self.before = starts.astype(np.uint16), before

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, "right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The kind that takes the fewest bytes: 2 a member, 4 a run, or a bit for every offset."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
    if 4 * len(first) <= min(2 * len(low), 8 * WORDS):
        return RunContainer(low[first], first)
    return ArrayContainer(low) if 2 * len(low) <= 8 * WORDS else BitmapContainer(low)


class BoundarySet:
    """Sorted offsets in containers, with the number of offsets before each container."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> LOW_BITS
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(offsets) else np.zeros(0, np.int64)
        self.keys, self.before = high[first], np.append(first, len(offsets))
        self.containers = [container(offsets[a:b] & ((1 << LOW_BITS) - 1)) for a, b in zip(self.before[:-1], self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th offset, from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << LOW_BITS) + self.containers[at].select(k - int(self.before[at]))


def boundaries(text: bytes, unit: str = "char") -> BoundarySet:
    """The start of every unit, and the end of the text: one more than it has units."""
    raw = np.frombuffer(text, np.uint8)
    if unit == "char":
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
    elif unit == "line":
        starts = np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1]) if len(raw) else np.zeros(0, np.int64)
    elif unit == "word":
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        starts = np.concatenate([[0], np.flatnonzero(blank[:-1] & ~blank[1:]) + 1]) if len(raw) else np.zeros(0, np.int64)
    else:
        raise ValueError(f"no such unit: {unit}")
    return BoundarySet(np.append(starts, len(raw)).astype(np.int64))


def _cut(unit: str):
    """Rows of (carried columns, text, form, two draws) as (carried columns, form, n, prefix, middle, output)."""
    marks = {name: mark.encode() for name, mark in zip("psm", MARKS, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.num_columns - 4
            for start, length in slices(whole.column(texts)):
                batch = whole.slice(start, length)
                n, prefix, middle, output = [], [], [], []
                for text, form, first, second in zip(*(batch.column(texts + i).to_pylist() for i in range(4)), strict=True):
                    text = text or b""
                    places = boundaries(text, unit)
                    n.append(len(places) - 1)
                    if form == "plain":
                        prefix.append(None)
                        middle.append(None)
                        output.append(text)
                        continue
                    low, high = sorted((first % len(places), second % len(places)))
                    a, b = places.select(low), places.select(high)
                    parts = {"p": marks["p"] + text[:a], "m": marks["m"] + text[a:b], "s": marks["s"] + text[b:]}
                    prefix.append(low)
                    middle.append(high - low)
                    output.append(b"".join(parts[x] for x in form))
                added = [pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                rest = list(range(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in rest), batch.column(texts + 1), *added],
                    [*(batch.schema.names[i] for i in rest), "_gw_form", "_gw_n", "_gw_prefix", "_gw_middle", "_gw_output"],
                )

    return run


RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the first digits of a hash of seed and id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Every row of ``df`` without its text, with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (units; null if plain) and ``output``.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of those with the
    suffix in front.
    """
    rest = [c for c in carried(df, text_col) if c.lower() not in RESULTS or c == id_col]
    text = F.col(text_col)
    first, second, third, fourth = draws(id_col, seed)
    marked = reduce(or_, (F.contains(text, F.lit(m)) for m in MARKS))
    form = F.when(text.isNull() | (text == "") | marked | (third % 100 >= rate), "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    asked = df.select(*rest, text.cast("binary").alias("_gw_text"), form.alias("_gw_form"), first.alias("_gw_first"), second.alias("_gw_second"))
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]
    done = asked.mapInArrow(_cut(unit), ", ".join([*fields, "_gw_form string, _gw_n long, _gw_prefix long, _gw_middle long, _gw_output binary"]))
    named = {"n": "_gw_n", "form": "_gw_form", "prefix_chars": "_gw_prefix", "middle_chars": "_gw_middle"}
    return done.select(*rest, *(F.col(c).alias(name) for name, c in named.items()), F.col("_gw_output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No text that is cut holds a mark, so the marks part it in just four."""
    parts = F.split(output, "|".join(re.escape(m) for m in MARKS), -1)
    put = lambda *order: F.concat(*(F.get(parts, F.lit(i)) for i in order))
    return F.when(form == "psm", put(1, 3, 2)).when(form == "spm", put(2, 3, 1)).otherwise(output)
