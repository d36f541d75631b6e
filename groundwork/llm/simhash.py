"""SimHash near duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit for each bit of the hashes of a text's shingles, set where
over half of the hashes have it. Two fingerprints that differ in at most two bits
meet at some variant that is within one bit of both. So each distinct fingerprint
emits itself and its 64 variants of one flipped bit; rows that share a variant are
exactly the pairs wanted.

A variant's holders are the variant itself or lie one bit from it. A bucket thus
has 65 members at most, however many documents there are, and is told in full by a
64-bit mask and a flag. Both are combined on the map side, so the shuffle has fixed
size rows and no key gathers anything. All holders of a variant are within two bits of
each other, so links from one of them to the others connect what all pairs would,
and every link is verified on the fingerprints. Copies share a fingerprint and
meet as one. Links become components by alternating star steps on written tables.

Defined results: A-Z are lower-cased, words are what stands between the six ASCII
blanks. A null text counts as empty; a text without words has fingerprint zero and
is linked like any other. A text of one or two words has one shingle, all its
words. ``component_id`` is the least id of the component, null only if none of its
rows has one. Repeated rows get a row each. Columns are carried except the text and
those with the names of results, in any case. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.bagminhash import FOLD, slices
from groundwork.llm.common import carried, written
from groundwork.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 64

#: Hashes whose bits are counted at once, which bounds memory: 64 bytes each.
AT_ONCE = 1 << 17


def hashes(text: str | None) -> np.ndarray:
    """XXH64 of every shingle of a text."""
    words = (text or "").encode().translate(FOLD).split()
    size = min(SHINGLE, len(words)) or 1
    joined = map(b" ".join, zip(*(islice(words, i, None) for i in range(size)), strict=False)) if words else ()
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), "<u8")


def _counted(every: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each bit is set among the hashes of each text; ``sizes``: how many of ``every`` are a text's."""
    counts = np.zeros((len(sizes), BITS), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    for start in range(0, len(every), AT_ONCE):
        of = text[start : start + AT_ONCE]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits = np.unpackbits(every[start : start + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return counts


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The fingerprints of some texts as unsigned numbers."""
    each = [hashes(text) for text in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    set_bits = 2 * _counted(np.concatenate([np.zeros(0, "<u8"), *each]), sizes) > sizes[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts fingerprints (as signed longs) in place of texts, which are the last column."""
    for whole in batches:
        last = whole.num_columns - 1
        for start, length in slices(whole.column(last)):
            batch = whole.slice(start, length)
            found = fingerprints(batch.column(last).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(found)], [*batch.schema.names[:last], "_gw_print"])


def fingerprinted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``_gw_print``, a signed long of the fingerprint's bits, in place of its text."""
    rest = carried(df, text_col)
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]
    return df.select(*rest, text_col).mapInArrow(_print, ", ".join([*fields, "_gw_print long"]))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: links that connect all distinct longs ``p`` of ``prints`` whose bits differ in ``radius`` (1 or 2) places or fewer."""
    if radius not in (1, 2):
        raise ValueError("variants of one bit find differences of one or two bits")
    # Number -1 stands for the fingerprint itself, 0 to 63 for the bit that is flipped.
    emitted = prints.select("p", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i"))
    flipped = F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(_bit(F.col("i")))
    variants = emitted.select(F.col("p").bitwiseXOR(flipped).alias("v"), flipped.alias("flip"), (F.col("i") < 0).alias("own"))
    buckets = variants.groupBy("v").agg(F.bit_or("flip").alias("flips"), F.bool_or("own").alias("own"))
    met = buckets.where(F.bit_count("flips") + F.col("own").cast("int") > 1)
    # At distance one, only the variant itself is linked to the others.
    met = met if radius == 2 else met.where("own")
    holders = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(F.col("flips").bitwiseAND(_bit(i)) != 0, F.col("v").bitwiseXOR(_bit(i)))), lambda x: x.isNotNull())
    starred = met.select("v", "own", holders.alias("holders")).select(F.when(F.col("own"), F.col("v")).otherwise(F.get("holders", F.lit(0))).alias("a"), F.explode("holders").alias("b"))
    pairs = starred.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


RESULTS = ["fingerprint", "component_id"]


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """Every row of ``df`` without its text, with ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    rest = [c for c in carried(df, text_col) if c.lower() not in RESULTS or c == id_col]
    rows = written(fingerprinted(df.select(*rest, text_col), text_col), "simhash-rows")
    distinct = written(rows.groupBy(F.col("_gw_print").alias("p")).agg(F.min(id_col).alias("least")), "simhash-prints")
    labels = components(written(ball_links(distinct.select("p"), radius), "simhash-links"))
    named = distinct.join(labels.withColumnRenamed("node", "p"), "p", "left").withColumn("label", F.coalesce("label", "p"))
    least = named.groupBy("label").agg(F.min("least").alias("_gw_component"))
    by_print = named.select(F.col("p").alias("_gw_print"), "label").join(least, "label").select("_gw_print", "_gw_component")
    digits = F.lower(F.lpad(F.hex("_gw_print"), 16, "0"))
    return rows.join(by_print, "_gw_print").select(*rest, digits.alias("fingerprint"), F.col("_gw_component").alias("component_id"))
