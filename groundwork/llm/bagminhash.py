"""Weighted MinHash signatures of shingle multisets, after the BagMinHash method.

A document is the multiset of its five-word shingles. For every shingle and
every unit of weight a Poisson process runs in time; a signature component is
the first arrival it sees below the document's weights, so two documents share
a component with a probability of just their weighted Jaccard similarity.

The weights are discretised by dyadic levels: (0, 1], (1, 2], (2, 4], (4, 8] ...
The published method splits one process over the whole range of weights into halves,
and these again, as its points need them. Here the hierarchy is laid flat: each
dyadic level has a process of its own, which by the splitting property of Poisson
processes is the same in distribution, and within a level points are thinned by the
unit that they draw instead of split further. Signatures are unbiased either way.
All components of one shingle and level share one process; each of its points
draws the component and the unit of weight that it belongs to, and counts only
when the document's weight reaches that unit. Points come in order of time, so a
process stops as soon as its next point is later than the document's slowest
component. That is about one point a shingle beyond what the components need,
instead of one for every shingle and component.

Everything is computed for a whole slice of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
#: Bits of a shingle's hash. With the document's number above them, one sort brings equal shingles together.
HASH_BITS = 48
#: Texts are taken in slices of so many bytes (and at least one text), which bounds memory.
SLICE_BYTES = 4 << 20

#: The six ASCII blanks become spaces, A-Z are lower-cased.
FOLD = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of ``x``."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of a text column with at most so many bytes, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start >= 1 << 14):
            yield start, i - start
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes) - start


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, weight) of the distinct shingles of a slice, by document and hash.

    A text of one to four words has one shingle, all its words; one without words has none.
    """
    folded = pa.array([(x or "").encode().translate(FOLD) for x in texts.to_pylist()], pa.binary())
    parts = pc.split_pattern(folded.cast(pa.string()), " ")
    coded = parts.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    filled = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0
    at = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    keep = filled[at] if len(at) else np.zeros(0, bool)
    word, doc = known[at[keep]], doc[keep]
    counts = np.bincount(doc, minlength=len(texts))
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    n = len(word)
    if n >= SHINGLE:
        joined = word[: n - SHINGLE + 1].copy()
        for j in range(1, SHINGLE):
            joined *= multiplier
            joined += word[j : n - SHINGLE + 1 + j]
        whole = doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :]
        joined, of = joined[whole], doc[: n - SHINGLE + 1][whole]
    else:
        joined, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        more = []
        for d in short:
            h = np.uint64(counts[d])
            for w in word[first[d] : first[d + 1]]:
                with np.errstate(over="ignore"):
                    h = h * multiplier + w
            more.append(h)
        joined, of = np.concatenate([joined, np.array(more, np.uint64)]), np.concatenate([of, short])
    key = (of.astype(np.uint64) << np.uint64(HASH_BITS)) | (mixed(joined) >> np.uint64(64 - HASH_BITS))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(first, append=len(key))
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), weight


def occurrences(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, element): each occurrence of a shingle as an element of its own, so that multisets become sets."""
    again = np.repeat(np.cumsum(weight) - weight, weight)
    number = np.arange(len(again)) - again
    element = np.repeat(shingle, weight)
    more = number > 0
    element[more] = mixed(element[more] ^ (number[more].astype(np.uint64) << np.uint64(HASH_BITS)))
    return np.repeat(doc, weight), element


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """An array (documents, m) of 64-bit components; documents without shingles have zeros."""
    strata = [(doc, shingle, weight, 0)]
    top = int(weight.max(initial=0))
    j = 1
    while (1 << (j - 1)) < top:
        above = weight > (1 << (j - 1))
        strata.append((doc[above], shingle[above], weight[above], j))
        j += 1
    d = np.concatenate([s[0] for s in strata])
    level = np.concatenate([np.full(len(s[0]), s[3], np.uint64) for s in strata])
    w = np.concatenate([s[2] for s in strata])
    seed = mixed(np.concatenate([s[1] for s in strata]) | (level << np.uint64(HASH_BITS)))
    span = np.where(level > 0, np.uint64(1) << (np.maximum(level, np.uint64(1)) - np.uint64(1)), np.uint64(1))
    base = np.where(level > 0, span, np.uint64(0)).astype(np.int64)  # the level holds the units base+1 .. base+span
    gap = 1.0 / (m * span.astype(np.float64))
    time = np.zeros(len(d))
    best = np.full(docs * m, np.inf)
    point = np.zeros(docs * m, np.uint64)
    slowest = np.full(docs, np.inf)
    turn = 0
    while len(d):
        turn += 1
        draw = mixed(seed + np.uint64(turn * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) * gap
        alive = time <= slowest[d]
        if not alive.all():
            d, w, seed, span, base, gap, time, draw = (x[alive] for x in (d, w, seed, span, base, gap, time, draw))
        second = mixed(draw)
        unit = base + 1 + ((second >> np.uint64(32)) % span).astype(np.int64)
        counts = unit <= w
        cell = d * m + ((second & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        cell, when, name = cell[counts], time[counts], draw[counts]
        np.minimum.at(best, cell, when)
        won = best[cell] == when
        point[cell[won]] = name[won]
        busy = np.unique(d)
        slowest[busy] = best.reshape(docs, m)[busy].max(axis=1)
    return point.reshape(docs, m)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """An array (documents, bands) of hashes of consecutive ``rows`` components; the band's number is part of the hash."""
    docs, m = signature.shape
    bands = m // rows
    parts = signature[:, : bands * rows].reshape(docs, bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (docs, bands)).copy()
    for r in range(rows):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return h
