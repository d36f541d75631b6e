"""Byte-level BPE ids of whole texts, batch by batch, as ``tokenizers`` gives them without added special tokens.

In the vocabulary's splitting pattern a space that stands before a character
other than white space always starts a new word. Cutting a text at such spaces
therefore never changes its ids. A batch of texts is cut by Arrow, each distinct
part is encoded once, and the ids of the texts are gathered from those. Texts
with other runs of white space after a space are encoded whole. Texts that hold a
special token's own text, or white space of a length that the fast library's
pattern search cannot take, are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: The splitting pattern of the vocabulary, and the byte-to-letter alphabet of its file (printable
#: bytes stand for themselves, the others for the letters from 256 on).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: White space of the splitting pattern.
BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space before white space of any kind, or at the end.
LOOSE_SPACE = rf" ([{BLANK}]|\z)"
#: A run of white space that the fast library's pattern search is not asked to take, as it tries back through all of it; and one that is
#: looked for first, as a search for long repeats is slow.
LONG_BLANK, SOME_BLANK = rf"[{BLANK}]{{1000}}", rf"[{BLANK}]{{8}}"


def vocabulary(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE file of the ``tokenizers`` library, without special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", ()) if x.get("special")}
    byte = {chr(b): b for b in PRINTABLE}
    byte |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
    return {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def special_tokens(path: str) -> list[str]:
    """Texts that are special tokens wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return [x["content"] for x in json.load(f).get("added_tokens", ()) if x.get("special")]


class TokenCounter:
    """The ids of texts by one vocabulary file."""

    def __init__(self, path: str) -> None:
        ranks = vocabulary(path)
        self.library = Tokenizer.from_file(path)
        self.special = special_tokens(path)
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, as uint32; none for null."""
        texts = texts.fill_null("")
        loose = pc.match_substring_regex(texts, LOOSE_SPACE).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(texts), bool)
        some = np.flatnonzero(pc.match_substring_regex(texts, SOME_BLANK).to_numpy(zero_copy_only=False))
        odd[some] = pc.match_substring_regex(texts.take(pa.array(some)), LONG_BLANK).to_numpy(zero_copy_only=False)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = iter(self._plain(texts.filter(pa.array(~loose & ~odd))))
        return [self._by_library(texts[i].as_py()) if odd[i] else self._one(texts[i].as_py()) if loose[i] else next(plain) for i in range(len(texts))]

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        first = np.cumsum(np.concatenate([[0], pc.list_value_length(parts).to_numpy()]))[:-1]

        # Each distinct part after its space: encoded in one call, the ids handed out by bytes.
        filled = pc.binary_length(words).to_numpy() > 0
        ids = self._one("".join(" " + w for w in words.to_pylist() if w))
        ends = np.cumsum(pc.binary_length(words).to_numpy()[filled].astype(np.int64) + 1)
        size = np.zeros(len(words), np.int32)
        size[filled] = np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends) + 1, prepend=0)
        start = np.cumsum(size, dtype=np.int32) - size

        # The first part of a text has no space before it.
        heads, which = np.unique(at[first], return_inverse=True)
        own = [self._one(words[int(i)].as_py()) for i in heads]
        own_size = np.array([len(x) for x in own], np.int32)
        own_start = len(ids) + np.cumsum(own_size, dtype=np.int32) - own_size
        ids = np.concatenate([ids, *own])
        starts, sizes = start[at], size[at]
        starts[first], sizes[first] = own_start[which], own_size[which]

        upto = np.cumsum(sizes, dtype=np.int32)
        where = np.repeat(starts - (upto - sizes), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return np.split(ids[where], upto[first[1:] - 1])
