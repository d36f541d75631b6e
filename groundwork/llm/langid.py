"""Language identification by span.

A model holds, for each language, hashed frequencies of letters, of letters
after and between their neighbours, and of whole words, together with the
scripts that the language is written in. The script of a word, found by
code-point range, narrows the languages that may score on it. Viterbi decoding
over the words' scores, with a penalty for every switch, labels the spans of a
text; the language of a text is the one whose spans hold most of its letters.

The model is fitted on at most ``rows_per_language`` rows a language (a share of
them by a hash of the id, so about that many), and its size is at most
``MAX_LANGUAGES`` times ``BUCKETS`` numbers (134 MB) however large the corpus is. More
labels than that stop the job before anything is learned.

Defined results: a text that is null or has no letter is ``und`` with score 0
and no spans; so is every text when there is nothing to learn from. Ties go to
the language that comes first by name. Repeated rows get a row each. Only the id
and text are read for a prediction; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.bagminhash import mixed, slices

BUCKETS, MAX_LANGUAGES, UNKNOWN = 1 << 16, 256, "und"

#: Main code-point ranges of scripts; letters elsewhere are of the last, nameless one.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


@cache
def script_table() -> np.ndarray:
    """By code point: 0 for what is no letter, else one more than the script's number."""
    names = np.zeros(0x110000, np.uint8)
    names[[i for i in range(0x110000) if chr(i).isalpha()]] = len(SCRIPTS) + 1
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for lo, hi in ranges:
            part = names[lo : hi + 1]
            part[part > 0] = number
    return names


@dataclass
class Words:
    """The words of a slice of texts: those between blanks, each distinct one once."""

    at: np.ndarray  # the distinct word at each place
    doc: np.ndarray  # the text of each place
    letters: np.ndarray  # letters of each distinct word
    script: np.ndarray  # the script of its first letter, 0 without letters
    feature: np.ndarray  # features of all distinct words, one after the other
    owner: np.ndarray  # the distinct word of each feature


def words_of(texts: pa.Array) -> Words:
    # U+0000 separates words below; in a text it is no letter, as is U+0001.
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.replace_substring(texts.fill_null(""), "\0", "\1")))
    coded = parts.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    char = np.frombuffer(("\0" + "\0".join(distinct) + "\0").encode("utf-32-le"), np.uint32) if distinct else np.zeros(2, np.uint32)
    script = script_table()[char]
    owner = np.cumsum(char == 0) - 1
    char = np.where(script > 0, char, 0).astype(np.uint64)
    here = np.flatnonzero(script > 0)
    before, middle, after = char[here - 1], char[here], char[here + 1]
    letters = np.bincount(owner[here], minlength=len(distinct))
    first = np.zeros(len(distinct), np.uint8)
    first[owner[here][::-1]] = script[here][::-1]
    one = mixed(middle)
    two = mixed(before * np.uint64(1 << 21) + middle + np.uint64(1 << 62))
    three = mixed((before * np.uint64(1 << 21) + middle) * np.uint64(1 << 21) + after + np.uint64(1 << 63))
    # A run of letters as a whole: the sum of its letters mixed with their places.
    starts = np.flatnonzero(before == 0)
    place = np.arange(len(here)) - np.repeat(starts, np.diff(starts, append=len(here)))
    run = mixed(np.add.reduceat(mixed(middle + (place.astype(np.uint64) << np.uint64(32))), starts)) if len(starts) else np.zeros(0, np.uint64)
    feature = (np.concatenate([one, two, three, run]) >> np.uint64(48)).astype(np.int64)
    return Words(at, doc, letters, first, feature, np.concatenate([*[owner[here]] * 3, owner[here][starts]]))


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # (BUCKETS, languages): log probability of a feature
    scripts: np.ndarray  # (scripts + 2, languages): what is taken off where a script is not the language's

    def word_scores(self, words: Words) -> np.ndarray:
        """(distinct words, languages). Features overlap, hence the third."""
        out = np.zeros((len(words.letters), len(self.languages)))
        for i in range(len(self.languages)):
            out[:, i] = np.bincount(words.owner, weights=self.score[words.feature, i], minlength=len(out)) / 3
        return out - self.scripts[words.script]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 5000) -> Model:
    """Learn from the rows of ``df`` that have a text and a language."""
    df = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in df.groupBy(lang_col).count().take(MAX_LANGUAGES + 1)}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS) + 2, 0)))
    share = F.coalesce(*(F.when(F.col(lang_col) == x, F.lit(rows_per_language / n)) for x, n in sizes.items()))
    sample = df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)).select(text_col, lang_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(languages), BUCKETS + len(SCRIPTS) + 2), np.int64)
        for whole in batches:
            for start, length in slices(whole.column(0)):
                batch = whole.slice(start, length)
                words = words_of(batch.column(0))
                lang = np.array([languages.index(x) for x in batch.column(1).to_pylist()])[words.doc]
                for i in np.unique(lang):
                    times = np.bincount(words.at[lang == i], minlength=len(words.letters))
                    seen[i, :BUCKETS] += np.bincount(words.feature, weights=times[words.owner], minlength=BUCKETS).astype(np.int64)
                    seen[i, BUCKETS:] += np.bincount(words.script, weights=times * words.letters, minlength=len(SCRIPTS) + 2).astype(np.int64)
        i, j = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(seen[i, j])], ["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(languages), BUCKETS + len(SCRIPTS) + 2))
    seen[rows["lang"], rows["bucket"]] = rows["n"]
    feature, script = seen[:, :BUCKETS], seen[:, BUCKETS:]
    score = np.log((feature + 0.5) / (feature.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T
    # A language is written in a script that makes up a hundredth of its letters; a script of no language narrows nothing.
    own = script >= 0.01 * np.maximum(1, script.sum(axis=1, keepdims=True))
    own[:, 0] = True
    return Model(languages, np.ascontiguousarray(score), np.where(own | ~own.any(axis=0), 0.0, 100.0).T)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels (columns of ``scores``) of the best path, each switch costing ``penalty``.

    One label throughout is best if no stretch gains half a penalty under
    another label: a path of k stretches has k - 1 switches at least. This is
    tried first, and most texts pass.
    """
    best = int(scores.sum(axis=0).argmax())
    gains = np.cumsum(scores - scores[:, [best]], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gains, axis=0), 0)
    if (gains - np.vstack([np.zeros((1, gains.shape[1])), lowest[:-1]])).max() <= penalty / 2:
        return np.full(len(scores), best)
    count = scores.shape[1]
    value, came = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        lead = value.index(top)
        top -= penalty
        came.append([i if v >= top else lead for i, v in enumerate(value)])
        value = [(v if v >= top else top) + s for v, s in zip(value, row, strict=True)]
    label = max(range(count), key=lambda i: (value[i], -i))
    path = [label]
    for step in reversed(came):
        path.append(label := step[label])
    return np.array(path[::-1])


def predicted(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 20.0) -> DataFrame:
    """Id, ``lang_pred``, ``score`` and ``spans`` (first word, number of words, language) of every row.

    ``score``: the share of letters in the language's spans, times the
    probability of the language on those spans.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for start, length in slices(whole.column(1)):
                batch = whole.slice(start, length)
                words = words_of(batch.column(1))
                scores = known.word_scores(words)
                ends = np.searchsorted(words.doc, np.arange(length + 1))
                langs, values, spans = [], [], []
                for i in range(length):
                    at = words.at[ends[i] : ends[i + 1]]
                    letters = words.letters[at]
                    if not known.languages or not letters.any():
                        langs.append(UNKNOWN)
                        values.append(0.0)
                        spans.append([])
                        continue
                    own = scores[at]
                    path = viterbi(own, penalty)
                    held = np.bincount(path, weights=letters, minlength=len(known.languages))
                    best = int(held.argmax())
                    total = own[path == best].sum(axis=0)
                    sure = 1 / np.exp(np.minimum(total - total[best], 50)).sum()
                    cut = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
                    langs.append(known.languages[best])
                    values.append(float(held[best] / held.sum() * sure))
                    spans.append([{"first_word": int(a), "n_words": int(b - a), "lang": known.languages[path[a]]} for a, b in zip(cut, cut[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(values, pa.float64()), pa.array(spans, span_type)], [id_col, "lang_pred", "score", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<first_word:long,n_words:long,lang:string>>")
