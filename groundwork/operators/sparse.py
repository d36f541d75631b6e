"""BM25 over a tokenized corpus: postings, statistics, and ranked lists by block-max bounds.

A document's terms are counted within its row, so nothing is shuffled to make
postings. Documents are numbered by blocks of ``BLOCK`` as they come. The index is
written in order of term and block: postings with their impact (the part of a
score that does not depend on the question), and for each term and block the
greatest of them.

A search takes three steps. Bounds: a question's weights times the greatest
impacts, summed by block, say what no document of the block exceeds. Floor: the
documents of the ``SEEDS`` blocks with the best bounds are scored, and the n-th best
score is reached by the answer. Answer: only postings in blocks whose bound
reaches the floor are read. All of it is exact; where fewer than n documents of
the seeds score above zero, every block with a bound above zero is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import vocabulary as v
from groundwork.functions.text import tokenize
from groundwork.sources.shared import written

#: Documents of a block.
BLOCK = 128
#: Blocks that a question's floor is taken from.
SEEDS = 4
#: Tokens that are counted at once.
AT_ONCE = 1 << 20
#: Bounds are this much on the safe side of rounding.
SAFE = 1e-6


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (columns to carry, tokens) as a row for each term of each: carried columns, dl, block, term, tf."""
    row = TaskContext.get().partitionId() << 33
    for whole in batches:
        sizes = whole.column(whole.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            batch = whole.slice(start, stop - start)
            tokens = batch.column(batch.num_columns - 1).flatten().dictionary_encode()
            doc = np.repeat(np.arange(stop - start), sizes[start:stop])
            many = max(1, len(tokens.dictionary))
            pair, tf = np.unique(doc * many + tokens.indices.to_numpy(), return_counts=True)
            of = pair // many
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(of)) for i in range(batch.num_columns - 1)),
                    pa.array(sizes[start:stop][of].astype(np.int64)),
                    pa.array((row + of) // BLOCK),
                    tokens.dictionary.take(pa.array(pair % many)),
                    pa.array(tf.astype(np.int64)),
                ],
                [*batch.schema.names[:-1], "dl", "block", "term", "tf"],
            )
            row += stop - start
            start = stop


def postings(corpus: DataFrame, id_col: str = "id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, columns to ``carry``, ``dl, block, term, tf``: one row for each term of a document."""
    rows = corpus.select(F.col(id_col).alias("id"), *carry, tokenize(F.col(text_col)).alias("tokens"))
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("id", *carry)]
    return rows.mapInArrow(_counted, ", ".join([*fields, "dl long, block long, term string, tf long"]))


class Bm25Index:
    """Postings and block maxima with the statistics of the whole corpus; written once and read by every batch of questions.

    ``carry``: columns of the corpus that scores are cut by, such as those of scopes.
    """

    def __init__(self, corpus: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = v.BM25_K1, b: float = v.BM25_B, floor: float = v.BM25_FLOOR, carry: tuple[str, ...] = ()) -> None:
        self.k1, self.b, self.carry = k1, b, carry
        # Each text is tokenized once: the number of tokens is that of the postings, and documents without any count too.
        self.counted = written(postings(corpus, id_col, text_col, carry), "bm25-counted")
        frequencies = written(self.counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "bm25-frequencies")
        self.n = corpus.count()
        idf = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        raw = frequencies.select("term", "df", "cf", idf.alias("raw_idf"))
        total, average = raw.agg(F.sum("cf"), F.avg("raw_idf")).first()
        self.avgdl, self.average_idf = (total or 0) / self.n if self.n else 0.0, average or 0.0
        # A term in over half of all documents gets a share of the mean instead of a negative weight.
        self.terms = raw.select("term", "df", "raw_idf", F.when(F.col("raw_idf") < 0, F.lit(floor * self.average_idf)).otherwise(F.col("raw_idf")).alias("idf"))
        self._laid: tuple[DataFrame, DataFrame] | None = None

    def impact(self) -> Column:
        """Of a row of ``counted``."""
        long = F.lit(1 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(self.avgdl)
        return F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * long)

    @property
    def laid(self) -> tuple[DataFrame, DataFrame]:
        """(``term, block, id, impact`` and carried columns; ``term, block, most, held``) in order of term and block, written when first asked for.

        A frequent term is split by blocks over as many files as it fills.
        """
        if self._laid is None:
            rows = self.counted.select("term", "block", "id", *self.carry, self.impact().alias("impact"))
            rows = written(rows.repartitionByRange("term", "block", "id").sortWithinPartitions("term", "block", "id"), "bm25-postings")
            # Greatest impacts are combined in the files' own order before anything moves.
            most = rows.groupBy("term", "block").agg(F.max("impact").alias("most"), F.count("*").alias("held"))
            self._laid = rows, written(most.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), "bm25-maxima")
        return self._laid

    def stats(self) -> DataFrame:
        return self.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.lit(self.n).cast("long").alias("n_docs"), F.lit(round(self.avgdl, 6)).alias("avgdl"))

    def _asked(self, questions: DataFrame) -> DataFrame:
        """``question_id, term, weight``; repeated terms count each time."""
        words = questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qf"))
        return words.join(self.terms.select("term", "idf"), "term").select("question_id", "term", (F.col("qf") * F.col("idf")).alias("weight"))

    def _summed(self, met: DataFrame, scopes: DataFrame | None, scopes_of: Callable[[], Column] | None) -> DataFrame:
        """Scores of documents from rows of postings with ``question_id`` and ``weight``.

        Partial sums precede the shuffle. Scores are rounded to nine decimals, so
        that equal ones tie in whatever order they were summed.
        """
        by = ["question_id", "id"]
        if scopes_of:
            met, by = met.join(scopes, "question_id").withColumn("scope_no", F.explode(scopes_of())), ["question_id", "scope_no", "id"]
        return met.groupBy(*by).agg(F.round(F.sum(F.col("weight") * F.col("impact")), 9).alias("score"))

    def scores(self, questions: DataFrame, scopes_of: Callable[[], Column] | None = None) -> DataFrame:
        """``question_id[, scope_no], id, score`` of all documents that share a term with a question.

        ``scopes_of`` gives the numbers of the question's ``scopes`` that a posting's
        carried columns fit, so that what is out of scope goes before it is summed.
        """
        scopes = questions.select("question_id", "scopes") if scopes_of else None
        return self._summed(self.laid[0].join(self._asked(questions), "term"), scopes, scopes_of)

    def reached(self, questions: DataFrame, n: int, scopes_of: Callable[[], Column] | None = None) -> DataFrame:
        """``question_id, term, block, weight``: what has to be read of the postings for the n best of every question and scope."""
        maxima = self.laid[1]
        asked = written(self._asked(questions), "bm25-asked")
        scopes = questions.select("question_id", "scopes") if scopes_of else None
        # A negative weight is worth nothing to a bound.
        gain = F.greatest(F.col("weight"), F.lit(0.0)) * F.col("most")
        bounds = maxima.join(asked, "term").groupBy("question_id", "block").agg(F.sum(gain).alias("bound")).where("bound > 0")
        bounds = written(bounds, "bm25-bounds")
        seeds = ranked(bounds, ["question_id"], SEEDS, "bound", "block").select("question_id", "block")
        first = self._summed(self._read(seeds.join(asked, "question_id")), scopes, scopes_of).where("score > 0")
        by = ["question_id", *(["scope_no"] if scopes_of else [])]
        floors = ranked(first, by, n).where(F.col("rank") == n).select(*by, F.col("score").alias("floor"))
        if scopes_of:
            # A block is read for all of a question's scopes: the least floor counts, none where a scope has none.
            wanted = questions.select("question_id", F.greatest(F.size("scopes"), F.lit(1)).alias("scopes_asked"))
            floors = floors.groupBy("question_id").agg(F.min("floor").alias("floor"), F.count("*").alias("k")).join(wanted, "question_id").where("k >= scopes_asked").select("question_id", "floor")
        kept = bounds.join(floors, "question_id", "left").where(F.col("floor").isNull() | (F.col("bound") + SAFE >= F.col("floor")))
        return kept.select("question_id", "block").join(asked, "question_id").select("question_id", "term", "block", "weight")

    def _read(self, wanted: DataFrame) -> DataFrame:
        return self.laid[0].join(wanted, ["term", "block"])

    def topk(self, questions: DataFrame, n: int, scopes_of: Callable[[], Column] | None = None) -> DataFrame:
        """The n best documents with a positive score of each question (and scope); ties by id."""
        scopes = questions.select("question_id", "scopes") if scopes_of else None
        scored = self._summed(self._read(self.reached(questions, n, scopes_of)), scopes, scopes_of)
        return ranked(scored.where("score > 0"), ["question_id", *(["scope_no"] if scopes_of else [])], n)


def ranked(scores: DataFrame, by: list[str], n: int | None = None, score: str = "score", tie: str = "id") -> DataFrame:
    """``rank`` from 1 in each group by score downwards, ties by id; the first n if given."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))))
    return out.where(F.col("rank") <= n) if n else out
