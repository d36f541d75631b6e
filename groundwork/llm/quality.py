"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once for each document. The ledger stores one bit per
failed rule beside the measurements that led to it. A policy is a named,
versioned set of rules; applying one, comparing two, or asking what a rule
costs is then bitwise arithmetic on the ledger and never reads a text again.

Defined results: a null text counts as empty (no words, so ``few_words`` fails
and the rules on shares pass). Repeated rows get a row each. The operator
returns only the id and its own columns, so other columns of the input can have
any name. Texts are measured in slices of a few MB. An empty table gives an empty
ledger, and no document for any rule.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.bagminhash import slices

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = CAPITALS + CAPITALS.lower()
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, end = 0, 0  # the words before `end` are counted
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        without(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        without(LETTERS),
        without(CAPITALS),
    )


@dataclass(frozen=True)
class Rule:
    """``fails``: a condition on the measurements; ``bit``: the rule's place in the mask, never given to another."""

    name: str
    bit: int
    fails: Column


def rules(prefix: str = "") -> list[Rule]:
    """The rules over measurement columns whose names start with ``prefix``."""
    n = lambda name: F.col(prefix + name)
    return [
        Rule("few_words", 0, n("n_words") < 50),
        Rule("repeated_windows", 1, 100 * n("n_repeat_words") > 50 * n("n_words")),
        Rule("symbols", 2, 10 * n("n_symbols") > n("n_words")),
        Rule("repeated_lines", 3, 10 * n("n_dup_lines") > 3 * n("n_lines")),
        Rule("shouting", 4, 10 * n("n_capitals") > 3 * n("n_letters")),
        Rule("long_words", 5, n("word_chars") > 25 * n("n_words")),
    ]


#: Versioned policies: a document is rejected if it fails any of these rules. A version is never edited, only followed.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "strict-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "long_words"),
}


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _failed(prefix: str = "") -> Column:
    mask = F.lit(0).cast("long")
    for rule in rules(prefix):
        mask = mask.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def _measured(df: DataFrame, text_col: str, carry: list[str], prefix: str) -> DataFrame:
    """The columns ``carry`` of ``df`` and the measurements of ``text_col``."""
    names = [*carry, *(prefix + m for m in MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(*part) for whole in batches for part in slices(whole.column(0))):
            columns = zip(*(measure(x) for x in batch.column(0).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, pa.int64()) for c in columns)], names)

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), *(f"{prefix}{m} long" for m in MEASURES)])
    return df.select(F.col(text_col).alias("_gw_text"), *carry).mapInArrow(run, schema)


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, every measurement, and ``failed``, the mask of failed rules."""
    return _measured(df, text_col, [id_col], "").withColumn("failed", _failed())


def accepted(df: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass a policy, with its columns."""
    rows = _measured(df, text_col, df.columns, "_gw_").withColumn("_gw_failed", _failed("_gw_"))
    return rows.where(passes(policy, F.col("_gw_failed"))).select(*df.columns)


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: documents it fails, fails alone, and the number kept without it.

    The ledger is first summed by mask, of which there are at most two to the
    power of the number of rules, so everything after is tiny.
    """
    whole = policy_mask(policy)
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules() if r.name in POLICIES[policy])))
    each = masks.select("m", "n", named.alias("r")).select("m", "n", "r.*")
    rest = F.col("m").bitwiseAND(F.bitwise_not("bit"))
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & (rest == 0)).alias("n_failed_alone"), total(rest == 0).alias("n_kept_without"))
