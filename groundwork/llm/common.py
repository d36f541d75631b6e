"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.sources.shared import shared_dir, written

__all__ = ["WORD", "carried", "having", "shared_dir", "table", "word_count", "written"]

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Up to so many keys (a few dozen MB) are sent to the rows; more of them are met by a shuffle.
SENT_KEYS = 4_000_000


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with one of these keys. Up to ``SENT_KEYS`` keys go to the rows, so that rows with long texts stay where they are."""
    keys = written(keys.select(key), "keys")
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, key, "left_semi")


def carried(df: DataFrame, *taken: str) -> list[str]:
    """Columns of ``df`` other than ``taken``, which an operator passes through."""
    return [c for c in df.columns if c not in taken]
