"""Texts by id, laid out so that looking up the few that win moves none of the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.sources.shared import shared_dir

#: Bytes of a bucket that the number of buckets is counted for.
BUCKET_BYTES = 128 << 20


class TextTable:
    """Chunks (``id``, ``text`` and other columns) in buckets of their ids, sorted in each; written once and read by every batch of questions.

    The table is joined bucket by bucket: only the hits are shuffled, to where the
    texts lie. Few hits are sent to the texts instead, as Spark sees fit.
    """

    def __init__(self, chunks: DataFrame, text_col: str = "text", buckets: int | None = None) -> None:
        spark = chunks.sparkSession
        if buckets is None:
            held = chunks.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
        self.buckets, self.name = buckets, f"texts_{uuid.uuid4().hex}"
        dealt = chunks.repartition(buckets, "id")
        dealt.write.format("parquet").option("path", f"{shared_dir(spark)}/{self.name}").bucketBy(buckets, "id").sortBy("id").saveAsTable(self.name)
        self.table = spark.table(self.name)

    def with_text(self, hits: DataFrame, *columns: str) -> DataFrame:
        """``hits`` (``id`` and others) with the text table's ``columns``; hits of ids that it does not hold are left out."""
        return hits.join(self.table.select("id", *columns), "id")
