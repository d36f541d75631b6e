"""The two jobs that run on streams: the answer cache and incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from groundwork.functions import vocabulary as v
from groundwork.operators import chunks as c
from groundwork.operators import facts as f
from groundwork.operators.cache import OUT, Entries
from groundwork.plans.build import Embedder, embedded, hashed_embedder
from groundwork.sources import filings as s
from groundwork.sources.shared import written


class _ScopeCache(StatefulProcessor):
    """State of a scope: a list of blocks, each with what one batch stored. A batch adds a block and rewrites none."""

    def __init__(self, threshold: float, ttl_ms: int | None) -> None:
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getListState("blocks", "vectors binary, payloads array<string>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        entries = Entries(self.threshold)
        for vectors, payloads in self.blocks.get():
            entries.add(np.frombuffer(vectors, np.float64).reshape(len(payloads), -1), payloads)
        known = len(entries.payloads)
        asked = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = [(seq, key[0], *entries.ask(vector, payload)) for seq, vector, payload in asked[["seq", "embedding", "payload"]].itertuples(index=False)]
        if len(entries.payloads) > known:
            self.blocks.appendValue((entries.vectors[known : len(entries.payloads)].tobytes(), entries.payloads[known:]))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    def close(self) -> None:
        pass


def answer_cache_stream(requests: DataFrame, threshold: float = v.CACHE_THRESHOLD, ttl_seconds: int | None = None) -> DataFrame:
    """The cache over a stream of requests (``seq, scope_key, embedding, payload``), appended to as they come.

    Within a batch, requests of a scope are taken by ``seq``; batches are taken as
    they arrive. What a batch writes of the state grows with what it stores, not with
    the scope. With ``ttl_seconds`` an entry is forgotten so long after it was stored;
    else it stays. Sets the session's state store to RocksDB, which list state needs.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = requests.select(F.col("seq").cast("long").alias("seq"), F.coalesce("scope_key", F.lit("")).alias("scope_key"), "embedding", "payload")
    cache = _ScopeCache(threshold, ttl_seconds * 1000 if ttl_seconds else None)
    return rows.groupBy("scope_key").transformWithStateInPandas(cache, OUT, "append", "processingTime" if ttl_seconds else "none")


#: What is stored of each batch, by company and batch: pieces, the facts of their tables as they stand there, and chunks. Of a chunk
#: that an earlier batch has stored, only the vector is left out.
STORED = {
    "pieces": "path string, section string, type string, text string, piece_no int, fiscal_year string, company string, batch long",
    "facts": "fiscal_year string, fiscal_period string, line_item_standardized string, line_item_raw string, metric_value double, unit string, source_company_fy string, source_section string, path string, piece_no int, row_no int, year_no int, company string, batch long",
    "chunks": "id string, path string, fiscal_year string, section string, type string, piece_no int, captioned boolean, chunk_no int, text string, embedding array<float>, company string, batch long",
}


def incremental_ingest(filings: DataFrame, spark: SparkSession, root: str, embedder: Embedder = hashed_embedder, count: c.Counter = c.count_tokens, id_digits: int = 8) -> DataStreamWriter:
    """A stream of filings (``path, company, html``) into ``pieces``, ``facts`` and ``chunks`` below ``root``.

    Each batch writes partitions of its own, so one that is run again replaces
    what it wrote. Its number in ``commits`` is written last, and readers see only
    batches up to the last one there: a batch that is cut short between its tables is
    not seen. Pieces of a path that another batch has stored are left out, and of a
    path that comes twice in one batch one page counts.
    Only the stored partitions of a batch's companies are read, and only chunks
    that are not stored yet are embedded. ``stored_pieces``, ``stored_facts`` and
    ``stored_chunks`` read what one build of all filings would give.
    """
    for name, schema in STORED.items():
        spark.createDataFrame([], schema).write.mode("append").partitionBy("company", "batch").parquet(f"{root}/{name}")
    spark.createDataFrame([], COMMITTED).write.mode("append").parquet(f"{root}/commits")

    def ingest(batch: DataFrame, number: int) -> None:
        companies = F.broadcast(batch.select("company").distinct())  # a row for each company of one batch
        before = lambda name: _all(spark, root, name).where(F.col("batch") < number).join(companies, "company", "left_semi")

        def store(df: DataFrame, name: str) -> None:
            columns = [x.split()[0] for x in STORED[name].split(", ")]
            out = df.withColumn("batch", F.lit(number).cast("long")).select(*columns).hint("rebalance", "company")
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company", "batch").parquet(f"{root}/{name}")

        pieces = written(s.extract_pieces(batch.dropDuplicates(["path"])).join(before("pieces").select("path").distinct(), "path", "left_anti"), "ingest-pieces")
        store(pieces, "pieces")
        found = f.table_to_facts(pieces.withColumn("piece_index", F.col("piece_no")), keep=("path",))
        store(found.withColumnRenamed("ticker", "company").withColumn("piece_no", F.col("piece_index")), "facts")
        chunks = written(c.build_chunks(pieces, count, id_digits), "ingest-chunks")
        known = before("chunks").where("embedding is not null").select("id").distinct()
        new = embedded(chunks.join(known, "id", "left_anti"), "text", embedder)
        again = chunks.join(known, "id", "left_semi").withColumn("embedding", F.lit(None).cast("array<float>"))
        store(new.unionByName(again), "chunks")
        spark.createDataFrame([(number,)], COMMITTED).write.mode("append").parquet(f"{root}/commits")

    return filings.writeStream.foreachBatch(ingest)


COMMITTED = "batch long"


def _all(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(STORED[name]).parquet(f"{root}/{name}")


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """What whole batches have stored."""
    last = spark.read.schema(COMMITTED).parquet(f"{root}/commits").agg(F.max("batch")).first()[0]
    return _all(spark, root, name).where(F.col("batch") <= (-1 if last is None else last))


def stored_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, root, "pieces").select(*s.PIECES)


def stored_facts(spark: SparkSession, root: str) -> DataFrame:
    """The fact store of all stored filings. Pieces are numbered over all of them, so identifiers are unique and those of one full build."""
    places = s.first_piece_index(stored_pieces(spark, root))
    placed = _stored(spark, root, "facts").join(places, "path").withColumn("piece_index", F.col("piece_index") + F.col("piece_no")).withColumnRenamed("company", "ticker")
    filed = F.regexp_extract("source_company_fy", "FY([^ ]*)$", 1)
    named = placed.withColumn("source_table_id", F.concat_ws("-", "ticker", filed, F.col("piece_index").cast("string")))
    return f.with_entry_ids(f.dedup(named.select(*f.FACT_COLUMNS, *f.ORDER)))


def stored_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunk index of all stored filings: each id once, the first in document order, with its vector."""
    rows = _stored(spark, root, "chunks").drop("batch")
    rest = [x for x in rows.columns if x not in ("id", "embedding")]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("path", "piece_no", "chunk_no")).alias("c"), F.max_by("embedding", F.col("embedding").isNotNull()).alias("embedding"))
    return first.select("id", "c.*", "embedding")
