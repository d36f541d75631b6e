"""Chunks: token-bounded parts of pieces with deterministic ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions import tables, text
from groundwork.functions import vocabulary as v

Counter = Callable[[str], int]
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(s: str) -> int:
    """Stand-in for a model's tokenizer: words and marks."""
    return len(_TOKEN.findall(s))


def split_table(md: str, summary: str | None, limit: int = v.TABLE_MAX_TOKENS, count: Counter = count_tokens) -> list[str]:
    """A table whole, or by rows with summary, header and separator repeated; at least one row a part.

    Tokens are counted once a row; marks and words never run across a line end.
    """
    prefix = f"[Table summary: {summary}]\n\n" if summary else ""
    lines = md.split("\n")
    if len(lines) < 3 or count(prefix + md) <= limit:
        return [prefix + md]
    head = f"{prefix}{lines[0]}\n{lines[1]}"
    base = count(head)
    parts: list[list[str]] = []
    used = 0
    for row in lines[2:]:
        size = count(row)
        if not parts or used + size > limit:
            parts.append([])
            used = base
        parts[-1].append(row)
        used += size
    return ["\n".join([head, *rows]) for rows in parts]


def split_prose(s: str, limit: int = v.PROSE_TOKENS, overlap: int = v.PROSE_OVERLAP, count: Counter = count_tokens) -> list[str]:
    """Parts of at most ``limit`` tokens that break at paragraphs, else lines, else blanks, else anywhere; neighbours share up to ``overlap``."""
    atoms = _atoms(s, limit, count, ("\n\n", "\n", " "))
    sizes = [count(a) for a in atoms]
    out, start, used = [], 0, 0
    for i, size in enumerate(sizes):
        if used + size > limit and i > start:
            out.append("".join(atoms[start:i]).strip())
            while start < i and (used > overlap or used + size > limit):
                used -= sizes[start]
                start += 1
        used += size
    out.append("".join(atoms[start:]).strip())
    return [x for x in out if x]


def _atoms(s: str, limit: int, count: Counter, separators: tuple[str, ...]) -> list[str]:
    """Consecutive parts of ``s``, each within a quarter of the limit where its separators allow, none over it."""
    if count(s) <= limit // 4 or not s:
        return [s]
    if not separators:
        if count(s) <= limit:
            return [s]
        half = len(s) // 2
        return _atoms(s[:half], limit, count, ()) + _atoms(s[half:], limit, count, ()) if half else [s]
    parts = s.split(separators[0])
    parts = [p + separators[0] for p in parts[:-1]] + parts[-1:]
    return [a for p in parts if p for a in (_atoms(p, limit, count, separators[1:]))]




def split_texts(df: DataFrame, splitter: Callable[..., list[str]], inputs: list[str], keep: list[str]) -> DataFrame:
    """``keep``, ``chunk_no`` and ``text``: the parts that ``splitter`` makes of the columns ``inputs`` of each row."""
    names = [f"_in{i}" for i in range(len(inputs))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [splitter(*row) for row in batch[names].itertuples(index=False)]
            out = batch[keep].assign(chunk_no=[list(range(len(p))) for p in parts], text=parts)
            yield out[[bool(p) for p in parts]].explode(["chunk_no", "text"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "chunk_no int, text string"])
    return df.select(*keep, *(F.col(c).alias(n) for c, n in zip(inputs, names, strict=True))).mapInPandas(run, schema)


def split_tables(df: DataFrame, keep: list[str], md: str = "md", summary: str = "summary", count: Counter = count_tokens) -> DataFrame:
    """Tables by rows; parts that are still over the embedder's limit as prose, so that nothing is cut off later."""

    def parts(table: str | None, caption: str | None) -> list[str]:
        return [x for part in split_table(table or "", caption, count=count) for x in ([part] if count(part) <= v.EMBED_LIMIT else split_prose(part, count=count))]

    return split_texts(df, parts, [md, summary], keep)


def split_proses(df: DataFrame, keep: list[str], text_col: str = "text", count: Counter = count_tokens) -> DataFrame:
    return split_texts(df, lambda s: split_prose(s or "", count=count), [text_col], keep)


def token_udf(count: Counter = count_tokens):
    @F.pandas_udf(T.LongType())
    def n_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("")
            known = {x: count(x) for x in set(texts)}  # equal texts are counted once
            yield texts.map(known).astype("int64")

    return n_tokens


def build_chunks(pieces: DataFrame, count: Counter = count_tokens, id_digits: int = 8) -> DataFrame:
    """``id, text, company, fiscal_year, section, type, captioned`` of all chunks, each id once, the first in document order.

    ``pieces``: path, company, fiscal_year, section, type, text, piece_no. Layout
    tables are dropped. Ids are deduplicated before anything is embedded.
    """
    graded = tables.canonical(pieces.where(F.col("type") == "table").where(text.is_real_table(F.col("text"))), "text")
    captioned = graded.withColumn("summary", tables.caption(F.col("canon"), F.col("company"), F.col("fiscal_year"), F.col("section")))
    keep = ["path", "company", "fiscal_year", "section", "type", "piece_no", "captioned"]
    of_tables = captioned.withColumns({"captioned": F.col("summary").isNotNull(), "md": text.compact_markdown(F.col("text"))})
    of_prose = pieces.where(F.col("type") == "prose").withColumn("captioned", F.lit(False))
    parts = split_tables(of_tables, keep, count=count).unionByName(split_proses(of_prose, keep, count=count))
    named = parts.withColumn("id", text.chunk_id(*(F.col(c) for c in ("company", "fiscal_year", "section", "type", "text")), digits=id_digits))
    return first_by_id(named)


def first_by_id(chunks: DataFrame, order: tuple[str, ...] = ("path", "piece_no", "chunk_no")) -> DataFrame:
    """The first chunk of each id; pre-aggregated, so boilerplate repeated everywhere costs no skew."""
    rest = [c for c in chunks.columns if c != "id"]
    return chunks.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("c")).select("id", "c.*")


def build_counts(chunks: DataFrame) -> DataFrame:
    tables_seen = F.when(F.col("captioned"), F.struct("path", "piece_no"))
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct(tables_seen).alias("n_captioned"))


def budget_check(chunks: DataFrame, limit: int = v.EMBED_LIMIT, count: Counter = count_tokens) -> DataFrame:
    return chunks.select(token_udf(count)("text").alias("n_tokens")).agg(F.count("*").alias("n_chunks"), F.count_if(F.col("n_tokens") > limit).alias("n_over"), F.coalesce(F.max("n_tokens"), F.lit(0)).alias("most"))
