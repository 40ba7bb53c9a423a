"""Documents in bounded chunks, and lookups of corpus-wide tables by the keys that a chunk needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that a chunk holds on average; a longer document is a chunk's own row and comes whole.
CHUNK_CHARS = 1_000_000


def chunked(docs: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id (as text, since pandas has no null integers), text and chunk: documents by a hash of their whole row, so that a repeated doc_id or a hot source does not make a large chunk. Null and
    empty texts have no place here and are left out; so an empty table has no chunks."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null and text <> ''")
    return in_chunks(docs, docs.agg(F.sum(F.length("text"))).first()[0] or 0, chars)


def in_chunks(docs: DataFrame, total: int, chars: int = CHUNK_CHARS) -> DataFrame:
    """docs with their chunk, where the number of all characters is known."""
    n = max(1, -(-total // chars))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))


def chunk_keys(docs: DataFrame, keys: Callable[[list[str]], set[str]]) -> DataFrame:
    """The distinct (chunk, key) of all chunks. Keys are made distinct in each batch before they are shuffled, so a key that every document holds costs
    one row per chunk and batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, part in pdf.groupby("chunk", sort=False)["text"]:
                found = sorted(keys(part.tolist()))
                yield pd.DataFrame({"chunk": [chunk] * len(found), "key": pd.Series(found, dtype="object")})

    return docs.select("chunk", "text").mapInPandas(run, "chunk long, key string").distinct()


def with_lookup(docs: DataFrame, found: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(documents of a chunk, rows of found for the chunk) for each chunk: one bounded group per call. work returns doc_id as text, too."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left, right)

    out = docs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(run, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
