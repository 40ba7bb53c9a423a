"""Encoding of the whole corpus with a public byte-level BPE (problem 8): corpus-level merge replay."""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.chunks import chunk_keys, chunked, with_lookup
from loomline.session import stage
from loomline.sources import tables

#: UTF-8 bytes of distinct words that one replay holds; a longer word is replayed on its own.
REPLAY_BYTES = 1_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a rank file of the installed public tokenizers; any other rank file's path can be given to encode() instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks(path: str) -> tuple[dict[bytes, int], tuple[int, ...]]:
    """Ids by token, and the ids of the 256 single bytes."""
    with open(path, "rb") as f:
        by = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return by, tuple(by[bytes([i])] for i in range(256))


@lru_cache(maxsize=4)
def splitter(pattern: str | None):
    import regex

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern)


def replay(words: list[str], path: str) -> list[np.ndarray]:
    """Token ids of distinct words. All words lie in one linked list of symbols; an inverted index leads from a merge to the positions of its pair. Merges
    are applied in rank order over all words at once, and each application updates the pairs of the two touched neighbours only.

    A merge's new pairs can only form tokens of a higher rank, since a token exists before it is merged further, so no rank is visited twice in vain.
    """
    by, single = ranks(path)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    parts: list[bytes] = []
    nxt: list[int] = []
    starts: list[int] = []
    for b in raw:
        at = len(parts)
        starts.append(at)
        parts.extend(b[i : i + 1] for i in range(len(b)))
        nxt.extend(range(at + 1, at + len(b) + 1))
        if b:
            nxt[-1] = -1
    prv = [-1] * len(parts)
    index: dict[int, list[int]] = defaultdict(list)
    get = by.get
    for i, j in enumerate(nxt):
        if j >= 0:
            prv[j] = i
            r = get(parts[i] + parts[j])
            if r is not None:
                index[r].append(i)
    heap = list(index)
    heapify(heap)
    while heap:
        r = heappop(heap)
        for i in sorted(index.pop(r, ())):
            j = nxt[i]
            if j < 0 or not parts[i]:
                continue
            token = parts[i] + parts[j]
            if get(token) != r:
                continue
            parts[i], parts[j] = token, b""
            k = nxt[i] = nxt[j]
            if k >= 0:
                prv[k] = i
                s = get(token + parts[k])
                if s is not None:
                    if s not in index:
                        heappush(heap, s)
                    index[s].append(i)
            h = prv[i]
            if h >= 0:
                s = get(parts[h] + token)
                if s is not None:
                    if s not in index:
                        heappush(heap, s)
                    index[s].append(h)
    out = []
    for at, b in zip(starts, raw, strict=True):
        ids, i = [], at if b else -1
        while i >= 0:
            ids.append(by[parts[i]])
            i = nxt[i]
        out.append(np.array(ids, dtype=np.int32))
    return out


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """key (distinct words) and ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[str] = []
        held = 0
        for pdf in batches:
            for w in pdf["key"]:
                block.append(w)
                held += len(w)
                if held >= REPLAY_BYTES:
                    yield pd.DataFrame({"key": block, "ids": replay(block, path)})
                    block, held = [], 0
        if block:
            yield pd.DataFrame({"key": block, "ids": replay(block, path)})

    return words.mapInPandas(run, "key string, ids array<int>")


def encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text), without special tokens: strings like <|endoftext|> are ordinary text.

    1. The distinct words of the corpus, each replayed once, however often it occurs. 2. Each chunk of documents fetches the ids of its own distinct words
    and puts its documents together; the number of word occurrences never meets a shuffle.
    Null and empty texts give an empty list; repeated rows give repeated rows; an empty table gives none. A text of any length is encoded whole.
    """
    texts = chunked(docs)

    def words_of(part: list[str]) -> set[str]:
        find = splitter(pattern).findall
        found: set[str] = set()
        for t in part:
            found.update(find(t))
        return found

    def put(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        find, known = splitter(pattern).findall, dict(zip(right["key"], right["ids"], strict=True))
        return pd.DataFrame({"doc_id": left["doc_id"], "ids": [np.concatenate([known[w] for w in find(t)]) for t in left["text"]]})

    needed = stage(chunk_keys(texts, words_of))
    table = stage(word_ids(needed.select("key").distinct(), path))
    full = with_lookup(texts, needed.join(table, "key"), put, "ids array<int>")
    blank = docs.filter("text is null or text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return full.unionByName(blank)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens."""
    return encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encode(tables.read(spark, base, "documents"), vocabulary_path())
