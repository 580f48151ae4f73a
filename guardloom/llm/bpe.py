"""Byte-level BPE encoding of whole tables with a public vocabulary.

Most pre-tokens are vocabulary entries: a minimal perfect hash (hash and
displace) finds their id in one probe. The others are merged byte by byte,
with a heap of candidate merges over a linked list.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import spread

#: Fixed value: the pre-token pattern of the vocabulary's publisher.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered pre-tokens of a worker; beyond that it starts over.
MEMORY = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: token bytes to rank, which is the id and the merge order."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash from n byte strings to their ids: n slots, one probe."""

    def __init__(self, ids: dict[bytes, int]):
        keys = list(ids)
        self.n = n = len(keys)
        self.buckets = m = max(1, n // 3)
        digests = [xxhash.xxh3_128_intdigest(k) for k in keys]
        by_bucket: dict[int, list[int]] = {}
        for i, d in enumerate(digests):
            by_bucket.setdefault((d & 0xFFFFFFFFFFFFFFFF) % m, []).append(i)
        self.shift = [0] * m
        taken = [-1] * n
        for b, own in sorted(by_bucket.items(), key=lambda x: -len(x[1])):
            highs = [digests[i] >> 64 for i in own]
            d = 0
            while True:
                slots = [self._slot(h, d, n) for h in highs]
                if len(set(slots)) == len(slots) and all(taken[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(own, slots):
                taken[s] = i
        self.key_at = [keys[i] for i in taken]
        self.id_at = [ids[k] for k in self.key_at]

    @staticmethod
    def _slot(high: int, shift: int, n: int) -> int:
        x = (high + shift * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
        return (x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) % n

    def get(self, key: bytes) -> int:
        """The id, or -1."""
        d = xxhash.xxh3_128_intdigest(key)
        s = self._slot(d >> 64, self.shift[(d & 0xFFFFFFFFFFFFFFFF) % self.buckets], self.n)
        return self.id_at[s] if self.key_at[s] == key else -1


def merge_bytes(piece: bytes, find) -> list[int]:
    """Ids of a piece that is no entry itself: lowest rank first, leftmost on ties.

    ``find`` gives the rank of bytes or -1. O(n log n) in the piece's length.
    """
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0: no part begins
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = find(piece[i : i + 2])
        if r >= 0:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        mid = end[i]
        if mid == 0 or mid >= n or end[mid] != stop:
            continue  # one of its parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = find(piece[i : end[stop]])
            if r >= 0:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0:
            r = find(piece[b:stop])
            if r >= 0:
                heapq.heappush(heap, (r, b, stop))
    out, i = [], 0
    while i < n:
        out.append(find(piece[i : end[i]]))
        i = end[i]
    return out


class Encoder:
    def __init__(self, table: PerfectHash, pattern: str = PATTERN):
        self.find = table.get
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "replace")
        i = self.find(raw)
        got = [i] if i >= 0 else merge_bytes(raw, self.find)
        if len(self.known) >= MEMORY:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get, extend = self.known.get, out.extend
        for w in self.split(text):
            extend(get(w) or self.piece(w))
        return out


_tables: dict[str, PerfectHash] = {}


def shipped(spark, path: str | None = None):
    """The hash table as a broadcast; its size is the vocabulary's, whatever the data."""
    path = path or default_path()
    if path not in _tables:
        _tables[path] = PerfectHash(load_ranks(path))
    return spark.sparkContext.broadcast(_tables[path])


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` ARRAY<INT> of every row; null and empty texts have no ids: [].

    Strings of special tokens are ordinary text. Texts are encoded whole,
    whatever their length; other columns are not carried.
    """
    table = shipped(df.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(table.value)
        for b in batches:
            ids = [np.asarray(enc.encode(t), dtype=np.int32) for t in b.iloc[:, 1]]
            yield pd.DataFrame({id_col: b.iloc[:, 0], "ids": ids})

    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col), F.col(text_col).alias("__text")))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text_col: str, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text (0 for null), as a column named ``out``."""
    table = shipped(df.sparkSession, path)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = Encoder(table.value)
        for b in batches:
            yield pd.Series([len(enc.encode(t)) for t in b], dtype="int64")

    return df.withColumn(out, count(F.col(text_col)))
