"""Encoding with a public byte-level BPE vocabulary.

Each pre-token is merged with a segment tree over its byte positions. A leaf holds the rank of the pair that
starts at that position, every inner node the smallest key ``rank * size + position`` below it; the root is
therefore the leftmost pair of lowest rank. A merge changes three leaves (the merged pair, its right neighbour,
which is no longer live, and its left neighbour), each by a logarithmic point update, so a pre-token of n bytes
takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

NONE = 1 << 62
#: Pre-tokens kept per worker, and the longest that is kept; both only bound memory.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 64

_encoders: dict[int, "Encoder"] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of ``byte_bpe_50k``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    mask, tree = size - 1, [NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for x in range(size - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a < b else b
    end = list(range(1, n + 1))  # where the live token that starts at i ends; the next live position
    before = list(range(-1, n - 1))
    while (best := tree[1]) != NONE:
        i = best & mask
        j = end[i]
        end[i] = stop = end[j]
        if stop < n:
            before[stop] = i
            r = rank(piece[i : end[stop]])
            changed = [(j, NONE), (i, NONE if r is None else r * size + i)]
        else:
            changed = [(j, NONE), (i, NONE)]
        if (k := before[i]) >= 0:
            r = rank(piece[k:stop])
            changed.append((k, NONE if r is None else r * size + k))
        for leaf, key in changed:
            x = size + leaf
            if tree[x] == key:
                continue
            tree[x] = key
            x >>= 1
            while x:
                a, b = tree[2 * x], tree[2 * x + 1]
                low = a if a < b else b
                if tree[x] == low:
                    break
                tree[x] = low
                x >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts; remembers the ids of short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find, self.memo = ranks, regex.compile(pattern).findall, {}

    def ids(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and for the empty text."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for word in self.find(text):
            found = memo.get(word)
            if found is None:
                found = merge_pairs(word.encode("utf-8"), self.ranks)
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[word] = found
            out += found
        return out


def encoder_of(shipped, pattern: str) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, made once per process."""
    data = shipped.value
    key = hash((data, pattern))
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def ship_vocabulary(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """The vocabulary file as a broadcast (under 1 MB, whatever the data) and the pre-token pattern."""
    known = default_vocabulary() if path is None or pattern is None else (None, None)
    with open(path or known[0], "rb") as file:
        return spark.sparkContext.broadcast(file.read()), pattern or known[1]


def encode(df: DataFrame, key: str, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (ARRAY<INT>) of every row of ``df``.

    Null and empty texts give an empty list, any other text is encoded as it stands; strings that look like
    special tokens are ordinary text. Repeated rows come out repeatedly; other columns are not read. One Arrow
    pass over the scan, without a shuffle.
    """
    vocabulary, split = ship_vocabulary(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder_of(vocabulary, split).ids
        for batch in batches:
            lists = [one(x) for x in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` (BIGINT) of every row; 0 for null and empty texts."""
    vocabulary, split = ship_vocabulary(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder_of(vocabulary, split).ids
        for batch in batches:
            counts = pa.array([len(one(x)) for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(df[text].alias("__text"), *keep).mapInArrow(run, f"{kinds}, n_tokens bigint")
