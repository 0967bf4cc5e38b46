"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece is merged by
``merge_ids``. There a segment tree over the byte positions holds, at every
node, the leftmost position whose pair has the least rank. A merge changes the
pair at the position, the pair of its live left neighbour and the pair that is
swallowed: three point updates of logarithmic cost, so a piece of n bytes takes
O(n log n) however long it is. Pieces recur, so a worker keeps the ids of short
ones in a dictionary of bounded size.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the public pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces up to this many bytes are remembered, and this many of them; longer or further ones are merged again.
REMEMBER_BYTES, REMEMBER = 48, 200_000

_NONE = 1 << 62


def tokenizer_path(name: str = "byte_bpe_50k") -> str:
    """The rank file: in $OPPFLOW_TOKENIZERS, the package of public vocabularies, or /opt/tokenizers."""
    folder = os.environ.get("OPPFLOW_TOKENIZERS")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, f"{name}.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; parts that are swallowed have 0
    before = list(range(-1, n - 1))  # start of the live left neighbour
    leaves = 1
    while leaves < n:
        leaves *= 2
    shift = max(1, n.bit_length())  # a node's value is rank << shift | position, so its minimum is the leftmost

    def pair(i: int) -> int:
        j = end[i]
        if j >= n:
            return _NONE
        rank = ranks.get(piece[i : end[j]])
        return _NONE if rank is None else rank << shift | i

    tree = [_NONE] * (2 * leaves)
    tree[leaves : leaves + n - 1] = [pair(i) for i in range(n - 1)]
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def update(i: int, value: int) -> None:
        k = leaves + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    mask = (1 << shift) - 1
    while tree[1] != _NONE:
        i = tree[1] & mask
        j = end[i]
        end[i] = end[j]
        end[j] = 0
        update(j, _NONE)
        if end[i] < n:
            before[end[i]] = i
        update(i, pair(i))
        if before[i] >= 0:
            update(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """encode(text): the ids of a text, without special tokens (their strings are ordinary text)."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _new(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "replace")
        ids = merge_ids(raw, self.ranks)
        if len(raw) <= REMEMBER_BYTES:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, new = self.known.get, self._new
        for piece in self.split(text):
            out += known(piece) or new(piece)
        return out


_encoders: dict[str, Encoder] = {}


def shipped(path: str | None = None) -> str:
    """The name under which the workers find the rank file, which the driver sends them (a few MB)."""
    path = path or tokenizer_path()
    context = SparkContext._active_spark_context
    if context is None:
        return path
    name = os.path.basename(path)
    if not any(os.path.basename(f) == name for f in context.listFiles):
        context.addFile(path)
    return name


def encoder(name: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(name if os.path.isabs(name) else SparkFiles.get(name))
    return _encoders[name]


def encode_ids(text: Column, path: str | None = None) -> Column:
    """Array of ids; null and empty texts both have the empty array."""
    name = shipped(path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(name).encode
        for texts in batches:
            yield pd.Series([encode(t) for t in texts], dtype=object)

    return ids(text)


def count_ids(text: Column, path: str | None = None) -> Column:
    """Number of ids of a text; 0 for null and empty texts."""
    name = shipped(path)

    @F.pandas_udf("long")
    def n(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(name).encode
        for texts in batches:
            yield pd.Series([len(encode(t)) for t in texts], dtype="int64")

    return n(text)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids, one row for each row of df.

    Defined cases: null, empty -> empty array; blank texts -> ids of their white
    space; strings of special tokens are ordinary text; texts of any length are
    encoded whole; repeated rows come out as often; a null key stays null; an
    empty table gives an empty table. No shuffle: a scan of two columns and one
    Arrow-batched function.
    """
    return df.select(F.col(key), encode_ids(F.col(text), path).alias("ids"))
