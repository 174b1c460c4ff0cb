"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

Each match of the pattern is encoded by itself. A match that is itself in the vocabulary is one id. Otherwise
every live position holds the rank of the pair that starts there, and a segment tree over the positions keeps the least rank
with its leftmost position at the root. A merge takes the root's pair, joins it into its left position, and updates three leaves: the joined
position, its live left neighbour, and the position that died; each update climbs the tree's log2(n) levels. Short matches go through the same
tree together, one row of a matrix each (`encode_many`); long ones one at a time (`encode_one`).

Defined results: null or empty text has no ids; the bytes that decoding gives are the text's own UTF-8; rows repeat as they come.
Texts and matches of any length are encoded whole. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tamarack.llm.common import slices, texts
from tamarack.llm.segments import Joined, Memory, matcher

#: Longer matches have a tree of their own.
TOGETHER = 64
#: Bytes of each of a worker's three memories.
MEMORY = 96 << 20
_NONE = np.int64(1) << 62


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[int(k)] for k in self.keys], np.int64)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it isn't in the vocabulary."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def encode_one(self, word: bytes) -> list[int]:
        n = len(word)
        size = 1 << max(1, (n - 1).bit_length())
        token, after, before = [int(self.single[b]) for b in word], list(range(1, n + 1)), list(range(-1, n - 1))
        none = (1 << 62, 0)
        tree = [none] * (2 * size)
        get = self.pairs.get

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            rank = get(token[i] << 20 | token[j]) if j < n else None
            return none if rank is None else (rank, i)

        def put(i: int, value: tuple[int, int]) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    break
                tree[i] = least

        for i in range(n):
            tree[size + i] = leaf(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            j = after[i]
            token[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            token[j] = -1
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [t for t in token if t >= 0]

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Words of 2 to TOGETHER bytes."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        size = 2
        while size <= TOGETHER:
            chosen = np.flatnonzero((lengths > size // 2) & (lengths <= size) if size > 2 else lengths <= 2)
            if len(chosen):
                for k, ids in zip(chosen, self._rows([words[k] for k in chosen], size), strict=True):
                    out[k] = ids
            size *= 2
        return out

    def _rows(self, words: list[bytes], size: int) -> list[list[int]]:
        count = len(words)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
        length = np.array([len(w) for w in words])
        token = np.where(np.arange(size) < length[:, None], self.single[raw], -1)
        end = np.full((count, 1), -1, np.int64)
        token = np.concatenate([token, end], axis=1)  # column `size` stands for no neighbour
        after = np.minimum(np.arange(1, size + 2), length[:, None])
        after[after >= length[:, None]] = size
        before = np.tile(np.concatenate([[size], np.arange(size)]), (count, 1))

        def key(rows, i):
            """(rank, position) as one number; the least is the leftmost pair of least rank."""
            j = after[rows, i]
            a, b = token[rows, i], token[rows, j]
            rank = self.pair_ranks(np.maximum(a, 0), np.maximum(b, 0))
            return np.where((a < 0) | (b < 0) | (rank == _NONE), _NONE, rank << 8 | i)

        tree = np.full((count, 2 * size), _NONE)
        everyone = np.arange(count)
        for i in range(size - 1):
            tree[:, size + i] = key(everyone, i)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

        def put(rows, i, value):
            at = i + size
            tree[rows, at] = value
            while size > 1 and at[0] > 1:  # all leaves are equally deep
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        while len(rows := np.flatnonzero(tree[:, 1] != _NONE)):
            root = tree[rows, 1]
            i = root & 255
            j = after[rows, i]
            token[rows, i], next_ = root >> 8, after[rows, j]
            after[rows, i] = next_
            before[rows, next_] = i
            token[rows, j] = -1
            put(rows, j, _NONE)
            put(rows, i, key(rows, i))
            left = before[rows, i]
            has = left < size
            if has.any():
                put(rows[has], left[has], key(rows[has], left[has]))
        return [[t for t in row if t >= 0] for row in token[:, :size].tolist()]


class Codec:
    """Encoding and decoding of whole texts by one vocabulary and pattern."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.matches, self.words = Vocabulary(path), matcher(pattern), Memory(MEMORY)
        self.joined = Joined(self._each, self._each, MEMORY)

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        known = [self.vocabulary.ranks.get(w) for w in raw]
        short = [k for k, r in enumerate(known) if r is None and len(raw[k]) <= TOGETHER]
        found = dict(zip(short, self.vocabulary.encode_many([raw[k] for k in short]), strict=True)) if short else {}
        return [np.array([r] if r is not None else found[k] if k in found else self.vocabulary.encode_one(raw[k]), "<u4").tobytes() for k, r in enumerate(known)]

    def _each(self, given: list[str]) -> list[bytes]:
        split = [self.matches(x) for x in given]
        self.words.learn({w for s in split for w in s}, self._words)
        get = self.words.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def encode(self, given: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        return self.joined(given)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_READY: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _READY:
        _READY[path, pattern] = Codec(path, pattern)
    return _READY[path, pattern]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of each whole text."""

    def kernel(batches):
        own = codec(vocabulary, pattern)
        for batch in slices(batches, 512, 2 << 20):
            ids = own.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(kernel, "doc_id long, n_tokens long, ids binary")


def decode_texts(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encoded with `decoded`: the bytes that its ids stand for."""

    def kernel(batches):
        own = codec(vocabulary, pattern)
        for batch in slices(batches, 512, 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(x) for x in batch["ids"].to_pylist()], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(kernel, "doc_id long, n_tokens long, ids binary, decoded binary")
