"""Byte-level BPE encoding and decoding.

Two tiers.  A text is split by the tokenizer's pattern; a minimal perfect hash over the vocabulary resolves a
piece that is itself a token.  Any other piece is merged byte by byte: its bytes form a doubly linked list, a
heap holds the possible merges by rank, and an entry that no longer describes its pair is skipped when popped.

The vocabulary file is read once on the driver (its path is a parameter) and its ranks, at most a few MB
whatever the corpus, travel to the executors in the task closure.  Texts are whole; there is no shuffle.

Defined results: a null text is encoded as an empty one (no ids, the digests of no bytes); repeated rows give
repeated results; further input columns are left out unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import remembered, text_slices

#: About as many bytes of pieces and ids a worker remembers in each of two generations; a piece used again moves to the younger one.
CACHE_BYTES, PIECE_BYTES = 56 << 20, 200
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must be 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of byte strings: levels of bit arrays, ranked; the strings are kept to verify a hit."""

    def __init__(self, keys: list[bytes], gamma: float = 2.0) -> None:
        self.n = len(keys)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two keys share a 64-bit hash")
        self.sizes, words, left = [], [], hashes
        while len(left):
            size = max(64, int(gamma * len(left)) + 63 & ~63)
            at = self._place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, bool)
        self.bits = bits
        self.before = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.value = np.zeros(self.n, np.int64)
        self.keys: list[bytes] = [b""] * self.n
        for i, slot in enumerate(self._slots(hashes).tolist()):
            self.value[slot] = i
            self.keys[slot] = keys[i]

    @staticmethod
    def _place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (hashes ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & _MASK)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no level has its bit."""
        slots = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + self._place(hashes[open_], level, size)
            hit = self.bits[at]
            slots[open_[hit]] = self.before[at[hit]]
            open_ = open_[~hit]
        return slots

    def find(self, pieces: list[bytes]) -> list[int]:
        """The index of each piece among the keys, -1 for a piece that isn't one."""
        if not pieces:
            return []
        slots = self._slots(np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], dtype=np.uint64)).tolist()
        keys, value = self.keys, self.value
        return [int(value[s]) if s >= 0 and keys[s] == p else -1 for s, p in zip(slots, pieces, strict=True)]


class ByteBPE:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        self.whole = PerfectHash(tokens)
        rank = {t: i for i, t in enumerate(tokens)}
        if len(tokens[0]) != 1:
            raise ValueError("rank 0 must be a single byte")
        self.byte_id = [rank[bytes([b])] for b in range(256)]
        #: (left id, right id) -> id of the two joined, which is never 0 as single bytes come first
        self.joined = {
            (rank[t[:k]], rank[t[k:]]): i
            for i, t in enumerate(tokens)
            for k in range(1, len(t))
            if t[:k] in rank and t[k:] in rank
        }
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that is no token: join the pair of lowest rank, the leftmost first, until none is left."""
        joined = self.joined.get
        ids = list(map(self.byte_id.__getitem__, piece))
        n = len(ids)
        pair = list(map(joined, zip(ids, ids[1:], strict=False)))
        pair.append(None)
        heap = [p << 32 | i for i, p in enumerate(pair) if p]
        if len(heap) > 1:
            heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, new = top & 0xFFFFFFFF, top >> 32
            if pair[i] != new:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i] = new
            ids[j] = -1
            pair[j] = None
            if k < n:
                before[k] = i
                p = pair[i] = joined((new, ids[k]))
                if p:
                    heappush(heap, p << 32 | i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                p = pair[h] = joined((ids[h], new))
                if p:
                    heappush(heap, p << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def _learn(self, pieces: set[str]) -> None:
        """Look up, or merge, pieces that the younger generation doesn't have."""
        self.held += PIECE_BYTES * len(pieces) + 12 * sum(map(len, pieces))
        older, seen = self.older, self.seen
        new = []
        for piece in pieces:
            if (ids := older.get(piece)) is not None:
                seen[piece] = ids
            else:
                new.append(piece)
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        for piece, b, at in zip(new, raw, self.whole.find(raw), strict=True):
            seen[piece] = (at,) if at >= 0 else self.merge(b)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        out = []
        for text in texts:
            pieces = self.split(text)
            if self.held > CACHE_BYTES:
                self.older, self.seen, self.held = self.seen, {}, 0
            if fresh := set(pieces).difference(self.seen):
                self._learn(fresh)
            out.append(np.array(list(chain.from_iterable(map(self.seen.__getitem__, pieces))), dtype="<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[tuple[int, str], ByteBPE] = remembered()


def _coder(tokens: list[bytes], pattern: str) -> ByteBPE:
    """One coder for each vocabulary in a worker process, kept between its tasks until another operator's come."""
    key = (xxhash.xxh3_64_intdigest(b"\0".join(tokens)), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(tokens, pattern)
    return _made[key]


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True
) -> DataFrame:
    """Encode the whole of each text and decode it again.

    Returns the columns ``keep`` (one that is called like a new one gives way to it), ``n_tokens`` long, ``ids_sha256``
    and ``decoded_sha256`` (lowercase hex) and, if ``ids``, ``token_ids`` array<int>.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} | (
        {"token_ids": T.ArrayType(T.IntegerType())} if ids else {}
    )
    keep = tuple(c for c in keep if c.lower() not in made)
    tokens = read_ranks(vocabulary)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in made.items()])
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokens, pattern)
        for batch in batches:
            for part in text_slices(batch, "t"):
                coded = coder.encode_batch([x or "" for x in part.column("t").to_pylist()])
                columns = [part.column(k) for k in kept] + [
                    pa.array([len(x) for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded], pa.string()),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in coded], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return docs.select(*[docs[c].alias(k) for c, k in zip(keep, kept, strict=True)], docs[text].cast("string").alias("t")).mapInArrow(run, schema)
