"""Language-model scoring by cross-entropy difference.

Two word bigram models, of a target text collection and of the background corpus, share one vocabulary: every word of
either.  Both are counted over all their texts and smoothed alike, each step as a Dirichlet prior of the next: a
bigram's count plus ``prior`` times the word's share, over the history's count plus ``prior``; a word's share is its count
plus ``base`` times its share in both collections together, over the model's tokens plus ``base``.  A text's loss under a
model is its mean negative log-probability per token; its score is target loss minus background loss, so that lower is
closer to the target.

Scale: nothing of the corpus comes to the driver but its size in bytes.  Texts are dealt into chunks by a hash.  A chunk
counts its distinct bigrams, words and histories, and sends their 64-bit hashes and counts, sorted and cut by range, to
the buckets of these ranges.  A bucket adds up both models' counts and answers each chunk in the chunk's own order, so
that no hash travels back and a bigram that every text has is one entry a chunk.  The chunk meets its texts again (the
exchange of the texts is made once and read twice) and scores them.  Chunks and buckets are of bounded size, their numbers
grow with the corpus; both steps are ordinary exchanges, so that lost executors cost what was theirs.

Defined results: a null or blank text has no tokens, losses and score null; with an empty target its model is the shared
vocabulary alone; an empty background gives no rows; repeated rows are counted, and given back, as often as they stand;
further columns and their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import mixed

PRIOR, BASE = 10.0, 1000.0
#: Bytes of text in a chunk, and for each bucket; both grow with the square root of a corpus beyond GROWS, to at most 8 times.
CHUNK_BYTES, GROWS = 8 << 20, 32 << 30
#: Characters of a text that are cut into words at once.
PIECE = 1 << 20
_BIGRAM, _WORD, _HISTORY = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_START, _TOTAL = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x27D4EB2F165667C5)


def words(text: str | None) -> Iterator[list[str]]:
    """Lower-cased words between white space, in lists of bounded size; a text is only ever cut at white space."""
    at = 0
    while text and at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].lower().split()
        at = end


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Chunk:
    """The bigrams of some texts: which text, word and history each token has, and the keys to be counted."""

    n_docs: int
    doc: np.ndarray
    word: np.ndarray
    history: np.ndarray
    pair: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    order: np.ndarray
    n_pairs: int
    n_words: int

    @classmethod
    def of(cls, texts: list[str | None]) -> Chunk:
        numbers, parts, sizes = _Numbers(), [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for piece in words(text):
                parts.append(np.fromiter(map(numbers.__getitem__, piece), np.int64, len(piece)))
                sizes[i] += len(piece)
        word, n = np.concatenate(parts), len(numbers)
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[(np.cumsum(sizes) - sizes)[sizes > 0]] = n  # the start mark
        distinct, pair, pair_counts = np.unique(history * (n + 1) + word, return_inverse=True, return_counts=True)
        own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in numbers), np.uint64, n)
        own = np.append(own, _START)
        with np.errstate(over="ignore"):
            bigrams = mixed(mixed(own[distinct // (n + 1)] * _BIGRAM) + own[distinct % (n + 1)])
            keys = np.concatenate([bigrams, mixed(own[:n] ^ _WORD), mixed(own * _HISTORY), [_TOTAL]])
        counts = np.concatenate([pair_counts, np.bincount(word, minlength=n), np.bincount(history, minlength=n + 1), [len(word)]])
        order = np.argsort(keys, kind="stable")
        return cls(len(texts), np.repeat(np.arange(len(texts)), sizes), word, history, pair, keys[order], counts[order], order, len(distinct), n)

    def losses(self, target: np.ndarray, background: np.ndarray, prior: float, base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text and its mean loss under both models, from the counts of ``keys`` in each."""
        n_tokens = np.bincount(self.doc, minlength=self.n_docs)
        sides = []
        for sorted_counts in (target, background):
            counts = np.empty(len(self.keys))
            counts[self.order] = sorted_counts
            sides.append(np.split(counts, np.cumsum([self.n_pairs, self.n_words, self.n_words + 1])))
        (_, t_words, _, t_total), (_, b_words, _, b_total) = sides
        shared = (t_words + b_words) / max(1.0, t_total[0] + b_total[0])
        means = []
        for pairs, single, histories, total in sides:
            share = (single + base * shared) / (total[0] + base)
            loss = -np.log((pairs[self.pair] + prior * share[self.word]) / (histories[self.history] + prior))
            means.append(np.bincount(self.doc, weights=loss, minlength=self.n_docs) / np.maximum(n_tokens, 1))
        return n_tokens, means[0], means[1]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest ones, then all second ones: sorted keys and small counts compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _ask(buckets: int):
    """``side, chunk, t`` of one chunk -> its keys and counts for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        own = Chunk.of(table.column("t").to_pylist())
        bucket = (own.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        spans = [slice(cuts[b], cuts[b + 1]) for b in some]
        side, chunk = (table.column(c)[0].as_py() for c in ("side", "chunk"))
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "side": pa.array([side] * len(some), pa.int32()),
                "chunk": pa.array([chunk] * len(some), pa.int32()),
                "keys": pa.array([_planes(own.keys[s]) for s in spans], pa.binary()),
                "counts": pa.array([_planes(own.counts[s]) for s in spans], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """All that chunks ask of one bucket -> for each chunk of the background, both models' counts in the chunk's order."""
    sides, keys, counts = np.array(table.column("side").to_pylist()), [], []
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True):
        keys.append(_numbers(k, np.uint64))
        counts.append(_numbers(c, np.int64))
    sizes = np.array([len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    count, side = np.concatenate(counts), np.repeat(sides, sizes)
    totals = [np.bincount(at[side == s], weights=count[side == s], minlength=len(distinct)).astype(np.int64) for s in (0, 1)]
    ends = np.cumsum(sizes)
    asked = np.flatnonzero(sides == 1)
    told = [[_planes(x[at[ends[i] - sizes[i] : ends[i]]]) for i in asked] for x in totals]
    picked = table.select(["chunk", "bucket"]).take(pa.array(asked))
    return pa.table({"chunk": picked.column("chunk"), "bucket": picked.column("bucket"), "target": pa.array(told[0], pa.binary()), "background": pa.array(told[1], pa.binary())})


def sized(docs: DataFrame, text: str, chunk_bytes: int) -> tuple[int, int]:
    """How many chunks the texts make, and the bytes of a chunk that a corpus of their size calls for."""
    whole = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).first()[0] or 0
    size = int(chunk_bytes * min(8.0, max(1.0, math.sqrt(whole / GROWS))))
    return max(1, -(-whole // size)), size


def score(
    docs: DataFrame,
    target: DataFrame,
    *,
    prior: float = PRIOR,
    base: float = BASE,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` for each of docs, which are the background as well."""
    chunks, size = sized(docs, text, chunk_bytes)
    of_target, _ = sized(target, target_text, size)
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("chunk")
    asking = target.select(F.lit(0).alias("side"), dealt(of_target, target[target_text]), F.lit(None).cast(docs.schema[doc_id].dataType).alias("id"), target[target_text].cast("string").alias("t"))
    rows = docs.select(F.lit(1).alias("side"), dealt(chunks, docs[doc_id], docs[text]), docs[doc_id].alias("id"), docs[text].cast("string").alias("t"))
    entries = "bucket int, side int, chunk int, keys binary, counts binary"
    asked = rows.groupBy("chunk").applyInArrow(_ask(chunks), entries).unionByName(asking.groupBy("chunk").applyInArrow(_ask(chunks), entries))
    answers = asked.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, target binary, background binary")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score"))])

    def meet(texts: pa.Table, told: pa.Table) -> pa.Table:
        own = Chunk.of(texts.column("t").to_pylist())
        told = told.sort_by("bucket")
        counts = [np.concatenate([_numbers(b, np.int64) for b in told.column(c).to_pylist()]).astype(float) for c in ("target", "background")]
        n, a, b = own.losses(*counts, prior, base)
        none = n == 0
        made = [pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in (a, b, a - b))]
        return pa.table([texts.column("id"), *made], names=schema.names)

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)
