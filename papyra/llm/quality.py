"""Quality classifier: supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words and the character n-grams of its words, with
boundary marks; all are hashed to a bounded table of learned vectors.  Their average goes to a softmax layer; vectors and layer are trained together by
stochastic gradient descent in numpy.

Fitting takes a bounded sample of labelled rows (``max_rows`` of them by a hash of the id, none longer than
``max_chars``), so the driver holds at most max_rows * max_chars characters; everything else, scoring above all,
covers every row and the whole of each text.  As average and softmax follow each other, scoring needs one number
per hash bucket; that table (``buckets`` floats) is all that goes to the executors.  There is no shuffle.

Defined results: a null text scores as an empty one, which gets the share of good rows in the sample; labels that
are null don't count, and an id labelled both ways counts by its mean (0.5: good); of rows that share an id the least
text is learned from; without any labelled row all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, lean, text_slices
from .hashing import grams, mixed, pack, word_hashes

GRAMS = (3, 4)


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature."""
    p = pack(texts)
    doc_at = p.doc_at()
    docs, hashes = [p.doc], [word_hashes(p)]
    if len(p.start) > 1:
        w = hashes[0]
        near = p.doc[1:] == p.doc[:-1]
        with np.errstate(over="ignore"):
            pair = mixed(w[:-1] * np.uint64(3) + w[1:])
        docs.append(p.doc[1:][near])
        hashes.append(pair[near])
    for _, at, h in grams(p, GRAMS):
        docs.append(np.minimum(doc_at[at], max(0, len(texts) - 1)))
        hashes.append(h)
    return np.concatenate(docs), (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    """Score of a text: sigmoid(mean of ``weight`` over its features + ``bias``); ``prior`` for a text without any."""

    weight: np.ndarray
    bias: float
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        doc, bucket = features(texts, len(self.weight))
        n = np.bincount(doc, minlength=len(texts))
        total = np.bincount(doc, weights=self.weight[bucket], minlength=len(texts))
        z = total / np.maximum(n, 1) + self.bias
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.prior)


def train(texts: list[str], labels: list[int], *, buckets: int = 1 << 18, dim: int = 8, epochs: int = 10, rate: float = 1.0, seed: int = 1) -> Model:
    """Fit vectors, softmax weights and bias by stochastic gradient descent, one document at a time."""
    if not texts:
        return Model(np.zeros(buckets, np.float32), 0.0, 0.5)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    # what is held of the texts: distinct buckets and their counts, in few large arrays of narrow numbers
    rows = []
    for k in range(0, len(texts), 64):
        some = texts[k : k + 64]
        doc, bucket = features(some, buckets)
        key, count = np.unique(doc * buckets + bucket, return_counts=True)
        ids, count = (key % buckets).astype(np.int32), count.astype(np.min_scalar_type(int(count.max(initial=0))))
        cuts = np.searchsorted(key, np.arange(len(some) + 1) * buckets)
        rows += [(ids[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, count = rows[i]
            share = count.astype(np.float32) / np.float32(max(1, count.sum()))
            step = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            q = np.exp(z - z.max())
            q /= q.sum()
            q[labels[i]] -= 1
            back = layer @ q
            layer -= step * np.outer(mean, q)
            bias -= step * q
            # a document's step is spread over its features by their share, scaled to move its mean by one step
            vectors[ids] -= np.outer(step * share / (share @ share), back).astype(np.float32)
    weight = vectors @ (layer[:, 1] - layer[:, 0])
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]), float(np.mean(labels)))


def sample(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 4000, max_chars: int = 20_000) -> tuple[list[str], list[int]]:
    """The texts and labels to learn from: held-out rows never take part."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1))
    marked = marked.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows small rows: broadcast below
    texts = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("t")).where(F.length("t") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "y")).alias("m")).select("doc_id", "m.t", "m.y").toPandas()
    rows = rows.sort_values("doc_id")
    return rows["t"].tolist(), rows["y"].tolist()


def score(docs: DataFrame, model: Model, *, text: str = "text", column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for the whole of each text (double; a column of that name, in any case, is replaced)."""
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    names = [f"c{i}" for i in range(len(kept))]
    at = names[kept.index(text)]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, 1 << 19):
                s = model.score([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(s, pa.float64())], names=[*kept, column])

    return docs.select(*[docs[c].alias(n) for c, n in zip(kept, names, strict=True)]).mapInArrow(lean(run), schema)


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    return train(*sample(docs, labels, **bounds))
