"""Language ID for code-switched text: a linear-chain conditional random field over words.

Every word is a node whose states are the learned languages.  Its features are hashed: prefixes and suffixes (the
character n-grams that touch a boundary mark), inner n-grams, the word itself, and whether it stands in a lexicon of
words that the training texts use almost only in one language.  Transitions between neighbouring words' languages
are learned with the feature weights, by stochastic gradient ascent on the sequences' log-likelihood.

A text's words are labelled by exact forward-backward.  To keep that vectorised for texts of any length, a text is
cut into blocks: products of each block's transition matrices carry the forward and backward messages from block to
block, then all blocks run side by side.  The text's language is the one with the largest sum of word marginals
over words that have a letter, and the score is its share; stretches of words of one language can be had as well.

Fitting takes a bounded sample (``max_rows`` rows by a hash of the id, none longer than ``max_chars``); prediction
covers every row and the whole text, in one scan without a shuffle.

Defined results: ``und`` with score 0 for a null text or one without letters, or if nothing could be learned; ties
go to the language first in alphabetical order; rows with a null language are never learned from; of rows that share
an id the least text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, text_slices
from .hashing import Packed, grams, pack, word_hashes

GRAMS = (2, 3, 4)
BLOCK = 32
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def word_features(p: Packed, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of the hashed features, and the words' own 64-bit hashes."""
    own = word_hashes(p)
    bucket = lambda h: (h % np.uint64(buckets)).astype(np.int32)
    words, found, word_at = [np.arange(len(own), dtype=np.int32)], [bucket(own)], p.word_at()
    for _, at, h in grams(p, GRAMS):
        words.append(word_at[at])
        found.append(bucket(h))
    return np.concatenate(words), np.concatenate(found), own


def _chain(n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of sequences of n words each: sequence, number in it, first word, length."""
    blocks = -(-n // block)
    seq = np.repeat(np.arange(len(n)), blocks)
    no = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = (np.cumsum(n) - n)[seq] + no * block
    return seq, no, first, np.minimum(block, n[seq] - no * block)


def marginals(emission: np.ndarray, n: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences of n words each, one after the other in ``emission`` (scores by state).

    ``transition``: scores from state to state; before a sequence's first word all states are alike.
    Returns the words' marginals, and the normalised messages before (through the transition) and after each word.
    """
    k = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) if len(emission) else emission
    step = np.exp(transition - transition.max())
    seq, no, first, length = _chain(n, block)
    order = np.argsort(-length, kind="stable")
    seq, no, first, length = seq[order], no[order], first[order], length[order]
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(block)]  # blocks longer than t
    product = np.tile(np.eye(k), (len(seq), 1, 1))
    for t in range(block):
        if not (m := active[t]):
            break
        now = (product[:m].reshape(-1, k) @ step).reshape(m, k, k) * e[first[:m] + t][:, None, :]
        product[:m] = now / now.sum(axis=(1, 2), keepdims=True)
    before, after = np.full((len(seq), k), 1.0 / k), np.ones((len(seq), k))
    place = np.empty(len(seq), np.int64)  # block of (sequence, number), in that order
    place[np.lexsort((no, seq))] = np.arange(len(seq))
    at = np.argsort(place)
    blocks = np.bincount(seq, minlength=len(n))
    base = np.cumsum(blocks) - blocks
    for c in range(1, int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > c)
        here, prev = at[base[own] + c], at[base[own] + c - 1]
        a = np.einsum("bi,bij->bj", before[prev], product[prev])
        before[here] = a / a.sum(axis=1, keepdims=True)
        here, later = at[base[own] + blocks[own] - 1 - c], at[base[own] + blocks[own] - c]
        b = np.einsum("bij,bj->bi", product[later], after[later])
        after[here] = b / b.sum(axis=1, keepdims=True)
    into, out = np.empty_like(e), np.empty_like(e)
    a = before
    for t in range(block):
        if not (m := active[t]):
            break
        come = a[:m] @ step
        into[first[:m] + t] = come
        a = come * e[first[:m] + t]
        a /= a.sum(axis=1, keepdims=True)
    b = after.copy()
    for t in range(block - 1, -1, -1):
        if not (m := active[t]):
            continue
        out[first[:m] + t] = b[:m]
        now = (e[first[:m] + t] * b[:m]) @ step.T
        b[:m] = now / now.sum(axis=1, keepdims=True)
    both = into * e * out
    return both / both.sum(axis=1, keepdims=True) if len(both) else both, into, out


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # by bucket and language
    transition: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    entry: np.ndarray  # language of each
    listed: np.ndarray  # weights of being in a language's lexicon

    def emissions(self, p: Packed) -> np.ndarray:
        word, bucket, own = word_features(p, len(self.weight))
        n, k = len(own), len(self.languages)
        out = np.empty((n, k))
        for j in range(k):
            out[:, j] = np.bincount(word, weights=self.weight[:, j].astype(float).take(bucket), minlength=n)
        return out + self.in_lexicon(own)

    def in_lexicon(self, own: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(own), len(self.languages)))
        at = np.minimum(np.searchsorted(self.lexicon, own), len(self.lexicon) - 1)
        return np.where((self.lexicon[at] == own)[:, None], self.listed[self.entry[at]], 0.0)

    def predict(self, texts: list[str], spans: list[list[dict]] | None = None) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; to ``spans``, if given, goes a list for each text of its stretches of one language."""
        if not self.languages:
            if spans is not None:
                spans += [[] for _ in texts]
            return ["und"] * len(texts), np.zeros(len(texts))
        p = pack([lowered(t) for t in texts])
        marginal, _, _ = marginals(self.emissions(p), np.bincount(p.doc, minlength=len(texts)), self.transition)
        letters = np.concatenate([[0], np.cumsum(_LETTER[p.code])])
        spoken = letters[p.end] > letters[p.start]
        if spans is not None:
            spans += self._spans(p, marginal, spoken)
        share = np.stack([np.bincount(p.doc[spoken], weights=marginal[spoken, j], minlength=len(texts)) for j in range(len(self.languages))], axis=1)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        return [self.languages[b] if t > 0 else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)], score


    def _spans(self, p: Packed, marginal: np.ndarray, spoken: np.ndarray) -> list[list[dict]]:
        """Neighbouring words with letters that are likeliest of one language, as one stretch; words without letters end none."""
        out: list[list[dict]] = [[] for _ in range(p.n_docs)]
        at = np.flatnonzero(spoken)
        if not len(at):
            return out
        own, doc = marginal[at].argmax(axis=1), p.doc[at]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(doc) != 0)]))
        last = np.concatenate([new[1:], [len(at)]]) - 1
        mean = np.add.reduceat(marginal[at, own], new) / (last - new + 1)
        for a, b, m in zip(new.tolist(), last.tolist(), mean.tolist(), strict=True):
            d = int(doc[a])
            out[d].append({"start": int(p.start[at[a]] - p.first[d]), "end": int(p.end[at[b]] - p.first[d]), "language": self.languages[own[a]], "probability": m})
        return out


def lowered(text: str) -> str:
    """In lower case, character by character where the whole would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def train(texts: list[str], languages: list[str], *, buckets: int = 1 << 17, segment: int = 64, batch: int = 32, epochs: int = 2, rate: float = 0.3, seed: int = 3) -> Model:
    """Fit by mini-batches of word sequences (texts cut into segments); each text's language labels its words."""
    names = sorted(set(languages))
    k = len(names)
    model = Model(names, np.zeros((buckets, max(1, k)), np.float32), np.zeros((k, k)), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k, k)))
    # a few texts at a time: of the features only the buckets stay, by word, and where each word's begin
    buckets_of, counts_of, own_of, doc_of = [], [], [], []
    for start in range(0, len(texts), 100):
        p = pack([lowered(t) for t in texts[start : start + 100]])
        word, found, hashes = word_features(p, buckets)
        buckets_of.append(found[np.argsort(word, kind="stable")])
        counts_of.append(np.bincount(word, minlength=len(hashes)))
        own_of.append(hashes)
        doc_of.append(p.doc + start)
    if not k or not sum(map(len, own_of)):
        return Model([], model.weight, model.transition, model.lexicon, model.entry, model.listed)
    bucket, own, doc = np.concatenate(buckets_of), np.concatenate(own_of), np.concatenate(doc_of)
    feature = np.concatenate([[0], np.cumsum(np.concatenate(counts_of))])
    label = np.array([names.index(x) for x in languages])[doc]
    distinct, which = np.unique(own, return_inverse=True)
    counts = np.stack([np.bincount(which[label == j], minlength=len(distinct)) for j in range(k)], axis=1)
    sure = (counts.sum(axis=1) >= 5) & (counts.max(axis=1) >= 0.9 * counts.sum(axis=1))
    model.lexicon, model.entry = distinct[sure], counts[sure].argmax(axis=1)
    _, _, first, length = _chain(np.bincount(doc, minlength=len(texts)), segment)
    rng = np.random.default_rng(seed)
    groups = [g for _ in range(epochs) for g in np.array_split(rng.permutation(len(first)), -(-len(first) // batch))]
    for i, g in enumerate(groups):
        eta = rate * (1 - i / len(groups))
        w = np.concatenate([np.arange(first[s], first[s] + length[s]) for s in g])
        f = np.concatenate([np.arange(feature[first[s]], feature[first[s] + length[s]]) for s in g])
        at = np.repeat(np.arange(len(w)), (feature[1:] - feature[:-1])[w])
        score = np.stack([np.bincount(at, weights=model.weight[bucket[f], j], minlength=len(w)) for j in range(k)], axis=1) + model.in_lexicon(own[w])
        marginal, into, out = marginals(score, length[g], model.transition)
        truth = np.eye(k)[label[w]]
        error = truth - marginal
        for j in range(k):
            np.add.at(model.weight[:, j], bucket[f], (eta * error[at, j]).astype(np.float32))
        lex = np.minimum(np.searchsorted(model.lexicon, own[w]), max(0, len(model.lexicon) - 1))
        if len(model.lexicon):
            hit = model.lexicon[lex] == own[w]
            np.add.at(model.listed, model.entry[lex[hit]], eta * error[hit] / len(g))
        inside = np.ones(len(w), bool)
        inside[np.cumsum(length[g]) - length[g]] = False
        here = np.flatnonzero(inside)
        # pair marginals: message before the earlier word's emission, transition, later word's emission and message
        step = np.exp(model.transition)
        e = np.exp(score - score.max(axis=1, keepdims=True))
        pair = (into[here - 1] * e[here - 1])[:, :, None] * step[None] * (e[here] * out[here])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        model.transition += eta * (truth[here - 1].T @ truth[here] - pair.sum(axis=0)) / max(1, len(here))
    return model


def sample(docs: DataFrame, *, max_rows: int = 3000, max_chars: int = 5_000) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from; held-out rows never take part."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1) & (F.length("text") <= max_chars))
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # max_rows ids: broadcast below
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("m")).select("doc_id", "m.text", "m.lang").toPandas().sort_values("doc_id")
    return rows["text"].tolist(), rows["lang"].tolist()


def fit(docs: DataFrame, **bounds: int) -> Model:
    return train(*sample(docs, **bounds))


def predict(docs: DataFrame, model: Model, *, text: str = "text", spans: str | None = None) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, and, if a name is given, the ``spans`` that they come from.

    Spans are stretches of words of one language: array of ``start, end`` (characters of the text), ``language`` and mean
    ``probability`` of its words.  Columns of those names, in any case, are replaced.
    """
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans is not None:
        span = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType())]
        made.append(T.StructField(spans, T.ArrayType(T.StructType(span))))
    kept = [c for c in docs.columns if c.lower() not in {f.name.lower() for f in made}]
    names = [f"c{i}" for i in range(len(kept))]
    at = names[kept.index(text)]
    schema = T.StructType([docs.schema[c] for c in kept] + made)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("probability", pa.float64())]))
    at_once = (1 << 22) // max(4, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, at_once):
                found: list[list[dict]] | None = None if spans is None else []
                lang, score = model.predict([t or "" for t in part.column(at).to_pylist()], found)
                more = [] if found is None else [pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more], names=schema.names)

    return docs.select(*[docs[c].alias(n) for c, n in zip(kept, names, strict=True)]).mapInArrow(run, schema)
