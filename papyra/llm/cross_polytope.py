"""Approximate nearest neighbours by cross-polytope hashing.

A hash is the nearest signed axes of a unit vector after two pseudo-rotations (three rounds of random signs and a fast
Hadamard transform each, in the next power of two of dimensions): a bucket of the index is a pair of axes.  In every
table a query probes the ``probes`` buckets whose two axes are nearest to it together; the rows filed there are its
candidates, ranked by their exact inner products with the original vectors in double precision.

How many buckets a query probes is fitted on a bounded sample (``fit_rows`` rows and ``fit_queries`` queries, by a hash of
the id), by how near its neighbours are (:func:`fit_probes`): so many that ``share`` of the sample's queries with about as
near neighbours find ``aim`` of them.  A query starts with the least of these numbers and goes on while the neighbours found
so far are too far away for it; a query whose neighbours are much farther than the sample knows, or that has found fewer than k,
goes on to all buckets, which is exact.  Every row is indexed, every probed bucket is read in full: there is no cap on
buckets or candidates.  The sample's neighbours are farther away than the whole table's, so that the recall on the whole is
at least the sample's, but for chance.

:mod:`papyra.operators.blocks` deals rows into blocks, each with its own tables, so that a bucket which holds a third of
all rows is spread over all blocks.

Defined results: null, zero and non-finite vectors take no part; repeated vectors are separate rows, ties go to the
smaller id; with fewer rows than asked for, the ranks end early; with no queries there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.blocks import Answer, Index

from .search import search, vectors

SEED = 11
#: Queries of the sample with about as near neighbours that are looked at together.
ALIKE = 32
#: Components up to which a rotation is applied as a matrix.
AS_MATRIX = 256


class Rotations:
    """``n`` pseudo-rotations of vectors of ``length`` components."""

    def __init__(self, length: int, n: int, seed: int = SEED) -> None:
        self.size = 1 << max(1, (length - 1).bit_length())
        self.length = length
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (n, 3, self.size))
        # short vectors: the rounds are made once, over the unit vectors, and applied as one matrix, which is quicker here
        self.matrices = [self._rounds(np.eye(length), i) for i in range(n)] if length <= AS_MATRIX else None

    def _rounds(self, x: np.ndarray, rotation: int) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : self.length] = x
        for signs in self.signs[rotation]:
            y = hadamard(y * signs)
        return y

    def turn(self, x: np.ndarray, rotation: int) -> np.ndarray:
        return x @ self.matrices[rotation] if self.matrices else self._rounds(x, rotation)

    def near(self, x: np.ndarray, rotation: int) -> np.ndarray:
        """How near each signed axis is to each vector: axis i is 2 * i, one more if negative."""
        y = self.turn(x, rotation)
        return np.stack([y, -y], axis=2).reshape(len(x), -1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector: its nearest axis in two rotations."""
        found = 0
        for rotation in (2 * table, 2 * table + 1):
            y = self.turn(x, rotation)
            at = np.abs(y).argmax(axis=1)
            found = found * 2 * self.size + 2 * at + (y[np.arange(len(x)), at] < 0)
        return found

    @property
    def n_buckets(self) -> int:
        return 4 * self.size * self.size


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, up to a factor."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def probed(first: np.ndarray, second: np.ndarray, probes: int) -> np.ndarray:
    """For each query the ``probes`` buckets of largest sum of nearness; both: (query, axis).

    The bucket of a query's i-th and j-th nearest axes has (i + 1)(j + 1) - 1 before it, so that few pairs come into question.
    """
    axes = first.shape[1]
    i, j = np.nonzero(np.arange(1, axes + 1)[:, None] * np.arange(1, axes + 1)[None] <= probes)
    a, b = np.argsort(-first, axis=1), np.argsort(-second, axis=1)
    rows = np.arange(len(first))[:, None]
    sums = first[rows, a][:, i] + second[rows, b][:, j]
    best = np.argpartition(-sums, probes - 1, axis=1)[:, :probes] if probes < len(i) else np.broadcast_to(np.arange(len(i)), sums.shape)
    return a[rows, i[best]] * axes + b[rows, j[best]]


@dataclass
class Probes:
    """Probes that a query needs by its k-th best score over its own length: ``number[i]`` down to ``least[i]``; all buckets below the last.

    A query that has found its share ``aim`` of the k has as many at its true k-th score or above; so it looks at the worst
    of that many.  What it has found can only be less than what there is, which asks for more probes, never for fewer.
    """

    aim: float = 1.0

    least: np.ndarray = field(default_factory=lambda: np.zeros(0))
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def needed(self, near: np.ndarray, all_: int) -> np.ndarray:
        at = np.searchsorted(-self.least, -near)
        return np.append(self.number, all_)[at]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one order for all rows, so that equal vectors get equal scores."""
    return (x * q).sum(axis=1)


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k rows of largest inner product, ties to the smaller id."""
    score = x @ q
    if len(score) > k:
        close = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9 * (1 + np.abs(score).max()))
    else:
        close = np.arange(len(score))
    score = exact(x[close], q)
    order = np.lexsort((ids[close], -score))[:k]
    return close[order], score[order]


class Tables:
    """The index of one block: rows by bucket, in every table."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, tables: int, probes: Probes) -> None:
        self.ids, self.rows, self.k, self.probes = ids, rows, k, probes
        self.enough = int(np.ceil(probes.aim * k)) - 1
        self.turns = Rotations(rows.shape[1], 2 * tables)
        self.filed = []
        for t in range(tables):
            bucket = self.turns.buckets(rows, t)
            self.filed.append((np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=self.turns.n_buckets))])))
        #: candidates compared so far, for tests and figures
        self.compared = 0

    def _collect(self, q: np.ndarray, probes: int) -> np.ndarray:
        """(query, row): whether the row is filed where the query probes."""
        hit = np.zeros((len(q), len(self.ids)), bool)
        if probes >= self.turns.n_buckets:
            hit[:] = True
            return hit
        for t, (order, first) in enumerate(self.filed):
            bucket = probed(self.turns.near(q, 2 * t), self.turns.near(q, 2 * t + 1), probes)
            size = (first[bucket + 1] - first[bucket]).ravel()
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit[np.repeat(np.repeat(np.arange(len(q)), bucket.shape[1]), size), order[np.repeat(first[bucket].ravel(), size) + nth]] = True
        return hit

    def answer(self, qi: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        everything = self.turns.n_buckets
        for start in range(0, len(qi), 128):
            q, own = qv[start : start + 128], qi[start : start + 128]
            probes = int(self.probes.number.min(initial=everything))
            active, seen = np.arange(len(q)), np.zeros((len(q), len(self.ids)), bool)
            seen[np.arange(len(q)), np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)] = np.isin(own, self.ids)
            best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
            while len(active):
                hit = self._collect(q[active], probes)
                more = np.zeros(len(active), np.int64)
                for n, i in enumerate(active):
                    fresh = np.flatnonzero(hit[n] & ~seen[i])
                    self.compared += len(fresh)
                    some = np.concatenate([best[i], fresh])  # the best so far and what is new
                    at, score = nearest(self.ids[some], self.rows[some], q[i], self.k)
                    best[i] = some[at]
                    if probes < everything:
                        more[n] = everything if len(at) < self.k else int(self.probes.needed(score[[self.enough]] / np.linalg.norm(q[i]), everything)[0])
                        if more[n] > probes:
                            continue
                        more[n] = 0
                    for out, value in zip(found, (np.full(len(at), start + i), best[i], score), strict=True):
                        out.append(value)
                seen[active] |= hit
                active, probes = active[more > 0], int(more[more > 0].min(initial=everything))
        return tuple(np.concatenate(x) for x in found)


def index(k: int, tables: int, probes: dict[int, Probes]) -> Index:
    """Tables over a block's rows, by the probes fitted for vectors of their length."""

    def build(ids: np.ndarray, rows: np.ndarray) -> Answer:
        return Tables(ids, rows, k, tables, probes.get(rows.shape[1], Probes())).answer

    return build


def fit_probes(x: np.ndarray, n_queries: int, k: int, tables: int, aim: float, share: float) -> Probes:
    """Probes by the k-th score, from the first ``n_queries`` rows of x and their true k nearest among its other rows."""
    n_queries = min(n_queries, len(x))
    if len(x) < 2:
        return Probes()
    turns = Rotations(x.shape[1], 2 * tables)
    score = x[:n_queries] @ x.T
    score[np.arange(n_queries), np.arange(n_queries)] = -np.inf  # the query itself, wherever it ranks
    true = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    near = score[np.arange(n_queries), true[:, -1]] / np.linalg.norm(x[:n_queries], axis=1)
    best = np.full(true.shape, turns.n_buckets)
    axes = 2 * turns.size
    for t in range(tables):
        first, second = turns.near(x[:n_queries], 2 * t), turns.near(x[:n_queries], 2 * t + 1)
        bucket = turns.buckets(x, t)[true]
        reached = np.take_along_axis(first, bucket // axes, axis=1) + np.take_along_axis(second, bucket % axes, axis=1)
        for i in range(n_queries):
            sums = np.sort((first[i][:, None] + second[i][None]).ravel())
            best[i] = np.minimum(best[i], len(sums) - np.searchsorted(sums, reached[i] - 1e-9 * np.abs(sums[[0, -1]]).max()))
    needs = np.sort(best, axis=1)[:, int(np.ceil(aim * best.shape[1])) - 1]
    order = np.argsort(-near, kind="stable")  # nearest neighbours first
    needs, near = needs[order], near[order]
    around = [needs[max(0, i - ALIKE // 2) : i + ALIKE // 2] for i in range(n_queries)]
    number = np.maximum.accumulate([int(np.sort(a)[int(np.ceil(share * len(a))) - 1]) for a in around])
    # farther than any by no more than they differ: twice the most probes; farther still, all buckets
    return Probes(aim, np.append(near, 2 * near[-1] - near[0]) - 1e-9, np.append(number, min(2 * number[-1], turns.n_buckets)))


def approximate(
    rows: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    tables: int = 16,
    aim: float = 0.9,
    share: float = 0.9,
    fit_rows: int = 8192,
    fit_queries: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    **sizes: int,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found for the rows whose id ``every`` divides."""
    sound = vectors(rows, vec_id=vec_id, embedding=embedding).where(F.exists("v", lambda x: x != 0))
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect()  # fit_rows vectors at most
    probes = {}
    for length in sorted({len(r["v"]) for r in sample}):
        x = np.array([r["v"] for r in sample if len(r["v"]) == length])
        probes[length] = fit_probes(x, fit_queries, k, tables, aim, share)
    return search(sound.where(F.col("vec_id") % every == 0), sound, index(k, tables, probes), k, **sizes)
