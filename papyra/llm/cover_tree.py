"""Exact top-k inner products by a dual-tree cover-tree search.

Both the queries and the rows of a block go into a cover tree: a node's children are centres more than half its
radius apart that cover all its points within that half.  Pairs of a query node and a row node are bounded by
``<q, r> + radius(q) |r| + radius(r) |q| + radius(q) radius(r)`` over their centres; a pair whose bound is below the
worst k-th score found so far in its group of queries is dropped with all its descendants.  Query nodes too small
for a matrix product are searched side by side, each with its own bounds.

Trees and bounds are over vectors scaled to components of at most one, in double precision, with room for rounding.
Scores are integers and exact: products of doubles where no sum can reach 2**53, else 64-bit integers, else Python's.
Score and row are kept apart; ties go to the smaller id, and a bound equal to a k-th score isn't dropped.  A score that
a long can't hold is the nearest long, and ranked as that; bounds then exclude nothing.  :mod:`papyra.operators.blocks` deals the tables into
blocks.

What is saved depends on the data: ``DualSearch.bounded`` counts evaluated bounds and ``tried`` compared pairs.  Where
vectors are far apart from each other, no ball around two of them is small enough to exclude, the tree is flat, and each
query meets a bound of each row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.blocks import Answer, Index

from .search import search, vectors

LEAF, GROUP, CENTRES, SEEDS = 24, 256, 256, 512


@dataclass
class CoverTree:
    """Nodes over the rows of ``x``: centre, radius, and children or else points."""

    x: np.ndarray
    leaf: int = LEAF
    centre: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    children: list[np.ndarray | None] = field(default_factory=list)
    points: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        if len(self.x):
            self._node(0, np.arange(len(self.x)), self._distance(np.arange(len(self.x)), np.zeros(1, np.int64))[:, 0])
        self.centre_at, self.radius_at = np.array(self.centre, np.int64), np.array(self.radius)
        self.norm_at = np.sqrt(self.square[self.centre_at]) if len(self.x) else np.zeros(0)

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.square[a][:, None] + self.square[b][None] - 2 * (self.x[a] @ self.x[b].T)
        return np.sqrt(np.maximum(d, 0))

    def _node(self, centre: int, own: np.ndarray, distance: np.ndarray) -> int:
        at, radius = len(self.centre), float(distance.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append(None)
        self.points.append(own)
        if len(own) > self.leaf and radius > 0:
            centres, nearest, near = self._cover(centre, own, radius / 2)
            order = np.argsort(nearest, kind="stable")
            cuts = np.cumsum(np.bincount(nearest, minlength=len(centres)))[:-1]
            parts = zip(centres.tolist(), np.split(own[order], cuts), np.split(near[order], cuts), strict=True)
            self.children[at] = np.array([self._node(c, p, d) for c, p, d in parts], np.int64)
        return at

    def _cover(self, first: int, own: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres more than ``reach`` apart, the first one first; each point's nearest centre of those it met, and distance."""
        nearest, near = np.full(len(own), -1, np.int64), np.full(len(own), np.inf)
        centres: list[int] = []
        left = np.concatenate([np.flatnonzero(own == first), np.flatnonzero(own != first)])
        while len(left):
            batch = left[:CENTRES]
            apart = self._distance(own[batch], own[batch])
            np.fill_diagonal(apart, 0)
            chosen: list[int] = []
            free = np.ones(len(batch), bool)
            for i in range(len(batch)):
                if free[i]:
                    chosen.append(i)
                    free &= apart[i] > reach
            picked = batch[chosen]
            d = self._distance(own[left], own[picked])
            place = {int(p): j for j, p in enumerate(picked)}
            for row, p in enumerate(left[: len(batch)].tolist()):  # a centre is its own
                if p in place:
                    d[row, place[p]] = 0
            best = d.argmin(axis=1)
            close = d[np.arange(len(left)), best]
            covered = close <= reach
            nearest[left[covered]] = len(centres) + best[covered]
            near[left[covered]] = close[covered]
            centres += own[picked].tolist()
            left = left[~covered]
        return np.array(centres, np.int64), nearest, near


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / (float(np.abs(x).max(initial=0)) or 1.0)


class Products:
    """Exact inner products of integer vectors that are given as doubles."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray) -> None:
        reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
        self.kind = np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object
        self.q, self.r = (self._of(x) for x in (queries, rows))

    def _of(self, x: np.ndarray) -> np.ndarray:
        if self.kind is object:
            return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
        return x.astype(self.kind)

    def between(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        found = self.q[queries] @ self.r[rows].T
        long = np.iinfo(np.int64)
        return np.minimum(np.maximum(found, long.min), long.max).astype(np.int64) if self.kind is object else found


class DualSearch:
    """The k best rows of ``rows`` for each query; the row at ``skip`` (its own, or -1) takes no part."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int, skip: np.ndarray, tree: CoverTree | None = None) -> None:
        """``tree``: that of the scaled rows, if it is there already."""
        self.q, self.r, self.k, self.skip = CoverTree(_scaled(queries), leaf=2), tree or CoverTree(_scaled(rows)), k, skip
        self.products = Products(queries, rows)
        #: of each query's best rows, best first: row (-1: none yet) and exact score
        self.row = np.full((len(queries), k), -1, np.int64)
        self.score = np.zeros((len(queries), k), np.float64 if self.products.kind is np.float64 else np.int64)
        #: a k-th scaled score that is known to be reached
        self.floor = np.full(len(queries), -np.inf)
        self.bounded = self.tried = 0

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of each query, best first; -1 where there are fewer rows than k."""
        if len(self.q.x) and len(self.r.x):
            self._seed()
            self._visit(np.zeros(1, np.int64), np.zeros(1, np.int64))
        return self.row, self.score

    def _seed(self) -> None:
        """A floor for each query's k-th score: that among the centres of the topmost row nodes, which are rows."""
        top, at = [0], 0
        while at < len(top) and len(top) < SEEDS:
            children = self.r.children[top[at]]
            top += [] if children is None else children.tolist()
            at += 1
        rows = np.unique(self.r.centre_at[top])
        if len(rows) <= self.k or self.products.kind is object:
            return
        for start in range(0, len(self.q.x), 1024):
            own = slice(start, start + 1024)
            score = self.q.x[own] @ self.r.x[rows].T
            self.tried += score.size
            score[rows[None] == self.skip[own][:, None]] = -np.inf
            self.floor[own] = np.partition(score, len(rows) - self.k, axis=1)[:, -self.k]

    def _worst(self, queries: np.ndarray) -> np.ndarray:
        return self.floor[queries]

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest inner product that the node pairs can have, by query node and row node."""
        q, r = self.q, self.r
        self.bounded += len(a) * len(b)
        dot = q.x[q.centre_at[a]] @ r.x[r.centre_at[b]].T
        qr, rr, qn, rn = q.radius_at[a][:, None], r.radius_at[b][None], q.norm_at[a][:, None], r.norm_at[b][None]
        bound = dot + qr * rn + rr * qn + qr * rr
        return bound + 1e-9 * ((qn + qr) * (rn + rr) + 1)

    def _visit(self, a: np.ndarray, b: np.ndarray) -> None:
        """Search query nodes a, side by side, in row nodes b."""
        worst = np.array([self._worst(self.q.points[x]).min() for x in a])
        bound = self._bounds(a, b)
        open_ = (bound >= worst[:, None]).any(axis=0)
        b, bound = b[open_], bound[:, open_].max(axis=0)
        if not len(b):
            return
        wide = [x for x in a.tolist() if self.q.children[x] is not None and len(self.q.points[x]) > GROUP]
        small = [x for x in a.tolist() if not (self.q.children[x] is not None and len(self.q.points[x]) > GROUP)]
        for x in wide:
            for y in self._packs(self.q.children[x]):
                self._visit(y, b)
        if small:
            fine = np.concatenate([self._leaves(x) for x in small])
            self._scan(fine, b)

    def _leaves(self, node: int) -> np.ndarray:
        """The query nodes below a node that have no children."""
        open_, out = [node], []
        while open_:
            x = open_.pop()
            if self.q.children[x] is None:
                out.append(x)
            else:
                open_ += self.q.children[x].tolist()
        return np.array(out, np.int64)

    def _packs(self, nodes: np.ndarray) -> list[np.ndarray]:
        """Sibling query nodes in packs of about GROUP queries; a larger node is a pack of its own."""
        packs, now, held = [], [], 0
        for x in nodes.tolist():
            size = len(self.q.points[x])
            if now and held + size > GROUP:
                packs.append(np.array(now))
                now, held = [], 0
            now.append(x)
            held += size
        return [*packs, np.array(now)] if now else packs

    def _scan(self, a: np.ndarray, b: np.ndarray) -> None:
        """All queries of nodes a against row nodes b, the most promising first.

        The nodes share matrix products while they need about the same rows; if most of the shared work would be
        for pairs that bounds exclude, each goes on alone.
        """
        queries = np.concatenate([self.q.points[x] for x in a])
        size = np.array([len(self.q.points[x]) for x in a])
        owner = np.repeat(np.arange(len(a)), size)
        while len(b):
            worst = np.full(len(a), np.inf)
            np.minimum.at(worst, owner, self._worst(queries))
            bound = self._bounds(a, b)
            open_ = bound >= worst[:, None]
            some = open_.any(axis=0)
            b, open_, bound = b[some], open_[:, some], bound[:, some]
            if not len(b):
                return
            if len(a) > 1:
                held = np.array([len(self.r.points[x]) for x in b])
                if 2 * (size[:, None] * open_ * held[None]).sum() < size.sum() * held.sum():
                    for i in range(len(a)):
                        self._scan(a[i : i + 1], b[open_[i]])
                    return
            b = b[np.argsort(-bound.max(axis=0), kind="stable")]
            now, b = b[:512], b[512:]
            leaves = [x for x in now.tolist() if self.r.children[x] is None]
            inner = [self.r.children[x] for x in now.tolist() if self.r.children[x] is not None]
            if leaves:
                self._compare(queries, np.concatenate([self.r.points[x] for x in leaves]))
            if inner:
                b = np.concatenate([*inner, b])

    def _compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        self.tried += len(queries) * len(rows)
        score = np.concatenate([self.score[queries], self.products.between(queries, rows)], axis=1)
        row = np.concatenate([self.row[queries], np.broadcast_to(rows, (len(queries), len(rows)))], axis=1)
        some = (row >= 0) & (row != self.skip[queries][:, None])
        # all that reach the k-th score, ties included, are put in order
        if row.shape[1] > self.k:
            least = -np.inf if score.dtype == np.float64 else np.iinfo(np.int64).min
            edge = np.partition(np.where(some, score, least), row.shape[1] - self.k, axis=1)[:, -self.k]
            some &= score >= edge[:, None]
        a, j = np.nonzero(some)
        score, row = score[a, j], row[a, j]
        order = np.lexsort((row, -np.maximum(score, -np.iinfo(np.int64).max), a))
        a, score, row = a[order], score[order], row[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        kept = place < self.k
        a, score, row, place = a[kept], score[kept], row[kept], place[kept]
        self.row[queries], self.row[queries[a], place], self.score[queries[a], place] = -1, row, score
        full = queries[a[place == self.k - 1]]
        if self.products.kind is not object:
            reached = np.einsum("ij,ij->i", self.q.x[full], self.r.x[self.row[full, -1]])
            self.floor[full] = np.maximum(self.floor[full], reached)


def top_k(k: int) -> Index:
    """A block's tree, to be met by a tree of each batch of queries; vectors are integers, ids ascend."""

    def index(ri: np.ndarray, rv: np.ndarray) -> Answer:
        tree = CoverTree(_scaled(rv))

        def answer(qi: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(ri, qi), len(ri) - 1)
            rows, scores = DualSearch(qv, rv, k, np.where(ri[at] == qi, at, -1), tree).run()
            a, j = np.nonzero(rows >= 0)
            return a, rows[a, j], scores[a, j].astype(np.int64)

        return answer

    return index


def exact_top_k(rows: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", **sizes: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` over floor(scale * x): queries are the rows whose id ``every`` divides.

    A table without queries or with a single row gives no rows; fewer than k other rows give as many ranks.
    """
    found = vectors(rows, vec_id=vec_id, embedding=embedding)
    floor = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)  # noqa: E731 beyond it all doubles are whole
    whole = found.select("vec_id", F.transform("v", lambda x: floor(x * scale)).alias("v"))
    return search(whole.where(F.col("vec_id") % every == 0), whole, top_k(k), k, score="long", **sizes)
