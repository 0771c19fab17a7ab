import random

import numpy as np
import pytest

from papyra.llm import cover_tree, cross_polytope
from papyra.llm.queries import op3_cover_tree, op9_cross_polytope


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def brute(rows, every, k, scale=None):
    """(query, rank, id, score) of every row that takes part; of rows with one id the least vector."""
    own = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            v = [float(np.float32(x)) for x in v]
            own[i] = min(own.get(i, v), v)
    x = {i: np.floor(scale * np.array(v)) if scale else np.array(v) for i, v in own.items() if scale or any(v)}
    out = set()
    for q in x:
        if q % every == 0:
            scored = sorted((-float(x[q] @ x[i]), i) for i in x if i != q and len(x[i]) == len(x[q]))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)}
    return out


def odd_rows(rng, n, d):
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]
    rows += [(n, None), (n + 1, [None] * d), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] + [0.0] * (d - 1)), (n + 4, []), (None, [1.0] * d), (3, [0.5] * d), (3, [0.5] * d)]
    return rows + [(n + 10 + i, rows[1][1]) for i in range(40)] + [(n + 60, [0.0] * d)]


def test_exact_top_k(spark):
    rows = odd_rows(random.Random(1), 150, 5)
    got = {tuple(r) for r in cover_tree.exact_top_k(vectors(spark, rows), every=10).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == {(q, r, i, int(s)) for q, r, i, s in brute(rows, 10, 5, 256)}
    few = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (7, [1.0])]
    got = {tuple(r) for r in cover_tree.exact_top_k(vectors(spark, few)).collect()}
    assert got == {(0, 1, 50, 256 * 256 * 4), (50, 1, 0, 256 * 256 * 4)}
    assert cover_tree.exact_top_k(vectors(spark, few).limit(0)).collect() == []


def test_blocks_change_nothing(spark):
    rows = odd_rows(random.Random(2), 120, 4)
    for few in (0, 1000):  # queries dealt to blocks, and given to all tasks
        got = {tuple(r) for r in cover_tree.exact_top_k(vectors(spark, rows), every=5, row_block=25, few=few).collect()}
        assert got == {(q, r, i, int(s)) for q, r, i, s in brute(rows, 5, 5, 256)}


@pytest.mark.parametrize("small", [True, False])
def test_tree_covers_and_prunes(small, monkeypatch):
    if small:
        monkeypatch.setattr(cover_tree, "GROUP", 8)
        monkeypatch.setattr(cover_tree, "LEAF", 4)
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (20, 6))
    x = np.concatenate([c + rng.integers(-20, 20, (200, 6)) for c in centres]).astype(float)
    tree = cover_tree.CoverTree(x)
    for c, r, points, children in zip(tree.centre, tree.radius, tree.points, tree.children, strict=True):
        assert (np.linalg.norm(x[points] - x[c], axis=1) <= r + 1e-6).all()
        if children is not None:
            assert sorted(np.concatenate([tree.points[k] for k in children])) == sorted(points)
    q = x[::40]
    found = cover_tree.DualSearch(q, x, 5, np.arange(0, len(x), 40))
    rows, scores = found.run()
    # bounds and comparisons together stay below all pairs
    assert found.tried + found.bounded < 0.6 * len(q) * len(x), (found.tried, found.bounded, len(q) * len(x))
    for row, told, own, mine in zip(rows, scores, np.arange(0, len(x), 40), q, strict=True):
        score = x @ mine
        score[own] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:5]
        assert row.tolist() == best.tolist() and told.tolist() == score[best].tolist()


def near(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))  # the nearest long


@pytest.mark.parametrize("size", [1 << 20, 1 << 26, 1 << 29, 1 << 40])
def test_scores_of_any_size_are_exact(size):
    rng = np.random.default_rng(size)
    x = np.rint(rng.normal(size=(400, 6)) * size)
    x[100:120] = x[0]  # ties go to the lesser row
    rows, scores = cover_tree.DualSearch(x[::20], x, 5, np.arange(0, 400, 20)).run()
    whole = [[int(v) for v in row] for row in x.tolist()]
    for own, row, told in zip(range(0, 400, 20), rows, scores, strict=True):
        exact = sorted((-near(sum(a * b for a, b in zip(whole[own], y, strict=True))), i) for i, y in enumerate(whole) if i != own)[:5]
        assert row.tolist() == [i for _, i in exact] and [int(s) for s in told] == [-s for s, _ in exact]


def test_large_components(spark):
    rows = [(i, [float(10**k * (i % 7 - 3)), float(i)]) for k in (3, 8, 20, 30) for i in range(k * 100, k * 100 + 60)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.exact_top_k(vectors(spark, rows)).collect()}
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows}
    for q in x:
        if q % 50 == 0:
            best = sorted((-near(sum(a * b for a, b in zip(x[q], x[i], strict=True))), i) for i in x if i != q)[:5]
            assert [got[q, r] for r in range(1, 6)] == [(i, -s) for s, i in best]


def test_hadamard_and_axes():
    x = np.eye(8)
    h = cross_polytope.hadamard(x)
    assert (h @ h.T == 8 * np.eye(8)).all()
    turns = cross_polytope.Rotations(5, 4)
    v = np.random.default_rng(1).normal(size=(30, 5))
    assert np.allclose(np.linalg.norm(turns.turn(v, 1), axis=1), np.linalg.norm(v, axis=1) * 8**1.5)
    assert np.allclose(turns.turn(v, 2), turns._rounds(v, 2))
    first, second = turns.near(v, 0), turns.near(v, 1)
    assert (turns.buckets(v, 0) == cross_polytope.probed(first, second, 1)[:, 0]).all()
    assert (turns.buckets(-v, 0) == ((turns.buckets(v, 0) // 16) ^ 1) * 16 + ((turns.buckets(v, 0) % 16) ^ 1)).all()
    sums = first[:, :, None] + second[:, None, :]
    for n in (1, 7, 100, 256):
        for i, own in enumerate(cross_polytope.probed(first, second, n)):
            assert len(set(own.tolist())) == n and sums[i].ravel()[own].min() >= np.sort(sums[i].ravel())[-n] - 1e-9


def test_approximate(spark):
    rows = odd_rows(random.Random(3), 150, 5)
    want = brute(rows, 20, 20)
    got = {tuple(r) for r in cross_polytope.approximate(vectors(spark, rows)).collect()}
    scores = {(q, i): s for q, _, i, s in brute(rows, 20, 10_000)}
    assert all(scores[q, i] == pytest.approx(s, abs=1e-12) for q, _, i, s in got)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    assert cross_polytope.approximate(vectors(spark, rows).limit(0)).collect() == []
    two = [(0, [1.0, 0.0]), (20, [1.0, 0.0])]
    assert sorted(tuple(r) for r in cross_polytope.approximate(vectors(spark, two)).collect()) == [(0, 1, 20, 1.0), (20, 1, 0, 1.0)]


def test_no_query_is_left_out(spark):
    rng = np.random.default_rng(4)
    few = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(15, 64)))]
    got = [(r.query_id, r.vec_id) for r in cross_polytope.approximate(vectors(spark, few), every=1).collect()]
    assert sorted(got) == [(q, i) for q in range(15) for i in range(15) if i != q]
    tight = np.repeat(rng.normal(size=(20, 64)), 100, axis=0) + 0.01 * rng.normal(size=(2000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate([*tight, *rng.normal(size=(60, 64))])]
    lone = {(q, i) for q, _, i, _ in brute(rows, 1, 20) if q >= 2000}
    got = [(r.query_id, r.vec_id) for r in cross_polytope.approximate(vectors(spark, rows), every=1).collect()]
    assert len(got) == 20 * 2060
    found = {q: sum((q, i) in lone for p, i in got if p == q) for q in range(2000, 2060)}
    assert min(found.values()) >= 10 and sum(found.values()) >= 0.9 * len(lone)


@pytest.mark.parametrize("lengths", ["alike", "differ"])
def test_fit_and_candidates(lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64)) + np.repeat(2 * rng.normal(size=(100, 64)), 40, axis=0) * (rng.random((4000, 1)) < 0.7)
    if lengths == "differ":
        x *= rng.uniform(0.1, 3, (4000, 1))  # the largest inner product is no longer one's own
    probes = cross_polytope.fit_probes(x[:2000], 128, 20, 16, 0.9, 0.75)
    assert (np.diff(probes.number) >= 0).all() and probes.needed(np.array([-1e9]), 9)[0] == 9
    tables = cross_polytope.Tables(np.arange(4000), x, 20, 16, probes)
    q = np.arange(0, 4000, 40)
    a, b, s = tables.answer(q, x[q])
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    least = np.sort(score, axis=1)[:, -20]
    assert np.allclose(s, (x[q][a] * x[b]).sum(axis=1)) and np.bincount(a).tolist() == [20] * len(q)
    assert (s >= least[a] - 1e-9).mean() >= 0.9
    if lengths == "alike":
        assert tables.compared < 0.3 * len(q) * 4000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    got = {}
    for r in op9_cross_polytope(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    recall = []
    for q, own in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        least = np.sort(score)[-20]
        recall.append(sum(s >= least - 1e-12 for _, _, s in own) / 20)
        assert [s for *_, s in sorted(own)] == sorted((s for *_, s in own), reverse=True)
    assert len(got) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9
    exact = {(r.query_id, r.vec_id) for r in op3_cover_tree(spark, sf).collect()}
    assert len(exact) == 5 * (ids % 50 == 0).sum()
