import random

import numpy as np
import xxhash

from papyra.llm import components, simhash
from papyra.llm.queries import op10_simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    own = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """(id, fingerprint) rows -> id sets by brute force."""
    ids = list(range(len(pairs)))
    for i, (_, a) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs[:i]):
            if (a ^ b).bit_count() <= 2:
                x, y = ids[i], ids[j]
                ids = [min(x, y) if k in (x, y) else k for k in ids]
    return ids


def test_fingerprints():
    texts = [None, "", "  \n", "One", "one TWO", "a b c", "a b c d e f g", "ÀÉ Straße x\x0by z", "x " * 500, "a\x1cb c d"]
    got = simhash.fingerprint_batch(texts)
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


def test_golay_code_covers():
    code = simhash.Golay(2)
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    rows, near = code.near(words, np.arange(500), 0)
    assert len(rows) == 500
    assert all(int(a ^ b).bit_count() <= 3 for a, b in zip(words, near, strict=True))
    assert (code.syndrome(near) == 0).all()


def test_links_lose_no_pair(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base) | {0, (1 << 64) - 1}
    for x in base:
        for n in (1, 2, 3):
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(spark.createDataFrame(rows, "fp long")).collect()}
    flat = [r[0] for r in rows]
    want = {tuple(sorted((a, b))) for i, a in enumerate(flat) for b in flat[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (100, 100), (300, 301), (301, 302), (300, 302)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    want = {}
    for x in list(parent):
        want.setdefault(root(x), []).append(x)
    want = {x: min(m) for m in want.values() if len(m) > 1 for x in m}
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*edges, (None, 4)], "u long, v long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_duplicates_against_brute_force(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40, 300))) for _ in range(40)]
    near = [t.replace(t.split()[5], "other", 1) for t in texts[:20]]
    rows = [(i, t) for i, t in enumerate(texts + near + texts[:10] + [None, "", " ", "one", "one two"])]
    rows += [(3, texts[3]), (None, texts[4]), (None, "nobody else says this at all")]
    pairs = [(i, plain_fingerprint(t)) for i, t in rows]
    groups = plain_components(pairs)
    least = {g: min((i for (i, _), h in zip(pairs, groups, strict=True) if h == g and i is not None), default=None) for g in set(groups)}
    want = sorted(((i, f, least[g]) for (i, f), g in zip(pairs, groups, strict=True)), key=str)
    df = documents(*rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "root")
    got = sorted(((r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want
    kept = simhash.keep_one(documents(*rows))
    assert kept.columns == documents(*rows).columns
    assert kept.count() == len(set(groups))
    assert simhash.near_duplicates(documents((1, "x")).limit(0)).collect() == []
    assert simhash.keep_one(documents((1, "x")).limit(0)).collect() == []


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    pairs = sorted((r.doc_id, plain_fingerprint(r.text)) for r in docs)
    groups = plain_components(pairs)
    least = {}
    for (i, _), g in zip(pairs, groups, strict=True):
        least[g] = min(i, least.get(g, i))
    want = {i: (f"{fp:016x}", least[g]) for (i, fp), g in zip(pairs, groups, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf).collect()} == want


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "some words here"), ("a", "Some words HERE"), (None, "other")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {"a": "a", "b": "a", None: None}
