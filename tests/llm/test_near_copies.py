import random

import pyarrow as pa

from papyra.llm import near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """Ids that stay of (id, text) rows: the least of each component of pairs of a Jaccard similarity of 0.8."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return {min(i for (i, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)}


def test_near_copies_against_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 40)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    frame = " ".join(words[:30])
    rows = []
    for n in [*range(1, 12), *range(20, 300, 20)]:
        text = [rng.choice(words) for _ in range(n)] + (frame.split() if n % 40 == 0 else [])
        rows.append(" ".join(text))
        for changed in (1, 2, 4):
            other = list(text)
            for at in rng.sample(range(len(other)), min(changed, len(other))):
                other[at] = "changed"
            rows.append(" ".join(other).upper())
        rows.append(" ".join(text[: n * 9 // 10]))
    rows = [(i, t) for i, t in enumerate([*rows, *rows[:9], None, "", " ", "one", "One"])]
    want = plain_kept(rows)
    assert {r.doc_id for r in near_copies.keep_one(documents(*rows)).collect()} == want
    assert near_copies.keep_one(documents((1, "x")).limit(0)).collect() == []
    assert near_copies.keep_one(documents((1, None), (2, ""), (None, None), (None, "a"))).count() == 2


def test_many_near_copies_of_one_text(spark, documents, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(100)]
    rows = [" ".join(base)]
    for _ in range(150):  # each near the base, most not near each other
        text = list(base)
        text[rng.randrange(5, 95)] = "changed"
        text[rng.randrange(5, 95)] = rng.choice(words)
        rows.append(" ".join(text))
    frame = " ".join(words[:60])
    rows += [frame + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40))) for _ in range(40)]  # much in common, few similar
    rows = list(enumerate(rows))
    assert {r.doc_id for r in near_copies.keep_one(documents(*rows)).collect()} == plain_kept(rows)
    sent = []
    real = near_copies._Sets.compared
    monkeypatch.setattr(near_copies._Sets, "compared", lambda self, pairs: (sent.append(pairs.count()), real(self, pairs))[1])
    near_copies.keep_one(documents(*rows[:151])).count()
    assert sum(sent) < 5 * 151, sent  # not the pairs of the group


def test_meetings_of_one_class_or_star():
    n = 500
    row = lambda hub, cls: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([7] * n, hub, [50] * n, [0] * n, cls)], names=["s", "hub", "n", "place", "class"])
    count = lambda *batches: sum(map(len, near_copies.meet(iter(batches))))
    alone, mixed = list(range(n)), [1] * (n - 2) + [2, 3]
    assert count(row(alone, [1] * n)) == 0
    assert count(row(alone, mixed)) == count(row(alone, mixed).slice(0, 100), row(alone, mixed).slice(100)) == 2 * (n - 2) + 1
    assert count(row([5] * (n - 2) + [6, 7], mixed)) == 3  # a star meets as one


def test_random_groups_against_brute_force(spark, documents, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):  # chains and stars around several bases, and texts that have passages in common
        base = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                base = text
            rows.append(" ".join(text[: len(text) - rng.randrange(0, 12)]))
        rows += [" ".join(base[:30] + [rng.choice(words) for _ in range(rng.randrange(2, 20))]) for _ in range(6)]
    rows = list(enumerate(rows))
    assert {r.doc_id for r in near_copies.keep_one(documents(*rows)).collect()} == plain_kept(rows)
    monkeypatch.setattr(near_copies, "FEW", 0)  # sets too large for every task
    assert {r.doc_id for r in near_copies.keep_one(documents(*rows)).collect()} == plain_kept(rows)


def test_few_links_are_united_without_rounds_of_jobs(spark):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(0, 400)]  # the farther apart, the more rounds of stars
    others = [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    links = spark.createDataFrame([*chain, *others, (-(2**62), 2**62), (7, 7), (5000, 5000)], "u long, v long")
    sc = spark.sparkContext
    found, jobs = [], []
    for few in (None, 3):  # as it is, then beyond the bound
        sc.setJobGroup(f"united-{few}", "")
        made = near_copies._classes(links) if few is None else near_copies._classes(links, few)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"united-{few}")))
        found.append(sorted(tuple(r) for r in made.select("node", "class").collect()))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and (400, 0) in found[0] and (2**62, -(2**62)) in found[0]
    assert jobs[0] <= 6 < jobs[1], jobs
    assert near_copies._classes(links.limit(0)).collect() == []


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "One two THREE"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == {"a", None}


def test_the_stage_leaves_no_near_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "/root/testdata/sf0.01")
    assert {r.doc_id for r in kept.collect()} == plain_kept([(r.doc_id, r.text) for r in docs.collect()])
