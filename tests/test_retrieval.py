import math

import pytest
from pyspark.sql import functions as F

from papyra.operators import agent, containment, dense, evaluate, fusion, lexical


def test_bm25_by_hand(spark):
    docs = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry cherry date"), (4, None)]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(10, "apple cherry apple"), (11, "nothing here"), (12, None)], "item_id long, text string")
    got = {(r.query_id, r.id): r.score for r in lexical.bm25(corpus, queries).collect()}
    split = {i: (t or "").split() for i, t in docs}
    mean = sum(map(len, split.values())) / 4
    want = {}
    for i, words in split.items():
        total = 0.0
        for term in ("apple", "cherry"):
            df = sum(term in w for w in split.values())
            f = words.count(term)
            total += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if total:
            want[10, i] = round(total, 6)
    assert got == want
    hits = lexical.ranked(lexical.bm25(corpus, queries), 2, where=F.col("id") != 1).collect()
    assert [(r.id, r.rank) for r in hits] == [(3, 1), (2, 2)]
    assert hits[0].score == want[10, 3]  # a filter never changes a score
    assert lexical.bm25(corpus.limit(0), queries).collect() == []


def test_dense_ties_and_nulls(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (None, [1.0, 1.0])], "id long, v array<double>")
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in dense.nearest(rows.where("id = 3"), rows, 2).collect()]
    assert sorted(got) == [(3, 1, 1.0, 1), (3, 3, 1.0, 2)]
    want = {(r.query_id, r.id, r["rank"]) for r in dense.nearest(rows, rows, 2).collect()}
    for few in (0, 1000):  # queries dealt to blocks, and given to all tasks
        assert want == {(r.query_id, r.id, r["rank"]) for r in dense.nearest(rows, rows, 2, row_block=1, few=few).collect()}
    assert {r.id: r.ok for r in dense.self_check(rows).collect()} == {1: True, 2: True, 3: False}
    assert dense.nearest(rows.limit(0), rows, 2).collect() == []


def hits(spark, rows, columns="query_id int, id string, unit string, section string, rank int"):
    return spark.createDataFrame(rows, columns)


def test_fusion_collapses_units_before_ranking(spark):
    clause = hits(spark, [(1, "a1", "A", "A", 1), (1, "a2", "A", "A", 2), (1, "b1", "B", "B", 3)])
    title = hits(spark, [(1, "p", "P", "P", 1), (1, "b9", "B", "B", 2), (1, "c", "C", "C", 3), (1, "d", "D", "D", 4)])
    got = [(r.unit, r.score) for r in fusion.weighted_units({"clause": clause, "title": title}, pinned="P").orderBy("rank").collect()]
    assert got == [("B", round(1 / 62 + 0.5 / 62, 9)), ("A", round(1 / 61, 9)), ("C", round(0.5 / 63, 9))]
    found = {r.unit: r.found_in for r in fusion.sources({"clause": clause, "title": title}).collect()}
    assert found == {"A": ["clause"], "B": ["clause", "title"], "P": ["title"], "C": ["title"]}
    assert {(r.unit, r.id, r.found_by) for r in fusion.best_per_unit({"clause": clause, "title": title}).collect()} >= {("A", "a1", "clause"), ("B", "b1", "clause"), ("P", "p", "title")}


def test_ties_keep_the_first_list(spark):
    a, b = hits(spark, [(1, "x", "X", "X", 1)]), hits(spark, [(1, "w", "W", "W", 1)])
    assert [r.id for r in fusion.reciprocal_ranks(a, b, k=5).orderBy("rank").collect()] == ["x", "w"]


def test_pool_quota_counts_priority(spark):
    priority = spark.createDataFrame([(1, "P-1", 1), (1, "Z", 2), (1, "P-2", 3), (1, "P-3", 4)], "query_id int, unit string, rank int")
    fused = spark.createDataFrame([(1, u, i) for i, u in enumerate(["P-4", "A", "Z", "B", "C"], 1)], "query_id int, unit string, rank int")
    got = [r.unit for r in fusion.pool(priority, fused, size=6, is_pinned=F.col("unit").startswith("P-")).orderBy("place").collect()]
    assert got == ["P-1", "Z", "P-2", "P-3", "A", "B"]
    few = [r.unit for r in fusion.pool(priority.where("rank > 9"), fused, size=3, quota=1, is_pinned=F.col("unit").startswith("P-")).orderBy("place").collect()]
    assert few == ["P-4", "A", "Z"]


@pytest.mark.parametrize(("sections", "want"), [("AABBP", "APABB"), ("AP", "AP"), ("PAB", "PAB"), ("AAAP", "AAAP"), ("AB", "AB"), ("ABCP", "APBC")])
def test_pin_to_second_place(spark, sections, want):
    rows = hits(spark, [(1, f"{s}{i}", s, s, i) for i, s in enumerate(sections, 1)])
    got = "".join(r.section for r in fusion.pin_second(rows, "P").orderBy("rank").collect())
    assert got == want


def test_rules_look_at_two_hits(spark):
    primary = hits(spark, [(1, f"{s}{i}", s, s, i) for i, s in enumerate("AAPC", 1)])
    cited = hits(spark, [(1, "c0", "C", "C", 1)])
    got = "".join(r.section for r in fusion.rules_ranking(cited, primary, "P").orderBy("rank").collect())
    assert got == "CPAA"


def test_unjudged_is_neither_true_nor_false(spark):
    rows = hits(spark, [(1, "a", "A", "A", 1), (1, "a2", "A", "A", 2), (1, "b", "B", "B", 3), (2, "c", "C", "C", 1)])
    judged = spark.createDataFrame([(1, "A", True), (1, "B", False)], "query_id int, unit string, selected boolean")
    got = {(r.query_id, r.unit): (r.place, r.selected) for r in fusion.final_hits(rows, judged).collect()}
    assert got == {(1, "A"): (1, True), (1, "B"): (2, False), (2, "C"): (1, None)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "IFR-art001", 2), (1, "CMIR-art003", 11), (2, "CGR-art009", 1), (4, "X-1", 1)], "query_id int, key string, rank int")
    expected = spark.createDataFrame([(1, "IFR-art001"), (1, "CMIR-art003"), (2, "CGR"), (3, "IFR-art001")], "query_id int, key string")
    got = evaluate.metrics(ranked, expected).first()
    assert (got.n_queries, got.hit1, got.hit3, got.mrr10, got.recall10) == (3, 0.333, 0.667, 0.5, 0.5)
    chosen = spark.createDataFrame([(1, "IFR-art001", True), (1, "Y-1", True), (2, "CGR", None), (3, "Z-1", False)], "query_id int, key string, selected boolean")
    pr = {r.query_id: (r.n_selected, r.recall, r.precision) for r in evaluate.selection(chosen, expected).collect()}
    assert pr == {1: (2, 0.5, 0.5), 2: (0, 0.0, None), 3: (0, 0.0, None)}


def test_containment(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, f"x{passage}y"), (3, passage.replace("ten", "tan")), (4, None), (5, f"{passage} {passage}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, None), (9, "too short"), (10, "nine tan"), (11, "y"), (12, " "), (13, "two three four"), (14, "ine tan")], "item_id long, text string")
    want = [(7, 1), (7, 2), (7, 5), (10, 3), (11, 1), (11, 2), *[(13, n) for n in (1, 2, 3, 5)], (14, 3)]
    assert sorted((r.query_id, r.id) for r in containment.passages(docs, items).collect()) == want
    assert containment.passages(docs, items.limit(0)).collect() == []


def test_agent_answers_are_sanitised(spark):
    pool = spark.createDataFrame([(1, f"U{i}", i) for i in range(12)], "query_id int, unit string, place int")
    picks = [{"key": "U3", "role": "related", "topic": 9}, {"key": "U1", "role": "governing", "topic": 1}, {"key": "NO", "role": "governing"}, {"key": "U3", "role": "governing"}, {"key": "U2", "role": "boss", "topic": 2}]
    import json

    answers = spark.createDataFrame([(1, json.dumps({"selected": picks})), (2, "not json"), (3, None)], "query_id int, answer string")
    topics = spark.createDataFrame([(1, ["a", "b"])], "query_id int, topics array<string>")
    got = [(r.unit, r.role, r.topic) for r in agent.sane_selection(answers, pool, topics=topics).orderBy("place").collect()]
    assert got == [("U1", "governing", 1), ("U3", "related", None), ("U2", "related", 2)]
    catalogue = spark.createDataFrame([("K1",), ("K2",)], "key string")
    plan = json.dumps({"topics": [{"topic": "t", "query": "q"}, {"topic": "u", "query": " "}], "articles": ["K2", "ZZ", "K1", "K2"], "annex11_item": 4})
    told = agent.sane_plan(spark.createDataFrame([(1, plan), (2, "[]x"), (3, None)], "query_id int, answer string"), catalogue)
    rows = {r.query_id: r for r in told.collect()}
    assert [t.query for t in rows[1].topics] == ["q"] and rows[1].articles == ["K2", "K1"] and rows[1].item == 4
    assert not rows[2].ok or rows[2].topics == []
    assert rows[3].topics == [] and rows[3].articles == []


def test_cache_asks_once(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, request string")
    seen = []

    def ask(rows):
        seen.extend(r.request for r in rows.collect())
        return rows.select("query_id", "key", F.when(F.col("request") != "c", F.upper("request")).alias("answer"))

    empty = spark.createDataFrame([], "key string, answer string")
    _, cache = agent.cached(asked, empty, ask)
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    answers, _ = agent.cached(asked, cache, ask)
    assert {r.query_id: r.answer for r in answers.collect()} == {1: "A", 2: "B", 3: None}
    assert seen[:3] == ["a", "b", "c"] and set(seen[3:]) == {"c"}


def test_excerpts(spark):
    paras = ["أ) " + "word " * 60, "ب) target " + "x " * 100, "ج) " + "other " * 90]
    pairs = spark.createDataFrame([(1, "U", "target", paras), (1, "S", "q", ["short", "text"])], "query_id int, unit string, query string, paras array<string>")
    got = {r.unit: r.excerpt for r in agent.excerpts(pairs, budget=300).collect()}
    assert got["S"] == "short\ntext"
    assert got["U"].startswith("…\nب) target") and got["U"].endswith("…")


def test_ablations_are_named(spark):
    with pytest.raises(ValueError, match="no_such"):
        agent.Agent(lambda n, q: q, spark.range(1), ablate=frozenset({"no_such"}))
