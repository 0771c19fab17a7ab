"""What finds words, passages and running lines in one reading of texts, against the plain ways."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from papyra.functions import text as T
from papyra.operators import containment, documents, lexical

TEXTS = ["red green_1", "", None, "ل x", "والكتاب والكتب إلى كَتَبَ", "a bb  ccc. bb-ccc dd", "Éa é ²3 ab́c x​y", "اللون لل ــلون", "１２ 漢字 नमस्ते"]


def test_tokens_in_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string").select("text", T.tokens(F.col("text")).alias("t")).collect()
    assert {r.text: lexical.plain_tokens(r.text) for r in rows} == {r.text: r.t for r in rows}


@pytest.mark.parametrize("empty", [None, "_"])
def test_best_is_the_top_of_all_pairs(spark, empty):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12))), i % 3) for i in range(300)] + [(300 + i, t, 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, third int").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", " ".join(draw.choices(words, k=4))) for i in range(8)] + [("none", ""), ("lam", "كتاب")], "item_id string, text string")
    told = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", F.round("score", 5), "rank").collect())
    every = lexical.bm25(docs, asked, empty=empty)
    assert told(lexical.best(docs, asked, 5, empty=empty)) == told(lexical.ranked(every, 5))
    within = docs.where("doc_id < 100").select(F.col("doc_id").alias("id"))
    want = lexical.ranked(every.join(docs.where("doc_id < 100 and third = 1").select(F.col("doc_id").alias("id")), "id", "left_semi"), 5)
    assert told(lexical.best(docs, asked, 5, empty=empty, where=F.col("third") == 1, within=within)) == told(want)
    twice = docs.unionByName(docs.limit(20))  # ids that aren't unique
    assert told(lexical.best(twice, asked, 5, empty=empty)) == told(lexical.ranked(lexical.bm25(twice, asked, empty=empty), 5))


def test_only_the_best_leave_a_task(spark):
    """No row for each occurrence and none for each pair of query and text: 2,000 texts and 20 queries that share words."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same words in every text "), F.col("id").cast("string")).alias("text")).repartition(4)
    asked = spark.range(20).select(F.col("id").alias("item_id"), F.lit("same words").alias("text"))
    plan = lexical.best(docs, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "MapInArrow" in plan


def test_passages_by_words_as_by_windows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a bb ccc dd e"), (2, "xbb ccc dd"), (3, "abb ccc ddx\n"), (4, None), (5, "bb ccc dd"), (6, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([("p", "bb ccc dd"), ("q", "two"), ("r", "  "), ("s", "bb ccc dd"), ("t", "e"), ("u", None), ("v", "a bb ccc dd e")], "item_id string, text string")
    got = lambda: sorted(tuple(r) for r in containment.passages(docs, items).collect())
    few = got()
    assert ("p", 1) in few and ("p", 3) in few and ("s", 5) in few and ("q", 6) in few and ("v", 1) in few
    assert "explode" not in containment.passages(docs, items)._jdf.queryExecution().optimizedPlan().toString()  # a text's windows don't become rows
    monkeypatch.setattr(containment, "MOST", 0)
    assert got() == few


def test_running_lines_below_the_first(spark, tmp_path):
    """Every line of a text counts, wherever it stands."""
    texts = [f"Title {'abcdefghij'[i] * 40}\nbody {'klmnopqrst'[i] * 30}\nAll rights reser{'vw'[i % 2]}ed, page {i}" for i in range(10)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in __spark_entry__.queries()["running_clusters"](spark, str(tmp_path)).collect()}
    first = "all rights reserved, page #"
    assert got == {("s", key, first, 10) for key in (first, first.replace("reserved", "reserwed"))}


def test_clusters_as_by_comparing_all():
    draw = random.Random(5)
    for _ in range(40):
        bases = ["".join(draw.choices("abc ", k=draw.randint(3, 14))) for _ in range(4)]
        keys = list({"".join(draw.choice("abcd ") if draw.random() < 0.08 else c for c in draw.choice(bases)) for _ in range(60)})
        on, least = [set(draw.choices(range(40), k=draw.randint(1, 4))) for _ in keys], draw.randint(3, 25)
        clusters = []
        for key, own in zip(keys, on, strict=True):
            at = next((c for c in clusters if difflib.SequenceMatcher(None, key, c[0]).ratio() >= 0.88), None)
            if at is None:
                clusters.append(at := (key, [], set()))
            at[1].append(key)
            at[2].update(own)
        assert sorted(documents._clusters(keys, on, 0.88, least)) == sorted((k, first, len(p)) for first, members, p in clusters if len(p) >= least for k in members)
