"""Quality classifier, language ID and language-model scores."""

import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import hashing, language, lm_scoring, quality
from papyra.llm.queries import ORACLES, op2_quality, op4_lm_score, op8_language

SF = "/root/testdata/sf0.01"
LONG = "w" * 200_000 + " end"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_grams_and_words():
    p = hashing.pack(["ab  cde", "", "x", "  "])
    words = ["".join(map(chr, p.code[a:b])) for a, b in zip(p.start, p.end, strict=True)]
    assert words == ["ab", "cde", "x"] and p.doc.tolist() == [0, 0, 2]
    text = "".join(map(chr, p.code))
    got = {n: {text[a : a + n] for a in at} for n, at, _ in hashing.grams(p, (2, 3, 4))}
    assert got[2] == {" a", "ab", "b ", " c", "cd", "de", "e ", " x", "x "}
    assert got[3] == {" ab", "ab ", " cd", "cde", "de ", " x "}
    assert got[4] == {" ab ", " cde", "cde "}
    again = hashing.pack(["cde ab", "ab"])
    h, g = hashing.word_hashes(p), hashing.word_hashes(again)
    assert h[0] == g[1] == g[2] and h[1] == g[0] and len(set(h.tolist())) == 3
    for n, at, hashes in hashing.grams(hashing.pack(["abab"]), (2,)):
        assert hashes[at.tolist().index(1)] == hashes[at.tolist().index(3)]


def test_quality_learns_and_scores_every_text(spark, documents):
    rng = random.Random(0)
    good = [" ".join(rng.choice(["river", "stone", "meadow", "cloud"]) for _ in range(20)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click", "click"]) for _ in range(20)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(None, None), (1000, ""), (1001, LONG), (0, good[0])]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    df = documents(*rows).withColumnRenamed("lang", "score")
    model = quality.fit(df, labels, max_rows=200)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows)
    right = [(r.score >= 0.5) == (r.doc_id < 120) for r in got if r.doc_id is not None and r.doc_id < 240 and held_out(r.doc_id)]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 for r in got)
    none = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert quality.score(df.limit(0), model).collect() == []
    chosen = quality.sample(df, labels, max_rows=50)
    held = {t for i, t in rows if i is not None and held_out(i)} - {t for i, t in rows if i is not None and not held_out(i)}
    assert len(chosen[0]) == 50 and not set(chosen[0]) & held


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op2_quality(spark, SF).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
    told = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in told) >= 0.95 * len(told)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    k, n = 3, np.array([5, 0, 1, 7])
    emission, transition = rng.normal(size=(13, k)), rng.normal(size=(k, k))
    got, _, _ = language.marginals(emission, n, transition, block=2)
    at = 0
    for length in n.tolist():
        want = np.zeros((length, k))
        for states in itertools.product(range(k), repeat=length) if length else ():
            x = np.log(np.exp(transition).sum(0))[states[0]] + sum(emission[at + i, s] for i, s in enumerate(states)) + sum(transition[a, b] for a, b in itertools.pairwise(states))
            want[np.arange(length), list(states)] += math.exp(x)
        if length:
            assert np.allclose(want / want.sum(1, keepdims=True), got[at : at + length])
        at += length


def test_languages_of_mixed_and_odd_texts(spark, documents):
    rng = random.Random(1)
    speech = {"en": ["the", "house", "with", "thing", "and"], "fr": ["la", "maison", "avec", "chose", "déjà"], "de": ["das", "über", "mit", "ding", "und"]}
    say = lambda lang, n: " ".join(rng.choice(speech[lang]) for _ in range(n))
    rows = [(i, say(lang, 30), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 456 !!!", "en"), (503, say("fr", 40) + " " + say("en", 10), None), (None, say("de", 9), "de"), (504, "und " * 30_000, None), (0, rows[0][1], "en")]
    df = documents(*rows)
    model = language.fit(df)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict(df.withColumnRenamed("source", "lang_pred"), model).collect()}
    assert all(got[i, t][0] == lang for i, t, lang in rows[:180])
    assert [got[rows[i][0], rows[i][1]] for i in (180, 181, 182)] == [("und", 0.0)] * 3
    assert got[503, rows[183][1]][0] == "fr" and 0.6 < got[503, rows[183][1]][1] < 1
    assert got[504, rows[185][1]][0] == "de"
    assert language.predict(df.limit(0), model).collect() == []
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"}


def test_language_query(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op8_language(spark, SF).collect()
    told = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert sum(told) >= 0.95 * len(told) and all(0 <= r.score <= 1 for r in got)


def test_languages_of_a_mixed_text(spark, documents):
    rng = random.Random(1)
    words = {"aa": ["baka", "dara", "kama", "lara"], "ii": ["miri", "sitti", "nili", "pirri"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    model = language.train([say(x, 30) for _ in range(60) for x in words], [x for _ in range(60) for x in words])
    first, second = say("aa", 12), say("ii", 20)
    df = documents((1, f"  {first} 42 {second}."), (2, None), (3, "12 34"), (4, "İ " + second))
    got = {r.doc_id: r for r in language.predict(df.withColumnRenamed("source", "Spans"), model, spans="spans").collect()}
    text = f"  {first} 42 {second}."
    assert [(text[s.start : s.end], s.language) for s in got[1].spans] == [(first, "aa"), (f"{second}.", "ii")]
    assert all(0.5 < s.probability <= 1 for s in got[1].spans) and got[1].lang_pred == "ii"
    assert got[2].spans == [] and got[3].spans == [] and got[3].lang_pred == "und" and got[4].spans[-1].end == len("İ " + second)


def test_rows_of_one_id_and_clashing_names(spark, documents):
    df = documents((7, "the good text"), (7, "another"), (8, "x")).withColumnRenamed("source", "Score")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    told = quality.sample(df, labels)
    assert told == quality.sample(df.orderBy("text"), labels) and "another" in told[0] and "the good text" not in told[0]
    assert quality.score(df, quality.fit(df, labels)).columns == ["doc_id", "text", "lang", "n_chars", "score"]


def plain_score(model, text):
    """A plain scorer: hashes of words, pairs and n-grams one by one, their weights averaged."""
    doc, bucket = quality.features([text], len(model.weight))
    total, n = 0.0, 0
    for b in bucket.tolist():
        total += float(model.weight[b])
        n += 1
    return model.prior if not n else 1 / (1 + math.exp(-max(-40, min(40, total / n + model.bias))))


def test_quality_query_against_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op2_quality(spark, "/root/testdata/sf0.001").collect():
        assert r.held_out == held_out(r.doc_id) and r.predicted == (r.score >= 0.5)
        assert r.score == pytest.approx(plain_score(model, texts[r.doc_id] or ""), abs=1e-4)


def test_language_query_against_a_plain_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op8_language(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    step = np.exp(model.transition - model.transition.max())
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:60]:
        p = hashing.pack([language.lowered(texts[i] or "")])
        e = np.exp(model.emissions(p)) if len(p.start) else np.zeros((0, len(model.languages)))
        sums = np.zeros(len(model.languages))
        forward = [np.ones(len(model.languages)) / len(model.languages)]
        for w in e:
            a = (forward[-1] @ step) * w
            forward.append(a / a.sum())
        back = np.ones(len(model.languages))
        for k in range(len(e) - 1, -1, -1):
            m = forward[k + 1] * back
            if any(chr(c).isalpha() for c in p.code[p.start[k] : p.end[k]]):
                sums += m / m.sum()
            back = step @ (e[k] * back)
            back /= back.sum()
        want = model.languages[int(sums.argmax())] if sums.sum() else "und"
        assert got[i].lang_pred == want and got[i].score == pytest.approx(sums.max() / sums.sum() if sums.sum() else 0.0, abs=1e-6)
        assert got[i].held_out == held_out(i)


def plain_losses(texts, other, prior=lm_scoring.PRIOR, base=lm_scoring.BASE):
    """-log P(b | a) by the counts of texts, with the words of both sides as the shared vocabulary."""
    coded = [["", *t.lower().split()] for t in texts if t and t.split()]
    pairs = Counter(p for c in coded for p in itertools.pairwise(c))
    single, history, shared = Counter(), Counter(), Counter(w for t in [*texts, *other] if t for w in t.lower().split())
    for (a, b), n in pairs.items():
        single[b] += n
        history[a] += n
    total, both = sum(single.values()), sum(shared.values())
    share = lambda w: (single[w] + base * shared[w] / both) / (total + base)
    return lambda a, b: -math.log((pairs[a, b] + prior * share(b)) / (history[a] + prior))


@pytest.mark.parametrize("chunk_bytes", [lm_scoring.CHUNK_BYTES, 64])
def test_cross_entropy_difference(spark, documents, chunk_bytes):
    texts = ["the river runs the river bends", "stones stones STONES", None, "", "  ", "the stones of the river", "one two three four", "the river runs the river bends", "z " * 3000]
    target = ["river the river", None, "stones of the river"]
    df = documents(*[(i, t) for i, t in enumerate(texts)], (None, "the")).withColumn("chunk", F.lit("c")).withColumn("score", F.lit(1))
    a, b = plain_losses(target, [*texts, "the"]), plain_losses([*texts, "the"], target)
    wanted = documents(*[(i, t) for i, t in enumerate(target)])
    got = {r.doc_id: r for r in lm_scoring.score(df, wanted, chunk_bytes=chunk_bytes).collect()}
    for i, t in [*enumerate(texts), (None, "the")]:
        pairs = list(itertools.pairwise(["", *(t or "").lower().split()]))
        assert got[i].n_tokens == len(pairs)
        if not pairs:
            assert got[i].score is None and got[i].target_loss is None
            continue
        assert got[i].target_loss == pytest.approx(sum(a(*p) for p in pairs) / len(pairs))
        assert got[i].background_loss == pytest.approx(sum(b(*p) for p in pairs) / len(pairs))
        assert got[i].score == pytest.approx(got[i].target_loss - got[i].background_loss)


def test_cross_entropy_difference_of_empty_tables(spark, documents):
    df = documents((1, "a b c"), (1, "a b c"), (2, None))
    assert lm_scoring.score(df.limit(0), df).collect() == []
    got = lm_scoring.score(df, df.limit(0)).collect()
    a, b = plain_losses(["a b c"] * 2, []), -math.log(1 / 3)  # an empty target knows the shared vocabulary alone
    for r in got:
        if r.doc_id == 1:
            assert r.target_loss == pytest.approx(b) and r.background_loss == pytest.approx((a("", "a") + a("a", "b") + a("b", "c")) / 3)
    assert sorted(r.doc_id for r in got) == [1, 1, 2]


def test_words_of_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(lm_scoring, "PIECE", 4)
    text = "Ab cdefghij k\u00a0l  mnopq\n" * 3
    assert [w for piece in lm_scoring.words(text) for w in piece] == text.lower().split()


def test_rare_words_and_repeated_texts_tell(spark, documents):
    plain = [(i, f"common words stand here w{i} x{i} y{i}") for i in range(40)]
    df = documents(*plain, (100, "common words stand here rare1 rare2 rare3"), (101, "common words stand here rare1 rare2 rare3"))
    got = {r.doc_id: r for r in lm_scoring.score(df, documents((0, "rare1 rare2 rare3"))).collect()}
    assert got[100].score < min(got[i].score for i in range(40))  # what only the target shares sets it apart
    assert got[100].background_loss < min(got[i].background_loss for i in range(40))  # so does standing twice in the background


def test_scores_prefer_the_target(spark):
    got = {r.doc_id: r for r in op4_lm_score(spark, SF).collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    hold = [got[r.doc_id].score for r in docs if r.text and any(x in r.text for x in items)]
    rest = [got[r.doc_id].score for r in docs if got[r.doc_id].score is not None and not any(x in r.text for x in items)]
    assert hold and sum(hold) / len(hold) < sum(rest) / len(rest) - 0.5


def test_scores_by_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_tokens, target_loss, background_loss, score FROM ({ORACLES['op4_lm_score']})").fetchall()}
    got = {r.doc_id: (r.n_tokens, r.target_loss, r.background_loss, r.score) for r in op4_lm_score(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=2e-6) if want[i][1] is not None else got[i] == want[i] for i in want)

