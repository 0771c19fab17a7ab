import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from papyra.llm import mixing


def plain_count(doc_id, text, rate, seed=17):
    d = hashlib.md5((text or "").encode()).hexdigest()
    u = (int(hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_and_weights(spark, documents):
    rows = [(i, f"text {i}", "en", "a" if i % 3 else "b") for i in range(600)] + [(900 + i, f"t {i}", "en", None) for i in range(30)]
    df = documents(*rows)
    got = Counter(r.doc_id for r in mixing.mix(df, {"a": 1.0, "b": 3.0}).collect())
    n = Counter(r[3] for r in rows)
    for i, text, _, s in rows:
        rate = {"a": 0.25, "b": 0.75}.get(s, 0) * len(rows) / n[s]
        assert got[i] == (plain_count(i, text, rate) if s else 0)


def test_all_sources_by_size_and_order_is_global(spark, documents):
    rows = [(i, "same", "en", f"s{i % 7}") for i in range(700)]
    out = mixing.mix(documents(*rows), exponent=0.5, epochs=2.0)
    got = out.collect()
    assert 1200 < len(got) < 1600
    assert out.columns[-2:] == ["copy", "shuffle_key"]
    again = mixing.mix(documents(*rows[::-1]), exponent=0.5, epochs=2.0, broadcast_sources=2, salts=4).collect()
    key = lambda r: (r.doc_id, r.copy, r.shuffle_key)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert all(Counter(r.copy for r in got)[c] >= Counter(r.copy for r in got)[c + 1] for c in range(1, 4))


def test_large_and_tiny_rates(spark):
    rates = spark.createDataFrame([(0.001,), (1.0,), (40.0,), (900.0,)], "rate double").withColumn("cdf", mixing.poisson_cdf(F.col("rate")))
    for r in rates.collect():
        assert all(b >= a for a, b in zip(r.cdf, r.cdf[1:], strict=False))
        assert abs(r.cdf[-1] - 1) < 1e-9
        mean = sum(1 - c for c in r.cdf)
        assert abs(mean - r.rate) < 1e-6 * max(1, r.rate)


def test_nulls_repeats_and_empty_tables(spark, documents):
    df = documents((None, None, None, None), (None, None, None, None), (1, "", "en", "x"), (1, "", "en", "x"))
    got = mixing.mix(df, epochs=3.0).collect()
    by = Counter((r.doc_id, r.copy) for r in got)
    assert all(n == 2 for n in by.values())
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(df, {"nothing": 1.0}).collect() == []
    same = df.withColumnRenamed("lang", "mix_digest").withColumnRenamed("n_chars", "Mix_Source")
    for most in (10_000, 0):
        told = mixing.mix(same, epochs=3.0, broadcast_sources=most)
        assert told.columns[:5] == same.columns and {r.mix_digest for r in told.collect()} == {None, "en"}
    clash = df.withColumnRenamed("lang", "copy").withColumnRenamed("n_chars", "Shuffle_Key")
    assert mixing.mix(clash, epochs=3.0).columns == ["doc_id", "text", "source", "copy", "shuffle_key"]


def test_no_python_on_the_main_path(spark, documents):
    plan = mixing.mix(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
