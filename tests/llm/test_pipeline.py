import hashlib
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from papyra.llm import byte_bpe, common, quality, simhash
from tests.llm.test_mixing import plain_count
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_substring_dedup import plain

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash_near_dedup", "substring_dedup", "mix_sources", "byte_bpe"]

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = stages["quality"](spark, docs, SF)
    assert good.columns == columns
    want = {i for i, t in rows.items() if model.score([t or ""])[0] >= 0.5}
    assert {r.doc_id for r in good.collect()} == want and len(want) < len(rows)

    one = stages["simhash_near_dedup"](spark, good, SF)
    assert one.columns == columns
    want = plain_kept([(i, rows[i]) for i in sorted(want)])  # five words, a similarity of 0.8
    assert {r.doc_id for r in one.collect()} == want

    cut = stages["substring_dedup"](spark, one, SF)
    assert cut.columns == columns
    order = sorted(want)
    texts = dict(zip(order, plain([(i, rows[i]) for i in order]), strict=True))
    got = cut.collect()
    assert {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got)

    mixed = stages["mix_sources"](spark, cut, SF)
    assert mixed.columns == columns
    sources = {r.doc_id: r.source for r in got}
    sizes = Counter(sources.values())
    total = sum(n**0.5 for n in sizes.values())
    rate = {s: n**0.5 / total * len(got) / n for s, n in sizes.items()}
    counts = Counter(r.doc_id for r in mixed.collect())
    assert counts == Counter({i: n for i, t in texts.items() if (n := plain_count(i, t, rate[sources[i]]))})

    coded = stages["byte_bpe"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in coded) == counts
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in coded)

    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, coded))


def test_clashing_columns_stay(spark, documents, sf_dir):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    df = documents((1, "some words"), (2, "other words here"))
    for c in ("score", "removed", "copy", "shuffle_key", "row_key", "kept_id", "unit", "h1", "fp", "root", "source_", "n_tokens"):
        df = df.withColumn(c, df["lang"])
    folder = sf_dir(documents=df, labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == df.columns, name
        assert {r.removed for r in docs.collect()} <= {"en"}
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_and_null_documents(spark, documents, sf_dir):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    folder = sf_dir(documents=documents((1, None), (2, ""), (None, None), (3, "some words"), (3, "some words")), labels=labels)
    got = corpus_pipeline.run(spark, folder).collect()
    assert all(r.n_tokens >= 0 for r in got)
    assert simhash.keep_one(documents((1, None), (2, ""), (None, None))).count() == 1
    assert byte_bpe.encode(documents((1, None)), corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY), corpus_pipeline.public_tokenizers.PATTERN).first().n_tokens == 0


def test_tasks_let_go_of_what_other_operators_remember(spark, documents, monkeypatch):
    runs, frame = [], type(documents((1, "x")))
    plainly = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **k: runs.append(run) or plainly(self, run, *a, **k))
    docs = documents((1, "some words of a text that goes on."), (2, "other words"))
    quality.score(docs, quality.train([], [])).count()
    stages = dict(corpus_pipeline.STAGES)
    stages["simhash_near_dedup"](spark, docs, SF)
    stages["substring_dedup"](spark, docs, SF)
    assert len(runs) >= 5
    tokens = byte_bpe.read_ranks(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    byte_bpe._coder(tokens, corpus_pipeline.public_tokenizers.PATTERN)
    for run in runs:
        if run.__module__ != "papyra.llm.simhash":
            byte_bpe._made[1, ""] = None
            assert list(run(iter([]))) == [] and not byte_bpe._made, run


def test_a_worker_lets_go(spark):
    leanly = common.lean(lambda batches: iter(()))

    def probe(batches):
        list(batches)
        byte_bpe._coder([bytes([b]) for b in range(256)], ".")
        before = len(byte_bpe._made)
        list(leanly(iter([])))
        yield pa.RecordBatch.from_arrays([pa.array([before]), pa.array([len(byte_bpe._made)])], names=["before", "after"])

    assert {(r.before, r.after) for r in spark.range(2).mapInArrow(probe, "before long, after long").collect()} == {(1, 0)}
