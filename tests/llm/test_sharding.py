import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from papyra.llm import sharding
from papyra.llm.queries import ORACLES, op6_shards


@pytest.fixture
def store(spark, tmp_path):
    return lambda **how: sharding.ShardedTable(spark, f"file://{tmp_path}/{uuid.uuid4().hex}", **how)


def rows(df):
    return sorted((tuple(r) for r in df.drop("shard").collect()), key=str)


def test_appends_merge_and_keep_every_row(spark, store, documents):
    table = store(fan_in=3, target_bytes=1 << 20, tier_bytes=1 << 20)
    sent = []
    for n in range(7):
        batch = documents((n, f"text {n}"), (n, f"text {n}"), (None, None), (n + 100, "x" * 50_000)).repartition(2)
        sent += [tuple(r) for r in batch.collect()]
        table.append(batch)
        version = table.manifest()
        runs = version.runs
        assert len(runs) <= 3
        assert rows(table.read()) == sorted(sent, key=str)
    assert version.number > 7  # merges are versions of their own
    assert table.versions() == [version.number - 1, version.number]
    live = {r.name for n in table.versions() for r in table.manifest(n).runs}
    folders = {p.rsplit("/", 1)[1] for p, _ in table._names(f"{table.root}/runs")}
    assert folders == live
    assert max(len(r.shards) for r in runs) <= 2


def test_tiers_and_targets(spark, store, documents):
    table = store(fan_in=2, target_bytes=40_000, tier_bytes=20_000)
    for n in range(4):
        table.append(documents(*[(i, "".join(uuid.uuid4().hex for _ in range(40))) for i in range(n * 100, n * 100 + 100)]))
    runs = table.manifest().runs
    assert len(runs) == 1
    assert len(runs[0].shards) >= 4, runs
    assert max(n for _, n in runs[0].shards) < 3 * table.target_bytes


def test_one_writer_wins_a_version(spark, store, documents):
    table = store()
    table.append(documents((1, "a")))
    version = table.manifest()
    version.number += 1
    table._commit(version)
    with pytest.raises(sharding.Conflict):
        table._commit(sharding.Version(version.number, [], version.columns))
    assert table.manifest() == version
    assert not [p for p, _ in table._names(f"{table.root}/manifest") if "draft" in p]


def test_an_arrival_that_loses_every_race_is_told(spark, store, documents, monkeypatch):
    table = store(tries=3)
    table.append(documents((1, "a")))
    won, real = [], table._commit

    def lose(version):
        won.append(version.number)
        real(sharding.Version(version.number, table.manifest().runs, version.columns))  # another writer is first
        real(version)

    monkeypatch.setattr(table, "_commit", lose)
    with pytest.raises(sharding.Conflict, match="arrival is in none"):
        table.append(documents((2, "b")))
    assert won == [2, 3, 4] and rows(table.read()) == [(1, "a", "en", "s", 1)]
    monkeypatch.setattr(table, "_commit", real)
    table.append(documents((2, "b")))
    assert len(rows(table.read())) == 2


def test_other_errors_are_no_conflict(spark, store, documents, monkeypatch):
    table = store()
    table.append(documents((1, "a")))
    version = table.manifest()
    version.number += 1
    monkeypatch.setattr(table, "_path", lambda name: table.jvm.Path(name if "draft" in name else f"{table.root}/missing/folder/x.json"))
    with pytest.raises(Exception) as caught:  # the place's folder doesn't exist
        table._commit(version)
    assert not isinstance(caught.value, sharding.Conflict)


def test_versions_stay_readable(spark, store, documents):
    table = store(fan_in=2, keep=3)
    for n in range(4):
        table.append(documents((n, f"t{n}")))
    last = table.manifest().number
    assert table.versions() == [last - 2, last - 1, last]
    sizes = [len(rows(table.read(n))) for n in table.versions()]
    assert sizes == sorted(sizes) and sizes[0] >= 3 and sizes[-1] == 4


def test_columns_join_and_keep_their_types(spark, store, documents):
    table = store(fan_in=2)
    table.append(documents((1, "a")).withColumn("shard", F.lit("mine")))
    table.append(documents((None, None)))
    got = {r.doc_id: r for r in table.read().collect()}
    assert got[1].shard == "mine" and got[None].shard is None and got[1].shard_
    with pytest.raises(ValueError, match="doc_id"):
        table.append(documents((1, "a")).withColumn("doc_id", F.lit("x")))


def test_shards_are_named_alike_in_every_run(spark, store, documents):
    told = []
    for _ in range(2):
        table = store(fan_in=3)
        table.append_each(documents(*[(i, "x") for i in range(9)], (None, "n")).coalesce(1).withColumn("day", (F.col("doc_id") % 4).cast("int")), "day")
        told.append(sorted(map(tuple, table.read().select("doc_id", "shard").collect()), key=str))
    assert told[0] == told[1] and len(told[0]) == 10 and all(s for _, s in told[0])


def test_unlisted_files_are_not_read(spark, store, documents):
    table = store()
    table.append(documents((1, "a")))
    documents((2, "lost")).write.parquet(f"{table.root}/runs/crashed")
    assert rows(table.read()) == [(1, "a", "en", "s", 1)]


def test_empty_arrivals(spark, store, documents):
    table = store()
    with pytest.raises(ValueError, match="no columns"):
        table.read()
    table.append(documents((1, "a")).limit(0))
    assert table.read().columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"] and table.read().collect() == []
    table.append(documents((1, "a")))
    assert rows(table.read()) == [(1, "a", "en", "s", 1)]
    none = store()
    none.append_each(documents((1, "a")).limit(0).withColumn("day", F.lit(1)), "day")
    assert none.read().collect() == []


def test_query_keeps_the_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, lang, source, n_chars, text_sha256 FROM ({ORACLES['op6_shards']})").fetchall()
    got = op6_shards(spark, sf).select("doc_id", "lang", "source", "n_chars", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_query_over_an_empty_table(spark, sf_dir, documents):
    assert op6_shards(spark, sf_dir(documents=documents((1, "a")).limit(0))).collect() == []
