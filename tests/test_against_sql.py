"""Registered queries against their SQL on small tables made for what the test tables don't hold: ties, bounds met exactly, nulls."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from tests.test_oracles import plain

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives its SQL's rows on tables of rows; a query's table may be dealt over several row groups."""

    def run(name, group=1 << 20, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            pq.write_table(pa.Table.from_pylist(rows[0], schema=rows[1]), path := f"{tmp_path}/{table}.parquet", row_group_size=group)
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{path}'")
        got = QUERIES[name](spark, str(tmp_path))
        told = ", ".join(f'"{c}"' for c in sorted(got.columns))
        want = sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {told} FROM ({ORACLES[name]})").fetchall())
        mine = sorted(tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect())
        assert mine == want
        return mine

    return run


def test_first_seen_of_lines_with_one_number(same):
    kinds = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32())])
    rows = [dict(zip(kinds.names, r, strict=True)) for r in [(9, 1, 4, 1), (2, 1, 7, 3), (2, 1, 5, 3), (2, 1, 6, 3), (3, 2, None, 1), (3, 2, 8, 1), (None, 2, 9, 1), (1, 3, 3, 12), (2, 3, 2, 1)]]
    assert len(same("first_seen", 3, lineitem=(rows, kinds))) == 3


def test_structure_gaps_at_the_share_exactly(same):
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    sizes = {1: [63, 30, 29, 29, 29], 2: [64, 30, 29, 29, 28], 3: [4]}  # 63 words of 180 are 0.35, not more
    rows = [{"conv_id": c, "turn": t, "role": "user", "text": " ".join(["w"] * n)} for c, own in sizes.items() for t, n in enumerate(own)]
    told = same("structure_gaps", conversations=(rows, kinds))
    assert [r for r in told if "'HUGE_CLAUSE'" in r] == [("2", "0", "'HUGE_CLAUSE'")] and not any("'MISSING_NUMBERS'" in r for r in told)


def test_self_check_without_all_pairs(spark):
    from pyspark.sql import functions as F

    from papyra.operators import dense

    rows = [(i, [float((i * k) % 7 - 3), float(i % 5) + 0.5, 1.0, float(k)]) for i in range(60) for k in (1,)] + [(100, [2.0, 1.0]), (99, [4.0, 2.0]), (98, [4.0, 2.003]), (97, [4.0, 2.009]), (200, [0.0, 0.0]), (201, [1.0, None]), (3, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>").where("v is not null or id <> 3").repartition(3)
    want = {(r.query_id, r.id) for r in dense.nearest(df, df, 1).collect()}
    got = dense.self_check(df)
    assert {(r.id, r.found) for r in got.collect()} == want and all(r.ok == (r.id == r.found) for r in got.collect())
    assert got.where(F.col("id") == 100).first().found == 98
    proper = dense.self_check(df.where("id < 200"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in proper and "cell" in proper  # no row goes to every block


def test_review_stats_in_tasks_of_bounded_size(spark, monkeypatch):
    from papyra.plans import service

    monkeypatch.setattr(service, "TASK_ROWS", 100)
    assert QUERIES["review_stats"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 50  # of some 6,000 lines
