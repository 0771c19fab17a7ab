"""The operators' queries that have SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from papyra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    plain = lambda rows: sorted((tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else repr(v) for v in r) for r in rows))
    want = con.execute("SELECT {} FROM ({})".format(", ".join(f'"{c}"' for c in columns), queries.ORACLES[name])).fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)
