"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    if name.startswith("op") or name == "pipeline":
        pytest.skip("tested with its operator")
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    told = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {told} FROM ({ORACLES[name]})").fetchall()
    mine = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert mine == sorted(tuple(map(plain, r)) for r in want)


def test_every_query_without_sql_has_a_test_of_its_own():
    tested = {"agent_rules", "agent_scripted", "excerpt_select", "wer_adjacent_turns", "clause_chain", "section_split", "toc_validation_blocks", "running_clusters"}
    named = {n for n in __spark_entry__.queries() if n not in ORACLES and not n.startswith("op") and n != "pipeline"}
    assert named <= tested, named - tested


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "papyra", tmp_path / "papyra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
