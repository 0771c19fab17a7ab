"""Name -> (query, SQL): what ``__spark_entry__`` offers.  Query modules register themselves here."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from papyra.operators.sizes import scope

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(made: Query) -> Query:
        @wraps(made)
        def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
            with scope() as belongs:
                return belongs(made(spark, sf_dir))

        QUERIES[made.__name__] = scoped
        if oracle is not None:
            ORACLES[made.__name__] = oracle
        return made

    return add


def load() -> None:
    """Import every module of queries."""
    from papyra.plans import agent, documents, evaluation, retrieval, service, structure, text  # noqa: F401
