"""Plans that depend on sizes: broadcasts of what is seen to be small, spreading of few files, reuse within a query."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table of few partitions is dealt over all cores; a larger one is many splits anyway.
SPREAD_BYTES = 16 << 30
#: Rows up to which a narrow table is broadcast.
SMALL_ROWS = 200_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Counts no further than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint while it has at most ``rows`` rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read as fewer partitions than there are cores, and isn't large; else as it is.

    A file written as one row group is one task; with many partitions there is nothing to gain, and the rows stay where
    they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


_scope: ContextVar[list[DataFrame] | None] = ContextVar("held tables of the query that is being made", default=None)


def _let_go(tables: list[DataFrame]) -> None:
    for df in tables:
        if df.sparkSession._jsc and not df.sparkSession._jsc.sc().isStopped():
            df.unpersist()


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are :func:`held` while a query is made are let go when its result (to be given to what this yields) is no longer used."""
    tables: list[DataFrame] = []
    token = _scope.set(tables)

    def belongs(result: DataFrame) -> DataFrame:
        if tables:
            weakref.finalize(result, _let_go, tables).atexit = False
        return result

    try:
        yield belongs
    finally:
        _scope.reset(token)


def held(df: DataFrame) -> DataFrame:
    """df kept for the several uses that one query makes of it (see :func:`scope`); outside of a query the caller lets it go.

    Only storage: what is lost with an executor is computed again.
    """
    kept = df.persist()
    if (tables := _scope.get()) is not None:
        tables.append(kept)
    return kept
