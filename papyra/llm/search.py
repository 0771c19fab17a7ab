"""Searches of a query set against all rows of a table of vectors (see :mod:`papyra.operators.blocks`).

Which rows take part: those with an id, and a vector without null or non-finite components (:func:`vectors`); of
rows that share an id, the one with the least vector.  Vectors of different length are never compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators import blocks

from .common import checkpointed


def vectors(rows: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id long, v array<double>``: one row for each id that takes part.

    Ids are counted first; only if some repeat do vectors move, once, to be compared.
    """
    v = rows[embedding].cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(rows[vec_id].cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size("v") > 0))
    n, ids = kept.agg(F.count("vec_id"), F.count_distinct("vec_id")).first()
    return kept if n == ids else checkpointed(kept.groupBy("vec_id").agg(F.min("v").alias("v")))


def search(queries: DataFrame, rows: DataFrame, index: blocks.Index, k: int, *, score: str = "double", row_block: int = blocks.ROW_BLOCK, few: int = blocks.FEW) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows, ties to the smaller id; both sides ``(vec_id, v)``."""
    q, r = (d.withColumnRenamed("vec_id", "id") for d in (queries, rows))
    found = blocks.search(q, r, index, k, score=score, row_block=row_block, few=few)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
