"""Rank fusion, pinning, pools and the final list, on DataFrames of ranked hits for whole batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed


def _by_query(*order: Column | str) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def reciprocal_ranks(*lists: DataFrame, k: int, rrf_k: int = fixed.RRF_K, digits: int = 9) -> DataFrame:
    """``query_id, id, score, rank`` from hit lists ``(query_id, id, rank)``: sums of 1 / (rrf_k + rank).

    Ties go to the list given first, then to its rank.
    """
    hits = None
    for no, one in enumerate(lists):
        part = one.select("query_id", "id", F.col("rank").cast("int").alias("place"), F.lit(no).alias("no"))
        hits = part if hits is None else hits.unionByName(part)
    fused = hits.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("place"))), digits).alias("score"), F.min(F.struct("no", "place")).alias("first")
    )
    order = F.row_number().over(_by_query(F.desc("score"), "first", "id"))
    return fused.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def units(hits: DataFrame) -> DataFrame:
    """A hit list ``(query_id, unit, rank)`` collapsed to each unit's first place and ranked again."""
    first = hits.groupBy("query_id", "unit").agg(F.min("rank").alias("first"))
    return first.select("query_id", "unit", F.row_number().over(_by_query("first", "unit")).alias("rank"))


def weighted_units(lists: dict[str, DataFrame], *, weights: dict[str, float] | None = None, title_limit: int = 3, pinned: str | None = None, rrf_k: int = fixed.RRF_K) -> DataFrame:
    """``query_id, unit, score, rank``: weighted reciprocal ranks of the lists' units.

    Of the list called ``title`` only the first ``title_limit`` places count, and never the pinned unit.  Ties keep
    the order in which a unit was first met, list by list.
    """
    weights = weights or fixed.FUSION_WEIGHTS
    parts = None
    for no, (name, hits) in enumerate(lists.items()):
        own = units(hits)
        if name == "title":
            own = own.where(F.col("rank") <= title_limit)
            if pinned is not None:
                own = own.where(F.col("unit") != pinned)
        weight = weights.get(name, weights["topic"])
        part = own.select("query_id", "unit", (F.lit(weight) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("gain"), F.struct(F.lit(no).alias("no"), F.col("rank").alias("at")).alias("met"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "unit").agg(F.round(F.sum("gain"), 9).alias("score"), F.min("met").alias("met"))
    order = F.row_number().over(_by_query(F.desc("score"), "met", "unit"))
    return fused.withColumn("rank", order).select("query_id", "unit", "score", "rank")


def sources(lists: dict[str, DataFrame], *, title_limit: int = 3) -> DataFrame:
    """``query_id, unit, found_in``: the names of the lists that hold a unit, in the lists' order."""
    parts = None
    for no, (name, hits) in enumerate(lists.items()):
        own = units(hits)
        own = own.where(F.col("rank") <= title_limit) if name == "title" else own
        part = own.select("query_id", "unit", F.struct(F.lit(no).alias("no"), F.lit(name).alias("name")).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", "unit").agg(F.transform(F.array_sort(F.collect_set("s")), lambda s: s["name"]).alias("found_in"))


def pool(priority: DataFrame, fused: DataFrame, *, size: int = fixed.POOL_SIZE, quota: int = 2, is_pinned: Column | None = None) -> DataFrame:
    """``query_id, unit, place``: all priority units, then fused ones until ``size``, at most ``quota`` pinned in all.

    ``priority(query_id, unit, rank)`` and ``fused(query_id, unit, rank)``; ``is_pinned`` tests the column ``unit``.
    The quota counts the priority's pinned units, too, but never drops one of them.
    """
    pinned = F.lit(False) if is_pinned is None else is_pinned
    kept = units(priority).select("query_id", "unit", F.lit(0).alias("part"), "rank")
    rest = fused.join(kept.select("query_id", "unit"), ["query_id", "unit"], "left_anti").select("query_id", "unit", F.lit(1).alias("part"), F.col("rank").cast("int").alias("rank"))
    both = kept.unionByName(rest).withColumn("pinned", pinned)
    nth = F.row_number().over(Window.partitionBy("query_id", "pinned").orderBy("part", "rank", "unit"))
    open_ = both.withColumn("nth", nth).where((F.col("part") == 0) | ~F.col("pinned") | (F.col("nth") <= quota))
    place = F.row_number().over(_by_query("part", "rank", "unit"))
    return open_.withColumn("place", place).where((F.col("part") == 0) | (F.col("place") <= size)).select("query_id", "unit", "place")


def pin_second(hits: DataFrame, pinned: str, *, section: str = "section") -> DataFrame:
    """The best hit of the pinned section moved to place 2, unless the section is among the first two sections.

    ``hits(query_id, rank, <section>, ...)`` with ranks from 1; returns them with ranks anew and ``pinned``.
    """
    w = Window.partitionBy("query_id")
    first = F.min(F.when(F.col("rank") == 1, F.col(section))).over(w)
    second_at = F.min(F.when(F.col(section) != F.col("__first"), F.col("rank"))).over(w)
    second = F.min(F.when(F.col("rank") == F.col("__second_at"), F.col(section))).over(w)
    best = F.min(F.when(F.col(section) == pinned, F.col("rank"))).over(w)
    told = hits.withColumn("__first", first).withColumn("__second_at", second_at).withColumn("__second", second).withColumn("__best", best)
    due = F.col("__best").isNotNull() & (F.col("__first") != pinned) & (F.coalesce("__second", F.lit("")) != pinned)
    return _moved(told, due)


def pin_top_two(hits: DataFrame, pinned: str, *, section: str = "section") -> DataFrame:
    """As :func:`pin_second`, but the test looks at the first two hits, not at the first two sections."""
    w = Window.partitionBy("query_id")
    best = F.min(F.when(F.col(section) == pinned, F.col("rank"))).over(w)
    return _moved(hits.withColumn("__best", best), F.col("__best") > 2)


def _moved(told: DataFrame, due: Column) -> DataFrame:
    moved = F.coalesce(due, F.lit(False)) & (F.col("rank") == F.col("__best"))
    rank = F.when(moved, 2).when(F.coalesce(due, F.lit(False)) & (F.col("rank") >= 2) & (F.col("rank") < F.col("__best")), F.col("rank") + 1).otherwise(F.col("rank"))
    return told.withColumn("pinned", moved).withColumn("rank", rank.cast("int")).drop("__first", "__second_at", "__second", "__best")


def rules_ranking(cited: DataFrame, primary: DataFrame, pinned: str, *, section: str = "section") -> DataFrame:
    """Cited sections first, then the search without them, the pinned section in the top two.

    ``cited(query_id, id, <section>, rank)`` and ``primary(query_id, id, <section>, rank)``.
    """
    rest = primary.join(cited.select("query_id", section).distinct(), ["query_id", section], "left_anti")
    columns = ["query_id", "id", section, "rank"]
    both = cited.select(columns).withColumn("part", F.lit(0)).unionByName(rest.select(columns).withColumn("part", F.lit(1)))
    return pin_top_two(both.withColumn("rank", F.row_number().over(_by_query("part", "rank", "id"))).drop("part"), pinned, section=section)


def best_per_unit(lists: dict[str, DataFrame]) -> DataFrame:
    """``query_id, unit, id, found_by``: each unit's first hit of the first list that has it."""
    parts = None
    for no, (name, hits) in enumerate(lists.items()):
        part = hits.select("query_id", "unit", F.struct(F.lit(no).alias("no"), F.col("rank").cast("int").alias("rank"), F.col("id"), F.lit(name).alias("name")).alias("h"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy("query_id", "unit").agg(F.min("h").alias("h"))
    return best.select("query_id", "unit", F.col("h.id").alias("id"), F.col("h.name").alias("found_by"))


def final_hits(hits: DataFrame, judged: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Each unit once, in order, with ``selected``: true, false, or null if the query or unit wasn't judged.

    ``hits(query_id, unit, id, rank)``, ``judged(query_id, unit, selected)``, ``cited(query_id, unit)``.
    """
    once = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "unit").orderBy("rank", "id"))).where("nth = 1").drop("nth")
    place = F.row_number().over(_by_query("rank", "id")).alias("place")
    told = once.join(judged.select("query_id", "unit", "selected"), ["query_id", "unit"], "left")
    if cited is None:
        told = told.withColumn("cited", F.lit(False))
    else:
        marks = cited.select("query_id", "unit").distinct().withColumn("cited", F.lit(True))
        told = told.join(marks, ["query_id", "unit"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return told.select("query_id", "unit", "id", place, "selected", "cited")


def rerank(hits: DataFrame, score: Column, *, keep: int, digits: int = 4) -> DataFrame:
    """Hits sorted anew by another score; ties keep the first stage's order, whose score stays as ``first_stage_score``."""
    told = hits.withColumnRenamed("score", "first_stage_score").withColumnRenamed("rank", "first_stage_rank").withColumn("score", F.round(score, digits))
    order = F.row_number().over(_by_query(F.desc("score"), "first_stage_rank"))
    return told.withColumn("rank", order).where(F.col("rank") <= keep)
