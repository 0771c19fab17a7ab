"""Relational queries of the review service: lists, statistics, ownership, progress and lock-outs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(rows: DataFrame, key: str, order: Column, *values: str, at: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key with each value of the first row by ``order`` that has both; ties to the first by ``at``.

    ``at`` tells a row's place in its table (:func:`papyra.sources.tables.place`), as rows come to a task in any order.
    """

    def told(value: str) -> Column:
        return F.min_by(value, F.when(order.isNotNull() & F.col(value).isNotNull(), F.struct(order.alias("by"), *[c.alias(f"at{i}") for i, c in enumerate(at)])))

    return rows.groupBy(key).agg(*[told(v).alias(v) for v in values])


def owned(rows: DataFrame, owner: str, user: object) -> DataFrame:
    """The rows of one user; rows without an owner belong to nobody."""
    return rows.where(F.coalesce(F.col(owner) == F.lit(user), F.lit(False)))


def branches(events: DataFrame, key: str, total: Column, done: Column) -> DataFrame:
    """``<key>, total, done, complete``: how many of a key's parallel branches are through; complete once all are.

    ``total``: the number that is told (the largest counts), ``done``: whether an event ends a branch.  Counting has no
    order, so that no lock is needed; it runs on a stream as on a table.
    """
    told = events.groupBy(key).agg(F.max(total).alias("total"), F.count_if(F.coalesce(done, F.lit(False))).alias("done"))
    return told.withColumn("complete", F.coalesce(F.col("done") >= F.col("total"), F.lit(False)))


def status(running: Column, output: Column) -> Column:
    """The running state if there is one, else done if there is output, else failed."""
    return F.coalesce(running, F.when(output.isNotNull(), "done").otherwise("failed"))


def orphans(rows: DataFrame, owner: str, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose owner is unknown or null (an anti join, so a null among the owners hides nothing)."""
    return rows.join(owners.select(F.col(key).alias(owner)), owner, "left_anti")


def cascade(owners: DataFrame, key: str, children: DataFrame, child_owner: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """(children that go with the owners, children that stay)."""
    gone = owners.select(F.col(key).alias(child_owner)).distinct()
    return children.join(gone, child_owner, "left_semi").select(child_owner, child_key), children.join(gone, child_owner, "left_anti")


def common_prefix(parts: DataFrame, group: str, column: str) -> DataFrame:
    """``<group>, prefix``: the longest run of leading parts that all of a group's arrays share.

    Compared by position: a position counts while every array has it and all agree; counts are aggregated before
    they meet, so a large group is no single task.
    """
    n = parts.groupBy(group).agg(F.count("*").alias("n"))
    at = parts.select(group, F.posexplode(column).alias("at", "part")).groupBy(group, "at").agg(F.count("*").alias("have"), F.min("part").alias("low"), F.max("part").alias("high"))
    same = at.join(n, group).where((F.col("have") == F.col("n")) & (F.col("low") == F.col("high")))
    run = F.row_number().over(Window.partitionBy(group).orderBy("at"))
    kept = same.withColumn("r", run).where(F.col("r") == F.col("at") + 1)
    told = kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "low"))), lambda s: s["low"]), "/").alias("prefix"))
    return n.select(group).join(told, group, "left").select(group, F.coalesce("prefix", F.lit("")).alias("prefix"))


def monotone(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """events with ``progress``: the largest value so far, whatever order the events came in."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("progress", F.max(value).over(w))


def streaks(events: DataFrame, key: str, order: list[str], failed: Column, *, limit: int = 5) -> DataFrame:
    """``<key>, longest, locks``: the longest run of failures, and how often one reached ``limit``."""
    w = Window.partitionBy(key).orderBy(*order)
    flagged = events.withColumn("__failed", failed)
    runs = flagged.withColumn("run", F.sum((~F.col("__failed")).cast("int")).over(w))
    lengths = runs.groupBy(key, "run").agg(F.count_if("__failed").alias("n"))
    return lengths.groupBy(key).agg(F.max("n").alias("longest"), F.sum(F.floor(F.col("n") / limit)).cast("long").alias("locks"))


def stage_spans(events: DataFrame, key: str, at: str, name: str, stages: list[str]) -> DataFrame:
    """``<key>, first_<stage>, last_<stage>`` for each stage, in seconds since the key's first event; null if it never came."""
    start = F.min(at)
    told = []
    for stage in stages:
        told += [F.round(F.min(F.when(F.col(name) == stage, F.col(at))) - start, 3).alias(f"first_{stage}"), F.round(F.max(F.when(F.col(name) == stage, F.col(at))) - start, 3).alias(f"last_{stage}")]
    return events.groupBy(key).agg(F.count("*").alias("n_events"), *told)


def officer_message(reason: Column, default: str) -> Column:
    """The reason if it is written in Arabic, else the general message."""
    return F.when(reason.rlike("[\\u0600-\\u06FF]"), reason).otherwise(F.lit(default))
