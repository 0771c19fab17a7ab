"""Retrieval and text-accuracy metrics as aggregations over ranked hits and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed

HIT_AT = (1, 3, 5, 10)


def collapse_sections(hits: DataFrame, k: int, *, section: str = "section") -> DataFrame:
    """``query_id, key, rank``: sections in the order of their best hits, at most k per query."""
    best = hits.groupBy("query_id", F.col(section).alias("key")).agg(F.min("rank").alias("best"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "key"))
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "key", "rank")


def matches(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, expected, rank``: ranks at which a label is met.

    A label without a hyphen stands for all keys with that prefix ("CMIR" meets "CMIR-art031").
    """
    labels = expected.select("query_id", F.col("key").cast("string").alias("expected"))
    keys = ranked.select("query_id", F.col("key").cast("string").alias("key"), "rank")
    same = (F.col("key") == F.col("expected")) | (~F.col("expected").contains("-") & (F.substring_index("key", "-", 1) == F.col("expected")))
    return labels.join(keys, "query_id").where(same).select("query_id", "expected", "rank")


def per_query(ranked: DataFrame, expected: DataFrame, *, depth: int = 10) -> DataFrame:
    """``query_id, n_expected, first_rank, found``: only labelled queries; found counts labels met within depth."""
    met = matches(ranked, expected).groupBy("query_id").agg(
        F.min("rank").alias("first_rank"), F.countDistinct(F.when(F.col("rank") <= depth, F.col("expected"))).alias("found")
    )
    wanted = expected.groupBy("query_id").agg(F.countDistinct("key").alias("n_expected"))
    return wanted.join(met, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def metric_columns(*, depth: int = 10, digits: int = 3) -> list[Column]:
    """Hit@k, MRR and Recall over rows of :func:`per_query`."""
    hit = [F.round(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), digits).alias(f"hit{k}") for k in HIT_AT]
    mrr = F.avg(F.when(F.col("first_rank") <= depth, F.lit(1.0) / F.col("first_rank")).otherwise(0.0))
    recall = F.avg(F.col("found").cast("double") / F.col("n_expected"))
    return [F.count("*").alias("n_queries"), *hit, F.round(mrr, digits).alias(f"mrr{depth}"), F.round(recall, digits).alias(f"recall{depth}")]


def metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of metrics over the labelled queries."""
    return per_query(ranked, expected).agg(*metric_columns())


def metrics_by(rows: DataFrame, mode: str, subset: str) -> DataFrame:
    """Metrics by mode, and by mode and subset (subset ``all`` for the former)."""
    grouped = rows.groupingSets([[mode], [mode, subset]], mode, subset).agg(*metric_columns())
    return grouped.withColumn(subset, F.coalesce(subset, F.lit("all")))


def coverage(pool: DataFrame, expected: DataFrame, *, depths: tuple[int, ...] = (5, fixed.POOL_SIZE)) -> DataFrame:
    """``query_id, n_expected, cov<k>``: the share of a query's labels within the first k of its pool."""
    met = matches(pool, expected)
    shares = [F.countDistinct(F.when(F.col("rank") <= k, F.col("expected"))).alias(f"met{k}") for k in depths]
    wanted = expected.groupBy("query_id").agg(F.countDistinct("key").alias("n_expected"))
    told = wanted.join(met.groupBy("query_id").agg(*shares), "query_id", "left")
    return told.select("query_id", "n_expected", *[F.round(F.coalesce(F.col(f"met{k}"), F.lit(0)).cast("double") / F.col("n_expected"), 6).alias(f"cov{k}") for k in depths])


def selection(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, n_selected, recall, precision``; precision is null if nothing was selected, unjudged hits don't count.

    ``hits(query_id, key, selected)`` with selected true, false or null.
    """
    labels = expected.select("query_id", "key").distinct().withColumn("wanted", F.lit(True))
    chosen = hits.where("selected").select("query_id", "key").distinct().withColumn("chosen", F.lit(True))
    both = labels.join(chosen, ["query_id", "key"], "full")
    told = both.groupBy("query_id").agg(F.count("wanted").alias("n_wanted"), F.count("chosen").alias("n_selected"), F.count_if(F.col("wanted") & F.col("chosen")).alias("n_both"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)), 6)
    return told.where("n_wanted > 0").select("query_id", "n_selected", share("n_both", "n_wanted").alias("recall"), share("n_both", "n_selected").alias("precision"))


def delta(rows: DataFrame, *, run: str, full: str, values: tuple[str, ...], digits: int = 3) -> DataFrame:
    """rows with ``delta_<value>``: the difference from the row whose run is ``full``; null without such a row."""
    base = rows.where(F.col(run) == full).select(*[F.col(v).alias(f"__{v}") for v in values])
    base_row = base.first()  # one row of numbers
    told = [F.round(F.col(v) - F.lit(base_row[f"__{v}"] if base_row else None).cast("double"), digits).alias(f"delta_{v}") for v in values]
    return rows.select("*", *told)


def gate(rows: DataFrame, value: str, least: float) -> DataFrame:
    """``value, least, passed`` in one row: the least of a metric's rows against what it must reach; no rows don't pass."""
    return rows.agg(F.min(value).cast("double").alias("value")).select("value", F.lit(float(least)).alias("least"), F.coalesce(F.col("value") >= least, F.lit(False)).alias("passed"))


def proper_runs(runs: DataFrame, name: str = "name", setup: str = "setup") -> DataFrame:
    """Timing records without descriptions of the environment, and without checks."""
    stem, told = F.col(name), F.coalesce(setup, F.lit(""))
    return runs.where(stem.startswith("timing_") & ~stem.startswith("timing_environment") & ~stem.contains("_check") & ~told.endswith("zero-cost check"))


def summary(rows: DataFrame, values: dict[str, str], *, digits: int = 3) -> DataFrame:
    """``stage, n, mean, median, min, max, share``: each value's statistics, and its mean's share of all means."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(name).alias("stage"), F.col(column).cast("double").alias("x")) for name, column in values.items()])).alias("s")).select("s.*")
    told = stacked.groupBy("stage").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.median("x").alias("median"), F.min("x").alias("min"), F.max("x").alias("max"))
    share = F.try_divide(F.col("m"), F.sum("m").over(Window.partitionBy(F.lit(1))))  # a row per stage
    return told.select("stage", "n", *[F.round(c, digits).alias(n) for c, n in ((F.col("m"), "mean"), (F.col("median"), "median"), (F.col("min"), "min"), (F.col("max"), "max"), (share, "share"))])


def with_mean(rows: DataFrame, name: str, *values: str, label: str = "mean", digits: int = 4) -> DataFrame:
    """rows ``name, values`` and one more, called ``label``, with the means of what isn't null."""
    told = rows.select(F.col(name).cast("string").alias(name), *[F.round(F.col(v).cast("double"), digits).alias(v) for v in values])
    return told.unionByName(rows.agg(*[F.round(F.avg(v), digits).alias(v) for v in values]).select(F.lit(label).alias(name), *values))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length (at least one)."""
    return F.levenshtein(reference, hypothesis).cast("double") / F.greatest(F.length(reference), F.lit(1))
