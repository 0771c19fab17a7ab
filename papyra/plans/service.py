"""Service queries: orders stand for reviews, customers for their owners, events for status messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.operators import service
from papyra.plans.catalog import query
from papyra.sources.tables import place, table

#: Lines of orders that a task joins and counts, about.
TASK_ROWS = 1_000_000


@query(
    """WITH n AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey, o_orderdate, coalesce(lines, 0) AS n_lines, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'running' ELSE CASE WHEN lines IS NOT NULL THEN 'done' ELSE 'failed' END END AS status,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INTEGER AS place FROM orders LEFT JOIN n ON l_orderkey = o_orderkey"""
)
def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, newest first, with their status and number of lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    told = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus").join(lines, "o_orderkey", "left")
    running = F.when(F.col("o_orderstatus").isin("O", "P"), "running")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return told.select("o_custkey", "o_orderkey", "o_orderdate", F.coalesce("lines", F.lit(0)).alias("n_lines"), service.status(running, F.col("lines")).alias("status"), place.alias("place"))


@query(
    """SELECT o_orderkey, count(l_orderkey) AS n_lines, count(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'R') AS n_parts, count(*) FILTER (WHERE l_returnflag = 'R') AS n_rejected FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, distinct parts that weren't returned, and returned lines, by order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag")
    rejected = F.col("l_returnflag") == "R"
    # so many tasks that each has a bounded number of rows; joining and counting keep that partitioning
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS))
    both = table(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey").join(lines.repartition(parts, "o_orderkey"), "o_orderkey", "left")
    return both.groupBy("o_orderkey").agg(F.count("l_partkey").alias("n_lines"), F.countDistinct(F.when(~rejected, F.col("l_partkey"))).alias("n_parts"), F.count_if(rejected).alias("n_rejected"))


@query("SELECT l_partkey, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each part; of lines with one number of one order, the first in the table."""
    return service.first_seen(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_orderkey", "l_suppkey", at=place())


@query("SELECT o_custkey, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a customer in credit."""
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return service.orphans(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", owners, "c_custkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that go when customers in debt are deleted."""
    gone, _ = service.cascade(table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return gone


@query(
    """WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages),
e AS (SELECT parts[1] AS host, unnest(parts) AS part, unnest(range(0, len(parts))) AS pos FROM p),
n AS (SELECT parts[1] AS host, count(*) AS n FROM p GROUP BY host),
same AS (SELECT host, pos, min(part) AS part FROM e JOIN n USING (host) GROUP BY host, pos, n HAVING count(*) = n AND min(part) = max(part)),
run AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos) AS r FROM same)
SELECT n.host, coalesce(string_agg(part, '/' ORDER BY pos), '') AS prefix FROM n LEFT JOIN run ON run.host = n.host AND r = pos + 1 GROUP BY n.host"""
)
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all addresses of a host begin with."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")
    pages = table(spark, sf_dir, "pages").select(parts.alias("parts")).withColumn("host", F.element_at("parts", 1))
    return service.common_prefix(pages, "host", "parts")


SECONDS = "epoch_us(ts) / 1000000.0::DOUBLE"


@query(
    "SELECT user_id, count(*) AS n_events, "
    + ", ".join(f"round(min(CASE WHEN event_type = '{k}' THEN {SECONDS} END) - min({SECONDS}), 3) AS first_{k}, round(max(CASE WHEN event_type = '{k}' THEN {SECONDS} END) - min({SECONDS}), 3) AS last_{k}" for k in ("view", "click", "purchase"))
    + " FROM events GROUP BY user_id"
)
def stage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's first and last view, click and purchase came, from their first event."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return service.stage_spans(events, "user_id", "at", "event_type", ["view", "click", "purchase"])


@query("SELECT user_id, event_id, max((props::JSON ->> '$.k')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def progress_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's progress (the number in props) as the largest so far."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return service.monotone(events, "user_id", ["ts", "event_id"], "k").select("user_id", "event_id", "progress")


@query(
    """WITH f AS (SELECT user_id, event_type = 'error' AS failed, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
r AS (SELECT user_id, run, count(*) FILTER (WHERE failed) AS n FROM f GROUP BY user_id, run)
SELECT user_id, max(n) AS longest, sum(n // 2)::BIGINT AS locks FROM r GROUP BY user_id"""
)
def lockout_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of errors of each user, and how often two in a row locked them out."""
    return service.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", limit=2)


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS latest, max((props::JSON ->> '$.k')::INTEGER) AS done, count(*) AS n FROM e GROUP BY user_id"""
)
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event and progress: the batch form of the status stream."""
    from papyra.streaming.status import keyed_state

    return keyed_state(table(spark, sf_dir, "events"))
