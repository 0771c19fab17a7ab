"""Evaluation: which passages are found, and how well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed
from papyra.functions import text as T
from papyra.functions import unicode as U
from papyra.operators import containment, evaluate
from papyra.operators.sizes import held, small
from papyra.plans import sql as S
from papyra.plans.catalog import query
from papyra.plans.retrieval import BM25, TITLE_BM25, by_titles, by_words, corpus, items
from papyra.sources.tables import table


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, key``: the documents that hold a passage word for word; other passages are unlabelled."""
    return held(containment.passages(corpus(spark, sf_dir), items(spark, sf_dir)).select("query_id", F.col("id").alias("key")))


def hits(found: DataFrame) -> DataFrame:
    return small(found).select("query_id", F.col("id").alias("key"), "rank")


@query(f"WITH {S.EXPECTED} SELECT query_id, key AS doc_id FROM expected")
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which passage."""
    return expected(spark, sf_dir).select("query_id", F.col("key").alias("doc_id"))


@query(f"WITH {BM25}, {S.ranked('hits', 'scored', 10)}, {S.EXPECTED}, {S.per_query('told', 'hits')} SELECT {S.METRICS} FROM told")
def hit_mrr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit@k, MRR@10 and Recall@10 of the search by words."""
    return evaluate.metrics(hits(by_words(spark, sf_dir, 10)), expected(spark, sf_dir))


MODES = f"""{BM25}, {S.ranked('hits', 'scored', 10)}, {TITLE_BM25}, {S.ranked('title_hits', 'titled', 10)}, {S.EXPECTED}, {S.per_query('told', 'hits')}, {S.per_query('title_told', 'title_hits')},
both_modes AS (SELECT 'bm25' AS mode, * FROM told UNION ALL SELECT 'title', * FROM title_told)"""


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = expected(spark, sf_dir)
    rows = [evaluate.per_query(hits(found), labels).withColumn("mode", F.lit(name)) for name, found in (("bm25", by_words(spark, sf_dir, 10)), ("title", by_titles(spark, sf_dir, 10)))]
    return reduce(DataFrame.unionByName, rows)


@query(
    f"""WITH {MODES}, styled AS (SELECT m.*, CASE WHEN len({S.words('text')}) > 40 THEN 'clause' ELSE 'question' END AS style FROM both_modes m JOIN benchmark ON item_id = query_id)
SELECT mode, coalesce(style, 'all') AS style, {S.METRICS} FROM styled GROUP BY GROUPING SETS ((mode), (mode, style))"""
)
def metrics_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by mode, over all passages and by style (long: clause, short: question)."""
    style = F.when(T.word_count(F.col("text")) > 40, "clause").otherwise("question")
    styles = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), style.alias("style"))
    return evaluate.metrics_by(_modes(spark, sf_dir).join(styles, "query_id"), "mode", "style")


@query(
    f"""WITH {BM25}, {S.ranked('hits', 'scored', fixed.POOL_SIZE)}, {S.EXPECTED},
n AS (SELECT query_id, count(DISTINCT key) AS n_expected FROM expected GROUP BY query_id),
met AS (SELECT e.query_id, count(DISTINCT key) FILTER (WHERE rank <= 5) AS m5, count(DISTINCT key) AS m18 FROM expected e JOIN hits h ON h.query_id = e.query_id AND h.id = e.key GROUP BY e.query_id)
SELECT query_id, n_expected, round(coalesce(m5, 0)::DOUBLE / n_expected, 6) AS cov5, round(coalesce(m18, 0)::DOUBLE / n_expected, 6) AS cov18 FROM n LEFT JOIN met USING (query_id)"""
)
def coverage_pool_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each passage's documents among the first five and in the whole pool."""
    return evaluate.coverage(hits(by_words(spark, sf_dir, fixed.POOL_SIZE)), expected(spark, sf_dir))


@query(
    f"""WITH {BM25}, {S.ranked('hits', 'scored', fixed.POOL_SIZE)}, {S.EXPECTED},
chosen AS (SELECT query_id, id AS key FROM hits JOIN labels ON doc_id = id WHERE quality = 1 AND rank <= {fixed.MAX_SELECTED}),
w AS (SELECT query_id, count(*) AS n_wanted FROM expected GROUP BY query_id), c AS (SELECT query_id, count(*) AS n FROM chosen GROUP BY query_id),
b AS (SELECT query_id, count(*) AS n FROM expected JOIN chosen USING (query_id, key) GROUP BY query_id)
SELECT w.query_id, coalesce(c.n, 0) AS n_selected, round(coalesce(b.n, 0)::DOUBLE / n_wanted, 6) AS recall, round(CASE WHEN c.n > 0 THEN coalesce(b.n, 0)::DOUBLE / c.n END, 6) AS precision
FROM w LEFT JOIN c USING (query_id) LEFT JOIN b USING (query_id)"""
)
def selection_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of what is selected: the good ones among the first eight; unlabelled ones aren't judged."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("selected"))
    found = hits(by_words(spark, sf_dir, fixed.MAX_SELECTED)).join(labels, "key", "left")
    return evaluate.selection(found, expected(spark, sf_dir))


@query(
    """SELECT user_id, count(*) AS n, bool_and(event_type <> 'error') AS valid, count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'view') AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id"""
)
def run_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: valid without any error, calls are answers (clicks) less cache hits (views)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.bool_and(kind != "error").alias("valid"), (F.count_if(kind == "click") - F.count_if(kind == "view")).alias("calls"), F.count_if(kind == "error").alias("errors")
    )


@query(
    f"""WITH {MODES}, m AS (SELECT mode AS run, {S.METRICS} FROM both_modes GROUP BY mode), f AS (SELECT * FROM m WHERE run = 'bm25')
SELECT m.run, m.hit5, m.mrr10, round(m.hit5 - f.hit5, 3) AS delta_hit5, round(m.mrr10 - f.mrr10, 3) AS delta_mrr10 FROM m, f"""
)
def ablation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the full search and of titles alone, and what the latter loses."""
    rows = _modes(spark, sf_dir).groupBy(F.col("mode").alias("run")).agg(*evaluate.metric_columns()).select("run", "hit5", "mrr10")
    return evaluate.delta(rows, run="run", full="bm25", values=("hit5", "mrr10"))


@query(
    # levenshtein counts bytes there, so every letter beyond ASCII becomes a control character of its own first
    r"""WITH letters AS (SELECT list_sort(list(DISTINCT c)) AS abc FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE ord(c) > 127),
a AS (
  SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN ord(c) <= 127 THEN c WHEN list_position(abc, c) <= 9 THEN chr(list_position(abc, c)::INTEGER) ELSE chr(list_position(abc, c)::INTEGER + 4) END), '') AS text
  FROM conversations, letters
),
p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM a)
SELECT conv_id, turn, round(levenshtein(last, text)::DOUBLE / greatest(length(last), 1), 6) AS cer FROM p WHERE last IS NOT NULL"""
)
def cer_adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each turn against the turn before."""
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(evaluate.character_error_rate(F.col("last"), F.col("text")), 6).alias("cer"))


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("last", last).where("last is not null")


@query()
def wer_adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of each turn against the turn before."""
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(U.word_error_rate(F.col("last"), F.col("text")), 6).alias("wer"))


@query(
    """WITH s AS (SELECT event_type AS stage, value FROM events),
t AS (SELECT stage, count(value) AS n, avg(value) AS m, median(value) AS md, min(value) AS lo, max(value) AS hi FROM s GROUP BY stage)
SELECT stage, n, round(m, 3) AS mean, round(md, 3) AS median, round(lo, 3) AS min, round(hi, 3) AS max, round(m / sum(m) OVER (), 3) AS share FROM t"""
)
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by type as stage timings: statistics, and each mean's share of all."""
    kinds = ("click", "error", "purchase", "signup", "view")
    wide = table(spark, sf_dir, "events").select(*[F.when(F.col("event_type") == k, F.col("value")).alias(k) for k in kinds])
    return evaluate.summary(wide, {k: k for k in kinds})
