"""The agent's parts on literal rows and on the benchmark passages, with deterministic providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import repair
from papyra.functions import text as T
from papyra.operators import agent, dense, layout, lexical, tables
from papyra.operators.sizes import held, small
from papyra.plans import sql as S
from papyra.plans.catalog import query
from papyra.plans.retrieval import PINNED, by_titles, by_words, corpus, item_vectors, items, vectors, with_source
from papyra.plans.text import literal, values
from papyra.sources.tables import table

KNOWN = ["IFR-art076", "IFR-anx11", "CMIR-art012", "IFR-art093"]
REFERRED = [
    (1, "وفقاً للمادة 76 من هذه اللائحة", "IFR-art076", None), (2, "انظر الملحق (11)", "IFR-anx11", None), (3, "المادة 12 من لائحة مؤسسات السوق المالية", "CMIR-art012", None),
    (4, "المادة 5 من نظام السوق المالية", None, "نظام خارج قاعدة المعرفة"), (5, "المادة 999", None, "غير موجودة في قاعدة المعرفة"),
]


@query(f"SELECT query_id::INTEGER AS query_id, key, why FROM {values(REFERRED, 'query_id, text, key, why')} ")
def reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered references in clauses, against what is expected."""
    clauses = literal(spark, [r[:2] for r in REFERRED], "query_id int, text string").drop("no")
    sections = spark.createDataFrame([(k,) for k in KNOWN], "key string")
    return agent.references(clauses, sections).select("query_id", "key", "why")


TITLES = [("[الشروط › 3 - الرسوم (الجزء 1 من 2)]\nنص", None, "الرسوم"), ("نص", "12) أهداف الصندوق", "أهداف الصندوق"), ("نص", None, ""), ("[مستند › أ]\nنص", "", "أ")]


@query(f"SELECT no, title AS clause_title FROM {values(TITLES, 'text, given, title')}")
def clause_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of clauses, against what is expected."""
    rows = literal(spark, [r[:2] for r in TITLES], "text string, given string")
    return rows.select("no", F.coalesce(agent.clause_title(F.col("text"), F.col("given")), F.lit("")).alias("clause_title"))


def _search(spark: SparkSession, sf_dir: str):
    def search(name: str, queries: DataFrame) -> DataFrame:
        if name == "lexical":
            found = dense.nearest(item_vectors(spark, sf_dir).join(queries.select(F.col("query_id").alias("id")), "id", "left_semi"), vectors(spark, sf_dir), fixed.SEARCH_DEPTH)
        elif name == "title":
            found = by_titles(spark, sf_dir, 5)
        else:
            found = lexical.best(corpus(spark, sf_dir), queries, fixed.SEARCH_DEPTH, query_id="query_id")
        return with_source(spark, sf_dir, held(found))

    return search


@query()
def agent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of the agent by rules alone: nothing is judged."""
    clauses = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text")
    sections = corpus(spark, sf_dir).select(F.col("source").alias("key")).distinct()
    return agent.Agent(_search(spark, sf_dir), sections, pinned=PINNED).run(clauses).select("query_id", "unit", "id", "place", "selected")


@query()
def agent_scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent with scripted answers: each clause's first words are its topic, the pool's first three units its choice."""
    clauses = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text")
    sections = corpus(spark, sf_dir).select(F.col("source").alias("key")).distinct()

    def understand(asked: DataFrame) -> DataFrame:
        first = F.array_join(F.slice(T.words(F.col("text")), 1, 12), " ")
        topic = F.array(F.struct(F.lit("topic").alias("topic"), first.alias("query")))
        return asked.select("query_id", F.to_json(F.struct(topic.alias("topics"), F.array(F.lit("src5"), F.lit("nowhere")).alias("articles"))).alias("answer"))

    def select(pool: DataFrame) -> DataFrame:
        chosen = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "unit"))))
        told = pool.groupBy("query_id").agg(chosen.alias("c"))
        picked = F.transform("c", lambda c: F.struct(c["unit"].alias("key"), F.lit("governing").alias("role"), F.lit(1).alias("topic"), F.lit("first").alias("reason")))
        return told.select("query_id", F.to_json(F.struct(picked.alias("selected"))).alias("answer"))

    made = agent.Agent(_search(spark, sf_dir), sections, understand, select, pinned=PINNED)
    return made.run(clauses).select("query_id", "unit", "id", "place", "selected", "role")


@query()
def excerpt_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage the paragraphs of its three best documents that are most like it, within the budget."""
    hits = by_words(spark, sf_dir, 3)
    texts = corpus(spark, sf_dir).select(F.col("doc_id").alias("unit"), "text").join(small(hits.select(F.col("id").alias("unit")).distinct()), "unit", "left_semi")
    asked = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = hits.select("query_id", F.col("id").alias("unit")).join(agent.paragraphs(texts), "unit").join(asked, "query_id")
    return agent.excerpts(pairs).select("query_id", "unit", F.length("excerpt").alias("n_chars"), F.md5(F.col("excerpt").cast("binary")).alias("digest"))


STRETCHED = [("المبالغ م سسسسستحقة الدفع", "المبالغ مستحقة الدفع"), ("نص بلا أثر", "نص بلا أثر"), ("ب شسسسسكل", "بشكل")]


@query(f"SELECT no, repaired FROM {values(STRETCHED, 'text, repaired')}")
def kashida_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn-out letters repaired by a vocabulary, against what is expected."""
    vocabulary = spark.createDataFrame([("مستحقة", 5), ("بشكل", 9)], "word string, n long")
    rows = literal(spark, [r[:1] for r in STRETCHED], "text string")
    return rows.select("no", repair.repair_stretched(F.col("text"), vocabulary).alias("repaired"))


GLYPHS = [("a", 1, t, float(x), 0.0, float(x + 8), 10.0, i) for i, (t, x) in enumerate([("ن", 100), ("د", 90), ("1", 30), ("2", 40), ("ب", 60), ("ل", 70), ("ا", 80)])]
GLYPHS += [("a", 1, t, float(x), 20.0, float(x + 8), 30.0, 20 + i) for i, (t, x) in enumerate([("H", 10), ("i", 18), ("!", 40)])]


@query("SELECT * FROM (VALUES ('a', 1, 1, 'ندالب 12'), ('a', 1, 2, 'Hi !')) AS v(doc_id, page, line_no, text)")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs as lines in reading order, against what is expected."""
    glyphs = spark.createDataFrame(GLYPHS, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, seq int")
    return layout.lines_of(glyphs).select("doc_id", "page", "line_no", "text")


RUNS = "SELECT user_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS v, count(*) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events"


@query(f"WITH r AS ({RUNS}), n AS (SELECT user_id, run, sum(v) AS n FROM r GROUP BY user_id, run) SELECT user_id, max(n)::BIGINT AS longest FROM n GROUP BY user_id")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of views of each user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("v"))
    return layout.longest_run(events, "user_id", "event_id", "v")


@query(
    """WITH g AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS d FROM events),
i AS (SELECT user_id, value, sum(CASE WHEN d IS NULL OR d > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM i GROUP BY user_id, island"""
)
def value_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values grouped where gaps are at most five."""
    told = layout.gaps_and_islands(table(spark, sf_dir, "events").select("user_id", "value"), "user_id", "value", 5.0)
    return told.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


ROWS = [("a|b;|;c|d", "a | b\nc | d"), ("|;|", ""), ("a|;|b;c|", "a | \n | b\nc | "), ("a|b|c;d|e", "a | b | c\nd | e | "), ("a|b", ""), ("a||b;c|d|;|e|f", "a | b\nc | d\ne | f"), ("a|;b|", "")]


@query(f"SELECT no, compact FROM {values(ROWS, 'text, compact')}")
def compact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without empty rows and, if that makes most rows alike, without empty cells, against what is expected."""
    rows = literal(spark, [r[:1] for r in ROWS], "text string")
    grid = F.transform(F.split("text", ";"), lambda r: F.split(r, "\\|"))
    return rows.select("no", F.coalesce(tables.as_text(tables.compact_rows(grid)), F.lit("")).alias("compact"))


@query(f"SELECT item_id AS query_id, len({S.tokens('text')})::INTEGER AS n_tokens FROM benchmark")
def query_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each query."""
    return items(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))
