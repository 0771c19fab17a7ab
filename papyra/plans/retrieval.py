"""Retrieval queries: benchmark passages are the queries, documents the corpus, a document's source its section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import text as T
from papyra.operators import dense, fusion, lexical
from papyra.operators.sizes import held, small
from papyra.plans import sql as S
from papyra.plans.catalog import query
from papyra.sources.tables import documents, table

#: The source that stands for the pinned section.
PINNED = "src3"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def by_words(spark: SparkSession, sf_dir: str, k: int, within: DataFrame | None = None) -> DataFrame:
    """The k best documents for each passage."""
    return held(lexical.best(corpus(spark, sf_dir), items(spark, sf_dir), k, within=within))


def by_titles(spark: SparkSession, sf_dir: str, k: int, digits: tuple[int, ...] = (6,)) -> DataFrame:
    """The k documents whose first lines are best for each passage."""
    return held(lexical.best(corpus(spark, sf_dir), items(spark, sf_dir), k, corpus_text=T.first_line(F.col("text")), empty="_", digits=digits))


def with_source(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Hits with the section and the ranking unit: the section, but each document of the pinned one by itself."""
    found = small(hits).join(corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("section")), "id")
    return found.withColumn("unit", F.when(F.col("section") == PINNED, F.concat_ws("-", "section", F.col("id").cast("string"))).otherwise(F.col("section")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's vector: the embedding that has its number."""
    return vectors(spark, sf_dir).join(small(items(spark, sf_dir).select(F.col("item_id").alias("id"))), "id")


BM25 = S.bm25("scored", S.DOCS, S.ITEMS)
TITLE_BM25 = S.bm25("titled", S.TITLES, S.ITEMS, empty="_")
KNN = """knn_pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id CROSS JOIN embeddings e
)"""
UNIT = f"CASE WHEN source = '{PINNED}' THEN source || '-' || id ELSE source END"


@query(f"WITH {BM25}, {S.ranked('hits', 'scored', 10)} SELECT query_id, id AS doc_id, score, rank::INTEGER AS rank FROM hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each passage."""
    return by_words(spark, sf_dir, 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(
    f"WITH docs AS (SELECT {S.tokens('text')} AS terms FROM documents) SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_tokens, round(avg(len(terms)::DOUBLE), 6) AS mean_length FROM docs"
)
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection statistics of the whole corpus."""
    stats = lexical.statistics(lexical.tokenised(corpus(spark, sf_dir), "doc_id", F.col("text")))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query(
    f"WITH {BM25}, good AS (SELECT s.* FROM scored s JOIN labels l ON l.doc_id = s.id WHERE l.quality = 1), {S.ranked('hits', 'good', 10)} "
    "SELECT query_id, id AS doc_id, score, rank::INTEGER AS rank FROM hits"
)
def bm25_label_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, only among good documents; the scores still come from the whole corpus."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return by_words(spark, sf_dir, 10, good).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(
    f"WITH {TITLE_BM25}, titled3 AS (SELECT query_id, id, round(score, 3) AS score FROM titled), {S.ranked('hits', 'titled3', 5)} "
    "SELECT query_id, id AS doc_id, score, rank::INTEGER AS rank FROM hits"
)
def title_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents whose first lines share most with each passage."""
    return by_titles(spark, sf_dir, 5, (6, 3)).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(
    f"WITH {KNN} SELECT * FROM (SELECT query_id, id AS vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM knn_pairs) WHERE rank <= 10"
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each item's vector, by cosine."""
    return dense.nearest(item_vectors(spark, sf_dir), vectors(spark, sf_dir), 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(
    f"WITH {KNN} SELECT * FROM (SELECT query_id, id AS vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM knn_pairs WHERE label IN (1, 3, 5)) WHERE rank <= 10"
)
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_topk, among three labels; the filter reaches the scan."""
    allowed = vectors(spark, sf_dir).where(F.col("label").isin(1, 3, 5))
    return dense.nearest(item_vectors(spark, sf_dir), allowed, 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(
    """WITH pairs AS (
  SELECT q.vec_id AS id, e.vec_id AS found, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS r
  FROM embeddings q CROSS JOIN embeddings e
) SELECT id, found, id = found AS ok FROM pairs WHERE r = 1"""
)
def knn_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each vector finds itself first."""
    return dense.self_check(vectors(spark, sf_dir))


HYBRID = f"""{BM25}, {S.ranked('lex', 'scored', fixed.RRF_CANDIDATES)}, {KNN},
near AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM knn_pairs) WHERE rank <= {fixed.RRF_CANDIDATES}),
both_lists AS (SELECT query_id, id, rank, 0 AS no FROM near UNION ALL SELECT query_id, id, rank, 1 FROM lex),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score, min(no * 1000 + rank) AS met FROM both_lists GROUP BY query_id, id)"""


@query(
    f"WITH {HYBRID} SELECT * FROM (SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, met, id))::INTEGER AS rank FROM fused) WHERE rank <= 10"
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty hits by vector and fifty by words, fused by reciprocal ranks; numbers stand for documents and vectors alike."""
    words = by_words(spark, sf_dir, fixed.RRF_CANDIDATES)
    near = dense.nearest(item_vectors(spark, sf_dir), vectors(spark, sf_dir), fixed.RRF_CANDIDATES)
    return fusion.reciprocal_ranks(near, words, k=10)


def unit_lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three searches of each passage, with units: its words, its nearest vectors, its titles."""
    lists = {
        "clause": with_source(spark, sf_dir, by_words(spark, sf_dir, fixed.SEARCH_DEPTH)),
        "lexical": with_source(spark, sf_dir, held(dense.nearest(item_vectors(spark, sf_dir), vectors(spark, sf_dir), fixed.SEARCH_DEPTH))),
        "title": with_source(spark, sf_dir, by_titles(spark, sf_dir, 5)),
    }
    return {name: held(hits) for name, hits in lists.items()}


UNIT_LISTS = f"""{BM25}, {S.ranked('clause_hits', 'scored', fixed.SEARCH_DEPTH)}, {KNN},
near AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM knn_pairs) WHERE rank <= {fixed.SEARCH_DEPTH}),
{TITLE_BM25}, {S.ranked('title_hits', 'titled', 5)},
listed AS (
  SELECT query_id, id, rank, 0 AS no FROM clause_hits UNION ALL SELECT query_id, id, rank, 1 FROM near UNION ALL SELECT query_id, id, rank, 2 FROM title_hits
),
united AS (SELECT no, query_id, id, rank, source AS section, {UNIT} AS unit FROM listed JOIN documents ON doc_id = id),
collapsed AS (SELECT no, query_id, unit, min(rank) AS first FROM united GROUP BY no, query_id, unit),
placed AS (SELECT no, query_id, unit, row_number() OVER (PARTITION BY no, query_id ORDER BY first, unit) AS rank FROM collapsed),
gains AS (
  SELECT query_id, unit, CASE no WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END / (60.0::DOUBLE + rank) AS gain, no * 1000 + rank AS met
  FROM placed WHERE no < 2 OR (rank <= 3 AND unit <> '{PINNED}')
),
fused AS (SELECT query_id, unit, round(sum(gain), 9) AS score, min(met) AS met FROM gains GROUP BY query_id, unit),
fused_ranked AS (SELECT query_id, unit, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, met, unit) AS rank FROM fused)"""


@query(f"WITH {UNIT_LISTS} SELECT query_id, unit, score, rank::INTEGER AS rank FROM fused_ranked")
def weighted_unit_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three searches fused by unit, with the lists' weights."""
    return fusion.weighted_units(unit_lists(spark, sf_dir), pinned=PINNED)


@query(
    f"""WITH {UNIT_LISTS},
prior AS (SELECT query_id, unit, rank FROM placed WHERE no = 2),
rest AS (SELECT f.query_id, f.unit, f.rank FROM fused_ranked f LEFT JOIN prior p USING (query_id, unit) WHERE p.unit IS NULL),
both_parts AS (SELECT query_id, unit, 0 AS part, rank FROM prior UNION ALL SELECT query_id, unit, 1, rank FROM rest),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id, starts_with(unit, '{PINNED}-') ORDER BY part, rank, unit) AS nth FROM both_parts),
open AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, unit) AS place FROM counted WHERE part = 0 OR NOT starts_with(unit, '{PINNED}-') OR nth <= 2)
SELECT query_id, unit, place::INTEGER AS place FROM open WHERE part = 0 OR place <= {fixed.POOL_SIZE}"""
)
def candidate_pool_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title units first, then the fused ranking to eighteen, with at most two pinned units."""
    lists = unit_lists(spark, sf_dir)
    fused = fusion.weighted_units(lists, pinned=PINNED)
    return fusion.pool(lists["title"], fused, is_pinned=F.col("unit").startswith(f"{PINNED}-"))


@query(
    f"""WITH {BM25}, {S.ranked('top', 'scored', fixed.RERANK_CANDIDATES)},
hits AS (SELECT query_id, id, rank, source AS section FROM top JOIN documents ON doc_id = id),
firsts AS (SELECT *, min(CASE WHEN rank = 1 THEN section END) OVER (PARTITION BY query_id) AS s1 FROM hits),
seconds AS (SELECT *, min(CASE WHEN section <> s1 THEN rank END) OVER (PARTITION BY query_id) AS at2 FROM firsts),
told AS (
  SELECT *, min(CASE WHEN rank = at2 THEN section END) OVER (PARTITION BY query_id) AS s2, min(CASE WHEN section = '{PINNED}' THEN rank END) OVER (PARTITION BY query_id) AS best FROM seconds
),
due AS (SELECT *, best IS NOT NULL AND s1 <> '{PINNED}' AND coalesce(s2, '') <> '{PINNED}' AS d FROM told)
SELECT query_id, id, section, (CASE WHEN d AND rank = best THEN 2 WHEN d AND rank >= 2 AND rank < best THEN rank + 1 ELSE rank END)::INTEGER AS rank, d AND rank = best AS pinned FROM due"""
)
def pin_to_rank2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pinned section's best hit at place two, unless it is there or above anyhow."""
    hits = with_source(spark, sf_dir, by_words(spark, sf_dir, fixed.RERANK_CANDIDATES)).select("query_id", "id", "section", "rank")
    return fusion.pin_second(hits, PINNED).select("query_id", "id", "section", "rank", F.coalesce("pinned", F.lit(False)).alias("pinned"))


@query(
    f"""WITH {BM25}, {S.ranked('top', 'scored', fixed.RERANK_CANDIDATES)}, {TITLE_BM25}, {S.ranked('title_top', 'titled', 2)},
cited AS (SELECT query_id, id, rank, source AS section FROM title_top JOIN documents ON doc_id = id),
prim AS (SELECT query_id, id, rank, source AS section FROM top JOIN documents ON doc_id = id),
both_parts AS (
  SELECT *, 0 AS part FROM cited UNION ALL SELECT p.*, 1 FROM prim p WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.query_id = p.query_id AND c.section = p.section)
),
placed AS (SELECT query_id, id, section, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, id) AS rank FROM both_parts),
told AS (SELECT *, min(CASE WHEN section = '{PINNED}' THEN rank END) OVER (PARTITION BY query_id) AS best FROM placed)
SELECT query_id, id, section, (CASE WHEN best > 2 AND rank = best THEN 2 WHEN best > 2 AND rank >= 2 AND rank < best THEN rank + 1 ELSE rank END)::INTEGER AS rank FROM told"""
)
def rules_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited documents (here: the two best titles) first, then the search without their sections."""
    columns = ["query_id", "id", "section", "rank"]
    primary = with_source(spark, sf_dir, by_words(spark, sf_dir, fixed.RERANK_CANDIDATES)).select(columns)
    cited = with_source(spark, sf_dir, by_titles(spark, sf_dir, 2)).select(columns)
    return fusion.rules_ranking(cited, primary, PINNED).select(columns)


@query(
    f"""WITH {UNIT_LISTS},
best AS (SELECT query_id, unit, id, no, row_number() OVER (PARTITION BY query_id, unit ORDER BY no, rank, id) AS r FROM united)
SELECT query_id, unit, id, CASE no WHEN 0 THEN 'clause' WHEN 1 THEN 'lexical' ELSE 'title' END AS found_by FROM best WHERE r = 1"""
)
def best_hit_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every unit the hit that stands for it."""
    return fusion.best_per_unit(unit_lists(spark, sf_dir))


@query(
    f"""WITH {UNIT_LISTS}
SELECT query_id, unit, list_aggregate(list_sort(list_distinct(list(CASE no WHEN 0 THEN '0clause' WHEN 1 THEN '1lexical' ELSE '2title' END))), 'string_agg', ',') AS found_in
FROM placed WHERE no < 2 OR rank <= 3 GROUP BY query_id, unit"""
)
def unit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which searches found a unit (numbered, as one text)."""
    found = fusion.sources(unit_lists(spark, sf_dir))
    number = F.create_map(*[F.lit(x) for x in ("clause", "0clause", "lexical", "1lexical", "title", "2title")])
    return found.select("query_id", "unit", F.array_join(F.transform("found_in", lambda n: number.getItem(n)), ",").alias("found_in"))


@query(
    f"""WITH {BM25}, {S.ranked('top', 'scored', fixed.SEARCH_DEPTH)},
hits AS (SELECT query_id, id, rank, {UNIT} AS unit FROM top JOIN documents ON doc_id = id),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, unit ORDER BY rank, id) AS nth FROM hits) WHERE nth = 1)
SELECT query_id, unit, id, (row_number() OVER (PARTITION BY query_id ORDER BY rank, id))::INTEGER AS place, quality = 1 AS selected
FROM once LEFT JOIN labels ON doc_id = id"""
)
def final_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit once, selected if its document is labelled good, not if bad, unknown if unlabelled."""
    hits = with_source(spark, sf_dir, by_words(spark, sf_dir, fixed.SEARCH_DEPTH))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("selected"))
    first = hits.groupBy("query_id", "unit").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
    judged = first.join(labels, "id").select("query_id", "unit", "selected")
    return fusion.final_hits(hits.select("query_id", "unit", "id", "rank"), judged).select("query_id", "unit", "id", "place", "selected")


@query(
    f"""WITH {BM25}, {S.ranked('top', 'scored', fixed.RERANK_CANDIDATES)},
words AS (SELECT query_id, id, top.score AS first_stage_score, rank, list_distinct({S.tokens('b.text')}) AS q, list_distinct({S.tokens('d.text')}) AS t
  FROM top JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = id),
again AS (SELECT *, round(len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1), 4) AS score FROM words)
SELECT * FROM (SELECT query_id, id, first_stage_score, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank))::INTEGER AS rank FROM again) WHERE rank <= 10"""
)
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty candidates sorted anew by the share of the passage's words that they hold."""
    hits = by_words(spark, sf_dir, fixed.RERANK_CANDIDATES)
    asked = items(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("q"))
    texts = corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").join(small(hits.select("id").distinct()), "id", "left_semi")
    both = hits.join(asked, "query_id").join(texts, "id")
    share = F.size(F.array_intersect("q", F.array_distinct(T.tokens(F.col("text"))))).cast("double") / F.greatest(F.size("q"), F.lit(1))
    return fusion.rerank(both, share, keep=10).select("query_id", "id", "first_stage_score", "score", "rank")
