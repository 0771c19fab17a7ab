"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, cover_tree, cross_polytope, language, lm_scoring, mixing, quality, sharding, simhash, substring_dedup
from .common import documents, fold, shared_dir, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, for each document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document; the model has seen no held-out row."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every 50th vector with all others."""
    return cover_tree.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of each document between models of the benchmark passages and of all documents."""
    scored = lm_scoring.score(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that the mix draws, in its shuffled order, with the digest of the text that went along."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight arrivals, each appended as shards and compacted; read back by the last manifest."""
    store = sharding.ShardedTable(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    arrival = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(8)).cast("int")
    docs = table(spark, sf_dir, "documents")
    store.append_each(docs.withColumn("arrival", arrival), "arrival")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return store.read().select("doc_id", "lang", "source", "n_chars", digest.alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without its repeated lines and passages, and the spans removed as ``start-end`` in the original text."""
    found = substring_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + (r["end"] - r["start"]).cast("long"))
    return found.select("doc_id", "text", spans.alias("removed_spans"), gone.alias("removed_chars"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; the model has seen no held-out row."""
    docs = documents(spark, sf_dir)
    model = language.fit(docs)
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found for every 20th vector."""
    return cross_polytope.approximate(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    found = simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_cover_tree": op3_cover_tree,
    "op4_lm_score": op4_lm_score,
    "op5_mix": op5_mix,
    "op6_shards": op6_shards,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language": op8_language,
    "op9_cross_polytope": op9_cross_polytope,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op3_cover_tree": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM whole q JOIN whole r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
""",
    "op4_lm_score": r"""
WITH texts AS (
  SELECT 'b' AS side, doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 't', item_id, lower(text) FROM benchmark
),
lists AS (SELECT side, id, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS ws FROM texts WHERE t IS NOT NULL),
listed AS (SELECT side, id, unnest(ws) AS w, unnest(range(0, len(ws))) AS no FROM lists),
pairs AS (SELECT side, id, coalesce(lag(w) OVER (PARTITION BY side, id ORDER BY no), '') AS h, w FROM listed),
bi AS (SELECT h, w, count(*) FILTER (WHERE side = 't')::DOUBLE AS t, count(*) FILTER (WHERE side = 'b')::DOUBLE AS b FROM pairs GROUP BY h, w),
hist AS (SELECT h, sum(t) AS t, sum(b) AS b FROM bi GROUP BY h),
total AS (SELECT sum(t) AS t, sum(b) AS b FROM bi),
uni AS (
  SELECT w, (sum(bi.t) + 1000 * sum(bi.t + bi.b) / (total.t + total.b)) / (total.t + 1000) AS t,
    (sum(bi.b) + 1000 * sum(bi.t + bi.b) / (total.t + total.b)) / (total.b + 1000) AS b
  FROM bi, total GROUP BY w, total.t, total.b
),
loss AS (
  SELECT bi.h, bi.w, -ln((bi.t + 10 * uni.t) / (hist.t + 10)) AS t, -ln((bi.b + 10 * uni.b) / (hist.b + 10)) AS b
  FROM bi JOIN hist ON hist.h = bi.h JOIN uni ON uni.w = bi.w
),
scored AS (
  SELECT id, count(*) AS n, avg(t) AS t, avg(b) AS b FROM pairs JOIN loss ON loss.h = pairs.h AND loss.w = pairs.w WHERE side = 'b' GROUP BY id
)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(t - b, 6) AS score
FROM documents LEFT JOIN scored ON scored.id = doc_id
""",
    "op5_mix": """
WITH sized AS (SELECT source, count(*) AS n_docs, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
total AS (SELECT sum(weight) AS w, sum(n_docs)::DOUBLE AS n FROM sized),
rated AS (SELECT source, n / w * weight / n_docs AS rate FROM sized, total),
pmf AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p
  FROM rated, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
digests AS (SELECT doc_id, source, md5(coalesce(text, '')) AS d FROM documents),
drawn AS (
  SELECT doc_id, source, d, (('0x' || substr(md5('17|' || doc_id || '|' || d), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM digests
),
counted AS (
  SELECT doc_id, drawn.source, d, count(*) FILTER (WHERE c <= u) AS n
  FROM drawn JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source GROUP BY doc_id, drawn.source, d
),
copies AS (SELECT doc_id, source, d, unnest(range(1, n + 1))::INTEGER AS copy FROM counted)
SELECT doc_id, source, copy, md5('17-order|' || doc_id || '|' || d || '|' || copy) AS shuffle_key, d AS text_md5 FROM copies
""",
    "op6_shards": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op7_substring_dedup": r"""
WITH tiles AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?]+|[^.!?\n]+|\n') AS units FROM documents
),
listed AS (SELECT doc_id, unnest(units) AS unit, unnest(range(0, len(units))) AS no FROM tiles),
plain AS (SELECT *, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM listed),
counted AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words FROM plain),
marked AS (
  SELECT *, words > 0 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS rep,
    sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY no) AS stop,
    count(*) FILTER (WHERE unit = chr(10)) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line
  FROM counted
),
whole AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line_text, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line
  FROM documents
),
said AS (SELECT doc_id, line, trim(regexp_replace(lower(line_text), '\s+', ' ', 'g')) AS norm FROM whole),
later AS (SELECT doc_id, line, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) > 1 AS rep_line FROM said),
runs AS (
  SELECT *, count(*) FILTER (WHERE words > 0 AND NOT rep) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM marked
),
spread AS (
  SELECT *, min(no) FILTER (WHERE rep) OVER w AS first_rep, max(no) FILTER (WHERE rep) OVER w AS last_rep, sum(words) FILTER (WHERE rep) OVER w AS run_words
  FROM runs WINDOW w AS (PARTITION BY doc_id, run)
),
in_runs AS (SELECT *, coalesce(run_words >= 8 AND no BETWEEN first_rep AND last_rep AND (rep OR words = 0), false) AS cut_run FROM spread),
by_line AS (
  SELECT *, sum(words) OVER l AS line_words, bool_and(cut_run OR words = 0) OVER l AS all_cut
  FROM in_runs JOIN later USING (doc_id, line) WINDOW l AS (PARTITION BY doc_id, line)
),
cuts AS (SELECT *, cut_run OR (line_words > 0 AND (all_cut OR rep_line)) AS cut FROM by_line),
islands AS (SELECT *, count(*) FILTER (WHERE NOT cut) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM cuts),
spans AS (
  SELECT doc_id, island, min(stop - length(unit)) AS a, max(stop) AS b FROM islands WHERE cut GROUP BY doc_id, island
),
joined AS (
  SELECT doc_id, string_agg(a::BIGINT || '-' || b::BIGINT, ',' ORDER BY a) AS removed_spans, sum(b - a)::BIGINT AS removed_chars FROM spans GROUP BY doc_id
),
kept AS (SELECT doc_id, string_agg(unit, '' ORDER BY no) FILTER (WHERE NOT cut) AS text FROM cuts GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(removed_spans, '') AS removed_spans, coalesce(removed_chars, 0) AS removed_chars
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN joined USING (doc_id)
""",
}
