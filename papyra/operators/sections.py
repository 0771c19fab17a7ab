"""Sections of a chunk table: outlines, whole texts, catalogues, and what a reader browses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.operators.agent import body
from papyra.operators.service import common_prefix


def sections(chunks: DataFrame, *values: str) -> DataFrame:
    """``key, chunk_ids, ...``: a section's chunks in order, and its first chunk's values."""
    return chunks.groupBy(F.col("section_key").alias("key")).agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), *[F.min_by(v, "chunk_id").alias(v) for v in values])


def full_texts(chunks: DataFrame) -> DataFrame:
    """``key, full_text``: the texts of a section's chunks without breadcrumbs, in order."""
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", body(F.col("text")).alias("t"))))
    return chunks.groupBy(F.col("section_key").alias("key")).agg(F.array_join(F.transform(listed, lambda s: s["t"]), "\n\n").alias("full_text"))


def article_of(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """``chunk_id, full_text``: the whole article that each chunk asked for belongs to."""
    wanted = asked.select("chunk_id").distinct().join(chunks.select("chunk_id", "section_key"), "chunk_id")
    own = chunks.join(wanted.select("section_key").distinct(), "section_key", "left_semi")
    return wanted.join(full_texts(own).withColumnRenamed("key", "section_key"), "section_key").select("chunk_id", "full_text")


def catalogue(chunks: DataFrame, allowed: Column) -> DataFrame:
    """``key, title`` of the titled sections that are allowed."""
    return sections(chunks.where(allowed), "section_title").where(F.coalesce("section_title", F.lit("")) != "").select("key", F.col("section_title").alias("title"))


def annex_items(chunks: DataFrame, pinned: str) -> DataFrame:
    """``item, chunk_id, title``: the first chunk of each numbered item of the pinned annex; 0 is its cover."""
    pattern = "› البند \\((\\d+)\\): ([^\\]]+)\\]"
    own = chunks.where(F.col("section_key") == pinned)
    number = F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1).try_cast("int")).otherwise(0)
    title = F.when(F.col("text").rlike(pattern), F.trim(F.regexp_extract("text", pattern, 2))).otherwise("صفحة الغلاف والمقدمة")
    told = own.select(number.alias("item"), "chunk_id", title.alias("title"))
    return told.groupBy("item").agg(F.min("chunk_id").alias("chunk_id"), F.min_by("title", "chunk_id").alias("title"))


def section_order(key: Column) -> list[Column]:
    """Sort columns: preambles, articles, annexes, each by number."""
    kind = F.regexp_extract(key, "-([a-z]+)", 1)
    rank = F.array_position(F.array(*[F.lit(k) for k in ("pre", "art", "anx")]), kind)
    return [F.when(rank == 0, 4).otherwise(rank), F.regexp_extract(key, "-[a-z]+(\\d+)", 1).try_cast("int"), key]


def browse(chunks: DataFrame) -> DataFrame:
    """``key, place, prefix, n_chunks``: sections in their order, with the breadcrumb that all their chunks share."""
    parts = chunks.select("section_key", F.split("breadcrumb", " › ").alias("parts"))
    shared = common_prefix(parts, "section_key", "parts").withColumnRenamed("section_key", "key")
    counted = chunks.groupBy(F.col("section_key").alias("key"), "doc_id").agg(F.count("*").alias("n_chunks"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*section_order(F.col("key"))))
    return counted.withColumn("place", place).join(shared, "key").select("doc_id", "key", "place", F.regexp_replace("prefix", "/", " › ").alias("prefix"), "n_chunks")


def unique_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that occur more than once: none may."""
    return chunks.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def record_problems(records: DataFrame, required: tuple[str, ...], most: int = 20) -> DataFrame:
    """At most ``most`` of ``id, problem``: required fields that are missing, and texts without their breadcrumb in front."""
    absent = [F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f"missing {f}")) for f in required]
    no_crumb = F.when(~F.coalesce(F.col("text").startswith("["), F.lit(False)), "no breadcrumb")
    found = F.filter(F.array(*absent, no_crumb), lambda p: p.isNotNull())
    return records.select("id", F.explode(found).alias("problem")).orderBy("id", "problem").limit(most)
