"""A corpus pipeline of five stages: quality, near duplicates, repeated passages, mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet in the cluster's
shared folder and read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import byte_bpe, mixing, near_copies, quality, substring_dedup
from papyra.llm.common import shared_dir, table, unused
from papyra.llm.queries import VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.5 or more)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.score(docs, model, column=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share four fifths of their five-word shingles, the document of least id."""
    return near_copies.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that an earlier document has; ``n_chars`` follows the text."""
    removed = unused(docs, "removed")
    cut = substring_dedup.dedup(docs, removed=removed).drop(removed)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson draws, so that sources weigh as the square roots of their sizes; in random order."""
    return mixing.mix(docs, copy=unused(docs, "copy"), shuffle_key=unused(docs, "shuffle_key")).select(docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each copy."""
    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids=False)


STAGES = [
    ("quality", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", to_tokens),
]

#: Tokenising, hashing with a seed and the classifier can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
