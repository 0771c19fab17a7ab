"""One search with its defaults: filters, first stage by words, vectors or both, reranking, the pinned section.

Filters only choose among hits and rows; scores by words are always of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import fixed
from papyra.operators import dense, fusion, lexical
from papyra.operators.chunking import FUND_TYPE_SCOPES

#: (pairs ``query_id, query, id, text``) -> ``query_id, id, relevance``
Reranker = Callable[[DataFrame], DataFrame]
MODES = ("dense", "bm25", "hybrid")


@dataclass(frozen=True)
class Filters:
    """What a hit's chunk must be; what isn't given doesn't restrict."""

    doc_ids: tuple[str, ...] = ()
    section_types: tuple[str, ...] = ()
    binding_status: str | None = None
    fund_type: str | None = None

    def allows(self) -> Column:
        """Over the columns ``doc_id, section_type, binding_status, fund_scope``; a null never passes a filter that is given."""
        parts = [F.lit(True)]
        if self.doc_ids:
            parts.append(F.col("doc_id").isin(*self.doc_ids))
        if self.section_types:
            parts.append(F.col("section_type").isin(*self.section_types))
        if self.binding_status:
            parts.append(F.col("binding_status") == self.binding_status)
        if self.fund_type:
            parts.append(F.col("fund_scope").isin(*FUND_TYPE_SCOPES[self.fund_type]))
        out = parts[0]
        for part in parts[1:]:
            out = out & part
        return F.coalesce(out, F.lit(False))


def rounded(value: Column, digits: int) -> Column:
    """value to so many decimals as SQL rounds doubles: the product with the power of ten, to the nearest whole number, halves away from zero.

    Spark's own round takes the shortest decimal instead, so that 0.26685 is halfway and goes up; as a double it is less.
    """
    power = F.lit(10.0**digits)
    return F.round(value * power) / power


def search(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    k: int = 5,
    mode: str = "dense",
    filters: Filters | None = None,
    rerank: Reranker | None = None,
    pinned: str | None = None,
    candidates: int = fixed.RRF_CANDIDATES,
    digits: int = 4,
) -> DataFrame:
    """``query_id, rank, id, score, first_stage_score, section_key, pinned``: the best k chunks of each query.

    ``corpus(id, text, v, section_key`` and the columns of :class:`Filters` ``)``, ``queries(query_id, text, v)``.  Without
    filters only what governs private funds is searched.  A first stage that is reranked, or in which a section may be
    pinned, is at least RERANK_CANDIDATES long.  The pinned section's best hit goes to place 2 unless the section is among
    the first two sections already.  An unknown mode or fund type is an error; scores are rounded to ``digits``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    filters = Filters(fund_type="private") if filters is None else filters
    allowed = corpus.withColumn("__allowed", filters.allows())
    depth = max(k, fixed.RERANK_CANDIDATES) if rerank or pinned else k
    first = candidates if mode == "hybrid" else depth

    def by_vector() -> DataFrame:
        rows = allowed.where("__allowed").select("id", "v")
        return dense.nearest(queries.select(F.col("query_id").alias("id"), "v"), rows, first)

    def by_words() -> DataFrame:
        return lexical.best(corpus, queries, first, corpus_id="id", query_id="query_id", where=filters.allows())

    if mode == "hybrid":
        hits = fusion.reciprocal_ranks(by_vector(), by_words(), k=depth)
    else:
        hits = by_vector() if mode == "dense" else by_words()
    told = hits.select("query_id", "id", F.col("rank").cast("int").alias("rank"), rounded(F.col("score"), digits).alias("score")).join(corpus.select("id", "section_key", "text"), "id")
    told = told.withColumn("first_stage_score", F.lit(None).cast("double"))
    if rerank is not None:
        pairs = told.select("query_id", "id", "text").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        judged = told.drop("first_stage_score").join(rerank(pairs).select("query_id", "id", "relevance"), ["query_id", "id"], "left")
        told = fusion.rerank(judged, F.col("relevance"), keep=depth, digits=digits)
    told = fusion.pin_second(told, pinned, section="section_key") if pinned else told.withColumn("pinned", F.lit(False))
    return told.where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "first_stage_score", "section_key", "pinned")


def length_batches(texts: DataFrame, *, text: str = "text", size: int = 32) -> DataFrame:
    """texts with ``batch``: at most ``size`` rows of like length each, for a model that pads; longest first.

    Rows are sorted where they are; nothing is shuffled, and the rows' own keys take the place of an inverse permutation.
    """
    placed = texts.sortWithinPartitions(F.length(text).desc_nulls_last()).withColumn("__at", F.monotonically_increasing_id())
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("batch", F.concat_ws("-", part.cast("string"), F.floor(row / size).cast("string"))).drop("__at")


def reachable(expected: DataFrame, sections: DataFrame, filters: Filters) -> DataFrame:
    """``query_id, key`` of the labels that a search with these filters can return.

    ``expected(query_id, key)``, ``sections(section_key`` and the columns of :class:`Filters` ``)``; a label without a
    hyphen is a document's code and stands for any of its sections.
    """
    keys = sections.where(filters.allows()).select("section_key").distinct()
    codes = keys.select(F.substring_index("section_key", "-", 1).alias("key")).distinct()
    known = keys.select(F.col("section_key").alias("key")).where(F.col("key").contains("-")).unionByName(codes.where(~F.col("key").contains("-")))
    return expected.join(known.distinct(), "key", "left_semi").select("query_id", "key")
