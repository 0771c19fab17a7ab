"""BM25 over a corpus DataFrame, for a whole batch of queries.

Statistics (number of texts, mean length, document frequencies) always come from the whole corpus; filters apply to
scored hits, so they never change a score.

:func:`best` reads each text once, in Python, and keeps its length and its counts of query terms, one row a text; a second
pass scores these rows where they are, and only the k best of a task leave it: no occurrence and no pair of query and text
becomes a row.  It holds a matrix of terms by queries (``DENSE`` numbers at most); beyond that :func:`bm25` makes the pairs
by joins: only the occurrences of query terms leave the scan, dealt by document once, so that counting terms and adding up a
document's score need no further exchange.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from papyra import fixed
from papyra.functions import text as T
from papyra.operators import blocks
from papyra.operators.sizes import held, is_small

#: Stands for a whole text among its terms; no token looks like it.
MARK = "\u0001"
#: Numbers of the matrix of terms by queries that every task holds at most (32 MB), and of a block of scores.
DENSE, BLOCK = 4_000_000, 1_000_000

_RUNS, _ARABIC = re.compile(r"\w{2,}"), re.compile("[\u0600-\u06ff]")
_MARKS, _FOLDED = re.compile(f"[{fixed.TASHKEEL}{fixed.TATWEEL}]"), str.maketrans(fixed.FOLDED_FROM, fixed.FOLDED_TO)
_PREFIX = re.compile("^(?:" + "|".join(fixed.TOKEN_PREFIXES) + ")(.{3,})$")


def plain_tokens(text: str) -> list[str]:
    """:func:`papyra.functions.text.tokens` of one text; in Python, word characters are exactly letters, numbers and "_"."""
    if not _ARABIC.search(text):  # all marks and variants are in that range
        return _RUNS.findall(text)
    found = _RUNS.findall(_MARKS.sub("", text).translate(_FOLDED))
    return [_PREFIX.sub(r"\1", w) for w in found] if "ل" in text else found


def tokenised(corpus: DataFrame, id_column: str, text: Column, *, empty: str | None = None) -> DataFrame:
    """``id, terms``; a text without tokens has the single term ``empty``, if given."""
    terms = T.tokens(F.coalesce(text, F.lit("")))
    if empty is not None:
        terms = F.when(F.size(terms) == 0, F.array(F.lit(empty))).otherwise(terms)
    return corpus.select(F.col(id_column).alias("id"), terms.alias("terms"))


def statistics(tokenised_corpus: DataFrame) -> DataFrame:
    """One row: ``n_docs``, ``n_tokens``, ``mean_length``."""
    return tokenised_corpus.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long").alias("n_tokens"), F.avg(F.size("terms").cast("double")).alias("mean_length")
    )


def query_terms(queries: DataFrame, id_column: str, text: Column) -> DataFrame:
    """``query_id, term``: each query's distinct terms."""
    return queries.select(F.col(id_column).alias("query_id"), F.explode(F.array_distinct(T.tokens(F.coalesce(text, F.lit(""))))).alias("term"))


def bm25(
    corpus: DataFrame,
    queries: DataFrame,
    *,
    corpus_id: str = "doc_id",
    corpus_text: Column | None = None,
    query_id: str = "item_id",
    query_text: Column | None = None,
    empty: str | None = None,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
    digits: int = 6,
) -> DataFrame:
    """``query_id, id, score`` of every pair with a term in common; an empty corpus gives no rows."""
    docs = tokenised(corpus, corpus_id, F.col("text") if corpus_text is None else corpus_text, empty=empty)
    asked = query_terms(queries, query_id, F.col("text") if query_text is None else query_text)
    # few queries bound their vocabulary and the weighted terms as well
    hint = F.broadcast if is_small(asked) else lambda df: df
    # each text keeps the query terms that it has, and one mark, so that the whole corpus is counted in the same pass;
    # dealing by document comes first, and the later sums over (query, document) keep that partitioning
    mark = F.array(F.lit(MARK))
    found = held(
        docs.select("id", F.size("terms").cast("double").alias("length"), F.explode(F.concat(mark, "terms")).alias("term"))
        .join(hint(asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([(MARK,)], "term string"))), "term", "left_semi")
        .repartition("id")
        .groupBy("id", "term")
        .agg(F.count("*").cast("double").alias("f"), F.first("length").alias("length"))
    )
    counted = found.where(F.col("term") == MARK).agg(F.sum("f").alias("n"), (F.sum(F.col("f") * F.col("length")) / F.sum("f")).alias("mean")).first()
    n, mean = float(counted["n"] or 0.0), float(counted["mean"] or 1.0)
    frequency = found.where(F.col("term") != MARK).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.ln(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = hint(hint(asked).join(frequency, "term").select("query_id", "term", idf.alias("idf")))
    gain = F.col("idf") * F.col("f") * (k1 + 1.0) / (F.col("f") + k1 * (1.0 - b + b * F.col("length") / mean))
    return found.join(weighted, "term").groupBy("id", "query_id").agg(F.round(F.sum(gain), digits).alias("score")).select("query_id", "id", "score")


def best(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    corpus_id: str = "doc_id",
    corpus_text: Column | None = None,
    query_id: str = "item_id",
    query_text: Column | None = None,
    empty: str | None = None,
    where: Column | None = None,
    within: DataFrame | None = None,
    k1: float = fixed.BM25_K1,
    b: float = fixed.BM25_B,
    digits: tuple[int, ...] = (6,),
) -> DataFrame:
    """``query_id, id, score, rank``: what :func:`ranked` takes from :func:`bm25`, without making the other pairs.

    Hits are only texts for which ``where`` (over the corpus) holds and whose ids are in ``within(id)``; scores are rounded
    to each of ``digits`` in turn.  Texts that share an id count as one document, by joins.
    """
    text = F.col("text") if corpus_text is None else corpus_text
    asked = query_terms(queries, query_id, F.col("text") if query_text is None else query_text)
    rows = asked.collect() if is_small(asked) else None
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows or ()}))}
    ids = list(dict.fromkeys(r["query_id"] for r in rows or ()))
    told = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kinds = {"query_id": queries.schema[query_id].dataType.simpleString(), "id": corpus.schema[corpus_id].dataType.simpleString()}
    counted = f"id {kinds['id']}, length int, codes array<int>, counts array<int>, told boolean"
    read = to_arrow_schema(StructType.fromDDL(counted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                lengths, codes, counts = [], [], []
                for x in batch.column(1).to_pylist():
                    own = plain_tokens(x or "")
                    met = Counter([terms[t] for t in own if t in terms])
                    lengths.append(max(len(own), int(empty is not None)))
                    codes.append(list(met))
                    counts.append(list(met.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip((lengths, codes, counts), list(read)[1:4], strict=True)), batch.column(2)], schema=read)

    found = None
    if rows is not None and len(terms) * len(ids) <= DENSE:
        found = held(corpus.select(F.col(corpus_id).alias("id"), text.alias("t"), told.alias("told")).mapInArrow(count, counted))
    if found is None or not found.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        scored = bm25(corpus, queries, corpus_id=corpus_id, corpus_text=corpus_text, query_id=query_id, query_text=query_text, empty=empty, k1=k1, b=b, digits=digits[0])
        for n in digits[1:]:
            scored = scored.withColumn("score", F.round("score", n))
        for allowed in ([] if where is None else [corpus.where(told).select(F.col(corpus_id).alias("id"))]) + ([] if within is None else [within]):
            scored = scored.join(allowed, "id", "left_semi")
        return ranked(scored, k)
    stats = found.agg(F.count("*").alias("n"), F.avg(F.col("length").cast("double")).alias("mean")).first()
    n, mean = float(stats["n"]), stats["mean"] or 1.0
    df = np.zeros(len(terms))
    for r in found.select(F.explode("codes").alias("c")).groupBy("c").count().collect():
        df[r["c"]] = r["count"]
    idf, place = np.log(1.0 + (n - df + 0.5) / (df + 0.5)), {q: i for i, q in enumerate(ids)}
    weights = np.zeros((len(terms), len(ids)))
    for r in rows:
        weights[terms[r["term"]], place[r["query_id"]]] = idf[terms[r["term"]]]
    names = np.array(ids) if all(isinstance(q, int) for q in ids) else np.array(ids, object)
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    out = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, new, least = [], 0, np.full(len(ids), np.nextafter(0.0, 1.0))  # of each query the k-th best so far
        for whole in batches:
            step, first = max(1, BLOCK // max(1, len(ids))), 0
            at = np.concatenate([[0], np.cumsum(whole.column("codes").value_lengths().to_numpy(), dtype=np.int64)])
            codes, counts = (whole.column(c).flatten().to_numpy() for c in ("codes", "counts"))
            lengths, keys = whole.column("length").to_numpy(), whole.column("id")
            keys = keys.to_numpy() if pa.types.is_integer(keys.type) else np.array(keys.to_pylist(), object)
            gain = counts * (k1 + 1.0) / (counts + k1 * (1.0 - b + b * np.repeat(lengths, np.diff(at)) / mean))
            while first < len(lengths):  # as many rows as a block of terms by queries holds, one at least
                last = max(first + 1, int(np.searchsorted(at, at[first] + step, "right")) - 1)
                used = np.flatnonzero(np.diff(at[first : last + 1])) + first
                if len(used):
                    own = slice(at[first], at[last])
                    s = np.add.reduceat(gain[own, None] * weights[codes[own]], at[used] - at[first], axis=0)
                    for d in digits:
                        s = np.floor(s * 10.0**d + 0.5) / 10.0**d
                    i, q = np.nonzero(s >= least)
                    kept.append((q, keys[used[i]], s[i, q]))
                    new += len(i)
                if new > 50_000 + 20 * k * len(ids):
                    kept, new = [blocks.best(kept, k)], 0
                    q, _, s = kept[0]
                    full = np.flatnonzero(np.bincount(q, minlength=len(ids)) == k)
                    low = np.full(len(ids), np.inf)
                    np.minimum.at(low, q, s)
                    least[full] = low[full]
                first = last
        q, i, s = blocks.best(kept, k)
        if len(q):
            yield blocks.as_batch((names[q], i, s), out)

    rows_ = found if within is None else found.join(within.select("id"), "id", "left_semi")
    hits = rows_.where("told").select("id", "length", "codes", "counts").mapInArrow(score, schema)
    return ranked(hits, k)


def ranked(scored: DataFrame, k: int, *, where: Column | None = None) -> DataFrame:
    """``rank`` within each query by falling score, ties by id; only scores above zero, at most k."""
    hits = scored if where is None else scored.where(where)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.where("score > 0").withColumn("rank", order).where(F.col("rank") <= k)
