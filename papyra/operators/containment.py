"""Which texts hold a passage word for word, without comparing every pair.

Up to MOST passages go to the texts: each is looked up by its longest inner word among a text's words, and compared in full
where that is there; a text is read once and only what is found leaves the task.  More passages are looked up by one window
of their inner words; documents offer all their windows of that width, and only pairs that share a window are compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from papyra.functions import text as T
from papyra.operators.sizes import is_small, small

WIDTH = 6
#: Items of one or two words that are looked for in each text.
SHORT = 1000
#: Passages that are given to every task at most.
MOST = 20_000


def passages(docs: DataFrame, wanted: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``query_id, id``: every document that contains the whole text of an item.

    Items of fewer than WIDTH + 2 words are looked up by as many words as they have inside, those of one or two words in
    each text directly (at most SHORT of them; more are an error).  An item without words is in no document.
    """
    asked = wanted.select(F.col(item_id).alias("query_id"), F.col("text").alias("passage"), T.words(F.col("text")).alias("own")).withColumn("width", F.least(F.size("own") - 2, F.lit(WIDTH)))
    if is_small(wanted, MOST):
        return _by_words(docs, asked, doc_id)
    widths = sorted(r["width"] for r in asked.select("width").where("width > -2").distinct().collect())  # at most WIDTH + 2 numbers
    texts = docs.select(F.col(doc_id).alias("id"), "text", T.words(F.col("text")).alias("w"))
    found = []
    for n in (n for n in widths if n > 0):
        found.append(_by_windows(texts, asked.where(F.col("width") == n).drop("width"), n))
    if widths and widths[0] < 1:
        few = asked.where("width in (-1, 0)").select("query_id", "passage").limit(SHORT + 1).collect()
        if len(few) > SHORT:
            raise ValueError(f"more than {SHORT} items of one or two words")
        items = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.lit(r["passage"]).alias("passage")) for r in few])
        inside = texts.select("id", F.explode(F.filter(items, lambda x: F.col("text").contains(x["passage"]))).alias("x"))
        found.append(inside.select("x.query_id", "id"))
    return reduce(DataFrame.unionByName, found).distinct() if found else asked.select("query_id", F.lit(None).cast(docs.schema[doc_id].dataType).alias("id")).limit(0)


def _by_words(docs: DataFrame, asked: DataFrame, doc_id: str) -> DataFrame:
    """Few passages, found by a word that stands between white space in them and so in every text that holds them."""
    rows = asked.where("passage is not null and width > -2").select("query_id", "passage", "width").collect()
    short = [(r["query_id"], r["passage"]) for r in rows if r["width"] < 1]
    if len(short) > SHORT:
        raise ValueError(f"more than {SHORT} items of one or two words")
    by_word = defaultdict(list)
    for r in rows:
        if r["width"] > 0:
            inner = r["passage"].split()[1:-1]
            by_word[max(inner, key=len)].append((r["query_id"], r["passage"]))
    words = frozenset(by_word)
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {docs.schema[doc_id].dataType.simpleString()}"
    told = to_arrow_schema(StructType.fromDDL(schema))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                met, rows_ = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for w in words.intersection(text.split()):
                        own = [q for q, passage in by_word[w] if passage in text]
                        met += own
                        rows_ += [i] * len(own)
                    own = [q for q, passage in short if passage in text]
                    met += own
                    rows_ += [i] * len(own)
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array(met, told.field(0).type), batch.column(0).take(pa.array(rows_, pa.int32()))], schema=told)

    return docs.where("text is not null").select(F.col(doc_id).alias("id"), "text").mapInArrow(look, schema).distinct()


def _by_windows(texts: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Passages that are in a text, found by their second to (n + 1)-th word, whole words inside the passage."""
    window = lambda words, at: F.xxhash64(F.array_join(F.slice(words, at, n), " "))
    keyed = asked.select("query_id", "passage", window(F.col("own"), F.lit(2)).alias("key"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size("w"))
    keys = texts.select("id", "text", F.explode(F.array_distinct(F.transform(starts, lambda i: window(F.col("w"), i)))).alias("key"))
    met = keys.join(small(keyed.select("key").distinct()), "key", "left_semi").join(keyed, "key")
    return met.where(F.col("text").contains(F.col("passage"))).select("query_id", "id")
