"""Searches of a query set against all rows of vectors, block by block.

A task indexes each of its blocks of rows once and answers queries from it; nothing else of the rows is held, no pair of
vectors becomes a row, and only the best k of a block leave it.

* Few queries (``few`` numbers, counted before) go to the tasks, the rows stay where they are read, and a task keeps k rows
  for each query over all its blocks.
* Otherwise rows are dealt into blocks by a hash of the id, in one exchange, and every query goes to every block; a task
  reads a block, then the queries for it as a stream, sorted by Spark, so that it holds one block and one batch of queries
  whatever the tables' sizes.

By nature the work is queries times rows unless the index prunes.  Vectors of different length never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

ROW_BLOCK, QUERY_BATCH = 32_768, 2_048
#: Numbers in the query vectors that are given to every task at most (16 MB).
FEW = 2_000_000
#: Scores that a task works out at once (16 MB, and as much for each copy).
SCORES = 2_000_000
Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (query ids, query vectors) -> (query number, row number, score) of each query's best rows
Answer = Callable[[np.ndarray, np.ndarray], Found]
#: (row ids, ascending, and row vectors) -> what answers queries
Index = Callable[[np.ndarray, np.ndarray], Answer]


def matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: ids, ascending, and vectors of ``id, v``."""
    out = {}
    lengths = pc.list_value_length(table.column("v"))
    for n in pc.unique(lengths).to_pylist():
        own = table.filter(pc.equal(lengths, n)).sort_by("id").combine_chunks()
        flat = pc.list_flatten(own.column("v")).to_numpy()
        out[n] = own.column("id").to_numpy(zero_copy_only=False) if pa.types.is_integer(own.schema.field("id").type) else np.array(own.column("id").to_pylist(), object), np.ascontiguousarray(flat.reshape(-1, n), dtype=np.float64)
    return out


class _Block:
    """One block of rows, indexed."""

    def __init__(self, index: Index, table: pa.Table) -> None:
        self.own = {n: (ids, index(ids, x)) for n, (ids, x) in matrices(table).items()}

    def answers(self, queries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[Found]:
        """(query id, row id, score)."""
        for n, (qi, qv) in queries.items():
            if n in self.own:
                ids, answer = self.own[n]
                for k in range(0, len(qi), QUERY_BATCH):
                    a, b, s = answer(qi[k : k + QUERY_BATCH], qv[k : k + QUERY_BATCH])
                    yield qi[k + a], ids[b], s


def best(found: list[Found], k: int) -> Found:
    """Each query's k best of several answers, ties to the smaller row id."""
    found = [x for x in found if len(x[0])] or [_NONE]
    q, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
    by_query, by_row = (np.unique(x, return_inverse=True)[1] for x in (q, r))  # ids of any type
    order = np.lexsort((by_row, -s, by_query))
    q, r, s, by_query = q[order], r[order], s[order], by_query[order]
    keep = np.arange(len(q)) - np.searchsorted(by_query, by_query) < k
    return q[keep], r[keep], s[keep]


def as_batch(found: Found, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x if x.dtype != object else x.tolist()).cast(t) for x, t in zip(found, kinds, strict=True)], names=["query_id", "id", "score"])


def search(queries: DataFrame, rows: DataFrame, index: Index, k: int, *, score: str = "double", row_block: int = ROW_BLOCK, few: int = FEW) -> DataFrame:
    """``query_id, id, score, rank``: each query's k best rows, ties to the smaller id; both sides ``(id, v array<double>)`` without nulls.

    Ids are unique on each side, and long or any other type that can be ordered.
    """
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score {score}"
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]
    if (queries.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0) <= few:
        asked = matrices(queries.select("id", "v").toArrow())

        def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            found: list[Found] = []
            for batch in _and_none(batches):
                if held and (batch is None or sum(map(len, held)) + len(batch) > row_block):
                    found = [best([*found, *_Block(index, pa.Table.from_batches(held)).answers(asked)] or [_NONE], k)]
                    held = []
                if batch is not None and len(batch):
                    held.append(batch)
            if found:
                yield as_batch(found[0], kinds)

        met = rows.select("id", "v").mapInArrow(stay, schema)
    else:
        blocks = max(1, -(-rows.count() // row_block))
        at = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        dealt = rows.select(at.alias("block"), F.lit(0).alias("side"), "id", "v")
        sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "v")
        order = ["block", "side", "id"]

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, block = None, [], None
            for batch in batches:
                for number, side, part in _runs(batch):
                    if number != now:
                        now, held, block = number, [], None
                    if side == 0:
                        held.append(part)
                    elif held or block:
                        if block is None:
                            block, held = _Block(index, pa.Table.from_batches(held)), []
                        for found in block.answers(matrices(pa.Table.from_batches([part]))):
                            yield as_batch(best([found], k), kinds)

        met = dealt.unionByName(sent).repartition(blocks, "block").sortWithinPartitions(*order).mapInArrow(stream, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


_NONE: Found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, side, rows) of the stretches of a sorted batch."""
    block, side = (batch.column(c).to_numpy() for c in ("block", "side"))
    cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
        if b > a:
            yield int(block[a]), int(side[a]), batch.slice(a, b - a).select(["id", "v"])


def products(k: int, *, cosine: bool = False, digits: int | None = None) -> Index:
    """The index that compares all: matrix products, cut to each query's k best."""

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if cosine else x

    def index(ids: np.ndarray, rows: np.ndarray) -> Answer:
        turned = unit(rows).T

        def answer(qi: np.ndarray, qv: np.ndarray) -> Found:
            out = [_NONE]
            step = max(1, min(512, SCORES // max(1, len(ids))))
            for start in range(0, len(qi), step):
                score = unit(qv[start : start + step]) @ turned
                if digits is not None:
                    score = np.round(score, digits) + 0.0
                edge = np.partition(score, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                a, b = np.nonzero(score >= edge[:, None])
                order = np.lexsort((b, -score[a, b], a))  # as ids ascend, so do their numbers
                a, b = a[order], b[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                out.append((start + a[keep], b[keep], score[a[keep], b[keep]]))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        return answer

    return index
