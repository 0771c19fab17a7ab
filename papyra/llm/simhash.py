"""SimHash near-duplicates by anchor-point covering.

Fingerprint: texts lower-cased for A-Z, cut into words at ASCII white space, hashed (XXH64, seed 42) by shingles
of ``words`` words; a bit is set if it is set in more than half of a text's shingle hashes.

Anchors: the perfect binary Golay code of length 23 covers all 23-bit words with radius 3.  Two fields of 23 bits
of a fingerprint each use it, so an anchor is a pair of code words.  A fingerprint owns the one anchor within
radius 3 in both fields, and is replicated to every anchor whose excess over that radius, added over the fields,
is at most the threshold: all those within covering radius plus threshold that a neighbour can own (about 61 of
16.8 million for threshold 2).  If x and y differ in at most the threshold, y therefore meets x at x's own anchor,
where they are compared in full; each pair meets once, and no pair of different distance leaves the join.

Only distinct fingerprints take part, so copies are one node however many there are.  Links become components in
:mod:`papyra.llm.components`; nothing is collected.

Defined results: a null or blank text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows share a component; a component whose ids are all null has a null id; further
columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_slices, unused
from .components import components

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0xC75
FIELD, RADIUS = 23, 3
SEED = 42


def fingerprint_batch(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Unsigned fingerprints of whole texts."""
    digest = xxhash.xxh64_intdigest
    sizes, hashes = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if len(w) > words:
            own = [digest(s, SEED) for s in map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))]
        else:
            own = [digest(b" ".join(w), SEED)] if w else []
        sizes[i] = len(own)
        hashes.append(np.array(own, dtype=np.uint64))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        every = np.concatenate([hashes[i] for i in some])
        for bit in range(64):
            on = np.add.reduceat((every >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
            out[some] |= (2 * on > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, row_key, fp``: row_key tells rows of other id or text apart, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                fp = fingerprint_batch(part.column("t").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(fp.view(np.int64))], names=["doc_id", "row_key", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[doc_id], docs[text]).alias("row_key"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_key long, fp long")


class Golay:
    """Error patterns by syndrome and by their excess over the covering radius, up to ``threshold``."""

    def __init__(self, threshold: int) -> None:
        self.low = np.array([self._remainder(x) for x in range(1 << 12)], np.int64)
        self.high = np.array([self._remainder(x << 12) for x in range(1 << 11)], np.int64)
        self.first, self.count, self.errors = [], [], []
        patterns = [[sum(1 << b for b in bits) for bits in combinations(range(FIELD), n)] for n in range(RADIUS + threshold + 1)]
        for excess in range(threshold + 1):
            own = np.array(sum(patterns[: RADIUS + 1], []) if not excess else patterns[RADIUS + excess], np.int64)
            at = self.syndrome(own)
            order = np.argsort(at, kind="stable")
            count = np.bincount(at, minlength=1 << 11)
            self.errors.append(own[order])
            self.count.append(count)
            self.first.append(np.cumsum(count) - count)
        assert (self.count[0] == 1).all()  # perfect: one word within the radius

    @staticmethod
    def _remainder(x: int) -> int:
        for b in range(FIELD - 1, 10, -1):
            if x >> b & 1:
                x ^= GOLAY << (b - 11)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def near(self, x: np.ndarray, rows: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """For the rows' words x: positions in rows, repeated, and the code words at that excess."""
        at = self.syndrome(x[rows])
        count = self.count[excess][at]
        again = np.repeat(np.arange(len(rows)), count)
        nth = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        return again, x[rows][again] ^ self.errors[excess][self.first[excess][at][again] + nth]

    def anchors(self, fp: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and anchors of every anchor to which the fingerprints go; total 0: only the one they own."""
        bits = fp.view(np.uint64)
        a = (bits & np.uint64((1 << FIELD) - 1)).astype(np.int64)
        b = (bits >> np.uint64(FIELD) & np.uint64((1 << FIELD) - 1)).astype(np.int64)
        rows, made = [], []
        for i in range(total + 1):
            for j in range(total + 1 - i):
                first, left = self.near(a, np.arange(len(fp)), i)
                again, right = self.near(b, first, j)
                rows.append(first[again])
                made.append(left[again] | right << FIELD)
        return np.concatenate(rows), np.concatenate(made)


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """``u, v``: pairs of distinct fingerprints (column ``fp``, no repeats) that differ in at most ``threshold`` bits."""

    def anchored(total: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = Golay(total)
            for batch in batches:
                fp = batch.column("fp").to_numpy(zero_copy_only=False)
                for k in range(0, len(fp), 2000):
                    part = fp[k : k + 2000]
                    rows, anchor = code.anchors(part, total)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[rows])], names=["anchor", "fp"])

        return run

    owners = fps.select("fp").mapInArrow(anchored(0), "anchor long, fp long").withColumnRenamed("fp", "u")
    guests = fps.select("fp").mapInArrow(anchored(threshold), "anchor long, fp long").withColumnRenamed("fp", "v")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    return guests.join(owners.hint("shuffle_hash"), "anchor").where(near).select("u", "v")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """One row for each of docs: ``doc_id, row_key, fp, root, component_id``.

    root is the same for all rows of a component; component_id is the least doc_id among them.
    """
    rows = checkpointed(fingerprints(docs, doc_id=doc_id, text=text, words=words))
    least = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = components(links(least, threshold)).select(F.col("node").alias("fp"), "root")
    rooted = least.join(grouped, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(of_root, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """The rows of docs without the near-duplicates: of each component the row of least doc_id (nulls last) stays, once."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, words=words, threshold=threshold)
    return keep_first(docs, found, doc_id=doc_id, text=text)


def keep_first(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of the rows of docs, found again by ``doc_id, row_key, root``, the one of least doc_id (nulls last) of each root, once."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("k"))
    row_key, kept_key, kept_id = (unused(docs, n) for n in ("row_key", "kept_key", "kept_id"))
    kept = first.select(F.col("k.row_key").alias(kept_key), F.col("k.doc_id").alias(kept_id))
    keyed = docs.withColumn(row_key, F.xxhash64(docs[doc_id], docs[text]))
    same = (F.col(row_key) == F.col(kept_key)) & F.col(doc_id).eqNullSafe(F.col(kept_id))
    return keyed.join(kept, same, "left_semi").dropDuplicates([row_key, doc_id]).drop(row_key)
