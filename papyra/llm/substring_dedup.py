"""Substring dedup by hashing lines, and in a second tier the sentences within them.

First tier: every line is normalised (lower case, white space collapsed) and its 128-bit digest grouped over all documents.
The earliest occurrence, by (doc_id, row, place), stays; every other is removed with its break, however short it is.

Second tier (``min_words``; None leaves it out): passages are also pasted into the middle of lines.  A text is tiled into
units: a run of anything up to and with its closing ``.``, ``!`` or ``?``, or up to a line break, and the line breaks
themselves.  Units are digested alike, apart from lines; an occurrence that isn't the earliest is removed if it belongs to
a run of neighbouring repeated units that has ``min_words`` words, so that short sentences that recur by chance stay.  A
line of which no word is left goes with its break.

Scale: a task looks at ``HELD`` occurrences at a time and sends each of their digests on once (other occurrences among
them are repeats whatever other tasks hold), so that a line which all documents share is one row for some 25 MB of text,
not one for each document; one shuffle groups the digests, one brings the places of repeats to their texts.

Defined results: a null text stays null and an empty one empty; rows alike in id and text get the same result;
null ids rank last; ids of any type that can be ordered do; further columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, text_slices, unused

UNIT = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+|\n")
MIN_WORDS = 8
#: Occurrences that a task compares before it sends their digests on, and how many of them go to the JVM at once.
HELD, SENT = 400_000, 1 << 16
_LINE = np.int64(0x5851F42D4C957F2D)


def units(text: str) -> list[str]:
    """The text's units; joined again they are the text."""
    return UNIT.findall(text)


def normalised(unit: str) -> str:
    return " ".join(unit.lower().split())


def removed_spans(text: str, units_before: set[int], lines_before: set[int], min_words: int | None = MIN_WORDS) -> list[tuple[int, int]]:
    """Spans (start, end) to cut, given the numbers of the units and of the lines that occurred before.

    Cut are those lines with their breaks, runs of repeated units of ``min_words`` words (units without words don't end a
    run), and lines of which no word is left.
    """
    parts = units(text)
    words = [len(p.split()) for p in parts]
    cut: set[int] = set()
    run: list[int] = []
    lines: list[tuple[int, int]] = []
    start = 0
    for i, part in enumerate([*parts, None]):
        if part is None or words[i] and i not in units_before:
            if min_words is not None and sum(words[x] for x in run) >= min_words:
                cut.update(range(run[0], run[-1] + 1))
            run = []
        elif words[i]:
            run.append(i)
        if part is None or part == "\n":
            lines.append((start, i))
            start = i + 1
    for n, (a, b) in enumerate(lines):
        worded = [x for x in range(a, b) if words[x]]
        if worded and (n in lines_before or all(x in cut for x in worded)):
            cut.update(range(a, min(b + 1, len(parts))))
    ends = list(accumulate(map(len, parts)))
    spans: list[tuple[int, int]] = []
    for x in sorted(cut):
        first, last = ends[x] - len(parts[x]), ends[x]
        if spans and spans[-1][1] == first:
            spans[-1] = (spans[-1][0], last)
        else:
            spans.append((first, last))
    return spans


class _Held:
    """Occurrences of some texts: digest, text and place; lines have the places below zero."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.keys: list[pa.Array] = []
        self.rows = 0
        # 24 bytes for each occurrence
        self.row, self.place = array("i"), array("i")
        self.digests = bytearray()

    def add(self, ids: pa.Array, keys: pa.Array, texts: list[str | None], sentences: bool) -> None:
        digest, digests = xxhash.xxh3_128_digest, self.digests
        for row, text in enumerate(texts, self.rows):
            for no, line in enumerate(text.split("\n") if text else ()):
                if plain := normalised(line):
                    digests += digest(plain.encode("utf-8", "surrogatepass"))
                    self.row.append(row)
                    self.place.append(-1 - no)
            for no, unit in enumerate(units(text) if text and sentences else ()):
                if plain := normalised(unit):
                    digests += digest(plain.encode("utf-8", "surrogatepass"))
                    self.row.append(row)
                    self.place.append(no)
        self.ids.append(ids)
        self.keys.append(keys)
        self.rows += len(texts)

    def sent(self) -> Iterator[pa.RecordBatch]:
        """``h1, h2, doc_id, row_key, place, sure``; sure: an earlier occurrence is here, so this one is a repeat."""
        ids, keys = pa.concat_arrays(self.ids), pa.concat_arrays(self.keys)
        order = [(i is None, 0 if i is None else i, k) for i, k in zip(ids.to_pylist(), keys.to_pylist(), strict=True)]
        ranks = {p: n for n, p in enumerate(sorted(set(order)))}  # rows alike in id and text share a rank
        row, place = np.frombuffer(self.row, np.int32), np.frombuffer(self.place, np.int32)
        half = np.frombuffer(self.digests, np.int64).reshape(-1, 2)
        first, second = np.where(place < 0, half[:, 0] ^ _LINE, half[:, 0]), half[:, 1]
        at = np.array([ranks[p] for p in order], np.int32)[row]
        step = np.where(place < 0, -1 - place, place)
        by = np.lexsort((step, at, second, first))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(first[by]) != 0) | (np.diff(second[by]) != 0)
        earliest = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        sure = np.zeros(len(by), bool)
        sure[by] = (at[by] != at[earliest]) | (step[by] != step[earliest])
        del by, new, earliest, at, step
        for k in range(0, len(row), SENT):
            some = slice(k, k + SENT)
            taken = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[some]), pa.array(second[some]), ids.take(taken), keys.take(taken), pa.array(place[some]), pa.array(sure[some])],
                names=["h1", "h2", "doc_id", "row_key", "place", "sure"],
            )


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences: bool = True) -> DataFrame:
    """``doc_id, row_key, places``: for rows with any, the units that occurred earlier by number, and lines by -1 - number."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for part in (p for batch in batches for p in text_slices(batch, "t")):
            held.add(part.column("doc_id"), part.column("row_key"), part.column("t").to_pylist(), sentences)
            if len(held.row) >= HELD:
                yield from held.sent()
                held = _Held()
        if held.row:
            yield from held.sent()

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[doc_id], docs[text]).alias("row_key"), docs[text].cast("string").alias("t"))
    found = rows.mapInArrow(lean(occurrences), f"h1 long, h2 long, doc_id {kind}, row_key long, place int, sure boolean")
    # sure repeats need no partner: each goes to a group of its own
    own = found.withColumn("h2", F.when(F.col("sure"), F.xxhash64("row_key", "place")).otherwise(F.col("h2")))
    own = own.withColumn("h1", F.when(F.col("sure"), F.xxhash64("place", "row_key", F.lit(7))).otherwise(F.col("h1")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_key").alias("r"), F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("p"))
    least = F.min(order).over(Window.partitionBy("h1", "h2"))
    later = own.withColumn("least", least).where(F.col("sure") | (F.col("least") != order))
    return later.groupBy("doc_id", "row_key").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", removed: str = "removed", min_words: int | None = MIN_WORDS) -> DataFrame:
    """docs with ``text`` cut, and ``removed``: array of (start, end) in characters of the original text.

    A column of docs that is called so gives way.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != removed.lower()])
    row_key, own_id, found_id, found_key, places = (unused(docs, n) for n in ("row_key", "own_id", "found_id", "found_key", "places"))
    keyed = docs.withColumn(row_key, F.xxhash64(docs[doc_id], docs[text])).withColumn(own_id, docs[doc_id])
    found = repeats(docs, doc_id=doc_id, text=text, sentences=min_words is not None)
    found = found.toDF(found_id, found_key, places)
    same = (F.col(row_key) == F.col(found_key)) & F.col(own_id).eqNullSafe(F.col(found_id))
    joined = keyed.join(found, same, "left")
    schema = T.StructType([f for f in docs.schema] + [T.StructField(removed, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, names[at]):
                texts, spans = [], []
                for t, u in zip(part.column(names[at]).to_pylist(), part.column("u").to_pylist(), strict=True):
                    cut = removed_spans(t, {x for x in u if x >= 0}, {-1 - x for x in u if x < 0}, min_words) if t and u else []
                    if cut:
                        kept, last = [], 0
                        for a, b in cut:
                            kept.append(t[last:a])
                            last = b
                        t = "".join([*kept, t[last:]])
                    texts.append(t)
                    spans.append([{"start": a, "end": b} for a, b in cut])
                columns = [part.column(n) for n in names]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[f.name for f in schema])

    return joined.select(*[joined[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], joined[places].alias("u")).mapInArrow(lean(run), schema)
