"""Chunks of bounded size: paragraphs with levels, units, pieces, and greedy packing per section.

Packing depends on what was packed before, so it runs per section in Python, a section being a few pages; sections
are spread over the cluster.  Sizes, headings and citations are Column expressions over the chunks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed
from papyra.functions import text as T

FOOTNOTE = re.compile(r"\s*\[\^(\d+)\]")


@dataclass(frozen=True)
class Paragraph:
    text: str
    level: int = 0
    path: str = ""
    subheading: bool = False

    @property
    def size(self) -> int:
        return len(self.text.split())


@dataclass
class Piece:
    """Paragraphs that stay together; ``lead``: the sentence they continue; ``opens``: they are such a sentence."""

    paragraphs: list[Paragraph]
    lead: str | None = None
    opens: bool = False

    @property
    def size(self) -> int:
        return sum(p.size for p in self.paragraphs)


@dataclass
class Chunk:
    paragraphs: list[Paragraph] = field(default_factory=list)
    context: str | None = None
    leads: set[str] = field(default_factory=set)
    size: int = 0

    def takes(self, piece: Piece, limit: int) -> bool:
        return self.size + piece.size <= limit and (piece.lead is None or piece.lead in self.leads)

    def add(self, piece: Piece) -> None:
        self.paragraphs += piece.paragraphs
        self.size += piece.size
        if piece.lead:
            self.leads.add(piece.lead)
        if piece.opens:
            self.leads.add(piece.paragraphs[0].text)


def balanced_limit(total: int, most: int, balance: float = fixed.BALANCE) -> int:
    """A limit that makes the parts of a total alike, never above ``most``."""
    parts = max(1, math.ceil(total / most))
    return most if parts == 1 else min(most, int(total / parts * balance) + 1)


def units(paragraphs: list[Paragraph]) -> list[list[Paragraph]]:
    """A paragraph of level 0 or 1, or a subheading, with the deeper ones that follow."""
    starts = [i for i, p in enumerate(paragraphs) if i == 0 or p.level <= 1 or p.subheading]
    return [paragraphs[a:b] for a, b in zip(starts, [*starts[1:], len(paragraphs)], strict=True)]


def split_text(text: str, limit: int) -> list[str]:
    """Sentences joined up to the limit; a longer one is cut by words."""
    held: list[list[str]] = [[]]
    for sentence in re.split(r"(?<=[.؛])\s+", text):
        w = sentence.split()
        if held[-1] and len(held[-1]) + len(w) > limit:
            held.append([])
        held[-1] += w
    return [" ".join(w[k : k + limit]) for w in held for k in range(0, len(w), limit)]


def _cut(p: Paragraph, limit: int) -> list[Paragraph]:
    return [p] if p.size <= limit else [replace(p, text=t) for t in split_text(p.text, limit)]


def _pieces_of_unit(unit: list[Paragraph], limit: int) -> list[Piece]:
    """The unit as it is; or its head, then each of the rest under the head as their lead; or, if the head is too long to be repeated, each alone."""
    if sum(p.size for p in unit) <= limit:
        return [Piece(unit)]
    led = len(unit) > 1 and unit[0].size <= limit // 2
    lead, body = (unit[0].text, unit[1:]) if led else (None, unit)
    return [Piece([p], opens=True) for p in unit[:1] if led] + [Piece([x], lead=lead) for p in body for x in _cut(p, limit)]


def pieces(paragraphs: list[Paragraph], limit: int) -> tuple[list[Piece], str | None]:
    """Pieces of at most ``limit`` words where possible, and the introductory sentence, if the section begins with one."""
    introduces = bool(paragraphs) and paragraphs[0].level == 0 and paragraphs[0].text.rstrip().endswith(":")
    return [p for unit in units(paragraphs) for p in _pieces_of_unit(unit, limit)], paragraphs[0].text if introduces else None


def pack(made: list[Piece], intro: str | None, most: int) -> list[Chunk]:
    """Chunks of consecutive pieces; one that opens without its lead gets it, or else the introduction, as context."""
    limit = balanced_limit(sum(p.size for p in made), most)
    chunks: list[Chunk] = []
    for piece in made:
        if not chunks or not chunks[-1].takes(piece, limit):
            context = piece.lead or (intro if chunks and intro and piece.paragraphs[0].text != intro else None)
            chunks.append(Chunk(context=context))
        chunks[-1].add(piece)
    return chunks


def paths(kinds: list[str | None], markers: list[str | None]) -> list[tuple[int, str]]:
    """Level and path of each paragraph: letters are level 1, numbers below them, bullets below those; others 0."""
    base = 1 if any(k in ("letter", "ordinal_word") for k in kinds) else 0
    depth = {"letter": 1, "ordinal_word": 1, "number": base + 1, "bullet": base + 2}
    open_: dict[int, str] = {}
    out = []
    for kind, marker in zip(kinds, markers, strict=True):
        level = depth.get(kind, 0)
        if level:
            open_ = {d: m for d, m in open_.items() if d < level} | {level: marker or ""}
        out.append((level, "".join(f"({m})" for _, m in sorted(open_.items()) if m != "•") if level else ""))
    return out


def with_paths(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, sec_no, para_no, kind, marker`` and more -> with ``level`` and ``path``.

    A marker at level l counts until a shallower or equal one comes, so each level's open marker is the last one of
    that level since the last shallower one: windows, no Python.
    """
    section = Window.partitionBy("doc_id", "sec_no")
    until = section.orderBy("para_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lettered = F.max(F.col("kind").isin("letter", "ordinal_word").cast("int")).over(section)
    base = F.coalesce(lettered, F.lit(0))
    level = F.when(F.col("kind").isin("letter", "ordinal_word"), 1).when(F.col("kind") == "number", base + 1).when(F.col("kind") == "bullet", base + 2).otherwise(0)
    told = paragraphs.withColumn("level", level)
    last_at = lambda depth: F.max(F.when(F.col("level") == depth, F.col("para_no"))).over(until)
    marker_at = lambda depth: F.last(F.when(F.col("level") == depth, F.col("marker")), ignorenulls=True).over(until)
    for depth in (1, 2, 3):
        told = told.withColumn(f"__at{depth}", last_at(depth)).withColumn(f"__m{depth}", marker_at(depth))
    shown = []
    for depth in (1, 2, 3):
        shallower = F.greatest(F.lit(-1), *[F.coalesce(f"__at{d}", F.lit(-1)) for d in range(1, depth)]) if depth > 2 else F.coalesce("__at1", F.lit(-1)) if depth == 2 else F.lit(-1)
        open_ = (F.col("level") >= depth) & (F.col(f"__at{depth}") > shallower) & (F.col(f"__m{depth}") != "•")
        shown.append(F.when(open_, F.concat(F.lit("("), F.col(f"__m{depth}"), F.lit(")"))))
    path = F.when(F.col("level") > 0, F.concat_ws("", *shown)).otherwise("")
    return told.withColumn("path", path).drop(*[f"__{x}{d}" for x in ("at", "m") for d in (1, 2, 3)])


CHUNKS = "doc_id string, sec_no int, chunk_index int, chunk_count int, context string, content string, paths array<string>, words int"


def chunk_sections(paragraphs: DataFrame, *, most: int = fixed.MAX_WORDS) -> DataFrame:
    """``doc_id, sec_no, para_no, text, level, path, is_subheading`` -> chunks of each section (see CHUNKS)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("para_no")
        level, heading = pdf["level"].fillna(0).astype(int), pdf["is_subheading"].fillna(value=False).astype(bool)
        own = [Paragraph(t or "", n, p or "", s) for t, n, p, s in zip(pdf["text"], level, pdf["path"], heading, strict=True)]
        chunks = pack(*pieces(own, most), most)
        shown = lambda t: FOOTNOTE.sub(r" [\1]", t).strip()
        return pd.DataFrame(
            {
                "doc_id": str(pdf["doc_id"].iloc[0]),
                "sec_no": int(pdf["sec_no"].iloc[0]),
                "chunk_index": range(1, len(chunks) + 1),
                "chunk_count": len(chunks),
                "context": [FOOTNOTE.sub("", c.context).strip() if c.context else None for c in chunks],
                "content": ["\n".join(shown(p.text) for p in c.paragraphs) for c in chunks],
                "paths": [[p.path for p in c.paragraphs if p.path] for c in chunks],
                "words": [c.size for c in chunks],
            }
        )

    return paragraphs.groupBy("doc_id", "sec_no").applyInPandas(run, CHUNKS)


def pack_lines(docs: DataFrame, *, most: int = fixed.MAX_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, chunk, first_line, last_line, n_words``: each text's lines with words, packed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for d, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                limit = balanced_limit(sum(sizes or ()), most)
                held, at, no = 0, 0, 0
                for line, size in enumerate(sizes or (), 1):
                    if not size:
                        continue
                    if not no or held + size > limit:
                        no, held, at = no + 1, 0, line
                        rows.append([d, no, at, at, 0])
                    held += size
                    rows[-1][3:] = [line, held]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "chunk", "first_line", "last_line", "n_words"])

    sizes = docs.select(doc_id, F.transform(F.split(F.col(text), "\n"), T.word_count).alias("sizes"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return sizes.mapInArrow(run, f"doc_id {kind}, chunk int, first_line int, last_line int, n_words int")


def breadcrumb(document: Column, part: Column, chapter: Column, section: Column) -> Column:
    """The levels above a text, outermost first, absent ones left out."""
    return F.concat_ws(" › ", document, part, chapter, section)


def labelled(label: Column, title: Column) -> Column:
    """``label: title``, or the label alone."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat_ws(": ", label, title)).otherwise(label)


def top_labels(paths_: Column) -> Column:
    """The outermost label of each path, each once, in the order of first appearance."""
    return F.array_distinct(F.filter(F.transform(paths_, lambda p: F.regexp_extract(p, "^\\(([^)]+)\\)", 1)), lambda x: x != ""))


def citation(title: Column, label: Column, tops: Column, count: Column) -> Column:
    """Title and label, and the paragraphs if the section has several chunks."""
    base = F.concat_ws("، ", title, F.when(F.coalesce(label, F.lit("")) != "", label))
    named = F.concat_ws(" ", F.when(F.size(tops) == 1, "الفقرة").otherwise("الفقرات"), F.array_join(F.transform(tops, lambda t: F.concat(F.lit("("), t, F.lit(")"))), "، "))
    return F.when((count > 1) & (F.size(tops) > 0), F.concat_ws("، ", base, named)).otherwise(base)


def chunk_text(crumb: Column, index: Column, count: Column, context: Column, content: Column, footnotes: Column | None = None) -> Column:
    """The text that is indexed: breadcrumb and part, context, content, footnotes."""
    part = F.when(count > 1, F.concat(F.lit(" (الجزء "), index.cast("string"), F.lit(" من "), count.cast("string"), F.lit(")"))).otherwise("")
    lines = [F.concat(F.lit("["), crumb, part, F.lit("]")), F.when(context.isNotNull(), F.concat(F.lit("(سياق: "), context, F.lit(")"))), content]
    if footnotes is not None:
        listed = F.array_join(F.transform(footnotes, lambda f: F.concat(F.lit("["), f["n"].cast("string"), F.lit("] "), f["text"])), "\n")
        lines.append(F.when(F.size(footnotes) > 0, F.concat(F.lit("الحواشي:\n"), listed)))
    return F.concat_ws("\n", *lines)


def padded(number: Column, width: int) -> Column:
    """Zeros in front up to ``width`` characters; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def chunk_id(code: Column, kind: Column, number: Column, first_page: Column, index: Column) -> Column:
    """``IFR-art007-c01``: document code, section (article, annex, preamble), chunk."""
    section = (
        F.when(kind == "article", F.concat(F.lit("art"), padded(number, 3)))
        .when(kind == "annex", F.concat(F.lit("anx"), F.regexp_replace(F.regexp_replace(number, "[^\\p{L}\\p{N}_]", ""), "ا", "")))
        .otherwise(F.concat(F.lit("pre"), first_page.cast("string")))
    )
    return F.concat_ws("-", code, section, F.concat(F.lit("c"), padded(index, 2)))


def section_key(chunk: Column) -> Column:
    """A chunk's id without its last part."""
    return F.regexp_replace(chunk, "-[^-]*$", "")


def fund_scope(doc_id: Column, kind: Column, annex: Column, part: Column) -> Column:
    """Which funds a section is about."""
    # --- fixed values: scopes by document, annex and part ---
    by_doc = {"capital_market_institutions_regulations": "general", "corporate_governance_regulations": "companies", "simplified_investment_funds_instructions": "simplified"}
    by_annex = {"1": "public", "2": "public", "4": "public", "5": "public", "6": "private_foreign", "7": "private", "8": "foreign", "9": "private_foreign", "11": "private", "12": "public", "13": "public"}
    by_part = {4: "public", 5: "private", 6: "foreign"}
    look = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair]).getItem(key)
    of_fund = F.when(kind == "annex", F.coalesce(look(by_annex, annex), F.lit("funds_all"))).otherwise(F.coalesce(look(by_part, part), F.lit("funds_all")))
    return F.coalesce(look(by_doc, doc_id), of_fund)


#: Scopes that apply to each type of fund (fixed values).
FUND_TYPE_SCOPES = {
    "public": ("general", "funds_all", "public"),
    "private": ("general", "funds_all", "private", "private_foreign"),
    "foreign": ("general", "funds_all", "foreign", "private_foreign"),
    "simplified": ("general", "simplified"),
}


def statistics(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks, sections that were split, and words, by document and (doc null) in all."""
    split = F.countDistinct(F.when(F.col("chunk_count") > 1, F.struct(doc, "sec_no")))
    numbers = [F.count("*").alias("chunks"), split.alias("split_sections"), F.min("words").alias("words_min"), F.median("words").alias("words_median"), F.round(F.avg("words")).alias("words_mean"), F.max("words").alias("words_max")]
    return chunks.rollup(doc).agg(*numbers)
