"""Sources: files with a validity check, documents in JSON and DOCX, lexicons, run reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from fnmatch import fnmatch
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra import fixed

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of all files below a path.

    Spark's binary source has no rows for empty files; their names come from a listing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, empty = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0 and fnmatch(file.getPath().getName(), pattern):
            empty.append((file.getPath().toString(), datetime.fromtimestamp(file.getModificationTime() / 1000, UTC), 0, b""))
    return found.unionByName(spark.createDataFrame(empty, found.schema)) if empty else found


def file_error(path: Column, length: Column, content: Column) -> Column:
    """Why a file isn't taken, or null: empty, too large, unknown type, content that isn't what the name says."""
    extension = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 8))
    pdf = F.hex(F.substring(content, 1, 1024)).contains("255044462D")  # %PDF-
    return (
        F.when(length == 0, "EMPTY_FILE")
        .when(length > fixed.MAX_FILE_MB << 20, "FILE_TOO_LARGE")
        .when(~extension.isin("pdf", "docx"), "UNSUPPORTED_TYPE")
        .when((extension == "pdf") & ~pdf, "INVALID_PDF")
        .when((extension == "docx") & head.startswith("D0CF11E0"), "ENCRYPTED_OR_OLD_DOC")
        .when((extension == "docx") & ~head.startswith("504B0304"), "INVALID_DOCX")
    )


def archive_error(content: bytes) -> str | None:
    """What is wrong with a zip archive: damaged, no document in it, or too large unpacked."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if sum(i.file_size for i in z.infolist()) > fixed.MAX_UNZIPPED_MB << 20:
                return "ZIP_BOMB"
            if "word/document.xml" not in z.namelist():
                return "INVALID_DOCX"
            return "CORRUPT_FILE" if z.testzip() else None
    except (zipfile.BadZipFile, OSError):
        return "CORRUPT_FILE"


def _blocks(content: bytes) -> list[tuple[str, str, list[list[str]] | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    out: list[tuple[str, str, list[list[str]] | None]] = []
    body = root.find(f"{_WORD}body")
    for child in () if body is None else body:
        if child.tag == f"{_WORD}p" and said(child).strip():
            out.append(("text", said(child).strip(), None))
        elif child.tag == f"{_WORD}tbl":
            rows = [["\n".join(said(p) for p in c.iter(f"{_WORD}p")).strip() for c in r.findall(f"{_WORD}tc")] for r in child.iter(f"{_WORD}tr")]
            out.append(("table", "\n".join(" | ".join(r) for r in rows), rows))
    return out


def docx_blocks(found: DataFrame) -> DataFrame:
    """``path, block_no, kind, text, rows, error`` from files(path, content): paragraphs and tables in order.

    A file that can't be read is one row with its error, and stops nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                error = archive_error(bytes(content))
                if error is None:
                    try:
                        rows += [(path, n, k, t, r, None) for n, (k, t, r) in enumerate(_blocks(bytes(content)), 1)]
                        continue
                    except ElementTree.ParseError:
                        error = "CORRUPT_FILE"
                rows.append((path, 0, None, None, None, error))
            yield pd.DataFrame(rows, columns=["path", "block_no", "kind", "text", "rows", "error"])

    return found.select("path", "content").mapInPandas(run, "path string, block_no int, kind string, text string, rows array<array<string>>, error string")


def docx_images(found: DataFrame) -> DataFrame:
    """``path, name, image``: pictures stored in documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if archive_error(bytes(content)) is None:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows += [(path, n, z.read(n)) for n in sorted(z.namelist()) if n.startswith("word/media/")]
            yield pd.DataFrame(rows, columns=["path", "name", "image"])

    return found.select("path", "content").mapInPandas(run, "path string, name string, image binary")


def json_documents(spark: SparkSession, path: str, schema: StructType | str, *, skip: tuple[str, ...] = ("validation.json",)) -> DataFrame:
    """One row per JSON file, without reports that lie beside them."""
    found = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("__file", F.col("_metadata.file_name"))
    return found.where(~F.col("__file").isin(*skip)).drop("__file")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row per line; blank lines are none."""
    return spark.read.schema(schema).json(path)


def lexicon(spark: SparkSession, seed: str, texts: str | None = None) -> DataFrame:
    """``word, n``: a list of words with counts, and the words of all text files below a folder, added up."""
    from papyra.operators import cleaning

    listed = spark.read.option("sep", "\t").schema("word string, n long").csv(seed).where("word is not null")
    if texts is not None:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(texts)
        listed = listed.unionByName(cleaning.lexicon(found))
    return listed.groupBy("word").agg(F.sum("n").alias("n"))


def newest(found: DataFrame, pattern: str) -> DataFrame:
    """The file changed last among those whose path matches, per first group of the pattern."""
    keyed = found.where(F.col("path").rlike(pattern)).withColumn("run", F.regexp_extract("path", pattern, 1))
    return keyed.groupBy("run").agg(F.max_by("path", "modificationTime").alias("path"))
