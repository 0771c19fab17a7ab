"""Sinks: JSON lines, text and Markdown renderings, CSV reports, and a vector store that is rebuilt and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import dense


def json_lines(rows: DataFrame, path: str, *by: str) -> None:
    """JSON lines, one folder for each value of ``by``; non-ASCII characters stay as they are."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def _ordered(order: str, text: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), between)


def pages_as_text(lines: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """``<doc>, text``: lines by page behind page marks; ``lines(<doc>, page, line_no, text)``."""
    pages = lines.groupBy(doc, "page").agg(_ordered("line_no", F.col("text"), "\n").alias("t"))
    marked = F.concat(F.lit("<<PAGE "), F.col("page").cast("string"), F.lit(">>\n"), F.col("t"))
    return pages.groupBy(doc).agg(_ordered("page", marked, "\n\n").alias("text"))


def sections_as_markdown(paragraphs: DataFrame) -> DataFrame:
    """``doc_id, markdown`` from ``doc_id, sec_no, label, title, para_no, level, text``: headings, paragraphs indented by level."""
    para = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), F.col("text"))
    sections = paragraphs.groupBy("doc_id", "sec_no", "label", "title").agg(_ordered("para_no", para, "\n").alias("t"))
    head = F.concat(F.lit("## "), F.concat_ws(": ", "label", "title"), F.lit("\n\n"), F.col("t"))
    return sections.groupBy("doc_id").agg(_ordered("sec_no", head, "\n\n").alias("markdown"))


def csv_report(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, for tables of a report's size; nothing is written for an empty table."""
    if rows.limit(1).count():
        rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """The first rows as a Markdown table."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("–" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()])


def content_digest(records: DataFrame, *, key: str = "id", text: str = "document") -> str:
    """SHA-256 over the records' own digests in order of their keys; a change of any text changes it.

    Digests are summed as numbers, not gathered: 16 bytes of each, modulo nothing, so order doesn't matter and no
    group grows with the table.
    """
    own = F.sha2(F.concat_ws("\u0001", F.col(key).cast("string"), F.col(text)), 256)
    part = lambda at: F.sum(F.conv(F.substring(own, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    row = records.agg(*[part(1 + 12 * i).alias(f"p{i}") for i in range(5)], F.count("*").alias("n")).first()
    import hashlib

    return hashlib.sha256("|".join(str(v) for v in row).encode()).hexdigest()


def rebuild_store(records: DataFrame, path: str, digest: str) -> bool:
    """Write ``records(id, document, embedding, ...)`` anew unless the store holds that digest; false if nothing was done."""
    spark: SparkSession = records.sparkSession
    mark = f"{path}/_info"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(mark)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) and spark.read.json(mark).where(F.col("digest") == digest).limit(1).count():
        return False
    records.write.mode("overwrite").parquet(f"{path}/records")
    spark.createDataFrame([(digest, records.sparkSession.read.parquet(f"{path}/records").count())], "digest string, n long").coalesce(1).write.mode("overwrite").json(mark)
    return True


def verify_store(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows, repeated ids, and vectors that don't find themselves first (or an equal of lesser id)."""
    stored = spark.read.parquet(f"{path}/records")
    numbered = stored.select(F.xxhash64("id").alias("id"), F.col("embedding").alias("v"))
    lost = dense.self_check(numbered).where("not ok").count()
    return {"rows": stored.count(), "repeated": stored.groupBy("id").count().where("count > 1").count(), "lost": lost}
