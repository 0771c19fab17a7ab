"""Tables and markup: rows of pipe-separated lines, compacting, continuation over pages, items of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.functions import text as T


def cells(line: Column) -> Column:
    """The trimmed cells of a line."""
    return F.transform(F.split(line, "\\|"), F.trim)


def pipe_tables(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``<doc>, table_no, first_line, n_rows, n_cols, header, fill``: runs of neighbouring lines with a pipe."""
    piped = lines.where(F.col("line").contains("|")).withColumn("cells", cells(F.col("line")))
    at = F.row_number().over(Window.partitionBy(doc).orderBy("line_no"))
    runs = piped.withColumn("run", F.col("line_no") - at)  # the same for lines in a row
    told = runs.groupBy(doc, "run").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), F.min_by("cells", "line_no").alias("head"), F.sum(F.size(F.filter("cells", lambda c: c != ""))).alias("filled")
    )
    header = (F.col("n_rows") >= 2) & F.exists("head", lambda c: c != "") & F.forall("head", lambda c: (F.length(c) <= 40) & ~c.rlike("[0-9\\u0660-\\u0669%•●]"))
    no = F.row_number().over(Window.partitionBy(doc).orderBy("first_line"))
    return told.select(doc, no.alias("table_no"), "first_line", "n_rows", "n_cols", header.alias("header"), F.round(F.col("filled") / (F.col("n_rows") * F.col("n_cols")), 4).alias("fill"))


def is_layout_grid(n_cols: Column, fill: Column) -> Column:
    """Wide and mostly empty: no table but a page's layout."""
    return (n_cols > 6) & (fill < 0.3)


def compact_rows(rows: Column) -> Column:
    """A table's rows, or null if they are none: fewer than two rows or columns with anything in them, or a page's layout.

    Empty rows and columns go; if 60 % of the rows of two or more filled cells have as many of them, so do empty cells.
    """
    filled = lambda c: c != ""
    trimmed = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    some = F.filter(trimmed, lambda r: F.exists(r, filled))
    width = F.coalesce(F.array_max(F.transform(some, F.size)), F.lit(0))
    cell = lambda r, j: F.coalesce(F.try_element_at(r, j), F.lit(""))
    columns = F.filter(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda j: F.exists(some, lambda r: cell(r, j) != ""))
    whole = F.transform(some, lambda r: F.transform(columns, lambda j: cell(r, j)))
    dense = F.transform(whole, lambda r: F.filter(r, filled))
    wide = F.filter(F.transform(dense, F.size), lambda n: n >= 2)
    commonest = F.coalesce(F.array_max(F.transform(wide, lambda n: F.size(F.filter(wide, lambda m: m == n)))), F.lit(0))
    chosen = F.when((commonest > 0) & (commonest >= 0.6 * F.size(wide)), dense).otherwise(whole)
    n_cols = F.coalesce(F.array_max(F.transform(chosen, F.size)), F.lit(0))
    held = F.aggregate(chosen, F.lit(0), lambda n, r: n + F.size(F.filter(r, filled)))
    grid = is_layout_grid(n_cols, held / F.greatest(F.lit(1), F.size(chosen) * n_cols))
    return F.when((F.size(some) < 2) | (F.size(columns) < 2) | grid, None).otherwise(chosen)


def continued(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """tables with ``continues``: the table before has as many columns and ends where or just before this one begins."""
    w = Window.partitionBy(doc).orderBy("table_no")
    last = F.lag(F.struct("n_cols", (F.col("first_line") + F.col("n_rows")).alias("end"))).over(w)
    near = (last["n_cols"] == F.col("n_cols")) & (F.col("first_line") - last["end"] <= 1)
    return tables.withColumn("continues", F.coalesce(near, F.lit(False)))


def as_text(rows: Column) -> Column:
    """Rows as lines of cells between pipes."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def as_markdown(rows: Column) -> Column:
    """A Markdown table: the first row as its head, pipes in cells escaped."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.regexp_replace(c, "\\|", "\\\\|")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
    return F.array_join(F.concat(F.array(row(rows[0]), rule), F.transform(F.slice(rows, 2, 1_000_000), row)), "\n")


def html_items(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``<page_id>, item_no, type, text, marker``: headings and paragraphs, without scripts, styles, comments and navigation."""
    bare = F.regexp_replace(F.col(html), "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>", " ")
    found = pages.select(page_id, F.posexplode(F.regexp_extract_all(bare, F.lit("(?is)<((?:h1|p)[ >].*?)</(?:h1|p)>"))).alias("at", "raw"))
    inner = F.regexp_replace(F.regexp_replace(F.col("raw"), "(?s)^[^>]*>", ""), "(?s)<[^>]*>", " ")
    text = T.collapse(inner)
    kind = F.when(F.lower(F.substring("raw", 1, 2)) == "h1", "heading").otherwise("paragraph")
    return found.select(page_id, (F.col("at") + 1).alias("item_no"), kind.alias("type"), text.alias("text"))
