"""Structuring, chunking, segmentation, tables and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed
from papyra.functions import text as T
from papyra.functions import unicode as U
from papyra.operators import chunking, cleaning, segmentation, structure, tables
from papyra.plans import sql as S
from papyra.plans.catalog import query
from papyra.plans.text import LINES, literal, values
from papyra.sources.tables import documents, table


@query(
    f"""WITH RECURSIVE {LINES}, sized AS (
  SELECT doc_id, line_no, len({S.words('line')}) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines WHERE len({S.words('line')}) > 0
),
totals AS (SELECT doc_id, sum(w) AS total, greatest(1, ceil(sum(w) / 300.0)) AS parts FROM sized GROUP BY doc_id),
limits AS (SELECT doc_id, CASE WHEN parts = 1 THEN 300 ELSE least(300, floor(total / parts * 1.2) + 1) END AS lim FROM totals),
packed AS (
  SELECT s.doc_id, k, line_no, w, 1 AS chunk, w AS held, lim FROM sized s JOIN limits l USING (doc_id) WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.k, s.line_no, s.w, CASE WHEN p.held + s.w > p.lim THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.held + s.w > p.lim THEN s.w ELSE p.held + s.w END, p.lim
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.k = p.k + 1
)
SELECT doc_id, chunk::INTEGER AS chunk, min(line_no)::INTEGER AS first_line, max(line_no)::INTEGER AS last_line, sum(w)::INTEGER AS n_words FROM packed GROUP BY doc_id, chunk"""
)
def greedy_chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines packed into chunks of balanced size."""
    return chunking.pack_lines(documents(spark, sf_dir))


PIECES = "pieces AS (SELECT source, doc_id, n, least(300, n - k * 300) AS w, ceil(n / 300.0) AS parts FROM (SELECT source, doc_id, n, unnest(range(0, ceil(n / 300.0)::BIGINT)) AS k FROM (SELECT source, doc_id, len({words}) AS n FROM documents))),".format(
    words=S.words("text")
)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 300 words as chunks: source is the document, each text a section."""
    docs = documents(spark, sf_dir).select("source", "doc_id", "lang", T.word_count(F.col("text")).alias("n"))
    cut = docs.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 300))))
    return cut.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("sec_no"), "lang", F.least(F.lit(300), F.col("n") - F.col("k") * 300).cast("int").alias("words"), F.ceil(F.col("n") / 300).alias("chunk_count"))


@query(
    f"""WITH {PIECES[:-1]} SELECT source AS doc_id, count(*) AS chunks, count(DISTINCT CASE WHEN parts > 1 THEN doc_id END) AS split_sections, min(w)::INTEGER AS words_min, median(w)::DOUBLE AS words_median,
  round(avg(w)) AS words_mean, max(w)::INTEGER AS words_max FROM pieces GROUP BY ROLLUP (source)"""
)
def chunk_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk statistics by document, and in all."""
    return chunking.statistics(_chunks(spark, sf_dir))


@query(
    """SELECT source, lang, count(*) AS n, max(length(text))::INTEGER AS chars_max, md5(string_agg(md5(text), '' ORDER BY doc_id)) AS digest
FROM documents GROUP BY GROUPING SETS ((source), (lang), ())"""
)
def prep_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, longest text and content digest by document, by type and in all.

    The digest of a group is over its texts' digests in order of id: 32 characters a row, not the texts.
    """
    docs = documents(spark, sf_dir).select("source", "lang", "doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("d"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "d"))), lambda s: s["d"]), "")
    grouped = docs.groupingSets([["source"], ["lang"], []], "source", "lang")
    return grouped.agg(F.count("*").alias("n"), F.max("chars").alias("chars_max"), F.md5(ordered.cast("binary")).alias("digest"))


@query(
    """WITH d AS (SELECT d.doc_id, text, lang, source, quality, count(*) OVER (PARTITION BY text) AS copies FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, problem FROM (
  SELECT doc_id, unnest([CASE WHEN length(trim(text)) < 20 THEN 'short_text' END, CASE WHEN quality IS NULL THEN 'no_label' END, CASE WHEN copies > 1 THEN 'repeated_text' END, CASE WHEN lang IS NULL OR source IS NULL THEN 'missing_field' END]) AS problem FROM d
) WHERE problem IS NOT NULL"""
)
def ingest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against taking a record in, one row per record and problem."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality")
    copies = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("d")).agg(F.count("*").alias("copies")).where("copies > 1")
    told = docs.withColumn("d", F.md5(F.col("text").cast("binary"))).join(copies, "d", "left").join(labels, "doc_id", "left")
    found = F.array(
        F.when(F.length(F.trim("text")) < 20, "short_text"),
        F.when(F.col("quality").isNull(), "no_label"),
        F.when(F.col("copies").isNotNull(), "repeated_text"),
        F.when(F.col("lang").isNull() | F.col("source").isNull(), "missing_field"),
    )
    return told.select("doc_id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


@query(
    f"""WITH d AS (SELECT doc_id, source, lang, substr(string_split(text, chr(10))[1], 1, 120) AS title, ceil(len({S.words('text')}) / 300.0) AS n FROM documents)
SELECT doc_id, concat_ws(' › ', source, CASE WHEN lang <> 'en' THEN 'lang: ' || lang END, title) AS breadcrumb, concat_ws('، ', source, CASE WHEN title <> '' THEN title END) || CASE WHEN n > 1 THEN '، الفقرة (' || lang || ')' ELSE '' END AS citation,
  'SRC-art' || CASE WHEN doc_id > 999 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 3, '0') END || '-c01' AS chunk_id FROM d"""
)
def breadcrumb_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumb, citation and chunk id of each document's first chunk."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", T.first_line(F.col("text")).alias("title"), F.ceil(T.word_count(F.col("text")) / 300).alias("n"))
    chapter = F.when(F.col("lang") != "en", chunking.labelled(F.lit("lang"), F.col("lang")))
    crumb = chunking.breadcrumb(F.col("source"), F.lit(None).cast("string"), chapter, F.col("title"))
    cited = chunking.citation(F.col("source"), F.col("title"), chunking.top_labels(F.array(F.concat(F.lit("("), F.col("lang"), F.lit(")")))), F.col("n"))
    number = F.col("doc_id").cast("string")
    return docs.select("doc_id", crumb.alias("breadcrumb"), cited.alias("citation"), chunking.chunk_id(F.lit("SRC"), F.lit("article"), number, F.lit(0), F.lit(1)).alias("chunk_id"))


SCOPES = [
    ("capital_market_institutions_regulations", "article", None, 5, "general"), ("corporate_governance_regulations", "annex", "1", None, "companies"), ("simplified_investment_funds_instructions", "article", None, 1, "simplified"),
    ("investment_funds_regulations", "annex", "11", None, "private"), ("investment_funds_regulations", "annex", "6", None, "private_foreign"), ("investment_funds_regulations", "annex", "35(أ)", None, "funds_all"),
    ("investment_funds_regulations", "article", None, 4, "public"), ("investment_funds_regulations", "article", None, 5, "private"), ("investment_funds_regulations", "article", None, 9, "funds_all"), ("investment_funds_regulations", "preamble", None, None, "funds_all"),
]


@query(f"SELECT no, scope, list_contains(['general', 'funds_all', 'private', 'private_foreign'], scope) AS private FROM {values(SCOPES, 'doc_id, kind, annex, part, scope')}")
def scope_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which funds sections are about, and whether that takes in private funds."""
    rows = literal(spark, [r[:4] for r in SCOPES], "doc_id string, kind string, annex string, part int")
    told = rows.withColumn("scope", chunking.fund_scope(F.col("doc_id"), F.col("kind"), F.col("annex"), F.col("part")))
    return told.select("no", "scope", F.col("scope").isin(*chunking.FUND_TYPE_SCOPES["private"]).alias("private"))


PATHS = [
    ("a", 1, None, None, 0, ""), ("a", 2, "letter", "أ", 1, "(أ)"), ("a", 3, "number", "1", 2, "(أ)(1)"), ("a", 4, "bullet", "•", 3, "(أ)(1)"), ("a", 5, "number", "2", 2, "(أ)(2)"), ("a", 6, "letter", "ب", 1, "(ب)"),
    ("a", 7, "number", "1", 2, "(ب)(1)"), ("b", 1, "number", "1", 1, "(1)"), ("b", 2, "bullet", "•", 2, "(1)"), ("b", 3, None, None, 0, ""), ("b", 4, "number", "2", 1, "(2)"),
]


@query(f"SELECT doc, para_no::INTEGER AS para_no, level::INTEGER AS level, path FROM {values(PATHS, 'doc, para_no, kind, marker, level, path')}")
def heading_path_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and paths of paragraphs, against what is expected."""
    rows = literal(spark, [r[:4] for r in PATHS], "doc string, para_no int, kind string, marker string").withColumn("sec_no", F.lit(1)).withColumnRenamed("doc", "doc_id")
    return chunking.with_paths(rows).select(F.col("doc_id").alias("doc"), "para_no", "level", "path")


CHAIN = ["مقدمة", "1. التعريفات", "2. الأهداف", "نص البند الثاني", "3. الأهلية. 4. الرسوم", "5. المخاطر", "نص طويل", "7. التصفية", "8. الأحكام", "ملحق أول"]


def _chain_items(spark: SparkSession) -> DataFrame:
    rows = [("lit", t, "heading" if t.startswith("ملحق") else "paragraph") for t in CHAIN]
    return literal(spark, rows, "doc_id string, text string, type string").select("doc_id", F.col("no").alias("item_no"), F.concat(F.lit("p1-"), F.col("no").cast("string")).alias("id"), "type", "text", F.lit(1).alias("page"))


@query()
def clause_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of a small document with a gap, a glued title and an annex."""
    return segmentation.segment(_chain_items(spark)).select("clause_id", "section_type", "clause_number", "title", "word_count")


@query()
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the clauses of documents whose lines are the items."""
    return segmentation.segment_texts(documents(spark, sf_dir)).select("doc_id", "clause_id", "section_type", "part", "parts", "word_count", "oversize", "char_count")


@query(
    f"""WITH {LINES}, piped AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda c: trim(c)) AS cells, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM lines WHERE contains(line, '|')),
t AS (SELECT doc_id, run, min(line_no) AS first_line, count(*) AS n_rows, max(len(cells)) AS n_cols, arg_min(cells, line_no) AS head, sum(len(list_filter(cells, lambda c: c <> ''))) AS filled FROM piped GROUP BY doc_id, run)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_line))::INTEGER AS table_no, first_line::INTEGER AS first_line, n_rows, n_cols::INTEGER AS n_cols,
  n_rows >= 2 AND len(list_filter(head, lambda c: c <> '')) > 0 AND len(list_filter(head, lambda c: length(c) > 40 OR regexp_matches(c, '[0-9٠-٩%•●]'))) = 0 AS header, round(filled / (n_rows * n_cols)::DOUBLE, 4) AS fill FROM t"""
)
def pipe_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made of neighbouring lines with pipes."""
    return tables.pipe_tables(cleaning.lines(documents(spark, sf_dir), "doc_id"))


@query(
    f"""WITH {LINES}, piped AS (SELECT doc_id, line_no, len(string_split(line, '|')) AS n, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM lines WHERE contains(line, '|')),
t AS (SELECT doc_id, min(line_no) AS first_line, count(*) AS n_rows, max(n) AS n_cols FROM piped GROUP BY doc_id, run),
p AS (SELECT *, lag(n_cols) OVER w AS last_cols, lag(first_line + n_rows) OVER w AS last_end, row_number() OVER w AS table_no FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY first_line))
SELECT doc_id, table_no::INTEGER AS table_no, coalesce(last_cols = n_cols AND first_line - last_end <= 1, false) AS continues FROM p"""
)
def adjacent_table_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table goes on with the one before."""
    found = tables.pipe_tables(cleaning.lines(documents(spark, sf_dir), "doc_id"))
    return tables.continued(found).select("doc_id", "table_no", "continues")


@query(
    r"""WITH bare AS (SELECT page_id, regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>', ' ', 'gsi') AS h FROM pages),
found AS (SELECT page_id, unnest(r) AS raw, unnest(range(1, len(r) + 1)) AS item_no FROM (SELECT page_id, regexp_extract_all(h, '(?si)<((?:h1|p)[ >].*?)</(?:h1|p)>', 1) AS r FROM bare))
SELECT page_id, item_no::INTEGER AS item_no, CASE WHEN lower(raw[1:2]) = 'h1' THEN 'heading' ELSE 'paragraph' END AS type,
  trim(regexp_replace(regexp_replace(regexp_replace(raw, '^[^>]*>', '', 's'), '<[^>]*>', ' ', 'gs'), '[\s\p{Z}]+', ' ', 'g')) AS text FROM found"""
)
def html_block_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and paragraphs of web pages."""
    return tables.html_items(table(spark, sf_dir, "pages"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, len({S.words('text')}) AS w, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, section::BIGINT AS section, arg_min(role, turn) AS opened_by, count(*) AS parts, sum(w)::BIGINT AS words FROM t GROUP BY conv_id, section"""
)
def outline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as outlines: a user's turn opens a section, words are summed over its turns."""
    turns = table(spark, sf_dir, "conversations").withColumn("w", T.word_count(F.col("text")))
    numbered = cleaning.sessions(turns, "conv_id", "turn", F.col("role") == "user", name="section")
    return numbered.groupBy("conv_id", "section").agg(F.min_by("role", "turn").alias("opened_by"), F.count("*").alias("parts"), F.sum("w").alias("words"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, len({S.words('text')}) AS w FROM conversations),
tot AS (SELECT *, sum(w) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
gaps AS (SELECT conv_id, unnest(range(1, max(turn) + 1)) AS number FROM t GROUP BY conv_id)
SELECT conv_id, 'MISSING_NUMBERS' AS problem, number::BIGINT AS number FROM gaps WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.conv_id = gaps.conv_id AND t.turn = gaps.number)
UNION ALL SELECT conv_id, 'REPEATED_NUMBERS', turn FROM t GROUP BY conv_id, turn HAVING count(*) > 1
UNION ALL SELECT conv_id, 'HUGE_CLAUSE', turn FROM tot WHERE w > 0.35 * total AND n >= 5
UNION ALL SELECT conv_id, 'NO_CLAUSES', NULL FROM t GROUP BY conv_id HAVING count(*) < 5"""
)
def structure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and repeated turns, turns too large, conversations too short."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("clause").alias("section_type"), F.col("turn").cast("int").alias("clause_number"), F.lit("").alias("section_title"), T.word_count(F.col("text")).alias("words"), F.lit(False).alias("oversize"))
    return segmentation.problems(turns).select(F.col("doc_id").alias("conv_id"), "problem", F.col("number").cast("long").alias("number"))


@query(
    """WITH RECURSIVE e AS (
  SELECT conv_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN role = 'user' THEN 'set' WHEN length(text) > 400 THEN 'split' ELSE 'remove' END AS op,
    (turn % 5)::INTEGER AS number, turn::INTEGER AS line, role AS reason FROM conversations
),
s AS (
  SELECT doc_id, 0::BIGINT AS i, []::STRUCT(line INTEGER, number INTEGER, reason VARCHAR)[] AS st FROM (SELECT DISTINCT doc_id FROM e)
  UNION ALL
  SELECT s.doc_id, e.i, CASE WHEN op = 'remove' THEN list_filter(st, lambda x: x.number <> e.number)
    ELSE list_append(
      list_filter(list_transform(st, lambda x: {'line': CASE WHEN op = 'split' AND x.line > e.line THEN x.line + 1 ELSE x.line END, 'number': x.number, 'reason': x.reason}),
        lambda x: x.number <> e.number AND x.line <> CASE WHEN op = 'split' THEN e.line + 1 ELSE e.line END),
      {'line': CASE WHEN op = 'split' THEN e.line + 1 ELSE e.line END, 'number': e.number, 'reason': e.reason}) END
  FROM s JOIN e ON e.doc_id = s.doc_id AND e.i = s.i + 1
),
f AS (SELECT doc_id, unnest(st) AS x FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
SELECT doc_id, x.number AS number, x.line AS line, x.reason AS reason FROM f"""
)
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as edit logs: users set a start at their turn, long answers split, other answers remove."""
    turns = table(spark, sf_dir, "conversations")
    op = F.when(F.col("role") == "user", "set").when(F.length("text") > 400, "split").otherwise("remove")
    edits = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("seq"), op.alias("op"), (F.col("turn") % 5).cast("int").alias("number"), F.col("turn").cast("int").alias("line"), F.col("role").alias("reason"))
    return segmentation.replay(edits)


TITLES = """nth AS (SELECT p_partkey % 100 AS number, p_brand, p_name AS title, row_number() OVER (PARTITION BY p_brand, p_partkey % 100 ORDER BY p_partkey) - 1 AS r FROM part),
titles AS (SELECT p_brand || '/' || (r // 2)::BIGINT AS doc_id, number, title, r % 2 AS r FROM nth)"""


@query(
    f"""WITH {TITLES}, toc AS (SELECT doc_id, number, title FROM titles WHERE r = 0), body AS (SELECT doc_id, number, title FROM titles WHERE r = 1),
j AS (SELECT t.doc_id, t.number, t.title, b.title AS found, round(1.0::DOUBLE - levenshtein(t.title, b.title)::DOUBLE / greatest(length(t.title), length(b.title), 1), 4) AS similarity FROM toc t LEFT JOIN body b USING (doc_id, number))
SELECT doc_id, number, CASE WHEN found IS NULL THEN 'missing' WHEN similarity < {fixed.TOC_SIMILARITY} THEN 'mismatch' ELSE 'ok' END AS status, similarity FROM j"""
)
def toc_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of contents lists against the titles of bodies: of each brand's parts with one number, every second one is of a body."""
    return structure.validate(*_contents_and_bodies(spark, sf_dir), exact=False)


def _contents_and_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nth = F.row_number().over(Window.partitionBy("p_brand", "number").orderBy("p_partkey")) - 1
    parts = table(spark, sf_dir, "part").withColumn("number", F.col("p_partkey") % 100).withColumn("r", nth)
    titles = parts.select(F.concat_ws("/", "p_brand", F.floor(F.col("r") / 2).cast("string")).alias("doc_id"), "number", F.col("p_name").alias("title"), (F.col("r") % 2).alias("r"))
    return titles.where("r = 0").drop("r"), titles.where("r = 1").drop("r")


@query()
def toc_validation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As toc_validation, with the similarity of matching blocks."""
    return structure.validate(*_contents_and_bodies(spark, sf_dir))


CLEANED = [("المكتب الرئيس ي", "المكتب الرئيسي"), ("البند (ي) من", "البند (ي) من"), ("سیاسات ترکز", "سياسات تركز"), ("حةوق المالك", "حقوق المالك"), ("الفصل ........ 12", "الفصل ... 12"), ("كلمة ، أخرى", "كلمة، أخرى")]


@query(f"SELECT no, cleaned FROM {values(CLEANED, 'text, cleaned')}")
def faithful_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faithful version of texts, against what is expected."""
    return literal(spark, [r[:1] for r in CLEANED], "text string").select("no", U.clean(F.col("text")).alias("cleaned"))


SEARCHED = [("إلى ١٠٠", "الي 100"), ("مُحَمَّد", "محمد"), ("٣٫٥٪", "3.5٪")]


@query(f"SELECT no, searched FROM {values(SEARCHED, 'text, searched')}")
def search_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searched version of texts, against what is expected."""
    return literal(spark, [r[:1] for r in SEARCHED], "text string").select("no", U.for_search(F.col("text")).alias("searched"))
