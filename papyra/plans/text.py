"""Text analytics: normalising, counting, quality, vocabularies, noise, and literal rows for the Arabic rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed
from papyra.functions import markers as M
from papyra.functions import text as T
from papyra.operators import cleaning
from papyra.plans import sql as S
from papyra.plans.catalog import query
from papyra.sources.tables import documents


def literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows written down here, with their number ``no`` from 1."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"no int, {names}")


def values(rows: list[tuple], names: str) -> str:
    """The same rows as a SQL table expression."""

    def told(x: object) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(told(x) for x in (i, *r)) + ")" for i, r in enumerate(rows, 1))
    return f"(VALUES {body}) AS v(no, {names})"


@query(
    f"SELECT doc_id, sha256({S.normalize('text')}) AS digest, len(regexp_split_to_array(regexp_replace(text, '([.؛])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)))::INTEGER AS n_sentences FROM documents"
)
def search_normalize_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each normalised text, and its number of sentences."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.sha2(T.search_normalize(F.col("text")), 256).alias("digest"), F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query(f"SELECT doc_id, len({S.tokens('text')})::INTEGER AS n_tokens, len(list_distinct({S.tokens('text')}))::INTEGER AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens of each document, and how many differ."""
    docs = documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(
    f"SELECT doc_id, len({S.words('text')})::INTEGER AS n_words, length(regexp_replace(text, '{S.SPACE}', '', 'g'))::INTEGER AS n_chars, substr(string_split(text, chr(10))[1], 1, 120) AS first_line FROM documents"
)
def word_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, characters and first line of each document."""
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.word_count(text).alias("n_words"), T.char_count(text).alias("n_chars"), T.first_line(text).alias("first_line"))


@query(
    """WITH d AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]'))::BIGINT AS a, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS l, len(regexp_extract_all(text, '[À-ÿ]'))::BIGINT AS x FROM documents)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE a > l) AS right_to_left, sum(l)::BIGINT AS latin, sum(x)::BIGINT AS accented FROM d GROUP BY lang"""
)
def script_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by script, and documents written right to left, by language."""
    text = F.col("text")
    docs = documents(spark, sf_dir).select("lang", T.is_right_to_left(text).alias("rtl"), T.count_of(text, "[A-Za-z]").alias("l"), T.count_of(text, "[À-ÿ]").alias("x"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if("rtl").alias("right_to_left"), F.sum("l").alias("latin"), F.sum("x").alias("accented"))


@query(
    f"""WITH c AS (SELECT doc_id, regexp_replace(text, '{S.SPACE}', '', 'g') AS t, {S.words('text')} AS w FROM documents),
r AS (
  SELECT doc_id, length(t)::DOUBLE AS n, len(regexp_extract_all(t, '[\\x{{FFFD}}\\p{{Cc}}\\p{{Co}}]'))::DOUBLE / length(t) AS garbage, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]'))::DOUBLE / length(t) AS letters,
    CASE WHEN len(w) >= 10 THEN len(list_filter(w, lambda x: length(x) = 1 AND regexp_matches(x, '^\\p{{L}}$') AND NOT regexp_matches(x, '^[وأإاAaIi]$')))::DOUBLE / len(w) ELSE 0.0::DOUBLE END AS singles FROM c
)
SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - least(0.6::DOUBLE, garbage * 6) - CASE WHEN singles > 0.10 THEN least(0.4::DOUBLE, (singles - 0.10::DOUBLE) * 1.5::DOUBLE) ELSE 0.0::DOUBLE END - CASE WHEN n >= 30 AND letters < 0.55 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)), 3) END AS score,
  CASE WHEN n = 0 THEN 'EMPTY' ELSE concat_ws(',', CASE WHEN garbage > 0.02 THEN 'GARBAGE_CHARS' END, CASE WHEN singles > 0.25 THEN 'FRAGMENTED_TOKENS' END, CASE WHEN n >= 30 AND letters < 0.55 THEN 'LOW_LETTER_RATIO' END) END AS flags
FROM r"""
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and flags of each document's text."""
    docs = documents(spark, sf_dir).select("doc_id", T.quality(F.col("text")).alias("q"))
    return docs.select("doc_id", F.col("q.score").alias("score"), F.array_join("q.flags", ",").alias("flags"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS word FROM documents) GROUP BY word")
def vocab_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word and how often it occurs."""
    return cleaning.unigrams(documents(spark, sf_dir))


@query(
    f"""WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
p AS (SELECT unnest(list_zip(ws, ws[2:])) AS p FROM w WHERE len(ws) > 1)
SELECT p[1] AS first, p[2] AS second, count(*) AS n FROM p WHERE p[2] IS NOT NULL GROUP BY ALL"""
)
def vocab_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring words and how often it occurs."""
    return cleaning.bigrams(documents(spark, sf_dir))


LINES = "lines AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
KEY = f"lower({S.collapse('regexp_replace(line, $$\\d+$$, $$#$$, $$g$$)')})"


@query(
    f"""WITH {LINES}, keyed AS (SELECT *, {KEY} AS key FROM lines),
n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM keyed GROUP BY source),
heads AS (SELECT source, key, count(DISTINCT doc_id) AS on_pages FROM keyed WHERE length(line) <= 200 AND length(key) >= 2 GROUP BY source, key)
SELECT source, key, on_pages FROM heads JOIN n USING (source) WHERE pages >= 3 AND on_pages >= greatest(3, ceil(0.02 * pages))"""
)
def repeated_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur on many pages (documents) of a file (source), by their key: running heads and feet."""
    return cleaning.running_lines(cleaning.lines(documents(spark, sf_dir), "source", "doc_id"), "source", "doc_id", share=0.02)


@query(
    f"""WITH {LINES}, digits AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS r FROM lines WHERE regexp_matches(trim(line), '^[^a-zA-Z]*[0-9]+[^a-zA-Z]*$'))
SELECT doc_id, count(*) AS n_lines, max(CASE WHEN r = 1 THEN line_no END)::INTEGER AS dropped FROM lines LEFT JOIN digits USING (doc_id, line_no) GROUP BY doc_id"""
)
def last_digit_line_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page the number of its last line without letters but with digits: its page number, which is dropped."""
    lines = cleaning.lines(documents(spark, sf_dir), "doc_id")
    found = cleaning.last_matching(lines, "doc_id", F.trim("line").rlike("^[^a-zA-Z]*[0-9]+[^a-zA-Z]*$"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.when(F.col("last"), F.col("line_no"))).alias("dropped"))


NOISE = """CASE WHEN regexp_matches(trim(line), '^(-?[0-9]{1,2}-?|\\(\\.\\.\\.\\)|\\.{3,})$') THEN 'empty_row' WHEN regexp_matches(line, '[.…]{4,}\\s*[0-9]+\\s*$') THEN 'contents'
  WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '\\|') THEN 'table' END"""


@query(f"WITH {LINES} SELECT source, {NOISE} AS category, count(*) AS n FROM lines WHERE {NOISE} IS NOT NULL GROUP BY ALL")
def noise_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each category of noise, by file."""
    return cleaning.noise_counts(cleaning.lines(documents(spark, sf_dir), "source"), "source")


PARAGRAPH_MARKS = [("أ) شروط الطرح",), ("(ب) نطاق",), ("(12) بند",), ("3- رقم",), ("4. رقم",), ("• نقطة",), ("أولا: تمهيد",), ("نص بلا علامة",), ("",), ("2030",)]


@query(
    f"""SELECT no, text, CASE WHEN regexp_matches(text, '^\\(?[ء-ي]ـ?\\)') THEN 'letter' WHEN regexp_matches(text, '^\\(\\d{{1,3}}\\)') THEN 'number' WHEN regexp_matches(text, '^\\d{{1,3}}\\s*[).\\-]') THEN 'number'
  WHEN regexp_matches(text, '^[•▪o]\\s+') THEN 'bullet' WHEN regexp_matches(text, '^({'|'.join(fixed.ORDINAL_ADVERBS)})\\s*:') THEN 'ordinal_word' END AS kind,
  CASE WHEN regexp_matches(text, '^\\(?[ء-ي]ـ?\\)') THEN regexp_extract(text, '^\\(?([ء-ي])', 1) WHEN regexp_matches(text, '^\\(\\d{{1,3}}\\)') THEN regexp_extract(text, '^\\((\\d+)', 1) WHEN regexp_matches(text, '^\\d{{1,3}}\\s*[).\\-]') THEN regexp_extract(text, '^(\\d+)', 1)
  WHEN regexp_matches(text, '^[•▪o]\\s+') THEN '•' WHEN regexp_matches(text, '^({'|'.join(fixed.ORDINAL_ADVERBS)})\\s*:') THEN regexp_extract(text, '^([^:\\s]+)', 1) END AS marker
FROM {values(PARAGRAPH_MARKS, 'text')}"""
)
def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opens a paragraph, one row for each kind."""
    found = literal(spark, PARAGRAPH_MARKS, "text string").withColumn("m", M.paragraph_marker(F.col("text")))
    return found.select("no", "text", F.col("m.kind").alias("kind"), F.col("m.marker").alias("marker"))


ITEMS = [
    ("6.2 منهجية العمليات الاستثمارية للصندوق:", "heading", "6.2", 2), ("1. حجم الإيرادات", "list_item", "1", None), ("2030", "paragraph", None, None),
    ("المادة الخامسة: نطاق التطبيق", "heading", "المادة الخامسة", 1), ("(3) يجب أن يكون", "heading", "3", 1), ("• نقطة أولى", "list_item", "•", None),
    ("مدير الصندوق", "heading", None, None), ("يجب على مدير الصندوق أن يلتزم بما يلي.", "paragraph", None, None), ("أ- البند الأول", "list_item", "أ", None),
    ("7 عنوان بدون نقطة", "heading", "7", 1),
]


@query(f"SELECT no, text, type, marker, level::INTEGER AS level FROM {values(ITEMS, 'text, type, marker, level')}")
def item_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, marker and level of items, against what is expected of each."""
    found = literal(spark, [r[:1] for r in ITEMS], "text string").withColumn("t", M.item_type(F.col("text")))
    return found.select("no", "text", "t.type", "t.marker", "t.level")


STYLES = [
    ("(3) نص", "number", "paren", 3), ("(ب) نص", "letter", "paren", 2), (")4( نص", "number", "paren", 4), ("5) نص", "number", "close", 5), ("ج( نص", "letter", "close", 3),
    ("6. نص", "number", "dot", 6), ("6.2 نص", None, None, None), ("7- نص", "number", "dash", 7), ("- 8 نص", "number", "dash", 8), ("ه – نص", "letter", "dash", 5), ("9 نص", "number", "plain", 9),
    ("100 نص", None, None, None), ("نص بلا رقم", None, None, None),
]


@query(f"SELECT no, text, kind, style, value::INTEGER AS value FROM {values(STYLES, 'text, kind, style, value')}")
def read_marker_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each style of list number, against what is expected."""
    found = literal(spark, [r[:1] for r in STYLES], "text string").withColumn("m", M.list_marker(F.col("text")))
    return found.select("no", "text", "m.kind", "m.style", "m.value")


ORDINALS = [("الأولى", 1), ("الثالثة والتسعون", 93), ("الثانية عشرة", 12), ("العاشرة بعد المئة", 110), ("الحادية والعشرون", 21), ("كلمة", None), ("عشر", None), ("المئة", 100)]


@query(f"SELECT no, phrase, value::INTEGER AS value FROM {values(ORDINALS, 'phrase, value')}")
def ordinal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal phrases as numbers, against what is expected."""
    return literal(spark, [r[:1] for r in ORDINALS], "phrase string").withColumn("value", M.ordinal(F.col("phrase")))


ARABIC = [("والصندوقِ للاستثمار بالوحدات",), ("إلى المادّة",), ("ال و بال",), ("الحـــوكمة في الشركات، والإفصاح",), ("كالمال فالمدير لله",)]


@query(f"SELECT no, text, array_to_string({S.tokens('text')}, ' ') AS tokens FROM {values(ARABIC, 'text')}")
def arabic_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens of Arabic phrases."""
    return literal(spark, ARABIC, "text string").withColumn("tokens", F.array_join(T.tokens(F.col("text")), " "))


@query(
    f"""WITH {LINES}, flags AS (SELECT doc_id, line_no, line, CASE WHEN line_no = 1 OR regexp_matches(line, '^[A-ZÀ-Þ]') THEN 1 ELSE 0 END AS opens FROM lines WHERE trim(line) <> ''),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM flags)
SELECT doc_id, paragraph::BIGINT AS paragraph, count(*) AS n_lines, min(line_no)::INTEGER AS first_line, sum(len({S.words('line')}))::BIGINT AS n_words FROM grouped GROUP BY doc_id, paragraph"""
)
def paragraph_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to paragraphs: a line that begins with a capital opens one."""
    lines = cleaning.lines(documents(spark, sf_dir), "doc_id").where(F.trim("line") != "")
    opens = (F.col("line_no") == 1) | F.col("line").rlike("^[A-ZÀ-Þ]")
    grouped = cleaning.sessions(lines, "doc_id", "line_no", opens, name="paragraph")
    return grouped.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.sum(T.word_count(F.col("line"))).alias("n_words"))


@query(
    f"""WITH s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.؛])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
e AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(1, len(parts) + 1)) AS no FROM s)
SELECT doc_id, no::INTEGER AS no, len({S.words('sentence')})::INTEGER AS n_words, md5(sentence) AS digest FROM e"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence, its words and digest."""
    parts = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence"))
    return parts.select("doc_id", (F.col("p") + 1).alias("no"), T.word_count(F.col("sentence")).alias("n_words"), F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query(
    f"""WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, greatest(1, ceil(len(ws) / 300.0))::BIGINT)) AS k FROM w)
SELECT doc_id, (k + 1)::INTEGER AS piece, md5(array_to_string(ws[k * 300 + 1 : (k + 1) * 300], ' ')) AS digest FROM p"""
)
def hard_word_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into pieces of 300 words."""
    pieces = documents(spark, sf_dir).select("doc_id", F.posexplode(T.cut_words(F.col("text"), fixed.MAX_WORDS)).alias("p", "piece"))
    return pieces.select("doc_id", (F.col("p") + 1).alias("piece"), F.md5(F.col("piece").cast("binary")).alias("digest"))


LEXICON = [("كتاب", 9), ("كتيب", 2), ("مدير", 7), ("مدبر", 5), ("بيان", 4), ("صيانة", 6), ("صبانة", 0)]
ASKED = [("كتبب",), ("مديز",), ("مدبز",), ("كتاب",), ("صبانة",), ("صبابة",)]
SWAPPED = [("كتبب", None), ("مديز", None), ("مدبز", None), ("كتاب", None), ("صبانة", "صيانة"), ("صبابة", None)]


@query(f"SELECT no, word, fixed FROM {values(SWAPPED, 'word, fixed')}")
def lexicon_swap_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words that one swap of ba and ya turns into exactly one word of the lexicon."""
    lexicon = literal(spark, [r for r in LEXICON if r[1]], "word string, n int").select("word", "n")
    return cleaning.swap_letters(literal(spark, ASKED, "word string"), lexicon).select("no", "word", "fixed")
