"""Text, structure, chunking, segmentation, cleaning, layout, sources, sinks and streams."""

import datetime
import io
import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from papyra.functions import markers, repair
from papyra.functions import text as T
from papyra.functions import unicode as U
from papyra.operators import chunking, cleaning, evaluate, layout, segmentation, service, structure, tables
from papyra.sources import readers, writers
from papyra.streaming import status


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("والصندوق", ["صندوق"]), ("بالوحدة", ["وحده"]), ("الى", ["الي"]), ("لله", ["لله"]), ("ab c", ["ab"]), ("", []), ("الصَّندُوق ـ", ["صندوق"]), ("x_1 y-2", ["x_1"])],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokens, text) == tokens


def test_text_functions(spark):
    assert one(spark, T.search_normalize, " إلى  مدرسة، مؤمن؟ ") == "الي مدرسه مومن"
    assert one(spark, lambda c: T.shorten(c, 5), "ab\ncdefg") == "ab cd …"
    assert one(spark, T.title_part, "Name: rest\nmore") == "Name:"
    assert one(spark, T.word_count, "  a b\tc ") == 3 and one(spark, T.word_count, "") == 0
    assert one(spark, lambda c: T.pack_sentences(c, 4), "a b. c d. e f g h i j. k") == ["a b. c d.", "e f g h", "i j.", "k"]
    assert one(spark, lambda c: T.cut_words(c, 2), "a b c") == ["a b", "c"]
    assert one(spark, T.header_key, "Page  ١٢ of 30") == "page # of #"
    q = one(spark, T.quality, "".join("�x" for _ in range(40)))
    assert q.score < 0.5 and "GARBAGE_CHARS" in q.flags
    turned = " ".join(w[::-1] for w in ("الصندوق", "الهيئة", "المادة", "المالية"))
    assert "REVERSED_ARABIC" in one(spark, T.quality, turned).flags
    assert one(spark, T.quality, " ").flags == ["EMPTY"] and one(spark, T.quality, None).flags == ["EMPTY"]


def test_markers_agree_with_the_plain_versions(spark):
    letters = [("أ) x", ("letter", "أ")), ("(ب) x", ("letter", "ب")), ("(12) x", ("number", "12")), ("3- x", ("number", "3"))]
    for text, want in [*letters, ("• x", ("bullet", "•")), ("أولا: x", ("ordinal_word", "أولا")), ("x", None), ("2030", None)]:
        got = one(spark, markers.paragraph_marker, text)
        assert (None if got is None else (got.kind, got.marker)) == want
    for text in ("(3) x", ")4( x", "5) x", "6. x", "6.2 x", "7- x", "- 8 x", "ه – x", "9 x", "100 x", "x"):
        got = one(spark, markers.list_marker, text)
        assert (None if got is None else (got.kind, got.style, got.value)) == segmentation.marker_of(text)
    for text, want in (("الأولى", 1), ("الثالثة والتسعون", 93), ("الثانية عشرة", 12), ("كلمة", None), ("عشر", None)):
        assert one(spark, markers.ordinal, text) == want


def test_clean_versions(spark):
    assert one(spark, U.clean, "ﻣﺪﻳﺮ‏ \r\nسطر") == "مدير\nسطر"
    assert one(spark, U.for_search, "أُسُسٌ ١٢") == "اسس 12"
    assert one(spark, U.corpus_form, "( 1 - 219 - 2006 ) نص  ،") == "(1-219-2006) نص،"
    assert one(spark, U.corpus_form, "300,000–100,001 •") == "• 100,001–300,000"
    assert one(spark, lambda c: U.similarity(c, F.lit("abcd")), "abxd") == pytest.approx(0.75)


P = chunking.Paragraph


def test_packing():
    many = [P(" ".join(["w"] * n), level=1) for n in (100, 100, 100, 100)]
    chunks = chunking.pack(*chunking.pieces(many, 300), 300)
    assert [c.size for c in chunks] == [200, 200]  # two parts of 200 at most 241, not 300 and 100
    exact = chunking.pack(*chunking.pieces([P("w " * 300)], 300), 300)
    assert [c.size for c in exact] == [300]
    lead = [P("the lead:", level=1, path="(a)"), *[P("s " * 200, level=2, path=f"(a)({i})") for i in (1, 2)]]
    chunks = chunking.pack(*chunking.pieces(lead, 300), 300)
    assert [c.context for c in chunks] == [None, "the lead:"] and chunks[0].paragraphs[0].text == "the lead:"
    intro = [P("Introduction:"), *[P("x " * 250, level=1) for _ in range(2)]]
    chunks = chunking.pack(*chunking.pieces(intro, 300), 300)
    assert [c.context for c in chunks] == [None, "Introduction:"]
    long = chunking.pack(*chunking.pieces([P("y " * 700)], 300), 300)
    assert sum(c.size for c in long) == 700 and max(c.size for c in long) <= 300
    assert chunking.pack([], None, 300) == []


def test_paths_as_windows_and_as_a_loop(spark):
    kinds = ["letter", "number", "bullet", None, "number", "letter", "bullet", "number", "ordinal_word"]
    marks = ["أ", "1", "•", None, "2", "ب", "•", "1", "أولا"]
    rows = [("d", 1, i, k, m) for i, (k, m) in enumerate(zip(kinds, marks, strict=True), 1)] + [("d", 2, 1, "number", "1"), ("d", 2, 2, "bullet", "•")]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, para_no int, kind string, marker string")
    got = [(r.level, r.path) for r in chunking.with_paths(df).orderBy("sec_no", "para_no").collect()]
    assert got == chunking.paths(kinds, marks) + chunking.paths(["number", "bullet"], ["1", "•"])


def test_chunks_and_their_columns(spark):
    rows = [("d", 1, 1, "intro[^3]:", 0, "", False), ("d", 1, 2, "w " * 200, 1, "(أ)", False), ("d", 1, 3, "v " * 200, 1, "(ب)", False), ("e", 1, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, sec_no int, para_no int, text string, level int, path string, is_subheading boolean")
    got = chunking.chunk_sections(df)
    told = got.where("doc_id = 'd'").orderBy("chunk_index").select(
        "chunk_index", "chunk_count", "context", chunking.citation(F.lit("T"), F.lit("L"), chunking.top_labels(F.col("paths")), F.col("chunk_count")).alias("cite"),
        chunking.chunk_id(F.lit("IFR"), F.lit("article"), F.lit("7"), F.lit(1), F.col("chunk_index")).alias("cid"), chunking.chunk_text(F.lit("crumb"), F.col("chunk_index"), F.col("chunk_count"), F.col("context"), F.lit("body")).alias("text"),
    ).collect()
    assert [(r.chunk_index, r.chunk_count, r.context) for r in told] == [(1, 2, None), (2, 2, "intro:")]
    assert told[1].cite == "T، L، الفقرة (ب)" and told[0].cid == "IFR-art007-c01"
    assert told[1].text == "[crumb (الجزء 2 من 2)]\n(سياق: intro:)\nbody"


I = segmentation.Item


def items(*texts, kind="paragraph"):
    return [I(f"p1-{n}", "heading" if t.startswith("ملحق") else kind, t, 1) for n, t in enumerate(texts, 1)]


def numbers(texts):
    chain, _ = segmentation.main_chain(items(*texts))
    return list(chain.values())


def test_clause_chains():
    assert numbers(["1. a", "2. b", "4. c", "5. d", "6. e"]) == [1, 2, 4, 5, 6]  # one number missing
    assert numbers(["1. a", "2. b", "5. c", "6. d", "7. e"]) == [1, 2, 5, 6, 7]  # two
    assert numbers(["1. a", "2. b", "6. c", "7. d", "8. e"]) == []  # three aren't bridged
    assert numbers(["1. a", "2. b", "3. c", "4. d"]) == []
    assert numbers(["1. a", "2. item in a list.", "x", "2. title", "3. c", "4. d", "5. e"]) == [1, 2, 3, 4, 5]
    chain, style = segmentation.main_chain(items("1. a", "2. item.", "2. title", "3. c", "4. d", "5. e"))
    assert chain == {0: 1, 2: 2, 3: 3, 4: 4, 5: 5} and style == ("number", "dot")
    assert numbers(["(أ) a", "(ب) b", "(ج) c", "(د) d", "(ه) e"]) == [1, 2, 3, 4, 5]


def test_glued_and_table_titles():
    item = I("p", "paragraph", "نهاية النص. 3. الرسوم")
    before, title = segmentation.glued_title(item, ("number", "dot"), 3)
    assert before.text == "نهاية النص." and title.text == "3. الرسوم" and title.id == "p-t" and title.type == "heading"
    assert segmentation.glued_title(item, ("number", "dot"), 4) is None
    table = I("t", "table", "", rows=(("a", "b"), ("", "3. الرسوم"), ("c", "d")))
    before, title, after = segmentation.table_title(table, ("number", "dot"), 3)
    assert before.rows == (("a", "b"),) and title.text == "3. الرسوم" and after.rows == (("c", "d"),) and after.id == "t-b"


def test_segmenting(spark):
    rows = segmentation.clauses_of("doc", items("front", "1. a", "body", "2. b", "3. cc. 4. dd", "5. e", "6. f", "ملحق 1", "7. not a clause"))
    assert [(r["section_type"], r["clause_number"]) for r in rows] == [("front", None), *[("clause", n) for n in range(1, 7)], ("annex", None)]
    assert rows[1]["content"] == "1. a\nbody" and rows[-1]["content"].endswith("7. not a clause")
    long = segmentation.clauses_of("doc", items("1. a", "w " * 700, "2. b", "3. c", "4. d", "5. e"))
    assert [r["parts"] for r in long if r["clause_number"] == 1] == [4, 4, 4, 4] and not any(r["oversize"] for r in long)
    df = spark.createDataFrame([("d", n, x.id, x.type, x.text, x.page) for n, x in enumerate(items("front", "1. a", "2. b", "3. c", "4. d", "6. e"))] + [("e", 1, "p", None, None, None)], "doc_id string, item_no int, id string, type string, text string, page int")
    clauses = segmentation.segment(df)
    assert clauses.where("doc_id = 'd'").count() == 6 and clauses.where("doc_id = 'e'").count() == 0
    told = {(r.problem, r.number) for r in segmentation.problems(segmentation.outline(clauses)).collect()}
    assert ("MISSING_NUMBERS", 5) in told


def test_edit_replay(spark):
    edits = [("d", 1, "set", 1, 0), ("d", 2, "set", 2, 5), ("d", 3, "split", 3, 2), ("d", 4, "set", 2, 9), ("d", 5, "remove", 1, 0), ("d", 6, "set", 7, 9)]
    df = spark.createDataFrame([(*e, "why") for e in edits], "doc_id string, seq int, op string, number int, line int, reason string")
    assert sorted((r.number, r.line) for r in segmentation.replay(df).collect()) == [(3, 3), (7, 9)]


def test_hierarchy(spark):
    texts = [("الباب الأول: أحكام", 18), ("المادة الأولى: التعريفات", 14), ("أ) نص أول.", 14), ("1) فرع.", 14), ("المادة الثانية: النطاق", 14), ("نص[^1] يستمر", 14), ("الملحق 1: نموذج", 18), ("نص الملحق.", 14)]
    rows = [("d", n, 1, t, float(s), 100.0, 520.0, 14.0) for n, (t, s) in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, page int, text string, size double, x0 double, x1 double, body_size double")
    got = structure.detach_annexes(structure.paragraphs(lines)).orderBy("sec_no", "para_no").collect()
    assert [(r.type, r.number, r.part_number, r.marker) for r in got] == [("article", "1", 1, "أ"), ("article", "1", 1, "1"), ("article", "2", 1, None), ("annex", "1", None, None)]
    notes = spark.createDataFrame([("d", 1, "فقرة استرشادية")], "doc_id string, n int, text string")
    df = spark.createDataFrame(got, structure.detach_annexes(structure.paragraphs(lines)).schema)
    assert [r.n for r in structure.footnotes_of(df, notes).collect()] == ["1"]
    sections = spark.createDataFrame([("d", 1, ["1"]), ("d", 2, [])], "doc_id string, sec_no int, heading_notes array<string>")
    assert {r.sec_no: r.binding_status for r in structure.binding_status(sections, notes).collect()} == {1: "guidance", 2: "mandatory"}
    articles = spark.createDataFrame([("d", 1, 1, "x"), ("d", 2, 2, "y")], "doc_id string, sec_no int, number int, title string")
    assert structure.continuous(articles).first().continuous
    contents = spark.createDataFrame([("d", 1, "x"), ("d", 2, "completely"), ("d", 3, "z")], "doc_id string, number int, title string")
    assert {r.number: r.status for r in structure.validate(contents, articles).collect()} == {1: "ok", 2: "mismatch", 3: "missing"}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    rows = [("a b c", "a x c d"), ("", "one"), (None, None), ("same words", "same words"), ("w " * 50 + "é", " ".join(f"v{i}" for i in range(300))), ("ä ö", "a ö")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select("i", U.word_error_rate(F.col("a"), F.col("b")).alias("wer"), evaluate.character_error_rate(F.col("a"), F.col("b")).alias("cer"))
    for r in got.collect():
        a, b = rows[r.i]
        left, right = (a or "").split(), (b or "").split()
        assert r.wer == pytest.approx(plain_distance(left, right) / max(1, len(left)))
        if a is not None:
            assert r.cer == pytest.approx(plain_distance(a, b) / max(1, len(a)))


def test_word_error_rates_of_the_query(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn))
    want = {(b.conv_id, b.turn): round(plain_distance(a.text.split(), b.text.split()) / max(1, len(a.text.split())), 6) for a, b in itertools.pairwise(rows) if a.conv_id == b.conv_id}
    assert {(r.conv_id, r.turn): pytest.approx(r.wer) for r in __spark_entry__.queries()["wer_adjacent_turns"](spark, sf).collect()} == want


LINES = "doc_id string, line_no int, page int, text string, size double, x0 double, x1 double, body_size double"


def read_lines(spark, *lines):
    """Paragraph rows of (text, size, x0, x1) lines on pages of two lines."""
    return structure.paragraphs(spark.createDataFrame([("d", n, n // 2, *x, 14.0) for n, x in enumerate(lines)], LINES)).orderBy("sec_no", "para_no").collect()


def test_headings_go_on_below(spark):
    wide, mid = (14.0, 100.0, 520.0), (18.0, 250.0, 370.0)
    got = read_lines(
        spark, ("الباب الأول", *mid), ("أحكام", *mid), ("عامة", *mid), ("الفصل الثاني", *mid), ("عنوان", *mid), ("نص قبل المادة", *wide),
        ("المادة الأولى: تعريفات[^1]", *wide), ("واسعة", 14.0, 300.0, 520.0), ("نص المادة.", *wide), ("الثالثة: ليست مادة", *wide), ("الثانية: النطاق", *wide), ("نص.", *wide),
        ("الباب الثاني: آخر", *mid), ("المادة الثالثة: بلا نص", *wide), ("الملحق (1 - 2) (أ)", 18.0, 100.0, 370.0), ("نموذج", *mid), ("نص", *wide),
    )
    assert [(r.sec_no, r.type, r.number, r.title, r.part_title, r.chapter_title, r.repaired, r.para_no) for r in got] == [
        (1, "preamble", None, "عنوان", "أحكام عامة", "عنوان", False, 1),
        (2, "article", "1", "تعريفات واسعة", "أحكام عامة", "عنوان", False, 1),
        (3, "article", "2", "النطاق", "أحكام عامة", "عنوان", True, 1),
        (4, "article", "3", "بلا نص", "آخر", None, False, None),
        (5, "annex", "1-2(أ)", "نموذج", "آخر", None, False, 1),
    ]
    assert got[1].text == "نص المادة. الثالثة: ليست مادة" and got[1].heading_notes == ["1"] and got[1].section_pages == [3, 4] and got[1].pages == [4]
    assert got[4].label == "الملحق 1-2 (أ)"


def test_paragraphs_open(spark):
    full, short = (14.0, 100.0, 520.0), (14.0, 300.0, 520.0)
    got = read_lines(spark, ("أول سطر", *full), ("(1) يتبع سطرا كاملا", *full), ("سطر قصير", *short), ("(2) بعد قصير", *full), ("ينتهي:", *full), ("3) بعد نقطتين", 14.0, 100.0, 400.0), ("نص", *full), ("أ) عند الهامش", *full), ("عنوان", 18.0, 100.0, 520.0), ("يليه", 18.0, 100.0, 520.0))
    assert [(r.para_no, r.kind, r.marker, r.is_subheading, r.text) for r in got] == [
        (1, None, None, False, "أول سطر (1) يتبع سطرا كاملا سطر قصير"), (2, "number", "2", False, "(2) بعد قصير ينتهي:"), (3, "number", "3", False, "3) بعد نقطتين نص"),
        (4, "letter", "أ", False, "أ) عند الهامش"), (5, None, None, True, "عنوان يليه"),
    ]
    assert read_lines(spark) == []
    assert [r.type for r in read_lines(spark, (None, None, None, None))] == ["preamble"]


def test_paragraphs_have_a_status_of_their_own(spark):
    rows = spark.createDataFrame([("d", 1, 1, "x[^1]"), ("d", 1, 2, "y[^2] z[^1]"), ("d", 1, 3, "y"), ("d", 2, None, None)], "doc_id string, sec_no int, para_no int, text string")
    notes = spark.createDataFrame([("d", 1, "فقرة استرشادية"), ("d", 2, "أصبحت إلزامية")], "doc_id string, n int, text string")
    assert {(r.sec_no, r.para_no): r.binding_status for r in structure.paragraph_binding(rows, notes).collect()} == {(1, 1): "guidance", (1, 2): "guidance"}


def test_running_heads(spark):
    pages = [("f", p, 1, f"Report 2024 page {p}") for p in range(5)] + [("f", p, 2, f"text {'abcde'[p]}") for p in range(5)] + [("f", 0, 3, "- 7 -")]
    df = spark.createDataFrame(pages, "file string, page int, line_no int, line string")
    assert sorted(r.line for r in cleaning.without_running_lines(df, "file", "page").collect()) == [f"text {c}" for c in "abcde"]
    assert cleaning.running_lines(df.where("page < 2"), "file", "page").collect() == []
    sizes = spark.createDataFrame([("d", "abc", 10.0), ("d", "abcdef", 12.0), ("d", "abc", 10.0)], "doc_id string, text string, size double")
    assert cleaning.body_size(sizes).first().body_size == 10.0


def test_repairs():
    assert repair.stretched("المبالغ م سسسستحقة", {"مستحقة": 3}) == "المبالغ مستحقة"
    assert repair.stretched("سسسسم", {}) == "سسسسم" and repair.stretched("نص", {}) == "نص"
    words = {"وفحص": 2, "الطلبات": 3, "في": 9, "الصندوق": 5}
    assert repair.split_words("وف حص الطلبات", words, {("وف", "حص"): 1}) == "وفحص الطلبات"
    assert repair.split_words("في الصندوق", {**words, "فيالصندوق": 9}, {}) == "في الصندوق"


def test_raised_digits_are_footnote_marks(spark):
    def glyphs(text, x, top, size, seq=0):
        return [("d", 1, c, x + n * size, top, x + (n + 1) * size, top + size, seq + n) for n, c in enumerate(text)]

    rows = glyphs("Fund", 0.0, 100.0, 10.0) + glyphs("12", 41.0, 99.0, 5.0, 4) + glyphs("x", 60.0, 100.0, 10.0, 6)  # within the line
    rows += glyphs("Rule", 0.0, 200.0, 10.0, 10) + glyphs("7", 41.0, 196.0, 4.0, 14)  # a line of its own
    rows += glyphs("99", 0.0, 300.0, 4.0, 20) + glyphs("1990", 0.0, 400.0, 10.0, 30)  # alone, and as large as its line
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, seq int")
    assert [r.text for r in layout.lines_of(df).orderBy("line_no").collect()] == ["Fund [^12] x", "Rule [^7]", "99", "1990"]


def test_geometry(spark):
    G = layout.Glyph
    line = [G("ب", 30, 0, 38, 10), G("ا", 20, 0, 28, 10), G("1", 0, 0, 5, 10), G("2", 6, 0, 11, 10), G("َ", 31, 0, 37, 4)]
    assert layout.line_text(line) == "بَا 12"
    assert layout.line_text([G("H", 0, 0, 5, 9), G("i", 6, 0, 9, 9)]) == "Hi"
    assert [len(x) for x in layout.glyph_lines([G("a", 0, 0, 5, 10), G("b", 9, 3, 14, 12), G("c", 0, 30, 5, 40)])] == [2, 1]
    words = spark.createDataFrame([("d", 1, 1, "a", 0.0, 0.0, 10.0, 10.0, 0.5), ("d", 1, 2, "bb", 100.0, 0.0, 120.0, 10.0, 1.0), ("d", 1, 3, "c", 0.0, 40.0, 9.0, 50.0, 0.9)], "doc_id string, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    rows = layout.rows_of_words(words).orderBy("row_no").collect()
    assert [r.text for r in rows] == ["a | bb", "c"] and rows[0].conf == pytest.approx((0.5 + 2.0) / 3)
    blocks = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, 14.0, 1.0, 30.0, 9.0), ("d", 1, 3, 0.0, 50.0, 9.0, 60.0)], "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_no: r.merged for r in layout.merged_blocks(blocks).collect()} == {1: 1, 2: 1, 3: 3}
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    glyphs = spark.createDataFrame([("d", 1, 1, (1.0, 1.0, 2.0, 2.0)), ("d", 1, 2, (90.0, 90.0, 91.0, 91.0))], f"doc_id string, page int, glyph int, box {box}")
    cells = spark.createDataFrame([("d", 1, 1, (0.0, 0.0, 50.0, 50.0)), ("d", 1, 2, (0.0, 0.0, 5.0, 5.0))], f"doc_id string, page int, cell int, box {box}")
    assert {r.glyph: r.cell for r in layout.smallest_cell(glyphs, cells).collect()} == {1: 2, 2: None}
    left = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["z"]), ("d", 3, ["e", "f"]), ("d", 4, ["a", "b"])], "doc_id string, block_no int, words array<string>")
    right = spark.createDataFrame([("d", 1, ["a", "b", "c"]), ("d", 2, ["e", "f"])], "doc_id string, page int, words array<string>")
    assert [r.page for r in layout.page_of_blocks(left, right).orderBy("block_no").collect()] == [1, 1, 2, 2]
    kinds = spark.createDataFrame([("docx", 3, 0), ("pdf", 4, 2), ("pdf", 4, 1), ("pdf", 4, 0)], "e string, n int, o int").select(layout.document_kind(F.col("e"), F.col("n"), F.col("o")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["word", "scanned", "mixed", "text"]


def test_tables(spark):
    lines = spark.createDataFrame([("d", 1, "Name | Size"), ("d", 2, "a | 1"), ("d", 3, "no table"), ("d", 4, "x | 2")], "doc_id string, line_no int, line string")
    found = tables.continued(tables.pipe_tables(lines)).orderBy("table_no").collect()
    assert [(r.n_rows, r.header, r.continues) for r in found] == [(2, True, False), (1, False, True)]
    grid = spark.createDataFrame([([["a|b", "c"], ["d", "e"]],)], "r array<array<string>>")
    assert grid.select(tables.as_markdown(F.col("r")).alias("m")).first().m == "| a\\|b | c |\n| --- | --- |\n| d | e |"


def docx(texts):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/i.png", b"png")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["one", "two"]))
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "d.pdf").write_bytes(b"nope")
    (tmp_path / "e.txt").write_bytes(b"x")
    (tmp_path / "f.pdf").write_bytes(b"")
    found = readers.files(spark, str(tmp_path))
    told = found.select(F.regexp_extract("path", "([a-z])\\.[a-z]+$", 1).alias("n"), readers.file_error(F.col("path"), F.col("length"), F.col("content")).alias("e"))
    assert {r.n: r.e for r in told.collect()} == {"a": None, "b": None, "c": None, "d": "INVALID_PDF", "e": "UNSUPPORTED_TYPE", "f": "EMPTY_FILE"}
    blocks = readers.docx_blocks(found.where("path like '%.docx'")).orderBy("path", "block_no").collect()
    assert [(b.kind, b.text, b.error) for b in blocks] == [("text", "one", None), ("text", "two", None), ("table", "x | ", None), (None, None, "CORRUPT_FILE")]
    assert [r.name for r in readers.docx_images(found.where("path like '%.docx'")).collect()] == ["word/media/i.png"]
    assert readers.newest(found, "([a-z])\\.pdf$").count() == 3


def test_json_and_lexicon(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for name in ("x.json", "validation.json"):
        (tmp_path / "j" / name).write_text(json.dumps({"doc_id": name}))
    assert [r.doc_id for r in readers.json_documents(spark, str(tmp_path / "j"), "doc_id string").collect()] == ["x.json"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").where("a is not null").collect()) == [1, 2]
    (tmp_path / "seed.tsv").write_text("صندوق\t4\n")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("الصندوق صندوق صَندوق")
    assert {r.word: r.n for r in readers.lexicon(spark, str(tmp_path / "seed.tsv"), str(tmp_path / "t")).collect()} == {"صندوق": 6, "الصندوق": 1}


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "id string, document string, embedding array<double>")
    digest = writers.content_digest(records)
    assert digest == writers.content_digest(records.orderBy(F.desc("id"))) != writers.content_digest(records.limit(1))
    path = str(tmp_path / "store")
    assert writers.rebuild_store(records, path, digest) and not writers.rebuild_store(records, path, digest)
    assert writers.verify_store(spark, path) == {"rows": 2, "repeated": 0, "lost": 0}
    writers.csv_report(records.select("id").limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    writers.json_lines(records.select("id", "document"), str(tmp_path / "jl"), "id")
    assert spark.read.json(str(tmp_path / "jl")).count() == 2
    lines = spark.createDataFrame([("d", 2, 1, "c"), ("d", 1, 2, "b"), ("d", 1, 1, "a")], "doc_id string, page int, line_no int, text string")
    assert writers.pages_as_text(lines).first().text == "<<PAGE 1>>\na\nb\n\n<<PAGE 2>>\nc"
    paras = spark.createDataFrame([("d", 1, "L", "T", 1, 0, "x"), ("d", 1, "L", "T", 2, 1, "y")], "doc_id string, sec_no int, label string, title string, para_no int, level int, text string")
    assert writers.sections_as_markdown(paras).first().markdown == "## L: T\n\n- x\n  - y"
    assert writers.markdown_table(lines.select("page").limit(0)) == "| page |\n| --- |"


def test_upsert_keeps_whole_versions(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"
    told = lambda n: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/state/version={n}").select("user_id", "latest", "n").collect())
    for n, rows in enumerate([[(1, 1, "a"), (2, 2, "b")], [(3, 1, "c")], [(4, 3, "d")]]):
        made = spark.createDataFrame([(e, datetime.datetime(2024, 1, 1, e), u, t, "{}") for e, u, t in rows], schema)
        made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        state = status.keyed_state(status.source(spark, f"{tmp_path}/events", made.schema))
        status.upsert(state, f"{tmp_path}/state", f"{tmp_path}/checkpoint").awaitTermination()
    assert status.versions(spark, f"{tmp_path}/state") == [0, 1, 2] and status.versions(spark, f"{tmp_path}/nothing") == []
    status.upsert(state, f"{tmp_path}/open", f"{tmp_path}/checkpoint2", finished="latest = 'c'").awaitTermination()
    last = status.versions(spark, f"{tmp_path}/open")[-1]
    assert sorted(r.user_id for r in spark.read.parquet(f"{tmp_path}/open/version={last}").collect()) == [2, 3]
    assert told(0) == [(1, "a", 1), (2, "b", 1)] and told(2) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = status.source(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    q = status.run(status.keyed_state(stream), "latest", str(tmp_path / "cp1"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, status.keyed_state(events).collect()))
    q = status.run(status.windowed_counts(stream, late="60 days"), "counts", str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, status.windowed_counts(events).collect()))


def test_service(spark):
    parts = spark.createDataFrame([("h", ["a", "b", "c"]), ("h", ["a", "b"]), ("h", ["a", "x"]), ("g", ["q"]), ("e", ["a"]), ("e", ["b"])], "g string, parts array<string>")
    assert {r.g: r.prefix for r in service.common_prefix(parts, "g", "parts").collect()} == {"h": "a", "g": "q", "e": ""}
    owners = spark.createDataFrame([(1,), (None,)], "id int")
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "owner int, r string")
    assert {r.r for r in service.orphans(rows, "owner", owners, "id").collect()} == {"y", "z"}
    events = spark.createDataFrame([("k", i, f) for i, f in enumerate([True, True, False, True, True, True, True, True])], "k string, n int, f boolean")
    told = service.streaks(events, "k", ["n"], F.col("f"), limit=5).first()
    assert (told.longest, told.locks) == (5, 1)
    reasons = spark.createDataFrame([("خطأ",), ("error",), (None,)], "r string").select(service.officer_message(F.col("r"), "عام").alias("m"))
    assert [r.m for r in reasons.collect()] == ["خطأ", "عام", "عام"]
