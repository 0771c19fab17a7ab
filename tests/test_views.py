from pyspark.sql import functions as F

from papyra.functions import views
from papyra.operators import sections


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x


def test_headings(spark):
    heading = lambda text: one(spark, lambda t: views.part_heading(t, F.lit("fallback")), text)
    assert heading("no breadcrumb") == "fallback"
    assert heading("[الشروط › 12) الاشتراك (الجزء 2 من 3)]\nع) الاشتراك الإضافي: نص") == "12) الاشتراك › ع) الاشتراك الإضافي"
    assert heading("[الشروط › الاشتراك]\nالاشتراك\nنص") == "الاشتراك"
    assert heading("[الشروط › الاشتراك]\n1. بموافقة خطية؛ و\nنص") == "الاشتراك"
    assert heading("[الشروط › الاشتراك]\nأ | ب") == "الاشتراك"
    assert one(spark, views.crumb, "[a › b (الجزء 1 من 2)]\nx") == "a › b" and one(spark, views.crumb, "x") == "-"
    told = lambda *v: one(spark, lambda s, t, label, annex, title: views.provision_heading(s, "P", t, label, annex, title), *v)
    assert told("A", "x", "المادة 5", None, "الرسوم") == "المادة 5: الرسوم" and told("A", "x", None, "3", None) == "الملحق 3"
    assert told("P", "[a › البند (11): الرسوم]", None, None, None) == "الملحق 11 — البند (11): الرسوم" and told("P", "x", None, None, None).endswith("صفحة الغلاف")


def test_small_views(spark):
    pages = one(spark, views.printed_pages, "169, 170,1,x")
    assert (pages.first, pages.last) == (168, 169) and one(spark, views.printed_pages, "1") is None
    assert one(spark, views.phone, "4567 123 50 966+") == "+966 50 123 4567" and one(spark, views.phone, "123") == "123"
    assert one(spark, lambda a, b: views.metadata(x=a, y=b), "1", None) == '{"x":"1"}'
    assert one(spark, lambda a: views.joined(F.array(F.lit(1), F.lit(2))), "") == "1,2"
    df = spark.createDataFrame([([(1, "a\nb"), (2, None)], [("doc، art", "e", True), ("d", "f", None)])], "i array<struct<page:int,text:string>>, r array<struct<citation:string,excerpt:string,selected:boolean>>")
    row = df.select(views.line_pages(F.col("i")).alias("p"), views.for_reader(F.col("r")).alias("r")).first()
    assert row.p == [1, 1, 2] and [(r.rank, r.document, r.excerpt) for r in row.r] == [(1, "doc", "e"), (2, "d", None)]
    t = spark.createDataFrame([(59.0,), (90.0,), (None,)], "x double").select(views.seconds(F.col("x")).alias("s"))
    assert [r.s for r in t.collect()] == ["59.00 s", "90.00 s (1.5 min)", "–"]


def test_sections(spark):
    rows = [
        ("d", "IFR-art002-c01", "IFR-art002", "[d › الباب › المادة 2]\nنص", "المادة 2", "d › الباب › المادة 2"), ("d", "IFR-art002-c02", "IFR-art002", "[d]\nبقية", "المادة 2", "d › الباب › أخرى"),
        ("d", "IFR-anx11-c01", "IFR-anx11", "[d]\nغلاف", None, "d"), ("d", "IFR-anx11-c02", "IFR-anx11", "[d › البند (3): الرسوم]\nx", None, "d"), ("d", "IFR-pre1-c01", "IFR-pre1", "[d]\np", None, "d"),
    ]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, section_key string, text string, section_title string, breadcrumb string")
    assert {r.key: r.full_text for r in sections.full_texts(chunks).collect()}["IFR-art002"] == "نص\n\nبقية"
    asked = spark.createDataFrame([("IFR-art002-c02",), ("none",)], "chunk_id string")
    assert [r.full_text for r in sections.article_of(chunks, asked).collect()] == ["نص\n\nبقية"]
    assert [(r.key, r.title) for r in sections.catalogue(chunks, F.lit(True)).collect()] == [("IFR-art002", "المادة 2")]
    assert {(r.item, r.chunk_id, r.title) for r in sections.annex_items(chunks, "IFR-anx11").collect()} == {(0, "IFR-anx11-c01", "صفحة الغلاف والمقدمة"), (3, "IFR-anx11-c02", "الرسوم")}
    assert [(r.key, r.prefix) for r in sections.browse(chunks).orderBy("place").collect()] == [("IFR-pre1", "d"), ("IFR-art002", "d › الباب"), ("IFR-anx11", "d")]
    assert sections.unique_ids(chunks).collect() == []
    records = spark.createDataFrame([("a", "[x] y", "t"), ("b", "y", None)], "id string, text string, title string")
    assert [(r.id, r.problem) for r in sections.record_problems(records, ("title",)).collect()] == [("b", "missing title"), ("b", "no breadcrumb")]
