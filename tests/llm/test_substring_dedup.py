import random
import re
import tracemalloc

import duckdb
import pyarrow as pa

from papyra.llm import substring_dedup as S
from papyra.llm.queries import ORACLES, op7_substring_dedup


def plain(rows, min_words=8):
    """Brute force: cut texts in the order of ids, keeping a set of what was seen."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, lines, out = set(), set(), {}
    for i in order:
        text = rows[i][1]
        if not text:
            out[i] = text
            continue
        parts = re.findall(r"[^.!?\n]*[.!?]+|[^.!?\n]+|\n", text)
        keys = [" ".join(p.lower().split()) for p in parts]
        rep = []
        for k in keys:
            rep.append(bool(k) and k in seen)
            if k:
                seen.add(k)
        n = [len(p.split()) for p in parts]
        gone, again = set(), []
        for x in text.split("\n"):
            key = " ".join(x.lower().split())
            again.append(bool(key) and key in lines)
            lines |= {key}
        start = 0
        while start < len(parts):
            if not rep[start]:
                start += 1
                continue
            run = [start]
            j = start + 1
            while j < len(parts) and (rep[j] or not n[j]):
                if rep[j]:
                    run.append(j)
                j += 1
            if min_words is not None and sum(n[x] for x in run) >= min_words:
                gone |= set(range(run[0], run[-1] + 1))
            start = j
        line = []
        for j in range(len(parts) + 1):
            if j == len(parts) or parts[j] == "\n":
                full = [x for x in line if n[x]]
                if again.pop(0) or (full and all(x in gone for x in full)):
                    gone |= set(line) | ({j} if j < len(parts) else set())
                line = []
            else:
                line.append(j)
        out[i] = "".join(p for x, p in enumerate(parts) if x not in gone)
    return [out[i] for i in range(len(rows))]


def check(documents, rows, min_words=8):
    got = {r.doc_id: r for r in S.dedup(documents(*rows), min_words=min_words).collect()}
    want = plain(rows, min_words)
    for (i, text), w in zip(rows, want, strict=True):
        r = got[i]
        assert r.text == w, i
        if text:
            cut = [(s.start, s.end) for s in r.removed]
            assert "".join(text[a:b] for a, b in zip([0, *[e for _, e in cut]], [*[s for s, _ in cut], len(text)], strict=True)) == w
    return got


def test_units_tile_the_text():
    for text in ("", "a", "A b. C d!? e\n\n f.", "...", "\n", " x . y ", "no end"):
        assert "".join(S.units(text)) == text


def test_lines_and_passages(documents):
    passage = "This passage has been pasted. It has several sentences of its own. Each has a few words. None is long at all."
    rows = [
        (1, f"Licensed under the common terms here.\nFirst text begins {passage} and goes on here."),
        (2, f"Second text differs entirely {passage} but has it too.\nlicensed  UNDER the common terms here.\nlast line of two"),
        (3, "Short one. Ok. Short one. Ok."),
        (4, "Short one. Another thing is said here."),
        (5, None),
        (6, ""),
        (7, "..\n\n!?"),
    ]
    alone = check(documents, rows, None)  # lines alone
    assert "several sentences" in alone[2].text and alone[2].text.startswith("Second text differs")
    got = check(documents, rows)
    assert "several sentences" not in got[2].text and "common terms" not in got[2].text.lower()
    assert got[4].text == rows[3][1] and got[5].text is None and got[1].removed == []


def test_random_texts_against_brute_force(documents, monkeypatch):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", "?", ""]) for _ in range(60)]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", "\n", "\n\n", ""]) for _ in range(rng.randrange(0, 30)))) for i in range(80)]
    check(documents, rows)
    check(documents, rows, None)
    monkeypatch.setattr(S, "HELD", 1)  # many small sets of occurrences
    check(documents, rows)


def test_short_lines_go(documents):
    got = check(documents, [(1, "ok\nfirst"), (2, "Ok\nsecond\nok"), (3, "not ok")])
    assert got[2].text == "second\n" and got[3].text == "not ok"


def test_long_texts_and_ids_of_text(spark, documents):
    long = "".join(f"sentence number {i} of a long text. " for i in range(100_000))
    got = check(documents, [(1, long), (2, long + "\nnew"), (3, "new")])
    assert got[2].text == "new" and got[3].text == ""
    df = spark.createDataFrame([("b", "a line"), ("a", "A  line"), (None, "a line")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in S.dedup(df).collect()} == {"a": "A  line", "b": "", None: ""}


def test_query_by_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, text, removed_spans, removed_chars FROM ({ORACLES['op7_substring_dedup']})").fetchall()
    got = op7_substring_dedup(spark, sf).select("doc_id", "text", "removed_spans", "removed_chars").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeated_rows_nulls_and_extra_columns(spark, documents):
    line = "one two three four five six seven eight nine."
    rows = [(1, line), (1, line), (None, line), (2, line)]
    df = documents(*rows).withColumnRenamed("lang", "unit").withColumnRenamed("source", "h1")
    got = sorted(((r.doc_id, r.text) for r in S.dedup(df).collect()), key=str)
    assert got == sorted([(1, line), (1, line), (2, ""), (None, "")], key=str)
    assert S.dedup(documents((1, "x")).limit(0)).collect() == []
    clash = documents(*rows).withColumnRenamed("lang", "removed").withColumnRenamed("source", "row_key").withColumnRenamed("n_chars", "places")
    assert S.dedup(clash).columns == ["doc_id", "text", "row_key", "places", "removed"] and S.dedup(clash).count() == 4
    hot = documents(*[(i, "a line that every document holds, word for word.\n" + "x" * i) for i in range(300)])
    kept = [r.doc_id for r in S.dedup(hot).collect() if "every" in r.text]
    assert kept == [0]


def test_bytes_of_held_occurrences():
    texts = [" ".join(f"w{i}x{j}." for j in range(1000)) for i in range(20)]
    ids = pa.array(range(len(texts)))
    tracemalloc.start()
    held = S._Held()
    held.add(ids, ids, texts, True)
    got = tracemalloc.get_traced_memory()[0] / len(held.row)
    tracemalloc.stop()
    assert len(held.row) == 20 * 1001 and got < 40
    parts = list(held.sent())
    assert sum(p.num_rows for p in parts) == len(held.row) and max(p.num_rows for p in parts) <= 1 << 16
