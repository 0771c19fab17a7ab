"""Registered queries that have no SQL, against plain Python over the same rows."""

import difflib
import hashlib
import math
import re
from collections import defaultdict

import pytest

import __spark_entry__
from papyra import fixed
from papyra.operators import agent, segmentation
from papyra.plans import agent as agent_plans
from papyra.plans import retrieval

QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def lists(spark):
    """The three searches of the agent's queries, by list and query: (rank, id, unit)."""
    sf = "/root/testdata/sf0.001"
    found = {}
    for name, df in retrieval.unit_lists(spark, sf).items():
        own = defaultdict(list)
        for r in df.collect():
            own[r.query_id].append((r["rank"], r.id, r.unit))
        found[name] = {q: sorted(rows) for q, rows in own.items()}
    return found


def plain_pool(lists, priority, topics=None):
    """query -> units in their places, and unit -> best id: weighted reciprocal ranks, then the pool with its quota."""
    named = [("clause", lists["clause"]), ("lexical", lists["lexical"])]
    named += [("topic1", topics)] if topics else []
    named += [("title", lists["title"])]
    out, ids = {}, {}
    for q in set().union(*(own for _, own in named)):
        score, met, best = defaultdict(float), {}, {}
        for no, (name, own) in enumerate(named):
            units = []
            for _, i, unit in own.get(q, []):
                best.setdefault(unit, i)
                if unit not in units:
                    units.append(unit)
            for place, unit in enumerate(units[:3] if name == "title" else units, 1):
                if name != "title" or unit != retrieval.PINNED:
                    score[unit] += fixed.FUSION_WEIGHTS[name.rstrip("1")] / (60 + place)
                    met.setdefault(unit, (no, place))
        fused = sorted(score, key=lambda u: (-round(score[u], 9), met[u], u))
        pinned = lambda u: u.startswith(f"{retrieval.PINNED}-")
        pool = list(dict.fromkeys(priority))
        for unit in fused:
            if len(pool) < fixed.POOL_SIZE and unit not in pool and not (pinned(unit) and sum(map(pinned, pool)) >= 2):
                pool.append(unit)
        out[q], ids[q] = pool, best
    return out, ids


def test_agent_rules(spark, sf, lists):
    want, ids = plain_pool(lists, [])
    got = defaultdict(dict)
    for r in QUERIES["agent_rules"](spark, sf).collect():
        assert r.selected is None and r.id == ids[r.query_id].get(r.unit)
        got[r.query_id][r.place] = r.unit
    assert {q: [own[p] for p in sorted(own)] for q, own in got.items()} == want


def test_agent_scripted(spark, sf, lists):
    items = {r.item_id: r.text for r in retrieval.items(spark, sf).collect()}
    asked = spark.createDataFrame([(q, " ".join(t.split()[:12])) for q, t in items.items()], "query_id long, text string")
    topics = defaultdict(list)
    for r in agent_plans._search(spark, sf)("topic", asked).collect():
        topics[r.query_id].append((r["rank"], r.id, r.unit))
    want, ids = plain_pool(lists, ["src5"], {q: sorted(rows) for q, rows in topics.items()})
    got = defaultdict(list)
    for r in QUERIES["agent_scripted"](spark, sf).collect():
        got[r.query_id].append((r.place, r.unit, r.id, r.selected, r.role))
    for q, rows in got.items():
        rows.sort()
        assert [(u, i) for _, u, i, *_ in rows] == [(u, ids[q].get(u)) for u in want[q]]
        assert [(s, r) for *_, s, r in rows] == [(n < 3, "governing" if n < 3 else None) for n in range(len(rows))]
    assert got.keys() == want.keys()


def plain_excerpt(paras, query, tokens, budget=fixed.EXCERPT_CHARS):
    if sum(map(len, paras)) + len(paras) <= budget:
        return "\n".join(paras)
    lists = [tokens(p) or ["_"] for p in paras]
    mean = sum(map(len, lists)) / len(lists)
    score = [0.0] * len(paras)
    for term in dict.fromkeys(tokens(query)):
        n = sum(term in x for x in lists)
        for i, x in enumerate(lists):
            f = x.count(term)
            score[i] += n and math.log(1 + (len(lists) - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(x) / mean))
    order = sorted(range(len(paras)), key=lambda i: -score[i])
    kept, used = [], 0
    for i in order:
        if used + len(paras[i]) <= budget or not kept:
            kept.append(i)
            used += len(paras[i])
    return kept


def test_excerpts_hold_the_best_paragraphs(spark, sf):
    """The chosen paragraphs by the query's own kernel on rows, the digests by the query."""
    got = {(r.query_id, r.unit): (r.n_chars, r.digest) for r in QUERIES["excerpt_select"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in retrieval.corpus(spark, sf).collect()}
    short = 0
    for (_, unit), (n, digest) in got.items():
        paras = [" ".join(x.split()) if False else x.strip() for x in texts[unit].split("\n") if x.strip()]
        joined = [[]]
        for p in paras:  # a paragraph grows until it is beyond 900 characters
            if joined[-1] and (re.match(r"^\s*\(?[ء-ي]{1,2}\)\s", p) or sum(map(len, joined[-1])) > 900):
                joined.append([])
            joined[-1].append(p)
        whole = [" ".join(x) for x in joined if x]
        if sum(map(len, whole)) + len(whole) <= fixed.EXCERPT_CHARS:
            text = "\n".join(whole)
            assert (n, digest) == (len(text), hashlib.md5(text.encode()).hexdigest())
            short += 1
    assert got and short


def test_excerpt_of_a_long_text(spark):
    tokens = lambda t: [w for w in t.split() if len(w) > 1]
    paras = ["aa bb cc " * 30, "dd ee " * 60, "aa bb dd " * 25, "ff gg " * 80, "aa " * 10]
    paras = [p.strip() for p in paras]
    df = spark.createDataFrame([(1, "u", "aa bb", paras)], "query_id int, unit string, query string, paras array<string>")
    told = agent.excerpts(df, budget=500).first().excerpt
    kept = plain_excerpt(paras, "aa bb", tokens, 500)
    assert all((p in told) == (i in kept) for i, p in enumerate(paras)) and "…" in told


def test_clause_chain(spark, sf):
    got = [tuple(r) for r in QUERIES["clause_chain"](spark, sf).orderBy("clause_id").collect()]
    assert got == [
        ("C001", "front", None, "مقدمة", 1),
        ("C002", "clause", 1, "1. التعريفات", 2),
        ("C003", "clause", 2, "2. الأهداف", 5),
        ("C004", "clause", 3, "3. الأهلية.", 2),
        ("C005", "clause", 4, "4. الرسوم", 2),
        ("C006", "clause", 5, "5. المخاطر", 4),
        ("C007", "clause", 7, "7. التصفية", 2),
        ("C008", "clause", 8, "8. الأحكام", 2),
        ("C009", "annex", None, "ملحق أول", 2),
    ]


def test_section_split(spark, sf):
    """Documents without numbered lines are front matter, cut into parts of like size."""
    got = defaultdict(list)
    for r in QUERIES["section_split"](spark, sf).collect():
        got[r.doc_id].append((r.clause_id, r.section_type, r.part, r.parts, r.word_count, r.oversize, r.char_count))
    docs = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for doc, text in docs.items():
        lines = [(n, x) for n, x in enumerate(text.split("\n"), 1) if x.strip(" ")]
        assert all(segmentation.marker_of(x.strip()) is None for _, x in lines)  # so no chain of clauses
        words = [len(x.split()) for _, x in lines if x.strip()]
        rows = sorted(got[doc])
        assert sum(r[4] for r in rows) == sum(words) and {r[1] for r in rows} <= {"front"}
        total = sum(words)
        n = max(1, math.ceil(total / fixed.MAX_WORDS))
        limit = fixed.MAX_WORDS if n == 1 else min(fixed.MAX_WORDS, int(total / n * fixed.BALANCE) + 1)
        assert all(r[4] <= limit and not r[5] for r in rows)
        sizes = [r[4] for r in rows]
        # a part ends only where a line didn't fit, but for lines that had to be broken
        if max(words, default=0) <= limit:
            packed = []
            for w in words:
                if not packed or packed[-1] + w > limit:
                    packed.append(0)
                packed[-1] += w
            assert sizes == packed, doc


def test_toc_validation_by_matching_blocks(spark, sf):
    parts = sorted(spark.read.parquet(f"{sf}/part.parquet").collect(), key=lambda r: r.p_partkey)
    groups = defaultdict(list)
    for r in parts:
        groups[r.p_brand, r.p_partkey % 100].append(r.p_name)
    want = {}
    for (brand, number), names in groups.items():
        for k in range(0, len(names), 2):
            found = names[k + 1] if k + 1 < len(names) else None
            ratio = None if found is None else round(difflib.SequenceMatcher(None, names[k], found).ratio(), 4)
            want[f"{brand}/{k // 2}", number] = ("missing" if found is None else "mismatch" if ratio < fixed.TOC_SIMILARITY else "ok", ratio)
    assert {(r.doc_id, r.number): (r.status, r.similarity) for r in QUERIES["toc_validation_blocks"](spark, sf).collect()} == want


def test_running_clusters(spark, sf):
    files = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        if r.text is not None:
            files[r.source].append([" ".join(re.sub(r"\d+", "#", line).split()).lower() for line in r.text.split("\n") if len(line) <= 200])
    want = set()
    for file, keys in files.items():
        clusters = []
        for page, key in ((page, key) for page, lines in enumerate(keys, 1) for key in lines):
            if len(key) >= 2:
                own = next((c for c in clusters if difflib.SequenceMatcher(None, key, c[0]).ratio() >= fixed.CLUSTER_RATIO), None)
                if own is None:
                    clusters.append(own := (key, set(), set()))
                own[1].add(key)
                own[2].add(page)
        for first, members, pages in clusters:
            if len(keys) >= 3 and len(pages) >= max(3, math.ceil(0.1 * len(keys))):
                want |= {(file, key, first, len(pages)) for key in members}
    got = {tuple(r) for r in QUERIES["running_clusters"](spark, sf).collect()}
    assert {(f, c, n) for f, _, c, n in got} == {(f, c, n) for f, _, c, n in want}
