"""The retrieval agent over a batch of clauses: understand, retrieve, pool, select.

Models are providers: functions over DataFrames with deterministic stand-ins, so that everything else (sanitising
answers, references, fusion, pools, excerpts, fallbacks) is ordinary DataFrame code for all clauses at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra import fixed
from papyra.functions import text as T
from papyra.operators import fusion
from papyra.operators.sizes import held, is_small, small

#: Answers: ``query_id, answer`` (a JSON object as text, or null on failure).
Provider = Callable[[DataFrame], DataFrame]

PLAN = "topics array<struct<topic:string,query:string>>, articles array<string>, annex11_item int"
SELECTION = "selected array<struct<key:string,role:string,topic:int,reason:string>>"


def clause_title(text: Column, title: Column) -> Column:
    """The title given, or the last part of the breadcrumb, without the part's number and leading numbering."""
    crumb = F.regexp_extract(text, "^\\s*\\[([^\\]]+)\\]", 1)
    chosen = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.element_at(F.split(crumb, "›"), -1))
    bare = F.trim(F.regexp_replace(chosen, "\\(الجزء[^)]*\\)", ""))
    return F.trim(F.regexp_replace(bare, "^[\\d٠-٩]+(?:\\s*-\\s*(?:[\\d٠-٩]+|[ء-ي](?![ء-ي])))*\\s*[-.)]?\\s*", ""))


def body(text: Column) -> Column:
    """A text without the breadcrumb in front."""
    return F.trim(F.regexp_replace(text, "^\\s*\\[[^\\]]+\\]\\s*", ""))


def reference_form(text: Column) -> Column:
    """Normalised, attached prepositions before "article" and "annex" as the article, oblique plurals as nominative."""
    t = F.regexp_replace(T.search_normalize(text), "(?<![\\p{L}\\p{N}_])(?:لل|بال|وال|فال)(ماده|ملحق)", "ال$1")
    return F.regexp_replace(t, "ين(?![\\p{L}\\p{N}_])", "ون")


def references(clauses: DataFrame, sections: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``query_id, at, ref, key, why``: articles and annexes that a clause names.

    ``clauses(query_id, text)``, ``sections(key)``, ``labels(label, number)``: article labels in words, which every task
    gets (more than SMALL_ROWS of them are an error).  Longer labels
    claim their place first, then numbers; a place is claimed once.  The document is told by the fifty characters
    behind a reference; laws outside the corpus, and keys it doesn't have, give a null key with the reason.
    """
    known: dict[str, int] = {}
    if labels is not None:
        told = labels.groupBy(reference_form(F.col("label")).alias("label")).agg(F.min("number").cast("int").alias("number")).where("label <> ''")
        if not is_small(told):
            raise ValueError("too many article labels for one table in every task")
        known = {r["label"]: r["number"] for r in told.collect()}
    lengths: dict[str, set[int]] = {}  # by a label's first word
    for label in known:
        lengths.setdefault(label.split(" ")[0], set()).add(len(label))
    outside, hints = [_plain(x) for x in fixed.OUTSIDE], [(_plain(x), code) for x, code in fixed.DOC_HINTS]

    @F.pandas_udf("array<struct<at:int,ref:string,kind:string,number:int,doc:string>>")
    def find(texts: pd.Series) -> pd.Series:
        import re

        number, word = re.compile(fixed.REFERENCE), re.compile(r"\w+")

        def one(t: str | None) -> list[dict]:
            t, out = t or "", []
            taken = np.zeros(len(t), bool)
            places = {(m.end() - len(w), m.end() - len(w) + n) for m in word.finditer(t) for w in lengths if m[0].endswith(w) for n in lengths[w]}
            worded = [(a, b) for a, b in places if t[a:b] in known and not (word.match(t, b) and b < len(t))]
            spans = [(a, b, "ماده", known[t[a:b]]) for a, b in sorted(worded, key=lambda s: (s[0] - s[1], t[s[0] : s[1]], s[0]))]
            spans += [(m.start(), m.end(), m[1], int(m[2])) for m in number.finditer(t)]
            for start, end, kind, n in spans:
                if not taken[start:end].any():
                    taken[start:end] = True
                    after = t[end : end + 50]
                    doc = None if any(w in after for w in outside) else next((c for w, c in hints if w in after), "IFR")
                    out.append({"at": start, "ref": t[start:end], "kind": kind, "number": n, "doc": doc})
            return out

        return texts.map(one)

    found = clauses.select("query_id", F.explode(find(reference_form(F.col("text")))).alias("r")).select("query_id", "r.*")
    wanted = F.when(F.col("kind") == "ماده", F.concat(F.col("doc"), F.lit("-art"), F.lpad(F.col("number").cast("string"), 3, "0"))).otherwise(F.concat(F.col("doc"), F.lit("-anx"), F.col("number").cast("string")))
    told = found.withColumn("wanted", wanted).join(small(sections.select(F.col("key").alias("wanted"), F.lit(True).alias("there")).distinct()), "wanted", "left")
    why = F.when(F.col("doc").isNull(), "نظام خارج قاعدة المعرفة").when(F.col("there").isNull(), "غير موجودة في قاعدة المعرفة")
    return told.select("query_id", "at", "ref", F.when(F.col("there"), F.col("wanted")).alias("key"), why.alias("why"))


def _plain(text: str) -> str:
    """reference_form of a fixed value."""
    import re

    t = text.translate(str.maketrans(fixed.FOLDED_FROM, fixed.FOLDED_TO))
    t = " ".join(re.sub(r"[^\w\s]", " ", t).split())
    return re.sub(r"ين\b", "ون", re.sub(r"\b(?:لل|بال|وال|فال)(ماده|ملحق)", r"ال\1", t))


def sane_plan(answers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``query_id, topics, articles, item, ok``: at most four topics with a query, three articles of the catalogue."""
    told = answers.withColumn("p", F.from_json("answer", PLAN))
    topics = F.slice(F.filter(F.coalesce("p.topics", F.array()), lambda t: F.trim(F.coalesce(t["query"], F.lit(""))) != ""), 1, fixed.MAX_TOPICS)
    named = told.select("query_id", F.posexplode(F.array_distinct(F.coalesce("p.articles", F.array().cast("array<string>")))).alias("at", "key")).join(small(catalogue.select("key").distinct()), "key", "left_semi")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    kept = named.withColumn("n", nth).where(F.col("n") <= fixed.MAX_NAMED).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "key"))), lambda s: s["key"]).alias("articles"))
    plain = told.select("query_id", topics.alias("topics"), F.col("p.annex11_item").alias("item"), F.col("p").isNotNull().alias("ok"))
    return plain.join(kept, "query_id", "left").withColumn("articles", F.coalesce("articles", F.array().cast("array<string>")))


def sane_selection(answers: DataFrame, pool: DataFrame, *, topics: DataFrame | None = None) -> DataFrame:
    """``query_id, unit, role, topic, reason, place``: units of the pool only, each once, governing ones first, at most eight.

    Unknown roles become "related"; topics out of range become null.
    """
    told = answers.select("query_id", F.posexplode(F.coalesce(F.from_json("answer", SELECTION)["selected"], F.array())).alias("at", "s"))
    rows = told.select("query_id", "at", F.col("s.key").alias("unit"), "s.role", "s.topic", F.trim(F.coalesce("s.reason", F.lit(""))).alias("reason"))
    rows = rows.join(pool.select("query_id", "unit").distinct(), ["query_id", "unit"], "left_semi")
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "unit").orderBy("at"))).where("n = 1")
    role = F.when(F.col("role").isin("governing", "disclosure", "related"), F.col("role")).otherwise("related")
    once = once.withColumn("role", role)
    if topics is not None:
        once = once.join(topics.select("query_id", F.size("topics").alias("n_topics")), "query_id", "left")
        once = once.withColumn("topic", F.when(F.col("topic").between(1, F.coalesce("n_topics", F.lit(0))), F.col("topic")))
    order = F.array_position(F.array(*[F.lit(r) for r in ("governing", "disclosure", "related")]), F.col("role"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "at"))
    return once.withColumn("place", place).where(F.col("place") <= fixed.MAX_SELECTED).select("query_id", "unit", "role", "topic", "reason", "place")


def cached(asked: DataFrame, cache: DataFrame, ask: Provider) -> tuple[DataFrame, DataFrame]:
    """(answers, the cache with the new ones): only requests that the cache doesn't know reach the provider.

    ``asked(query_id, request)``; the key is the digest of the request; failed answers (null) aren't kept.
    """
    keyed = asked.withColumn("key", F.sha2("request", 256))
    hits = keyed.join(cache.select("key", "answer"), "key")
    fresh = ask(keyed.join(cache.select("key"), "key", "left_anti").select("query_id", "request", "key"))
    grown = cache.select("key", "answer").unionByName(fresh.where("answer is not null").groupBy("key").agg(F.first("answer").alias("answer")))
    return hits.select("query_id", "answer").unionByName(fresh.select("query_id", "answer")), grown


def paragraphs(texts: DataFrame, *, most: int = 900) -> DataFrame:
    """``unit, paras``: a unit's text cut at lettered items, and where a paragraph has grown beyond ``most`` characters."""

    @F.pandas_udf("array<string>")
    def cut(column: pd.Series) -> pd.Series:
        import re

        item = re.compile(r"^\s*\(?[ء-ي]{1,2}\)\s")

        def one(text: str | None) -> list[str]:
            out: list[list[str]] = []
            for line in (x.strip() for x in (text or "").split("\n")):
                if line:
                    if not out or item.match(line) or sum(map(len, out[-1])) > most:
                        out.append([])
                    out[-1].append(line)
            return [" ".join(p) for p in out]

        return column.map(one)

    return texts.select("unit", cut(F.col("text")).alias("paras"))


def excerpts(pairs: DataFrame, *, budget: int = fixed.EXCERPT_CHARS) -> DataFrame:
    """``query_id, unit, query, paras[, similarity]`` -> ``query_id, unit, excerpt``.

    The paragraphs most like the query, by BM25 among the unit's own paragraphs (half of it similarity, if there is
    any), as many as the budget holds, in their own order, with an ellipsis for what is left out.
    """
    scored = "similarity" in pairs.columns
    terms = pairs.withColumn("__q", F.array_distinct(T.tokens(F.col("query")))).withColumn("__t", F.transform("paras", T.tokens))

    @F.pandas_udf("string")
    def choose(paras: pd.Series, asked: pd.Series, tokens: pd.Series, similar: pd.Series) -> pd.Series:
        def one(own: list, q: list, t: list, sim: list | None) -> str:
            own = list(own)
            if sum(map(len, own)) + len(own) <= budget:
                return "\n".join(own)
            lists = [list(x) or ["_"] for x in t]
            mean = sum(map(len, lists)) / len(lists)
            score = np.zeros(len(own))
            for term in q:
                n = sum(term in x for x in lists)
                if n:
                    idf = np.log(1 + (len(lists) - n + 0.5) / (n + 0.5))
                    f = np.array([x.count(term) for x in lists], float)
                    score += idf * f * (fixed.BM25_K1 + 1) / (f + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * np.array([len(x) for x in lists]) / mean))
            score = score / (score.max() or 1.0)
            if sim is not None:
                score = 0.5 * score + 0.5 * np.asarray(sim, float)
            kept, used = [], 0
            for i in np.argsort(-score, kind="stable").tolist():
                if not kept or used + len(own[i]) <= budget:
                    kept.append(i)
                    used += min(len(own[i]), budget)
            out: list[str] = []
            for i, last in zip(sorted(kept), [-1, *sorted(kept)], strict=False):
                out += ["…"] * (i != last + 1) + [own[i][:budget]]
            return "\n".join([*out, "…"] if max(kept) < len(own) - 1 else out)

        return pd.Series([one(*row) for row in zip(paras, asked, tokens, similar, strict=True)])

    sim = F.col("similarity") if scored else F.lit(None).cast("array<double>")
    return terms.select("query_id", "unit", choose(F.col("paras"), F.col("__q"), F.col("__t"), sim).alias("excerpt"))


@dataclass
class Agent:
    """All stages for a batch of clauses.

    ``search(name, queries)`` returns hits ``query_id, id, unit, section, rank`` for the lists "clause", "lexical",
    "topic" (queries of all topics at once) or "title".  ``understand`` and ``select`` are providers; without one, or where its answer is
    null, the rules decide.  ``ablate``: parts to leave out.
    """

    search: Callable[[str, DataFrame], DataFrame]
    sections: DataFrame
    understand: Provider | None = None
    select: Provider | None = None
    pinned: str = fixed.PINNED_SECTION
    ablate: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if unknown := set(self.ablate) - set(fixed.ABLATIONS):
            raise ValueError(f"unknown ablations: {sorted(unknown)}")

    def run(self, clauses: DataFrame) -> DataFrame:
        """``query_id, unit, id, place, selected, role, found_in``; selected is null where no selection was made."""
        lists = {"clause": held(self.search("clause", clauses))}
        if "no_lexical" not in self.ablate:
            lists["lexical"] = held(self.search("lexical", clauses))
        plan = sane_plan(self.understand(clauses), self.sections) if self.understand else None
        if plan is not None and "no_topics" not in self.ablate:
            # one search for all topics of all clauses; then a list for each topic's number
            kind = clauses.schema["query_id"].dataType
            asked = plan.select("query_id", F.posexplode("topics").alias("n", "topic")).select(F.concat_ws("#", F.col("query_id").cast("string"), "n").alias("query_id"), F.col("topic.query").alias("text"))
            found = held(self.search("topic", asked).withColumn("n", F.substring_index("query_id", "#", -1).cast("int")).withColumn("query_id", F.substring_index("query_id", "#", 1).cast(kind)))
            for n in range(fixed.MAX_TOPICS):
                lists[f"topic{n + 1}"] = found.where(F.col("n") == n).drop("n")
        if "no_title" not in self.ablate:
            lists["title"] = held(self.search("title", clauses))
        cited = references(clauses, self.sections).where("key is not null").select("query_id", F.col("key").alias("unit"), F.col("at").alias("rank"))
        priority = cited
        if plan is not None and "no_named" not in self.ablate:
            named = plan.select("query_id", F.posexplode("articles").alias("at", "unit")).select("query_id", "unit", (F.col("at") + 1_000_000).alias("rank"))
            priority = priority.unionByName(named)
        fused = fusion.weighted_units(lists, pinned=self.pinned)
        pool = fusion.pool(priority, fused, is_pinned=F.col("unit").startswith(f"{self.pinned}-"))
        told = pool.join(fusion.best_per_unit(lists), ["query_id", "unit"], "left").join(fusion.sources(lists), ["query_id", "unit"], "left")
        if self.select is None:
            return told.select("query_id", "unit", "id", "place", F.lit(None).cast("boolean").alias("selected"), F.lit(None).cast("string").alias("role"), "found_in")
        answers = self.select(pool)
        judged = answers.where("answer is not null").select("query_id", F.lit(True).alias("judged")).distinct()
        chosen = sane_selection(answers, pool, topics=plan).select("query_id", "unit", "role", F.col("place").alias("chosen"))
        both = told.join(chosen, ["query_id", "unit"], "left").join(judged, "query_id", "left")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("chosen").asc_nulls_last(), "place"))
        selected = F.when(F.col("judged"), F.col("chosen").isNotNull())
        return both.select("query_id", "unit", "id", order.alias("place"), selected.alias("selected"), "role", "found_in")
