"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from papyra import fixed

SPACE = r"[\s\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"


def fold(e: str) -> str:
    return f"translate({e}, '{fixed.FOLDED_FROM}', '{fixed.FOLDED_TO}')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '{SPACE}', ' ', 'g'))"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{SPACE}'), lambda w: w <> '')"


def normalize(e: str) -> str:
    return collapse(f"regexp_replace({fold(e)}, '{NOT_WORD}', ' ', 'g')")


def tokens(e: str) -> str:
    bare = normalize(f"regexp_replace({e}, '[{fixed.TASHKEEL}{fixed.TATWEEL}]', '', 'g')")
    prefix = "^(?:" + "|".join(fixed.TOKEN_PREFIXES) + ")(.{3,})$"
    return f"list_filter(list_transform({words(bare)}, lambda t: regexp_replace(t, '{prefix}', '\\1')), lambda t: length(t) > 1)"


def bm25(name: str, corpus: str, queries: str, *, empty: str | None = None) -> str:
    """CTEs that end with ``name(query_id, id, score)``; corpus gives (id, text), queries (qid, text)."""
    terms = tokens("coalesce(text, '')")
    if empty is not None:
        terms = f"(CASE WHEN len({terms}) = 0 THEN ['{empty}'] ELSE {terms} END)"
    return f"""
{name}_docs AS (SELECT id, {terms} AS terms FROM ({corpus})),
{name}_stats AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)::DOUBLE) AS mean FROM {name}_docs),
{name}_tf AS (SELECT id, length, term, count(*)::DOUBLE AS f FROM (SELECT id, len(terms)::DOUBLE AS length, unnest(terms) AS term FROM {name}_docs) GROUP BY id, length, term),
{name}_df AS (SELECT term, count(*)::DOUBLE AS df FROM {name}_tf GROUP BY term),
{name}_q AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({tokens("coalesce(text, '')")}) AS term FROM ({queries}))),
{name} AS (
  SELECT qid AS query_id, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_stats GROUP BY qid, id
)"""


DOCS = "SELECT doc_id AS id, text FROM documents"
TITLES = "SELECT doc_id AS id, substr(string_split(text, chr(10))[1], 1, 120) AS text FROM documents"
ITEMS = "SELECT item_id AS qid, text FROM benchmark"


def ranked(name: str, scored: str, k: int, where: str = "true") -> str:
    """A CTE of the k best hits of each query, with ``rank``."""
    return f"{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {scored} WHERE score > 0 AND ({where})) WHERE rank <= {k})"


EXPECTED = "expected AS (SELECT item_id AS query_id, doc_id AS key FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0)"

METRICS = """count(*) AS n_queries,
  round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 3) AS hit1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 3) AS hit3,
  round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 3) AS hit5, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 3) AS hit10,
  round(avg(CASE WHEN first_rank <= 10 THEN 1.0::DOUBLE / first_rank ELSE 0.0 END), 3) AS mrr10, round(avg(found::DOUBLE / n_expected), 3) AS recall10"""


def per_query(name: str, hits: str) -> str:
    """A CTE as papyra.operators.evaluate.per_query; hits has (query_id, id, rank)."""
    return f"""{name} AS (
  SELECT e.query_id, count(DISTINCT e.key) AS n_expected, min(h.rank) AS first_rank, count(DISTINCT e.key) FILTER (WHERE h.rank <= 10) AS found
  FROM expected e LEFT JOIN {hits} h ON h.query_id = e.query_id AND h.id = e.key GROUP BY e.query_id
)"""
