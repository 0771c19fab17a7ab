"""Repairs of words by a vocabulary: stretched letters and words split by a stray space.

The vocabularies are small tables (words and pairs of one document, or of a corpus of regulations); each wrapper
checks the size before it takes them to the executors.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra import fixed

#: Words that a vocabulary may have to be held in every worker.
MOST_WORDS = 500_000
_FOLD = str.maketrans(fixed.ALEF_FORMS + "ى", "ااااي")
_ARABIC = re.compile("[ء-يً-ْٰ]+")


def core(word: str) -> str:
    """A word as vocabularies hold it: no diacritics, one alef, one ya."""
    return re.sub(f"[{fixed.TASHKEEL}]", "", word).translate(_FOLD)


def stretched(text: str, vocabulary: Mapping[str, int]) -> str:
    """Words in which a drawn-out stroke has become a run of sin letters, put right by the vocabulary.

    A window of three words, then two, then one is joined; each run of sins is tried with none, one and two of them,
    and the commonest known word wins.  A split word that stays unknown keeps a single sin.
    """
    if not re.search("س{3,}|شسس|سشس", text):
        return text
    words, out = text.split(" "), []
    while words:
        for n in (3, 2, 1):
            window = words[:n]
            if len(window) < n or not any("سس" in w or w == "س" for w in window):
                continue
            before, middle, after = re.match(r"^([^ء-ي]*)(.*?)([^ء-ي]*)$", "".join(window)).groups()
            if n == 1 and middle in vocabulary:
                continue
            parts = re.split("(س+)", middle)
            tries = {"".join(p) for p in itertools.product(*[("", "س", "سس") if p.startswith("س") else (p,) for p in parts])}
            best = max(sorted(tries), key=lambda w: vocabulary.get(w, 0))
            if vocabulary.get(best, 0) > 0 and (n > 1 or best != middle):
                out.append(before + best + after)
                words = words[n:]
                break
        else:
            if len(words) > 1 and re.match("س{3,}", words[1]):
                out.append(re.sub("س{3,}", "س", words[0] + words[1]))
                words = words[2:]
            else:
                out.append(words.pop(0))
    return " ".join(out)


def _count(word: str, words: Mapping[str, int], cut: int) -> int:
    """How often a word is known, itself or without a prefix that ends before the cut."""
    bare = (word[len(p) :] for p in fixed.WORD_PREFIXES if word.startswith(p) and len(word) - len(p) >= 3 and cut > len(p))
    return next((n for w in (word, *bare) if (n := words.get(w, 0))), 0)


def split_words(text: str, words: Mapping[str, int], pairs: Mapping[tuple[str, str], int]) -> str:
    """Joins two or three neighbours that are one known word more often than they stand side by side.

    One of them must be no word of its own: a single letter, or up to three letters (two if the joined form isn't
    known itself) not commoner than the pair.  A joined word is tried again with what follows.
    """

    def parts_of(token: str) -> tuple[str, bool]:
        bare = re.sub(r"[.,،:;؛!؟)\]»\"”']+$", "", token)
        return bare, bool(bare) and _ARABIC.fullmatch(bare) is not None

    tokens = re.split(r"(\s+)", text)
    i = 0
    while i + 2 < len(tokens):
        first, (second, arabic) = tokens[i], parts_of(tokens[i + 2])
        if tokens[i + 1] != " " or not arabic or not _ARABIC.fullmatch(first or " "):
            i += 2
            continue
        a, b = core(first), core(second)
        together = pairs.get((a, b), 0)
        longest = 3 if words.get(a + b, 0) else 2

        def fake(w: str, most: int = longest, together: int = together) -> bool:
            alone = w == "و" or w in fixed.SHORT_WORDS
            return not alone and (len(w) == 1 or (len(w) <= most and words.get(w, 0) <= together))

        no_word = fake(a) or fake(b)
        if no_word and _count(a + b, words, len(a)) >= max(1, together):
            tokens[i : i + 3] = [first + tokens[i + 2]]
            continue
        if second == tokens[i + 2] and i + 4 < len(tokens) and tokens[i + 3] == " ":
            third, arabic = parts_of(tokens[i + 4])
            c = core(third)
            if arabic and (no_word or (len(c) == 1 and c != "و")) and _count(a + b + c, words, len(a)) >= max(1, together):
                tokens[i : i + 5] = [first + second + tokens[i + 4]]
                continue
        i += 2
    return "".join(tokens)


def _held(vocabulary: DataFrame, *keys: str) -> dict:
    rows = vocabulary.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a vocabulary of more than {MOST_WORDS} rows isn't held in every worker")
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): int(r["n"]) for r in rows}


def repair_stretched(text: Column, vocabulary: DataFrame) -> Column:
    """:func:`stretched` with ``vocabulary(word, n)``."""
    known = _held(vocabulary, "word")
    made = F.pandas_udf(lambda s: s.map(lambda t: stretched(t, known), na_action="ignore"), "string")
    return F.when(text.rlike("س{3,}|شسس|سشس"), made(text)).otherwise(text)


def repair_split_words(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of texts repaired with the words and pairs of their own document, one group per document."""
    schema = docs.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words: dict[str, int] = {}
        pairs: dict[tuple[str, str], int] = {}
        for t in pdf[text].fillna(""):
            for w in map(core, _ARABIC.findall(t)):
                words[w] = words.get(w, 0) + 1
            split = t.split(" ")
            for x, y in itertools.pairwise(split):
                y = re.sub(r"[.,،:;؛!؟)\]»\"”']+$", "", y)
                if _ARABIC.fullmatch(x or " ") and _ARABIC.fullmatch(y or " "):
                    pairs[core(x), core(y)] = pairs.get((core(x), core(y)), 0) + 1
        return pdf.assign(**{text: pdf[text].map(lambda t: split_words(t, words, pairs), na_action="ignore")})

    return docs.groupBy(doc_id).applyInPandas(run, schema)
