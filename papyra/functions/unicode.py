"""Functions that Spark has no built-in for: Unicode normal forms, and similarities of sequences (Arrow batches)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import text as T

_ASCII = "^[\\x00-\\x7F]*$"


def _form(name: str):
    @F.pandas_udf("string")
    def normal(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: unicodedata.normalize(name, x), na_action="ignore")

    return normal


def nfc(text: Column) -> Column:
    """Composed form; plain ASCII doesn't leave the JVM's expression."""
    return F.when(text.rlike(_ASCII), text).otherwise(_form("NFC")(text))


def nfkc(text: Column) -> Column:
    """Composed compatibility form."""
    return F.when(text.rlike(_ASCII), text).otherwise(_form("NFKC")(text))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks (Ratcliff and Obershelp), 1 for equal texts."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)])

    return ratio(a, b)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance by words over the reference's words (at least one); a null counts as empty.

    Each distinct word of the two texts stands for one character, so that the distance is the built-in one.
    """
    left, right = (T.words(F.coalesce(x, F.lit(""))) for x in (reference, hypothesis))
    known = F.array_distinct(F.concat(left, right))
    coded = lambda own: F.array_join(F.transform(own, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")), "")
    return F.levenshtein(coded(left), coded(right)).cast("double") / F.greatest(F.size(left), F.lit(1))


def clean(text: Column) -> Column:
    """The faithful version: one form of each character, no invisible ones, tidy spaces, joined endings.

    Rules in order: compatibility form, line breaks, invisible and control characters, stretching, Persian letters,
    a closing ta inside a word, leaders, kinds of spaces, space before Arabic punctuation, a lone final ya.
    """
    t = nfkc(text)
    t = F.regexp_replace(t, "\\r\\n|\\r|\\u2028", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "\\u2029", "\n\n"), f"[{fixed.INVISIBLE}]|[{fixed.CONTROL}]|{fixed.TATWEEL}", "")
    t = F.translate(t, fixed.PERSIAN_FROM, fixed.PERSIAN_TO)
    t = F.regexp_replace(t, "ة(?=[\\u0621-\\u063A\\u0641-\\u064A])(?!ال)", "ق")
    t = F.regexp_replace(t, "(?:\\s*[.…]){4,}\\s*", " ... ")
    t = F.regexp_replace(t, "[ \\t\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]+", " ")
    t = F.regexp_replace(t, " +([،؛؟])", "$1")
    t = F.regexp_replace(t, "([\\u0621-\\u064A]+) ([يى])(?=[\\s.،؛:!؟)\\]]|$)", "$1$2")
    t = F.regexp_replace(t, " *\\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def for_search(text: Column) -> Column:
    """The version that is searched: clean, without diacritics, one alef, one ya, western digits."""
    bare = F.regexp_replace(clean(text), f"[{fixed.TASHKEEL}]", "")
    return T.western_digits(F.translate(bare, fixed.ALEF_FORMS + "ى", "ااااي"))


def corpus_form(text: Column) -> Column:
    """The version that a corpus keeps: composed form, no controls or marks, tidy punctuation, dates and brackets."""
    t = F.regexp_replace(nfc(text), f"[{fixed.BIDI_CONTROLS}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\\u00a0", " "), f"[{fixed.TASHKEEL}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "(?<=[ء-ي])ـ+(?=[ء-ي])", ""), "هـ{2,}", "هـ")
    t = F.trim(F.regexp_replace(t, "[ \\t]+", " "))
    t = F.regexp_replace(F.regexp_replace(t, "\\s+([.,،؛:؟!)\\]])", "$1"), "([(\\[])\\s+", "$1")
    t = F.regexp_replace(t, "(?<=\\d)\\s*/\\s*(?=\\d)", "/")
    t = F.regexp_replace(t, "\\(\\s*(\\d+)\\s*-\\s*(\\d+)\\s*-\\s*(\\d+)\\s*\\)", "($1-$2-$3)")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, "\\s*\\[\\^(\\d+)\\]\\s*", " [^$1] ")), "\\s+([.,،؛:])", "$1")
    t = F.when(t.contains("•"), _bullet_cell(t)).otherwise(t)
    t = F.regexp_replace(t, "\\)([A-Za-z][A-Za-z0-9 /.&\\-]*)\\(", " ($1) ")
    t = F.regexp_replace(F.regexp_replace(t, "\\s+([.,،؛:)])", "$1"), " {2,}", " ")
    return F.trim(t)


def _bullet_cell(t: Column) -> Column:
    """A bullet at the wrong end goes to the front, and a range that runs down is turned round."""
    span = "([\\d,]+)\\s*–\\s*([\\d,]+)"
    low, high = F.regexp_extract(t, span, 1), F.regexp_extract(t, span, 2)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    turned = F.when(t.rlike(span) & (number(low) > number(high)), F.regexp_replace(t, span, "$2–$1")).otherwise(t)
    return F.when(turned.rlike("•$"), F.concat(F.lit("• "), F.trim(F.regexp_replace(turned, "•$", "")))).otherwise(turned)
