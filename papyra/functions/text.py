"""Text functions as Column expressions: they stay in generated code and are pushed through scans like any other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed

#: White space in the Unicode sense; Java's \s leaves out no-break spaces.
SPACE = "[\\s\\p{Z}]+"
NOT_WORD = "[^\\p{L}\\p{N}_\\s\\p{Z}]"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words(text: Column) -> Column:
    """Words between white space; an empty array for a blank text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def char_count(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def first_line(text: Column, limit: int = 120) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, limit)


def shorten(text: Column, size: int = 200) -> Column:
    """One line of at most ``size`` characters, with an ellipsis if cut."""
    flat = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit(" …"))).otherwise(flat)


def title_part(text: Column) -> Column:
    """The first line up to its first colon, or all of it."""
    line = first_line(text)
    return F.when(line.contains(":"), F.concat(F.substring_index(line, ":", 1), F.lit(":"))).otherwise(line)


def fold_letters(text: Column) -> Column:
    """Variants of Arabic letters as one letter."""
    return F.translate(text, fixed.FOLDED_FROM, fixed.FOLDED_TO)


def search_normalize(text: Column) -> Column:
    """Folded letters, punctuation as space, white space collapsed."""
    return collapse(F.regexp_replace(fold_letters(text), NOT_WORD, " "))


def strip_marks(text: Column) -> Column:
    """Without diacritics and stretching."""
    return F.regexp_replace(text, f"[{fixed.TASHKEEL}{fixed.TATWEEL}]", "")


def tokens(text: Column) -> Column:
    """Search tokens: marks off, normalised, the first matching article or preposition off, single letters dropped."""
    prefix = "^(?:" + "|".join(fixed.TOKEN_PREFIXES) + ")(.{3,})$"
    plain = F.filter(F.split(search_normalize(strip_marks(text)), " "), lambda w: F.length(w) > 1)
    # every prefix has a lam, and a single letter never has one before three more: other texts skip the rule
    bare = F.filter(F.transform(plain, lambda w: F.regexp_replace(w, prefix, "$1")), lambda w: F.length(w) > 1)
    return F.when(text.contains("ل"), bare).otherwise(plain)


def western_digits(text: Column) -> Column:
    return F.translate(text, fixed.DIGITS_FROM, fixed.DIGITS_TO)


def header_key(text: Column) -> Column:
    """What running heads and feet are compared by: numbers as #, white space collapsed, lower case."""
    return F.lower(collapse(F.regexp_replace(western_digits(text), "\\d+", "#")))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def is_right_to_left(text: Column) -> Column:
    """More Arabic than Latin letters."""
    return count_of(text, "[\\u0600-\\u06FF]") > count_of(text, "[A-Za-z]")


def sentences(text: Column) -> Column:
    """Parts that end with a full stop or an Arabic semicolon before white space."""
    return F.split(F.regexp_replace(text, f"([.؛]){SPACE}", "$1\u0001"), "\u0001")


def pack_sentences(text: Column, limit: int) -> Column:
    """Sentences joined while ``limit`` words hold them; what is longer alone is cut by words."""
    room = F.lit(limit)

    def add(held: Column, sentence: Column) -> Column:
        n = word_count(sentence)
        fits = (held["n"] == 0) | (held["n"] + n <= room)
        joined = F.trim(F.concat_ws(" ", held["now"], sentence))
        return F.struct(
            F.when(fits, held["done"]).otherwise(F.array_append(held["done"], held["now"])).alias("done"),
            F.when(fits, joined).otherwise(sentence).alias("now"),
            F.when(fits, held["n"] + n).otherwise(n).alias("n"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))
    pieces = F.aggregate(sentences(text), start, add, lambda held: F.when(held["now"] != "", F.array_append(held["done"], held["now"])).otherwise(held["done"]))
    return F.flatten(F.transform(pieces, lambda p: F.when(word_count(p) <= room, F.array(p)).otherwise(cut_words(p, limit))))


def cut_words(text: Column, limit: int) -> Column:
    """Pieces of ``limit`` words, the last one shorter."""
    w = words(text)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(limit))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s, limit), " "))


def quality(text: Column) -> Column:
    """``score`` from 0 to 1 and ``flags``: empty, garbage, reversed or fragmented text, few letters.

    The text is taken as it is; compose with :func:`papyra.functions.unicode.nfkc` for compatibility forms.
    """
    return let(F.struct(F.regexp_replace(text, SPACE, "").alias("compact"), words(text).alias("words"), text.alias("text")), lambda t: let(_measures(t), _judged))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _measures(t: Column) -> Column:
    """Ratios and counts that the quality test weighs; t has compact, words and text."""
    length = F.length(t["compact"])
    n = F.nullif(length, F.lit(0))  # ratios of an empty text are null
    kept = lambda other: F.length(F.regexp_replace(t["compact"], other, "")).cast("double")
    single = F.filter(F.filter(t["words"], lambda w: F.length(w) == 1), lambda w: w.rlike("^\\p{L}$") & ~w.isin(*"وأإاAaIi"))
    arabic = F.when(
        t["text"].rlike("[\\u0600-\\u06FF]"),
        F.transform(F.regexp_extract_all(t["text"], F.lit("([\\u0600-\\u06FF]+)")), lambda w: F.translate(F.regexp_replace(w, f"[{fixed.TASHKEEL}]", ""), fixed.ALEF_FORMS + "ى", "ااااي")),
    ).otherwise(F.array().cast("array<string>"))
    hits = lambda listed: F.size(F.filter(arabic, lambda w: w.isin(*listed)))
    return F.struct(
        length.alias("n"),
        ((n - kept("[\\uFFFD\\p{Cc}\\p{Co}\\p{Cs}\\p{Cn}]+")) / n).alias("garbage"),
        (kept("[^\\p{L}\\p{N}]+") / n).alias("letters"),
        ((n - kept("[\\uFB50-\\uFDFF\\uFE70-\\uFEFF]+")) / n).alias("shapes"),
        F.when(F.size(t["words"]) >= 10, F.try_divide(F.size(single).cast("double"), F.size(t["words"]))).otherwise(F.lit(0.0)).alias("singles"),
        hits(fixed.STOP_WORDS).alias("normal"),
        hits([w[::-1] for w in fixed.STOP_WORDS]).alias("turned"),
    )


def _judged(m: Column) -> Column:
    backwards = (m["turned"] >= 3) & (m["turned"] > m["normal"])
    few = (m["n"] >= 30) & (m["letters"] < 0.55)
    legacy = (m["shapes"] > 0.3) & backwards
    less = [
        F.least(F.lit(0.6), m["garbage"] * 6),
        F.when(m["singles"] > 0.10, F.least(F.lit(0.4), (m["singles"] - 0.10) * 1.5)).otherwise(0.0),
        F.when(few, 0.3).otherwise(0.0),
        F.when(backwards, 0.5).otherwise(0.0),
        F.when(legacy, 0.45).otherwise(0.0),
    ]
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a - b, less, F.lit(1.0)))), 3)
    named = F.array(
        F.when(m["garbage"] > 0.02, "GARBAGE_CHARS"),
        F.when(backwards, "REVERSED_ARABIC"),
        F.when(m["singles"] > 0.25, "FRAGMENTED_TOKENS"),
        F.when(few, "LOW_LETTER_RATIO"),
        F.when(legacy, "LEGACY_ARABIC_ENCODING"),
    )
    empty = F.coalesce(m["n"], F.lit(0)) == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(score).alias("score"),
        F.when(empty, F.array(F.lit("EMPTY"))).otherwise(F.filter(named, lambda f: f.isNotNull())).alias("flags"),
    )
