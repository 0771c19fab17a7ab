"""Ordinals, list markers and item types as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.text import SPACE, words


def _lookup(table: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def ordinal(phrase: Column) -> Column:
    """The number that an Arabic ordinal phrase says; null if a word of it is unknown or none counts.

    Units and tens add up, with or without a leading "and"; "ten" after a unit adds ten, "after" adds nothing.
    """
    units, tens = _lookup(fixed.UNIT_ORDINALS), _lookup(fixed.TENS_ORDINALS)
    known = F.map_concat(units, tens)

    def worth(word: Column) -> Column:
        bare = F.when(word.startswith("و") & known.getItem(F.substring(word, 2, 100)).isNotNull(), F.substring(word, 2, 100)).otherwise(word)
        return F.when(word == "بعد", 0).when(word.isin("عشر", "عشرة"), 10).otherwise(known.getItem(bare))

    parts = words(phrase)
    counted = F.exists(parts, lambda w: ~w.isin("بعد", "عشر", "عشرة"))
    total = F.aggregate(F.transform(parts, worth), F.lit(0), lambda a, x: a + x)
    return F.when(counted, total)


def _first(*cases: tuple[Column, Column]) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out


def paragraph_marker(text: Column) -> Column:
    """``kind`` (letter, number, bullet, ordinal_word) and ``marker`` that open a paragraph; null without one."""
    # --- fixed values: what opens a paragraph ---
    letter = "^\\(?([ء-ي])ـ?\\)\\s*"
    in_parens, number = "^\\((\\d{1,3})\\)\\s*", "^(\\d{1,3})\\s*[).\\-]\\s*"
    bullet, adverb = "^[•▪o]\\s+", "^(" + "|".join(fixed.ORDINAL_ADVERBS) + ")\\s*:\\s*"
    made = lambda kind, marker: F.struct(F.lit(kind).alias("kind"), marker.alias("marker"))
    return _first(
        (text.rlike(letter), made("letter", F.regexp_extract(text, letter, 1))),
        (text.rlike(in_parens), made("number", F.regexp_extract(text, in_parens, 1))),
        (text.rlike(number), made("number", F.regexp_extract(text, number, 1))),
        (text.rlike(bullet), made("bullet", F.lit("•"))),
        (text.rlike(adverb), made("ordinal_word", F.regexp_extract(text, adverb, 1))),
    )


def list_marker(text: Column) -> Column:
    """``kind`` (number, letter), ``style`` and ``value`` of a clause or list number; letters count by the abjad order."""
    letters = F.array(*[F.lit(c) for c in fixed.ABJAD])

    def made(style: str, pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        digits = found.rlike("^\\d+$")
        value = F.when(digits, found.try_cast("int")).otherwise(F.array_position(letters, found).cast("int"))
        return F.struct(F.when(digits, "number").otherwise("letter").alias("kind"), F.lit(style).alias("style"), value.alias("value"))

    return _first(*[(text.rlike(p), made(s, p)) for s, p in fixed.MARKER_STYLES])


def _item_marker(text: Column) -> tuple[Column, Column]:
    """Marker and what follows it, before the test that anything does."""
    # --- fixed values: what opens an item ---
    number = "^\\s*(\\d{1,3}(?:\\.\\d{1,3}){0,4})(?:[.)\\-:]\\s*|\\s+)"
    in_parens = "^\\s*\\((\\d{1,3}|[\\u0621-\\u064A])\\)\\s*"
    letter = "^\\s*([\\u0621-\\u064A])\\s?[.)\\-]\\s*"
    bullet = f"^\\s*([{fixed.BULLETS}])\\s*"
    named = "^\\s*((?:المادة|مادة|البند|الفقرة|الباب|الفصل)\\s+[^\\s:]+)\\s*[:\\-]?\\s*"
    adverb = "^\\s*((?:" + "|".join(f"{w}ً?" if not w.endswith("ا") else f"{w[:-1]}اً|{w}" for w in fixed.ORDINAL_ADVERBS) + "))\\s*[:\\-]?\\s*"
    patterns = (number, in_parens, letter, bullet, named, adverb)
    marker = _first(*[(text.rlike(p), F.regexp_extract(text, p, 1)) for p in patterns])
    rest = _first(*[(text.rlike(p), F.trim(F.regexp_replace(text, p, ""))) for p in patterns])
    return marker, rest


def item_marker(text: Column) -> Column:
    """``marker`` and ``rest``; a marker with nothing behind it (a page number) is none."""
    marker, rest = _item_marker(text)
    real = marker.isNotNull() & (F.coalesce(rest, F.lit("")) != "")
    return F.struct(F.when(real, marker).alias("marker"), F.when(real, rest).otherwise(text).alias("rest"))


def item_type(text: Column) -> Column:
    """``type`` (heading, list_item, paragraph), ``marker`` and ``level`` of an item of text."""
    marker = item_marker(text)["marker"]
    short = (F.length(text) <= 90) & ~text.rlike("[.!؟]\\s*$")
    numbered = marker.rlike("^\\d{1,3}(\\.\\d{1,3})*$")
    level = F.length(marker) - F.length(F.regexp_replace(marker, "\\.", "")) + 1
    after = F.substring(F.ltrim(text), F.length(marker) + 1, F.lit(1))
    listed = numbered & (level == 1) & after.isin(".", ")", "-")
    article = marker.rlike("^(المادة|مادة|الباب|الفصل)")
    plain = (F.length(text) <= 60) & ~text.rlike("[.!؟:؛،]\\s*$") & ~text.rlike("[0-9\\u0660-\\u0669@/|]") & (F.size(words(text)) >= 2)
    made = lambda kind, m, n: F.struct(kind.alias("type"), m.alias("marker"), n.cast("int").alias("level"))
    heading = F.when(short, "heading").otherwise("list_item")
    none = F.lit(None).cast("string")
    return (
        F.when(listed, made(F.lit("list_item"), marker, F.lit(None)))
        .when(numbered, made(heading, marker, level))
        .when(article, made(heading, marker, F.lit(1)))
        .when(marker.isNotNull(), made(F.lit("list_item"), marker, F.lit(None)))
        .when(plain, made(F.lit("heading"), none, F.lit(None)))
        .otherwise(made(F.lit("paragraph"), none, F.lit(None)))
    )


def is_contents_line(text: Column) -> Column:
    """Dot leaders, dashes or an ellipsis, or a trailing page number."""
    return text.rlike("\\.{4,}|-{4,}|…") | text.rlike("\\s\\d{1,3}$")


def is_contents_item(text: Column) -> Column:
    """A contents heading, three or more entries, or one entry that ends a short text."""
    entries = F.regexp_count(text, F.lit(fixed.CONTENTS_ENTRY))
    heading = F.regexp_replace(text, "^[ :]+|[ :]+$", "").isin(*fixed.CONTENTS_HEADINGS)
    closing = text.rlike("(?:\\.{3,}|…)\\s*\\d{1,3}\\s*$") & (F.size(words(text)) <= 20)
    return heading | (entries >= 3) | ((entries == 1) & closing)


def is_sentence(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}$", "").rlike("[.؛]$")
