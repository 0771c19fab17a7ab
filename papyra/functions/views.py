"""Derived columns that readers see: headings, page ranges, metadata, results of a clause."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions import text as T

#: What numbers a heading: digits and letters between hyphens (fixed value).
LEADING = "^[\\d٠-٩]+(?:\\s*-\\s*(?:[\\d٠-٩]+|[ء-ي](?![ء-ي])))*\\s*[-.)]?\\s*"
#: What a sub-heading begins with (fixed value).
SUB_MARKER = "^\\s*(?:[▪•]\\s*)?(?:\\(?[\\u0621-\\u064A]{1,2}\\)|\\(\\d{1,2}\\)|\\d{1,2}\\s*[.)-]|[\\u0621-\\u064A]\\s*[.-])\\s*\\S"
PART_SUFFIX = "\\(الجزء[^)]*\\)"


def crumb(text: Column) -> Column:
    """The breadcrumb in front of a text without the part's number; a hyphen if there is none."""
    found = F.regexp_extract(text, "^\\s*\\[([^\\]]+)\\]", 1)
    return F.when(found == "", "-").otherwise(F.trim(F.regexp_replace(found, PART_SUFFIX, "")))


def part_heading(text: Column, fallback: Column) -> Column:
    """The clause's heading, and the sub-heading that the part opens with, if its first line is one.

    A line is no sub-heading if it is the heading itself, an item of a list, a table row or longer than twelve words.
    """
    found = F.regexp_extract(text, "^\\s*\\[([^\\]]+)\\]", 1)
    heading = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.element_at(F.split(found, "›"), -1), PART_SUFFIX, "")), ":+$", ""))
    first = F.trim(F.substring_index(F.regexp_replace(text, "^\\s*\\[[^\\]]+\\]\\s*", ""), "\n", 1))
    bare = lambda c: F.trim(F.regexp_replace(c, LEADING, ""))
    before_colon = F.regexp_extract(first, "^([^:\\n|]{3,90}):", 1)
    short = (T.word_count(first) <= 10) & ~first.endswith(".")
    sub = F.when(before_colon != "", F.trim(before_colon)).when(short, first)
    listed = first.rlike("[؛،,]\\s*و?$")
    marked = sub.rlike(SUB_MARKER) | F.regexp_replace(first, "\\s+$", "").endswith(":")
    good = sub.isNotNull() & ~listed & ~first.contains("|") & (T.word_count(sub) <= 12) & marked & (first != "") & (bare(first) != bare(heading))
    return F.when(found == "", fallback).when(F.coalesce(good, F.lit(False)), F.concat_ws(" › ", heading, sub)).otherwise(heading)


def provision_heading(section: Column, pinned: str, text: Column, label: Column, annex: Column, title: Column) -> Column:
    """``label: title``; of the pinned annex the item that the text is about, or its cover."""
    item = "› البند \\((\\d+)\\): ([^\\]]+)\\]"
    of_pinned = F.when(text.rlike(item), F.concat(F.lit("الملحق 11 — البند ("), F.regexp_extract(text, item, 1), F.lit("): "), F.trim(F.regexp_extract(text, item, 2)))).otherwise("الملحق 11 — صفحة الغلاف")
    named = F.coalesce(label, F.concat(F.lit("الملحق "), annex))
    blank = lambda c: F.nullif(c, F.lit(""))
    plain = F.coalesce(F.concat_ws(": ", blank(named), blank(title)), F.lit(""))
    return F.when(section == pinned, of_pinned).otherwise(plain)


def printed_pages(pages: Column) -> Column:
    """``first`` and ``last`` printed page of a list like "169,170": one less than in the file, covers left out."""
    numbers = F.filter(F.transform(F.split(pages, ","), lambda p: F.trim(p).try_cast("int")), lambda n: n > 1)
    shown = F.transform(numbers, lambda n: n - 1)
    return F.when(F.size(shown) > 0, F.struct(F.array_min(shown).alias("first"), F.array_max(shown).alias("last")))


def metadata(**columns: Column) -> Column:
    """A JSON object of the columns that aren't null; arrays as text with commas."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "true"})


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def line_pages(items: Column) -> Column:
    """The page of each line of a clause, from an array of ``(page, text)``."""
    lines = lambda t: F.length(t) - F.length(F.regexp_replace(t, "\n", "")) + 1
    return F.flatten(F.transform(items, lambda i: F.array_repeat(i["page"], lines(F.coalesce(i["text"], F.lit(""))))))


def for_reader(regulations: Column) -> Column:
    """Hits as a reader gets them: numbered, the document's name from the citation, no excerpt of what wasn't selected.

    ``regulations``: array of structs with ``citation, excerpt, selected``.
    """
    return F.transform(
        regulations,
        lambda r, i: r.withField("rank", i + 1).withField("document", F.trim(F.substring_index(r["citation"], "،", 1))).withField("excerpt", F.when(F.coalesce(r["selected"], F.lit(False)), r["excerpt"])),
    )


def phone(text: Column) -> Column:
    """A phone number whose groups stand in reverse order ("4567 123 50 966+") put right."""
    turned = "^(\\d+(?: \\d+)*) (\\d{3})\\+$"
    return F.when(text.rlike(turned), F.concat(F.lit("+"), F.regexp_extract(text, turned, 2), F.lit(" "), F.array_join(F.reverse(F.split(F.regexp_extract(text, turned, 1), " ")), " "))).otherwise(text)


def seconds(value: Column) -> Column:
    """Seconds with two places, and minutes beside them from one minute up; a dash for null."""
    plain = F.format_string("%.2f s", value)
    return F.when(value.isNull(), "–").when(value > 60, F.concat(plain, F.format_string(" (%.1f min)", value / 60))).otherwise(plain)


def expired(created: Column, ttl_seconds: int, now: Column) -> Column:
    """Whether something made at ``created`` (a timestamp) is over its time."""
    return F.unix_micros(created) + ttl_seconds * 1_000_000 < F.unix_micros(now)
