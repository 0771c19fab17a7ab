"""Lines that open a block, lines joined to paragraphs, and tokens read from images, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import text as T
from papyra.functions import unicode as U

_OPENS = "(?i)^(?:" + "|".join(fixed.BLOCK_OPENS) + ")"
_EDGE = fixed.EDGE_PUNCTUATION.replace("(", "").replace(")", "")


def match_form(line: Column) -> Column:
    """A line as patterns see it: compatibility form, no diacritics, one alef and one ya, western digits, trimmed."""
    plain = F.regexp_replace(U.nfkc(line), f"[{fixed.TASHKEEL}]", "")
    return F.trim(T.western_digits(F.translate(F.regexp_replace(plain, f"[{fixed.ALEF_FORMS}]", "ا"), "ى", "ي")))


def opens_block(line: Column) -> Column:
    """Whether a line begins with a number, a letter, a bullet or a word that opens a block."""
    return match_form(line).rlike(_OPENS)


def joined(lines: Column) -> Column:
    """Paragraphs of an array of structs ``text, opens``: a line goes on the one before unless it opens a block or stands behind an empty one.

    A word broken at its hyphen is joined without a space.
    """
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, line: Column) -> Column:
        text, now, done = F.trim(line["text"]), state["now"], state["done"]
        closed = F.when(now != "", F.array_append(done, now)).otherwise(done)
        ends = (text == "") | (now == "") | line["opens"]
        glued = F.when(now.rlike("[A-Za-z]-$"), F.concat(now, text)).otherwise(F.concat(now, F.lit(" "), text))
        return F.struct(F.when(ends, closed).otherwise(done).alias("done"), F.when(ends, text).otherwise(glued).alias("now"))

    return F.aggregate(lines, none, step, lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def digits(text: Column) -> Column:
    """The digits of a text, in order."""
    return F.regexp_replace(text, "[^\\p{Nd}]", "")


def is_subsequence(small: Column, big: Column) -> Column:
    """Whether the characters of one text stand in the other in that order."""
    at = F.aggregate(F.split(small, ""), F.lit(0), lambda p, c: F.when((p < 0) | (c == ""), p).otherwise(_place(big, c, p)))
    return at >= 0


def _place(big: Column, c: Column, after: Column) -> Column:
    found = F.instr(big.substr(after + 1, F.length(big)), c)
    return F.when(found > 0, after + found).otherwise(-1)


def image_token(token: Column) -> Column:
    """A token read from an image without the marks around it: a web address alone, no unbalanced brackets, a percent sign behind its number."""
    edge = "[" + "".join("\\" + c for c in _EDGE) + "]+"
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, f"^{edge}", ""), f"{edge}$", "")
    count = lambda t, marks: F.length(t) - F.length(F.translate(t, marks, ""))

    def unwrapped(t: Column) -> Column:
        left = t.rlike("^[(\\[]") & (count(t, "([") > count(t, ")]"))
        right = t.rlike("[)\\]]$") & (count(t, ")]") > count(t, "(["))
        return F.when(left, strip(F.substring(t, 2, 1 << 20))).when(right, strip(t.substr(F.lit(1), F.length(t) - 1))).otherwise(t)

    # each bracket that goes takes at least one character, so as many steps as the token has characters are enough
    bare = F.aggregate(F.sequence(F.lit(0), F.length(token)), strip(token), lambda t, _: unwrapped(t))
    turned = F.when(bare.rlike("^%[.,]*\\p{Nd}[\\p{Nd}.,]*$"), F.concat(F.substring(bare, 2, 1 << 20), F.lit("%"))).otherwise(bare)
    address = F.regexp_extract(token, fixed.WEB_ADDRESS, 1)
    return F.when(address != "", address).otherwise(turned)


def email(raw: Column) -> Column:
    """An address in lower case, null if it isn't one."""
    plain = F.lower(F.trim(raw))
    return F.when((F.length(plain) <= fixed.MAX_EMAIL) & plain.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), plain)


def password_problem(password: Column) -> Column:
    """``TOO_SHORT``, ``NEEDS_LETTERS_AND_DIGITS`` or null."""
    given = F.coalesce(password, F.lit(""))
    mixed = given.rlike("[A-Za-z\u0600-\u06ff]") & given.rlike("\\p{Nd}")
    return F.when(F.length(given) < fixed.MIN_PASSWORD, "TOO_SHORT").when(~mixed, "NEEDS_LETTERS_AND_DIGITS")
