"""Text preparation. Every step mentions its input once, so that the chain can
be used inside a lambda (where Spark shares no common subexpressions) without
evaluating anything twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions.arrays import let

# The 29 code points that count as white space.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as members of a Java character class.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters fail the first range and are done, whatever else the class holds.
SPACE = rf"[\x00-\x20\x7f-\u3000&&[{WHITESPACE}]]"
NON_SPACE = f"[^{WHITESPACE}]"
# Decimal digits plus the other digit characters (superscripts,
# subscripts, circled and the like) that count as digits.
DIGITS = (
    r"\p{Nd}"
    r"\xb2\xb3\xb9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    r"\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one space; the ends are stripped.

    Single spaces, by far the most of all runs, are not matched.
    """
    return F.trim(F.regexp_replace(text, rf"{SPACE}(?:{SPACE}+|(?<! ))", " "))


def clean_text(text: Column) -> Column:
    """Page text ready for narration; an empty string where nothing remains.

    The short-text and digit rules see the page after its line breaks were
    collapsed, so they judge the page as a whole and never a single line.
    Removed dashes may leave two spaces in a row; these stay.
    """
    cleaned = collapse_space(F.coalesce(text, F.lit("")))
    for needed, pattern, replacement in (
        (None, r"^.{0,2}\z", ""),
        (None, rf"^[{DIGITS}]+\z", ""),
        ("..", r"\.{2,}", "."),
        ("-", r" *- *", " - "),
        (None, r"([.!?])(?:  +)?(?=[A-Z])", "$1 "),
    ):
        cleaned = _replaced(cleaned, needed, pattern, replacement)
    return F.trim(cleaned)


def _replaced(text: Column, needed: str | None, pattern: str, replacement: str) -> Column:
    """`regexp_replace`, past texts without what every match needs, if anything:
    bytes are looked through much faster than a pattern is tried everywhere."""
    if needed is None:
        return F.regexp_replace(text, pattern, replacement)
    return let(
        text, lambda t: F.when(F.contains(t, F.lit(needed)), F.regexp_replace(t, pattern, replacement)).otherwise(t)
    )


def survives_cleaning(text: Column) -> Column:
    """Whether `clean_text` leaves anything, decided near the start of a text.

    True exactly where `clean_text(text) != ''`: three characters are left
    after collapsing, and one of them is no digit.
    """
    pair = f"{NON_SPACE}{SPACE}+{NON_SPACE}"
    long_enough = F.rlike(text, F.lit(f"{NON_SPACE}{{3}}|{pair}"))
    not_a_number = F.rlike(text, F.lit(f"[^{DIGITS}{WHITESPACE}]|{pair}"))
    return F.coalesce(long_enough & not_a_number, F.lit(False))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def word_count(cleaned: Column) -> Column:
    """Words of a cleaned text; a doubled space separates no empty word."""
    return F.size(F.array_remove(F.split(cleaned, " "), "")).cast("bigint")


def preview(text: Column, max_chars: int) -> Column:
    """The first characters of a text, with dots when something was cut off."""
    shown = F.substring(text, 1, max_chars)
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(shown, F.lit("...")))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def processing_minutes(chars: Column) -> Column:
    """Rough processing time with one decimal: a minute for a thousand characters.

    Rounds the double that holds the minutes, not its decimal digits: 1.15 is
    a little less than it says and becomes 1.1. For a count that ends in 50,
    twenty times that double is compared with the whole number it stands for.
    The product is split into two terms whose sum and rounding error are exact.
    """
    minutes = chars / F.lit(1000.0)
    large, small = minutes * 16, minutes * 4
    product = large + small
    excess = (product - chars / F.lit(50.0)) + (small - (product - large))
    below = F.floor(chars / 100)
    up = F.when(excess > 0, 1).when(excess < 0, 0).otherwise(below % 2)
    tenths = F.when(chars % 100 == 50, below + up).otherwise(F.floor((chars + 50) / 100))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
