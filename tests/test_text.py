import pytest

from cuesheet.functions import text as X

CLEANED = [
    ("1234", ""),
    ("12\n34", "12 34"),
    ("ok", ""),
    (" ok \n", ""),
    ("a b", "a b"),
    ("...", "."),
    ("wait... what..", "wait. what."),
    ("a--b", "a -  - b"),
    ("well-known", "well - known"),
    ("-abc", "- abc"),
    ("U.S.A", "U. S. A"),
    ("Stop!Go?Yes", "Stop! Go? Yes"),
    ("ok.Äb", "ok.Äb"),
    ("12\n\n\nPage  two\t\tends", "12 Page two ends"),
    ("a \x1cb　", "a b"),
    ("²²²²", ""),
    ("١٢٣", ""),
    ("①②③", ""),
    ("½½½", "½½½"),
    ("", ""),
    (None, ""),
    (" \n ", ""),
]


def test_clean_text(apply):
    assert apply(X.clean_text, [raw for raw, _ in CLEANED]) == [want for _, want in CLEANED]


def test_cleaning_inside_a_lambda_gives_the_same(apply):
    from pyspark.sql import functions as F

    raw = [r for r, _ in CLEANED]
    assert apply(lambda c: F.transform(F.array(c), X.clean_text)[0], raw) == apply(X.clean_text, raw)


def test_survives_cleaning_agrees_with_cleaning(apply):
    extra = ["a", "ab", "abc", "1 2", "12 ", "1²", "a 1", " 1 23", "12a", "- -", "--", "---", "1-2", "  1\n2  "]
    raw = [r for r, _ in CLEANED] + extra
    assert apply(X.survives_cleaning, raw) == [c != "" for c in apply(X.clean_text, raw)]


def test_white_space_is_the_same_set_everywhere(apply):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert sorted(X.WHITESPACE_CHARS) == spaces
    assert apply(X.strip, [f"{s}a{s}" for s in spaces]) == ["a"] * len(spaces)
    assert apply(X.collapse_space, [f"a{s}{s}b" for s in spaces]) == ["a b"] * len(spaces)
    assert apply(X.strip, ["​a", "﻿a"]) == ["​a", "﻿a"]


def test_digit_rule_for_all_digit_characters(apply):
    digits = [chr(c) for c in range(0xD800) if chr(c).isdigit()]
    assert set(apply(X.clean_text, [d * 3 for d in digits])) == {""}
    others = ["¼", "⅐", "一", "Ⅰ"]
    assert apply(X.clean_text, [o * 3 for o in others]) == [o * 3 for o in others]


def test_word_count(apply):
    assert apply(X.word_count, ["", "a", "a b", "a -  - b"]) == [0, 1, 2, 4]


@pytest.mark.parametrize("size, want", [(4, "abcd"), (5, "abcde"), (6, "abcde...")])
def test_preview_edge(apply, size, want):
    assert apply(lambda c: X.preview(c, 5), ["abcdef"[:size]]) == [want]


def test_report_numbers(spark):
    from pyspark.sql import functions as F

    counts = [*range(0, 30001, 25), *range(10**9 + 50, 10**9 + 10**5, 100), 123456789050]
    df = spark.createDataFrame([(c,) for c in counts], "c bigint")
    for row in df.select("c", X.processing_minutes(F.col("c")).alias("m"), X.thousands(F.col("c")).alias("t")).collect():
        assert (row.m, row.t) == (f"{row.c / 1000:.1f}", f"{row.c:,}")
