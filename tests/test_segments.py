import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesheet.functions import segments as G
from cuesheet.functions.arrays import array_scan, slices_from


def lines_of(words, width=60):
    """Greedy lines, by taking the longest run of words that still fits."""
    lines, rest = [], list(words)
    while rest:
        room = width - 1 if not lines else width
        take = 1
        while take < len(rest) and len(" ".join(rest[: take + 1])) <= room:
            take += 1
        lines.append(" ".join(rest[:take]))
        rest = rest[take:]
    return lines


def shown(text, keep, repeat_dots):
    lines = lines_of(text.split())
    cut = len(lines) > keep
    out = "\n".join(lines[:keep])
    return out + "..." if cut and (repeat_dots or not out.endswith("...")) else out


def test_sentences(apply):
    texts = ["A b. C d!? E.", "", "One", "Mr. X left. ", "a.b c", "Hm... well", "!? x"]
    assert apply(G.sentences, texts) == [
        ["A b", "C d", "E."],
        [],
        ["One"],
        ["Mr", "X left"],
        ["a.b c"],
        ["Hm", "well"],
        ["x"],
    ]


WRAP_EDGES = [
    "",
    "one",
    " ".join(["abcd"] * 12),
    " ".join(["abcd"] * 13),
    " ".join(["abcd"] * 12) + " e",
    "x" * 59 + " yy zz",
    "x" * 60 + " yy zz",
    "x" * 61 + " yy zz",
    "a " + "x" * 60 + " yy",
    "a " + "x" * 61 + " yy",
    "x" * 200,
    " ".join(["x" * 70] * 5),
    " ".join(["w"] * 58) + " foo... bar baz",
    " ".join(["w"] * 29 + ["v"] * 28 + ["end..."]) + " more words here",
    "a -  - b",
    "é" * 30 + " " + "ü" * 28 + " z",
    "\U0001d11e" * 58 + " y z",
    "a b \u0085 c",
]


@pytest.mark.parametrize("wrap, keep, repeat", [(G.wrap_cue, 2, False), (G.wrap_caption, 3, True)])
def test_wrap_edges(apply, wrap, keep, repeat):
    assert apply(wrap, WRAP_EDGES) == [shown(t, keep, repeat) for t in WRAP_EDGES]


@pytest.mark.parametrize("wrap, keep, repeat", [(G.wrap_cue, 2, False), (G.wrap_caption, 3, True)])
def test_wrap_random_texts(apply, wrap, keep, repeat):
    rng = random.Random(7)
    texts = []
    for _ in range(3000):
        sizes = [rng.choice([1, 2, 3, 5, 8, 13, 28, 29, 30, 31, 57, 58, 59, 60, 61, 62]) for _ in range(rng.randint(0, 25))]
        texts.append(" ".join("ab."[rng.randint(0, 2)] * n for n in sizes))
    assert apply(wrap, texts) == [shown(t, keep, repeat) for t in texts]


def test_cue_chunks_120_character_edge(apply):
    def chunks(text):
        return apply(lambda c: G.cue_chunks(c, F.lit(6.1)), [text])[0]

    # The first chunk counts a space for each of its sentences: 60 + 1 + 59.
    assert chunks("a" * 60 + ". " + "b" * 59) == ["a" * 60 + " " + "b" * 59]
    assert chunks("a" * 60 + ". " + "b" * 60) == ["a" * 60, "b" * 60]
    # A later chunk does not count one for the sentence that opens it.
    assert chunks("c" * 120 + ". " + "a" * 60 + ". " + "b" * 60) == ["c" * 120, "a" * 60 + " " + "b" * 60]
    assert chunks("a" * 300 + ". B.") == ["a" * 300, "B."]


def test_short_page_is_one_chunk(apply):
    text = "A b. " * 40
    assert apply(lambda c: G.cue_chunks(c, F.lit(6.0)), [text]) == [[text]]


def test_request_chunks_edges(apply):
    whole = "a" * 5000
    assert apply(G.request_chunks, [whole]) == [[whole]]
    assert apply(G.request_chunks, ["a" * 5001]) == [["a" * 5001 + "."]]
    long = "a" * 4998 + ". " + "b" * 10 + "."
    assert apply(G.request_chunks, [long]) == [["a" * 4998 + ".", "b" * 10 + ".."]]
    # The first piece and its mark come to 2,002; 2,998 more still fit.
    two = "a" * 2000 + ". " + "b" * 2998 + ". c"
    assert apply(G.request_chunks, [two]) == [["a" * 2000 + ". " + "b" * 2998 + ".", "c."]]
    over = "a" * 2000 + ". " + "b" * 2999 + ". c"
    assert apply(G.request_chunks, [over]) == [["a" * 2000 + ".", "b" * 2999 + ". c."]]
    assert apply(lambda c: G.request_chunks(c, 10), [". . " * 9]) == [[". . . . . ."] * 3 + ["."]]


def test_paragraphs(apply):
    text = "\n One\nstill one \n\n\n\nTwo\n  \nstill two\n\n "
    assert apply(G.paragraphs, [text, ""]) == [["One\nstill one", "Two\n  \nstill two"], []]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 70), max_size=200), min_size=1, max_size=8))
def test_scan_is_a_plain_loop(spark, lists):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    scan = array_scan(F.col("v"), F.lit(0), lambda s, v: (s + v) % 97, lambda s, v: s * 100 + v, "int")
    for row, values in zip(df.orderBy("i").select(scan.alias("r")).collect(), lists):
        state, out = 0, []
        for v in values:
            out.append(state * 100 + v)
            state = (state + v) % 97
        assert (row.r.out, row.r.state) == (out, state)


def test_slices(spark):
    df = spark.createDataFrame(
        [([1, 2, 3], [True, False, True]), ([], []), ([9], [True])], "v array<int>, o array<boolean>"
    )
    assert [r[0] for r in df.select(slices_from(F.col("v"), F.col("o"))).collect()] == [[[1, 2], [3]], [], [[9]]]
