"""Sentences, wrapped lines and size-limited chunks of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesheet.functions.arrays import array_scan, let, slices_from
from cuesheet.functions.text import SPACE, collapse_space, strip

# Limits of lines, cues, captions and synthesis calls.
LINE_WIDTH = 60
CUE_LINES = 2
CAPTION_LINES = 3
MAX_CUE_SECONDS = 6.0
MIN_CUE_SECONDS = 1.0
REQUEST_CHARS = 5000

SENTENCE_END = rf"[.!?]+{SPACE}+"


def sentences(text: Column) -> Column:
    """Sentences in order, without the marks that ended them.

    The last sentence keeps its mark, since no space follows it.
    """
    pieces = F.transform(F.split(text, SENTENCE_END, -1), strip)
    return F.filter(pieces, lambda s: s != "")


def _lines(width: int, n: int) -> str:
    """Pattern of the first `n` lines of a collapsed text."""

    def line(room: int) -> str:
        return rf"((?>\S{{{room + 1},}}(?= |\z)|\S.{{0,{room - 1}}}(?= |\z)))"

    return " ".join([line(width - 1)] + [line(width)] * (n - 1))


def wrap_lines(text: Column, width: int, max_lines: int, *, repeat_dots: bool) -> Column:
    """Greedy line wrapping, cut after `max_lines` lines with dots at the cut.

    A line takes words while it fits. The first line has room for one
    character less than the others, and a word too long for any line is a line
    of its own. Each possible outcome is one anchored pattern, so a long text
    is read only as far as its visible lines. Groups are atomic: a line once
    taken greedily is never shortened to make the rest match.
    """

    def lines(n: int) -> str:
        return _lines(width, n)

    def broken(n: int) -> str:
        return "\n".join(f"${i}" for i in range(1, n + 1))

    rules = []
    if repeat_dots:
        rules.append((rf"^{lines(max_lines)} .*\z", broken(max_lines) + "..."))
    else:
        rules.append((rf"^{lines(max_lines)}(?<!\.\.\.) .*\z", broken(max_lines) + "..."))
        rules.append((rf"^{lines(max_lines)} .*\z", broken(max_lines)))
    rules += [(rf"^{lines(n)}\z", broken(n)) for n in range(max_lines, 1, -1)]

    def broken_up(collapsed: Column) -> Column:
        wrapped = collapsed
        # A text that one rule has broken holds a line feed, which no later rule
        # can cross.
        for pattern, replacement in rules:
            wrapped = F.regexp_replace(wrapped, pattern, replacement)
        # Most sentences fit in the first line, where no rule finds anything.
        return F.when(F.length(collapsed) < width, collapsed).otherwise(wrapped)

    return let(collapse_space(text), broken_up)


def wrap_cue(text: Column) -> Column:
    """Text of a cue: two lines; dots that are already there are not repeated."""
    return wrap_lines(text, LINE_WIDTH, CUE_LINES, repeat_dots=False)


def cue_head(text: Column) -> Column:
    """As much of a text, collapsed, as `wrap_cue` of it, or of any text that
    goes on from a part of it, can depend on: its lines and the word after
    them, of which no more than fits in no line.

    Heads of neighbouring parts, joined by a space, are wrapped as the whole."""
    shown = rf"^({_lines(LINE_WIDTH, CUE_LINES)} \S{{1,{LINE_WIDTH + 1}}}).*\z"
    return F.regexp_replace(collapse_space(text), shown, "$1")


def wrap_caption(text: Column) -> Column:
    """Text of a page caption: three lines, always with dots when cut."""
    return wrap_lines(text, LINE_WIDTH, CAPTION_LINES, repeat_dots=True)


def _pack(pieces: Column, limit: int, gap: int, first_gap: int) -> Column:
    """Greedy packing of pieces into runs.

    A piece joins the open run when the length so far plus its own stays
    within `limit`. A piece counts its length plus `gap`, or plus `first_gap`
    where it opens any run but the very first. State is the length so far, -1
    before the first piece.
    """

    def opens(parts: Column) -> Column:
        return array_scan(
            F.transform(parts, F.length),
            F.lit(-1),
            lambda used, length: F.when(used < 0, length + gap)
            .when(used + length > limit, length + first_gap)
            .otherwise(used + length + gap),
            lambda used, length: (used < 0) | (used + length > limit),
            "boolean",
        )["out"]

    return let(pieces, lambda parts: slices_from(parts, opens(parts)))


def packed_sentences(text: Column) -> Column:
    """Whole sentences packed into two lines' worth of characters."""
    runs = _pack(sentences(text), LINE_WIDTH * CUE_LINES, 1, 0)
    return F.transform(runs, lambda run: F.array_join(run, " "))


def cue_chunks(text: Column, duration: Column) -> Column:
    """Unwrapped cue texts of one page, which stays whole if it is short enough
    for one cue."""
    return F.when(duration <= MAX_CUE_SECONDS, F.array(text)).otherwise(packed_sentences(text))


def request_chunks(text: Column, max_chars: int = REQUEST_CHARS) -> Column:
    """Texts of the synthesis calls for one text.

    A longer text is cut at '. ' and packed; every piece gets its '. ' back,
    also the last one, so a final full stop comes out doubled.
    """
    packed = F.transform(
        _pack(F.split(text, r"\. ", -1), max_chars, 2, 2),
        lambda chunk: strip(F.concat(F.array_join(chunk, ". "), F.lit(". "))),
    )
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


def paragraphs(text: Column) -> Column:
    """Paragraphs set apart by an empty line; a line of spaces is not empty."""
    pieces = F.transform(F.split(strip(text), "\n\n", -1), strip)
    return F.filter(pieces, lambda p: p != "")
