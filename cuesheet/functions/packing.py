"""Greedy packing as maps from fill level to fill level, which compose.

A packer that takes pieces in order has one number as its state: how full the
open chunk is. What a row of pieces does to it is a step function of the level
it starts from: below `bound` all pieces fit and the level grows by `total`;
from there on each of `steps`, by descending `low`, tells for levels of `low`
and more how many chunks are opened and how full the last one is left. Maps of
neighbouring rows compose into the map of both, so a long text is packed in
parts, which meet as maps. A map has no more steps than pieces fit in a chunk.

The functions take and give SQL text: nested lambdas are built in one step so.
"""

from __future__ import annotations

_STEPS = "array<struct<low:bigint,opened:bigint,level:bigint>>"


def full(limit: int) -> int:
    """A level from which any piece opens a chunk; higher ones act alike."""
    return limit + 1


def _step(low: str, opened: str, level: str) -> str:
    return f"named_struct('low', {low}, 'opened', {opened}, 'level', {level})"


def _nothing(limit: int) -> str:
    return f"named_struct('total', 0L, 'bound', {full(limit) + 1}L, 'steps', cast(array() as {_STEPS}))"


def pack_map(lengths: str, limit: int, gap: int) -> str:
    """The map of an array of piece lengths (bigint): a piece joins the open
    chunk if its length and the level are within `limit` together, and either
    way adds its length and `gap` to the level."""
    low = f"greatest({limit} - done.total - n + 1, 0L)"
    joins = _step("s.low", "s.opened", f"s.level + n + {gap}")
    opens = _step("s.low", "s.opened + 1", f"n + {gap}")
    return f"""aggregate({lengths}, {_nothing(limit)}, (done, n) -> named_struct(
        'total', done.total + n + {gap},
        'bound', least(done.bound, {low}),
        'steps', concat(
            transform(done.steps, s -> if(s.level + n > {limit}, {opens}, {joins})),
            filter(array({_step(low, "1L", f"n + {gap}")}), s -> s.low < done.bound))))"""


def pack_from(packing: str, opened: str, level: str, limit: int) -> str:
    """`struct(opened, level)` after a map, for a state before it."""
    first = f"slice(filter({packing}.steps, x -> x.low <= at), 1, 1)"
    return f"""transform(array(least({level}, {full(limit)}L)), at -> if(at < {packing}.bound,
        named_struct('opened', {opened}, 'level', at + {packing}.total),
        transform({first}, x -> named_struct('opened', {opened} + x.opened, 'level', x.level))[0]))[0]"""


def compose(maps: str, limit: int) -> str:
    """The map of an array of maps, taken in order.

    Levels that the first of two leaves within its open chunk go on in the second.
    """
    through = f"""transform(a.steps, s -> transform(array({pack_from("b", "s.opened", "s.level", limit)}),
        r -> {_step("s.low", "r.opened", "r.level")})[0])"""
    direct = f"""transform(
        filter(b.steps, (s, i) -> s.low - a.total < a.bound and (i = 0 or get(b.steps, i - 1).low > a.total)),
        s -> {_step("greatest(s.low - a.total, 0L)", "s.opened", "s.level")})"""
    return f"""aggregate({maps}, {_nothing(limit)}, (a, b) -> named_struct(
        'total', a.total + b.total,
        'bound', least(a.bound, greatest(b.bound - a.total, 0L)),
        'steps', concat({through}, {direct})))"""


def packed_chunks(maps: str, limit: int) -> str:
    """How many chunks a text takes whose parts have these maps."""
    start = f"named_struct('opened', 0L, 'level', {full(limit)}L)"
    return f"""aggregate({maps}, {start}, (state, m) -> {pack_from("m", "state.opened", "state.level", limit)},
        state -> state.opened)"""
