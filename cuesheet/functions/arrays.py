"""Arrays inside one row: a running fold, and cutting into runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def array_scan(
    values: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    emit_type: str,
) -> Column:
    """`struct(out, state)`: what `emit(state, value)` gives for every value in
    turn, and the state after the last one; `step(state, value)` moves on.

    Appending to one growing array copies it for every element, which is
    quadratic in the length. The array is therefore folded in blocks: only a
    short block grows element by element, and finished blocks are appended
    whole. The order of evaluation is that of a plain loop, so sums of doubles
    come out bit for bit as a loop would give them.
    """

    def pack(out: Column, state: Column) -> Column:
        return F.struct(out.alias("out"), state.alias("state"))

    def fold_block(done: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            pack(F.array().cast(f"array<{emit_type}>"), done["state"]),
            lambda acc, value: pack(
                F.array_append(acc["out"], emit(acc["state"], value)),
                step(acc["state"], value),
            ),
            lambda acc: pack(F.array_append(done["out"], acc["out"]), acc["state"]),
        )

    def blocks(array: Column) -> Column:
        starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(_BLOCK)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda start: F.slice(array, start, F.lit(_BLOCK)),
        )

    return F.aggregate(
        let(values, blocks),
        pack(F.array().cast(f"array<array<{emit_type}>>"), zero),
        fold_block,
        lambda acc: pack(F.flatten(acc["out"]), acc["state"]),
    )


def slices_from(values: Column, opens: Column) -> Column:
    """Cut an array before every element whose flag in `opens` is true.

    Both arguments are used more than once; bind computed ones with `let`.
    """
    starts = F.filter(
        F.transform(opens, lambda flag, i: F.when(flag, i + 1)), lambda start: start.isNotNull()
    )

    def cut(first: Column) -> Column:
        after = F.transform(first, lambda _, i: F.coalesce(F.get(first, i + 1), F.size(values) + 1))
        return F.zip_with(first, after, lambda a, b: F.slice(values, a, b - a))

    return let(starts, cut)
