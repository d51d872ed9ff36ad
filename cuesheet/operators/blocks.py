"""Running sums and totals of a document, without gathering the document.

A window over a document would sort all its pages in one task, however many
there are. Here its rows are cut into blocks of consecutive ordinals. Rows are
shuffled by (document, block), so the pages of a huge document spread over the
cluster; only one small row per block is brought together by document, and the
sums found there travel back to the rows through the block. Whole numbers are
summed up before they are shuffled. Fractions are added in the order of the
rows, as a loop over the document would, so that results do not change in
their last digits from run to run; a block bounds what one sum has to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of the ordinal dropped at each level: 4096 ordinals to a block. Ordinals
# with wide gaps may leave each row a block of its own and get a second level.
_DENSE = (12,)
_SPARSE = (12, 32)


def document_facts(
    rows: DataFrame,
    key: str,
    order: str,
    sums: dict[str, Column],
    attach: DataFrame | None = None,
    how: str = "left",
    sparse: bool = False,
) -> DataFrame:
    """`rows` with `<name>_before` and `<name>_total` for every entry of `sums`.

    `order` is an integer column, not negative and unique within `key`;
    `sparse` says that its values may lie far apart.

    The rows are read twice, for the blocks and for themselves. Where they come
    out of a shuffle of the same columns both times, Spark reuses it.

    `attach` is a table with at most one row per `key`. Its columns are joined
    on (`how` as in a join) where a document is one row per block, so a
    document that holds much of all rows makes no join task large.
    """
    staged = rows.withColumns({_value(name): value for name, value in sums.items()})
    facts = _facts(staged, key, order, list(sums), attach, how, _SPARSE if sparse else _DENSE)
    return facts.drop(*[_value(name) for name in sums])


def _value(name: str) -> str:
    return f"__{name}"


def _facts(
    rows: DataFrame,
    key: str,
    order: str,
    names: list[str],
    attach: DataFrame | None,
    how: str,
    levels: tuple[int, ...],
) -> DataFrame:
    if not levels:
        joined = rows if attach is None else rows.join(attach, key, how)
        ordered = Window.partitionBy(key).orderBy(order)
        earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return joined.withColumns(
            {f"{name}_before": _sum_over(name, earlier) for name in names}
            | {f"{name}_total": _sum_over(name, whole) for name in names}
        )

    block = f"__block{len(levels)}"
    shift, rest = levels[0], tuple(bits - levels[0] for bits in levels[1:])
    blocked = rows.withColumn(block, F.shiftright(order, shift))
    sums = [_block_sum(blocked, name, order).alias(_value(name)) for name in names]
    blocks = blocked.groupBy(key, block).agg(*sums) if sums else blocked.select(key, block).distinct()
    blocks = _facts(blocks, key, block, names, attach, how, rest)
    base = blocks.drop(*[_value(name) for name in names]).withColumnsRenamed(
        {f"{name}_before": f"__base_{name}" for name in names}
    )
    earlier = (
        Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    located = blocked.join(base, [key, block]).withColumns(
        {f"{name}_before": F.col(f"__base_{name}") + _sum_over(name, earlier) for name in names}
    )
    return located.drop(block, *[f"__base_{name}" for name in names])


def _block_sum(blocked: DataFrame, name: str, order: str) -> Column:
    value = _value(name)
    if not isinstance(blocked.schema[value].dataType, (T.DoubleType, T.FloatType)):
        return F.sum(value)
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce(value, F.lit(0.0)).alias("value"))))
    return F.aggregate(rows, F.lit(0.0), lambda total, row: total + row["value"])


def _sum_over(name: str, window: Window) -> Column:
    return F.coalesce(F.sum(_value(name)).over(window), F.lit(0))


def explode_rows(rows: DataFrame, array: Column, value: str, position: str | None = None) -> DataFrame:
    """One row per array element, its place counted from 0 in `position`.

    The outer form with a filter above it: for the inner form Spark infers a
    filter on the size of the array and evaluates the array twice.
    """
    if position is None:
        exploded = rows.select("*", F.explode_outer(array).alias(value))
    else:
        exploded = rows.select("*", F.posexplode_outer(array).alias(position, value))
    return exploded.where(F.col(value).isNotNull())
