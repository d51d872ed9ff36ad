"""Mixing sources to target weights by a low-discrepancy source schedule.

The documents of a source, shuffled by a digest, form one stream of words,
cut into blocks of equal size. A schedule of slots says which source comes
next: the points of a golden-ratio sequence fall onto the cumulative block
counts of the sources, so that every stretch of the schedule holds each source
nearly in proportion. The slots of a source, ranked, take its blocks in turn,
from the start again once it is used up; the last slot is cut at the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import BLOCK_ROWS, blocks_for, unique_name, with_running_total, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
# Words of a block. The schedule holds up to 2^36 slots: larger corpora take larger blocks.
BLOCK_WORDS = 1024
# Slots that one task makes at a time.
SPAN = 1 << 17
# 2^48 divided by the golden ratio: multiples of it, modulo 2^48, are the points.
_GOLDEN, _ONE = 173961102589771, 1 << 48
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, number, target) for (source, source_size): all
    sources share `SHARE` of the total by weight, none above `MOST_REPEATS`
    times its size; what is cut off is shared by weight among the others.

    Weights go by code point order of the names, null last. Sharing again
    until none is above ends at target = min(cap, level * weight), with one
    level for all; windows over the sources, one row each, find it.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("number") % len(WEIGHTS) + 1)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    everything = Window.partitionBy(F.lit(1))
    level = (F.col("total") * SHARE - F.col("capped")) / F.col("open_weight")
    return (
        sizes.withColumn("number", F.row_number().over(named) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * MOST_REPEATS)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn(
            "capped",
            F.coalesce(
                F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn(
            "open_weight",
            F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        )
        .withColumn("level", level)
        .withColumn(
            "fits", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
        )
        .withColumn(
            "level",
            F.first("fits", ignorenulls=True).over(
                by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
        .select(
            "source",
            "source_size",
            "number",
            F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def point_unit(at: Column, slots: int) -> Column:
    """The unit, of `slots` that share a whole, onto which point number `at`
    falls: the whole part of `slots` times the fraction of `at` golden ratios.

    In parts that stay below 2^63 for up to 2^36 slots and three times as many points."""
    limbs = [
        F.shiftright(at, 13 * k).bitwiseAND(F.lit((1 << 13) - 1)) * F.lit((_GOLDEN << 13 * k) % _ONE) for k in range(3)
    ]
    point = F.pmod(limbs[0] + limbs[1] + limbs[2], F.lit(_ONE))
    high, low = F.shiftright(point, 24), point.bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftright(high * slots + F.shiftright(low * slots, 24), 24)


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, number, block, limit): which block of which source comes at
    which point, and how many words of it are taken."""
    words = F.floor("target")
    size = F.col("source_size")
    plan = (
        sources.where((size > 0) & (words > 0))
        .withColumn("blocks", F.ceil(size / block_words))
        .withColumn("epochs", F.floor(words / size))
        .withColumn("rest", words - F.floor(words / size) * size)
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
        .withColumn("until", F.sum("slots").over(Window.orderBy("number")))
    )
    plan = written(plan, "mix-plan")
    slots = plan.agg(F.sum("slots")).first()[0] or 0
    # With three points to a unit, no gap between neighbouring points spans a whole unit.
    points = plan.sparkSession.range(3 * slots).select(
        point_unit(F.col("id"), slots).alias("unit"), F.col("id").alias("slot")
    )
    # The units of a source in spans, which are dealt out before they are unrolled.
    begin, end = F.col("until") - F.col("slots"), F.col("until") - 1
    kept = ["number", "blocks", "epochs", "rest", "until"]
    spans = plan.select(*kept, F.explode(F.sequence(begin, end, F.lit(SPAN))).alias("begin"))
    units = spans.repartition("number", "begin").select(
        *kept[:-1], F.explode(F.sequence("begin", F.least(F.col("begin") + SPAN - 1, end))).alias("unit")
    )
    first = points.groupBy("unit").agg(F.min("slot").alias("slot"))
    ranked = with_running_total(
        units.join(first, "unit"),
        ["number"],
        F.floor(F.col("slot") / BLOCK_ROWS),
        [F.col("slot")],
        F.lit(1),
        "rank",
    )
    block = F.col("rank") % F.col("blocks")
    left = F.col("rest") - block * block_words
    last = F.floor(F.col("rank") / F.col("blocks")) >= F.col("epochs")
    return ranked.select(
        "slot",
        "number",
        block.alias("block"),
        F.when(last, F.least(left, F.lit(block_words))).otherwise(block_words).alias("limit"),
    )


def mix_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The mix: (row, doc_id, size, source, source_size, target, opens, first_word, words, slot).

    One row for every stretch of a document that a slot takes, words
    `first_word` on; `opens` marks the stretch that begins a document. A
    document of which nothing is taken has one row of 0 words with null slot.
    Null texts have size 0; a null source is a source of its own; repeated
    rows are rows of their own.
    """
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
    ).withColumn(
        "order",
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "size")),
    )
    sized = written(sized, "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sizes), "mix-sources")
    rows = (
        sized.alias("d")
        .join(sources.alias("s"), F.expr("d.source <=> s.source"))
        .select("d.*", "s.number", "s.source_size", "s.target")
    )
    blocks = blocks_for(sized.count())
    head = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    placed = with_running_total(
        rows,
        ["number"],
        F.shiftright(head * blocks, 32),
        [F.col("order"), F.col("row")],
        F.col("size"),
        "at",
    )
    first = F.floor(F.col("at") / block_words)
    last = F.floor((F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1) / block_words)
    pieces = placed.select(
        "*", F.explode(F.sequence(first, last)).alias("block"), first.alias("opening")
    )
    slots = schedule(sources, block_words)
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(
        F.col("at") + F.col("size"),
        F.col("block") * block_words + F.least(F.coalesce("limit", F.lit(0)), F.lit(block_words)),
    )
    return pieces.join(slots, ["number", "block"], "left").select(
        "row",
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (
            (F.col("block") == F.col("opening"))
            & (F.col("at") < F.col("block") * block_words + F.coalesce("limit", F.lit(0)))
        ).alias("opens"),
        (begin - F.col("at")).alias("first_word"),
        F.greatest(end - begin, F.lit(0)).alias("words"),
        "slot",
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the
    mix takes, repeats counted). An empty table gives an empty result."""
    return (
        mix_pieces(docs, doc_id)
        .groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"))
        .drop("row")
    )


def mixed_corpus(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` with every document as often as the mix begins it (0, 1 or 2 times).

    Rows that share an id share the largest of their counts.
    """
    count = unique_name(docs, "copies")
    copies = (
        mix_pieces(docs, doc_id)
        .groupBy("row", "doc_id")
        .agg(F.sum(F.col("opens").cast("int")).alias("copies"))
        .groupBy(F.col("doc_id").alias("_mixed"))
        .agg(F.max("copies").alias(count))
        .where(F.col(count) > 0)
    )
    joined = docs.join(copies, F.col(doc_id).eqNullSafe(F.col("_mixed")))
    repeated = joined.withColumn(count, F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    return repeated.select(*[F.col(f"`{name}`") for name in docs.columns])
