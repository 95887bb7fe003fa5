"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words and its place is a hash of its id. Each
source takes its documents in the order of their places until its target is met,
but nothing is sorted: sizes are summed by source and hash bucket, the bucket in which the budget
ends is refined by the next bits of the hash, three times twelve bits deep, and the
threshold so found is a filter. Histograms are combined before the shuffle; a source that holds a third
of all rows is 4,096 rows of them at most. After the last level, whichever side of the
last bucket is nearer to the target is taken.

Targets: sources in the order of their code points, null last, weigh 5, 2, 1, 5, 2, 1, ... and share
``share`` of all sizes; no target is above ``most`` times its source's size, what is
above is shared again by weight among the others. A target over the source's size
takes every document once and those below the threshold twice.

Null text has size 0. A null doc_id has a place of its own; rows that share a doc_id are taken alike. Other
columns are kept, whatever their names, but for those of the result. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.llm.common import cut, id_key, words

WEIGHTS = (5, 2, 1)
BITS, LEVELS = 12, 3


#: Columns that :func:`mix` adds; columns of these names in its input give way to them.
RESULT = ("size", "source_size", "target", "times", "taken")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with ``__size`` and ``__place``, the hash's upper 36 bits."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_key()), 64 - BITS * LEVELS)
    return docs.withColumns({"__size": F.size(words(F.col("text"))).cast("long"), "__place": place})


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target; one row for each source. ``sizes`` has source and size."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("limit") / F.col("weight"))
    # Sources fill up in the order of full_at. What each weight gets if all before are full is greatest
    # at the first source that isn't full.
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("each", rest / weight)
    each = each.withColumn("level", F.max("each").over(everything))
    return each.select("source", "source_size", F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``once``, how often every document is taken, and ``below``, the place below which it is taken once more.

    ``sizes`` (source, size, place) is read once for each level.
    """
    size, goal = F.col("source_size"), F.col("target")
    once = F.when(size > 0, F.floor(goal / size)).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("once", once).withColumn("budget", goal - F.col("once") * size).withColumns({"base": F.lit(0).cast("long"), "spent": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = sizes.select(F.col("source").alias("of"), "size", F.shiftright("place", shift).alias("bucket"))
        if level > 1:
            edge = state.select(F.col("source").alias("of2"), F.col("base").alias("edge"))
            inside = inside.join(edge, F.col("of").eqNullSafe(F.col("of2")) & (F.shiftright("bucket", BITS) == F.col("edge")))
        sums = inside.groupBy("of", "bucket").agg(F.sum("size").alias("n"))
        running = F.sum("n").over(Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("upto", running)
        met = state.drop("n").join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        # the bucket in which the budget ends: the first that goes beyond it
        over = F.col("spent") + F.col("upto") > F.col("budget")
        found = F.min(F.when(over, F.struct("bucket", (F.col("spent") + F.col("upto") - F.col("n")).alias("spent"), "n")))
        keys = ["source", "source_size", "target", "once", "budget"]
        state = met.groupBy(*keys).agg(found.alias("at")).select(*keys, F.col("at.bucket").alias("base"), F.coalesce("at.spent", F.lit(0)).alias("spent"), F.col("at.n").alias("n"))
        state = cut(state, "mix")
    nearer = F.abs(F.col("spent") + F.col("n") - F.col("budget")) < F.abs(F.col("spent") - F.col("budget"))
    below = F.when(F.col("base").isNull() | (F.col("budget") <= 0), F.lit(0)).otherwise(F.col("base") + F.when(nearer, 1).otherwise(0))
    return state.select("source", "source_size", "target", "once", below.cast("long").alias("below"))


def taken(sized_docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``sized_docs`` with the columns of ``RESULT``; taken: the words that the mix takes of each document."""
    limits = limits.select(*(F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "once", "below")))
    joined = sized_docs.join(limits, F.col("source").eqNullSafe(F.col("__source")))
    times: Column = F.col("__once") + F.when(F.col("__place") < F.col("__below"), 1).otherwise(0)
    own = [F.col(f"`{c}`") for c in sized_docs.columns if c not in RESULT and c not in ("__size", "__place")]
    return joined.withColumn("__times", times).select(
        *own, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__times").alias("times"),
        (F.col("__size") * F.col("__times")).alias("taken"),
    )


def _limits(small: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    sizes = small.select("source", F.col("__size").alias("size"), F.col("__place").alias("place"))
    return thresholds(sizes, cut(targets(sizes, weights, share, most), "targets"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target, times and taken."""
    small = cut(sized(docs, seed).select("source", "__size", "__place"), "sizes")
    return taken(sized(docs, seed), _limits(small, weights, share, most))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """As :func:`mix`, without texts and other columns: texts are read once."""
    small = cut(sized(docs, seed).select("doc_id", "source", "__size", "__place"), "sizes")
    return taken(small, _limits(small, weights, share, most))
