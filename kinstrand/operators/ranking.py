"""Order, statistics and division of sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions.storage import stored


def numbered(rows: DataFrame, *order: str | Column, name: str = "place", start: int = 0) -> DataFrame:
    """``rows`` with ``name``: their places from ``start`` in a total order.

    Rows are dealt by ranges of the order, sorted within them and stored with their place in their range; counts by range, as many as there are
    partitions, give each range its offset. No task sees more rows than those of its range, which equal orders alone can't split.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(sorted_.withColumns({"__range": F.shiftright("__at", 33), "__inside": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = dealt.join(F.broadcast(offsets), "__range")  # a row for each partition
    return placed.withColumn(name, (F.col("__before") + F.col("__inside") + start).cast("long")).drop("__range", "__inside", "__before")


def rank_by_length(sequences: DataFrame, seq: str = "seq", order: str = "seq_idx") -> DataFrame:
    """``rank``: 0 for the longest, equal lengths in the order of ``order``, which tells rows apart.

    Only lengths and ``order`` are sorted, by ranges of both, so sequences of one length are ranked by as many tasks as any others.
    """
    sized = sequences.withColumn("len", F.length(seq))
    places = numbered(sized.select("len", F.col(order).alias("__order")), F.desc("len"), "__order", name="rank").drop("len")
    return sized.join(places, F.col(order) == F.col("__order")).drop("__order")


def statistics(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: n, letters, min_len, max_len, n50 (the first length, longest first, at which half the letters are reached)."""
    counts = sequences.groupBy(F.length(seq).alias("len")).agg(F.count("*").alias("n"))
    upto = F.sum(F.col("len") * F.col("n")).over(Window.orderBy(F.desc("len")))
    counts = counts.withColumn("upto", upto).withColumn("total", F.sum(F.col("len") * F.col("n")).over(Window.partitionBy(F.lit(0))))
    half = F.floor(F.col("total") / 2)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).cast("long").alias("letters"),
        F.min("len").cast("long").alias("min_len"),
        F.max("len").cast("long").alias("max_len"),
        F.max(F.when(F.col("upto") >= half, F.col("len"))).cast("long").alias("n50"),
    )


def divide_round_robin(sequences: DataFrame, parts: int, order: str = "seq_idx") -> DataFrame:
    """``part``: the i-th sequence goes to part i mod ``parts``. ``order`` is dense from 0."""
    return sequences.withColumn("part", F.pmod(F.col(order), F.lit(parts)).cast("long"))


def divide_by_letters(ranked: DataFrame, parts: int) -> DataFrame:
    """``part`` for sequences with rank and len: longest first, a new part when the letters of the current one reach a share of all plus the longest.

    The cuts are a fold, but over lengths and not rows: all of one length go in
    multiplicities, so the driver sees a row for each length.
    """
    spark = ranked.sparkSession
    counts = [(r.len, r.n) for r in ranked.groupBy("len").agg(F.count("*").alias("n")).orderBy(F.desc("len")).collect()]
    limit = sum(a * n for a, n in counts) // parts + (counts[0][0] if counts else 0)
    cuts, letters, rank = [0], 0, 0
    for length, n in counts:
        left = n
        while left:
            fits = max(1, -(-(limit - letters) // length)) if length else left
            take = min(left, fits)
            letters, rank, left = letters + take * length, rank + take, left - take
            if letters >= limit and (left or rank):
                cuts.append(rank)
                letters = 0
    table = spark.createDataFrame([(i, a) for i, a in enumerate(cuts)], "part long, low long")
    starts = table.agg(F.sort_array(F.collect_list("low")).alias("lows"))
    return ranked.crossJoin(F.broadcast(starts)).withColumn("part", (F.size(F.filter("lows", lambda x: x <= F.col("rank"))) - 1).cast("long")).drop("lows")
