"""Greedy representative selection on a table of passing pairs.

A sequence becomes a representative unless a representative of smaller rank passes with
it; so the representatives are the lexicographically first maximal independent set of the
passing pairs. It is found in rounds: sequences whose smaller neighbours are all decided decide
themselves, all at once. A round is two joins on the pairs still open; only who becomes redundant is kept of it, as all others
represent. Tables between rounds are written to the shared folder, and deleted when a later round has replaced them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions.storage import forget, shared_folder, stored
from kinstrand.operators.ranking import numbered

__all__ = ["assign", "forget", "number_representatives", "placed", "representatives", "shared_folder", "stored"]


def representatives(pairs: DataFrame) -> DataFrame:
    """(rank, is_rep) of every rank in ``pairs`` (q, r with r < q): representatives and redundant ones.

    Ranks without pairs are representatives; they don't appear. Each round decides the smallest open rank at least, and
    as a rule nearly all; rounds go on until none is open.
    """
    open_ = first = stored(pairs.select("q", "r").where("r < q").distinct())
    redundant: list[DataFrame] = []
    while not open_.isEmpty():
        # without a smaller open neighbour: a representative; its greater neighbours are redundant and take all their pairs with them
        gone = stored(open_.join(open_.select(F.col("q").alias("r")).distinct(), "r", "left_anti").select("q").distinct())
        kept = stored(open_.join(gone, "q", "left_anti").join(gone.select(F.col("q").alias("r")), "r", "left_anti"))
        redundant.append(gone)
        if open_ is not first:
            forget(open_)
        open_ = kept
    ranks = first.select(F.explode(F.array("q", "r")).alias("rank"), F.lit(True).alias("is_rep"))
    for gone in redundant:
        ranks = ranks.unionByName(gone.select(F.col("q").alias("rank"), F.lit(False).alias("is_rep")))
    out = stored(ranks.groupBy("rank").agg(F.min("is_rep").alias("is_rep")))
    forget(first, *redundant, *(() if open_ is first else (open_,)))
    return out


def assign(ranked: DataFrame, pairs: DataFrame, mode: str = "fast") -> DataFrame:
    """``ranked`` with is_rep, rep_rank and cluster_id.

    ``pairs`` (q, r, and first_word for ``fast`` or score for ``accurate``) hold all passing pairs. fast: the first
    representative in look-up order (smallest shared word, then rank); accurate: the highest score, then the smallest rank.
    """
    status = representatives(pairs)
    reps = status.where("is_rep").select(F.col("rank").alias("r"))
    order = [F.col("first_word"), F.col("r")] if mode == "fast" else [F.desc("score"), F.col("r")]
    chosen = pairs.where("r < q").join(reps, "r", "left_semi")  # who has a representative before it is redundant
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where("n = 1").select(F.col("q").alias("rank"), F.col("r").alias("rep_rank"))
    return placed(ranked, chosen)


def placed(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """``ranked`` with is_rep, rep_rank and cluster_id; ``chosen`` (rank, rep_rank) has the redundant ones."""
    out = ranked.join(chosen, "rank", "left").withColumn("is_rep", F.col("rep_rank").isNull()).withColumn("rep_rank", F.coalesce("rep_rank", "rank"))
    return out.join(number_representatives(out.where("is_rep").select("rank")), "rep_rank")


def number_representatives(reps: DataFrame) -> DataFrame:
    """(rep_rank, cluster_id): ordinals from 0 by rank."""
    return numbered(reps.select(F.col("rank").alias("rep_rank")), "rep_rank", name="cluster_id")
