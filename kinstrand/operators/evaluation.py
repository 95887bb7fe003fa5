"""Comparing clusters with labels: pairs, links, enrichment; sample and taxon tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.operators.ranking import numbered


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def pair_quality(members: DataFrame) -> DataFrame:
    """One row from (cluster_id, term): cluster_pairs, term_pairs, both_pairs, sensitivity, specificity.

    Pairs are counted in closed form from group sizes; none are listed.
    """
    cells = members.where("term is not null").groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    both = cells.agg(_sum(_pairs(F.col("n"))).alias("both_pairs"))
    clusters = cells.groupBy("cluster_id").agg(F.sum("n").alias("n")).agg(_sum(_pairs(F.col("n"))).alias("cluster_pairs"))
    terms = cells.groupBy("term").agg(F.sum("n").alias("n")).agg(_sum(_pairs(F.col("n"))).alias("term_pairs"))
    one = clusters.crossJoin(terms).crossJoin(both)  # one row each
    return one.select("cluster_pairs", "term_pairs", "both_pairs", F.try_divide("both_pairs", "term_pairs").alias("sensitivity"), F.try_divide("both_pairs", "cluster_pairs").alias("specificity"))


#: Rows of a block of :func:`pair_list`, about, and pairs of a task.
PAIR_BLOCK, PAIRS_AT_ONCE = 1_000, 4_000_000


def _met(members: DataFrame, group: str, other: str) -> DataFrame:
    """(a, b, same: whether they agree in ``other``) of rows of one ``group``, ids a < b.

    A group's rows are in blocks by their ids, and each two blocks meet in a cell, so no task has a whole group and each pair is made once, one within a block as a < b.
    """
    rows = members.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(other).alias("o"), "id")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.coalesce(F.sum(_pairs(F.col("n").cast("double"))), F.lit(0.0)).alias("n")).first().n
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS_AT_ONCE))
    at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes.select("g", F.ceil(F.col("n") / PAIR_BLOCK).alias("blocks")), "g").withColumn("at", at)
    x = dealt.select("g", F.col("at").alias("i"), F.explode(F.sequence("at", (F.col("blocks") - 1).cast("int"))).alias("j"), F.col("o").alias("xo"), F.col("id").alias("x"))
    y = dealt.select("g", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), F.col("o").alias("yo"), F.col("id").alias("y"))
    cell = ["g", "i", "j"]
    met = x.repartition(tasks, *cell).join(y.repartition(tasks, *cell), cell).where("i < j or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.coalesce(F.col("xo") == F.col("yo"), F.lit(False)).alias("same"))


def pair_list(members: DataFrame) -> DataFrame:
    """(a, b, status) of ids a < b: T in a cluster and a term together, C in a cluster only, B in a term only. Quadratic in group sizes by its nature.

    Each row of ``members`` counts by itself. What two rows are is known where they meet, so pairs aren't dealt or sorted.
    """
    c = _met(members, "cluster_id", "term").select("a", "b", F.when(F.col("same"), "T").otherwise("C").alias("status"))
    return c.unionByName(_met(members, "term", "cluster_id").where(~F.col("same")).select("a", "b", F.lit("B").alias("status")))


def link_quality(members: DataFrame) -> DataFrame:
    """As :func:`pair_quality` with n - 1 links for a group of n."""
    cells = members.where("term is not null").groupBy("cluster_id", "term").agg(F.count("*").alias("n"))
    both = cells.agg(_sum(F.col("n") - 1).alias("both_links"))
    clusters = cells.groupBy("cluster_id").agg(F.sum("n").alias("n")).agg(_sum(F.col("n") - 1).alias("cluster_links"))
    terms = cells.groupBy("term").agg(F.sum("n").alias("n")).agg(_sum(F.col("n") - 1).alias("term_links"))
    one = clusters.crossJoin(terms).crossJoin(both)
    return one.select("cluster_links", "term_links", "both_links", F.try_divide("both_links", "term_links").alias("sensitivity"), F.try_divide("both_links", "cluster_links").alias("specificity"))


def log_factorial(n: Column) -> Column:
    """ln(n!), from a short table or Stirling's series; good to 1e-11 of its value."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(12)))
    return F.when(n < 12, F.get(small, n.cast("int"))).otherwise(series)


def enrichment(members: DataFrame) -> DataFrame:
    """Right-tailed Fisher test of each cluster and term in (cluster_id, id, term): n11, n1p, np1, total, ratio, p_value.

    The first term of the tail is made from log factorials, the others by the ratio of neighbouring terms.
    """
    total = members.select("id").distinct().agg(F.count("*").alias("total"))
    n1p = members.select("cluster_id", "id").distinct().groupBy("cluster_id").agg(F.count("*").alias("n1p"))
    np1 = members.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("np1"))
    cells = members.select("cluster_id", "term", "id").distinct().groupBy("cluster_id", "term").agg(F.count("*").alias("n11"))
    cells = cells.join(n1p, "cluster_id").join(np1, "term").crossJoin(total)
    top = F.least("n1p", "np1")
    t, r, c, x = F.col("total"), F.col("n1p"), F.col("np1"), F.col("n11")
    up = [c, t - c, r, t - r]
    down = [x, c - x, r - x, t - c - r + x, t]
    log_first = sum((log_factorial(n) for n in up), F.lit(0.0)) - sum((log_factorial(n) for n in down), F.lit(0.0))
    tail = F.aggregate(
        F.when(top > F.col("n11"), F.sequence(F.col("n11"), top - 1)).otherwise(F.array().cast("array<long>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.struct(
            (s["term"] * (F.col("np1") - k) * (F.col("n1p") - k) / ((k + 1) * (F.col("total") - F.col("np1") - F.col("n1p") + k + 1))).alias("term"),
            (s["sum"] + s["term"] * (F.col("np1") - k) * (F.col("n1p") - k) / ((k + 1) * (F.col("total") - F.col("np1") - F.col("n1p") + k + 1))).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    ratio = F.col("n11") * F.col("total") / (F.col("n1p") * F.col("np1"))
    return cells.withColumn("p_value", F.least(F.lit(1.0), F.exp(log_first) * tail)).select(
        "cluster_id", "term", "n11", "n1p", "np1", "total", ratio.alias("ratio"), "p_value"
    )


def sample_table(members: DataFrame, samples: Sequence[str]) -> DataFrame:
    """otu and a column of counts for each sample, from (otu, sample)."""
    return members.groupBy("otu").pivot("sample", list(samples)).agg(F.count(F.lit(1))).na.fill(0)


def annotated_table(members: DataFrame, samples: Sequence[str]) -> DataFrame:
    """otu, the joined annotations of members without a sample, and counts for each sample, from (otu, sample, annotation)."""
    names = members.where("sample is null").groupBy("otu").agg(F.array_join(F.array_sort(F.collect_set("annotation")), ";").alias("annotation"))
    return sample_table(members.where("sample is not null"), samples).join(names, "otu", "left")


def taxon_rollup(counts: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """level, taxon (the ranks so far, joined by ;), n and place (by n, largest first, in its level): one aggregate over ROLLUP."""
    rolled = counts.rollup(*ranks).agg(F.sum("n").cast("long").alias("n"), F.grouping_id().alias("g"))
    level = F.lit(len(ranks)) - F.size(F.filter(F.array(*(F.shiftright("g", i) % 2 for i in range(len(ranks)))), lambda x: x == 1))
    named = rolled.withColumn("level", level.cast("long")).where("level > 0").withColumn("taxon", F.concat_ws(";", *(F.when(F.col("level") > i, F.coalesce(r, F.lit("None"))) for i, r in enumerate(ranks))))
    # places over all levels at once, and each level's first one: no level is one task's
    placed = numbered(named.select("level", "taxon", "n"), "level", F.desc("n"), "taxon")
    first = placed.groupBy("level").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "level").select("level", "taxon", "n", (F.col("place") - F.col("first") + 1).alias("place"))  # a row for each rank


def consensus(sequences: DataFrame, columns: int = 45, seq: str = "seq") -> DataFrame:
    """place, letter, share, n: the most frequent letter of each of the first columns (the smaller of equals)."""
    letters = sequences.select(F.posexplode(F.split(F.substring(seq, 1, columns), "")).alias("place", "letter")).where("letter <> ''")
    counts = letters.groupBy("place", "letter").agg(F.count("*").alias("c"))
    best = counts.groupBy("place").agg(F.max_by("letter", F.struct("c", -F.ascii("letter"))).alias("letter"), F.max("c").alias("c"), F.sum("c").alias("n"))
    return best.select((F.col("place") + 1).cast("long").alias("place"), "letter", (F.col("c") / F.col("n")).alias("share"), F.col("n").cast("long").alias("n"))


def consensus_length(columns: DataFrame, from_share: float = 0.33, low: float = 0.75, run: int = 3) -> DataFrame:
    """One row ``keep``: columns up to the first of ``run`` weak ones in a row, a third of all at least."""
    after = Window.orderBy("place").rowsBetween(0, run - 1)
    weak = columns.withColumn("w", F.sum((F.col("share") < low).cast("int")).over(after)).withColumn("m", F.max("place").over(Window.partitionBy(F.lit(0))))
    cut = F.min(F.when((F.col("w") == run) & (F.col("place") >= F.col("m") * from_share), F.col("place") - 1))
    return weak.agg(F.coalesce(cut, F.max("place")).cast("long").alias("keep"))


def pair_chimeras(pairs: DataFrame, fold: int = 2) -> DataFrame:
    """Clusters of read pairs whose two mates lie with different, more abundant parents: pairs(cluster_id, n, r1_rep, r2_rep, r1_n, r2_n, r1_otu, r2_otu)."""
    return pairs.where((F.col("r1_rep") != F.col("r2_rep")) & (F.col("r1_n") >= fold * F.col("n")) & (F.col("r2_n") >= fold * F.col("n")) & ~F.col("r1_otu").eqNullSafe(F.col("r2_otu")))


def drop_chimeric_and_small(pairs: DataFrame, share: float, fold: int = 2) -> DataFrame:
    """``pairs`` with ``reason``: chimeric, small (not above the larger of 1 and share of all reads) or null for those that stay."""
    total = pairs.agg(F.sum("n").alias("__total"))  # one row
    cutoff = F.greatest(F.lit(1), F.floor(F.col("__total") * share))
    odd = (F.col("r1_rep") != F.col("r2_rep")) & (F.col("r1_n") >= fold * F.col("n")) & (F.col("r2_n") >= fold * F.col("n")) & ~F.col("r1_otu").eqNullSafe(F.col("r2_otu"))
    return pairs.crossJoin(F.broadcast(total)).withColumn("reason", F.when(odd, "chimeric").when(F.col("n") <= cutoff, "small")).drop("__total")


def drop_reference_chimeras(pairs: DataFrame, cutoff: int, fold: int = 2) -> DataFrame:
    """Sample clusters of ``cutoff`` members or fewer whose mates map to different references, neither the cluster's own, each ``fold`` times as abundant where that is known, go."""
    known = lambda c: F.coalesce(F.col(c) >= fold * F.col("n"), F.lit(True))
    odd = (F.col("n") <= cutoff) & (F.col("r1_rep") != F.col("r2_rep")) & (F.col("r1_rep") != F.col("cluster_id")) & (F.col("r2_rep") != F.col("cluster_id")) & known("r1_n") & known("r2_n")
    return pairs.where(~F.coalesce(odd, F.lit(False)))
