"""Read operators: overlaps and links of mates. Chimeras are in :mod:`kinstrand.operators.chimeras`."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.operators import greedy


def overlap_pairs(ranked: DataFrame, least: int = 20, share: float = 0.0, both_strands: bool = True) -> DataFrame:
    """(q, r, strand, overlap, q_off, r_off, side): r < q, and a suffix of r is a prefix of q (side 0) or a prefix of r a suffix of q (side 1).

    An overlap has at least max(least, share of the query) letters and fits exactly. Each end of a sequence, of every length, is a number made of that length
    and the end's first and last ``least`` letters; equal numbers meet, and only then letters are fetched and the whole overlap is compared.
    """
    rows = ranked.select("rank", "seq", F.col("len").cast("int").alias("len")).where(F.col("len") >= least)
    queries = rows.select(F.col("rank").alias("q"), "len", "seq").withColumn("strand", F.lit("+"))
    if both_strands:
        queries = queries.unionByName(rows.select(F.col("rank").alias("q"), "len", S.reverse_complement("seq").alias("seq"), F.lit("-").alias("strand")))
    targets = rows.withColumnRenamed("rank", "r")
    word = lambda at: F.substring("b", at, F.lit(least))
    begin = lambda n: F.xxhash64(n, word(F.lit(1)), word(n - (least - 1)))
    end = lambda n: F.xxhash64(n, word(F.col("len") - n + 1), word(F.col("len") - (least - 1)))

    def ends(of: DataFrame, key, low: Column, high: Column, *columns: str) -> DataFrame:
        each = F.transform(F.sequence(low, high), lambda n: F.struct(n.alias("n"), key(n).alias("key")))
        # bytes, where a place is an offset; ends multiply rows by the length, so sequences are first spread over all partitions
        bytes_ = of.where(low <= high).withColumn("b", F.col("seq").cast("binary")).repartition(spread, columns[0])
        return bytes_.select(*columns, F.explode(each).alias("x")).select(*columns, "x.n", "x.key")

    need, fewest = F.greatest(F.lit(least), F.floor(F.col("len") * share).cast("int")), F.lit(least)
    qs = queries.select("q", "strand", F.col("len").alias("q_len"), F.col("seq").alias("q_seq"))
    rs = targets.select("r", F.col("len").alias("r_len"), F.col("seq").alias("r_seq"))
    n, spread = F.col("n"), int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(mine, other, high: Column) -> DataFrame:
        # ends are many more than what they are cut from, which sizes don't tell, so none are broadcast
        found = ends(queries, mine, need, high, "q", "strand").join(ends(targets, other, fewest, F.col("len"), "r").drop("n").hint("merge"), "key").where("r < q").drop("key")
        return found.join(qs, ["q", "strand"]).join(rs, "r").where(n <= F.col("r_len"))

    ahead = met(begin, end, F.col("len") - 1).where(F.substr("r_seq", F.col("r_len") - n + 1, n) == F.substr("q_seq", F.lit(1), n))
    ahead = ahead.select("q", "r", "strand", n.alias("overlap"), F.lit(0).alias("q_off"), (F.col("r_len") - n).alias("r_off"), F.lit(0).alias("side"))
    behind = met(end, begin, F.col("len")).where(F.substr("q_seq", F.col("q_len") - n + 1, n) == F.substr("r_seq", F.lit(1), n))
    return ahead.unionByName(behind.select("q", "r", "strand", n.alias("overlap"), (F.col("q_len") - n).alias("q_off"), F.lit(0).alias("r_off"), F.lit(1).alias("side")))


def overlap_clusters(ranked: DataFrame, least: int = 20, share: float = 0.0, both_strands: bool = True) -> DataFrame:
    """``ranked`` with is_rep, rep_rank, strand, overlap, q_off, r_off: suffix hits before prefix hits, longest first, plus before minus, then the earliest representative."""
    pairs = greedy.stored(overlap_pairs(ranked, least, share, both_strands))
    status = greedy.representatives(pairs.select("q", "r").distinct())
    reps = status.where("is_rep").select(F.col("rank").alias("r"))
    order = Window.partitionBy("q").orderBy("side", F.desc("overlap"), "strand", "r")
    hits = pairs.join(reps, "r", "left_semi").join(status.where("not is_rep").select(F.col("rank").alias("q")), "q", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    out = ranked.join(hits.withColumnRenamed("q", "rank").drop("n"), "rank", "left")
    return out.withColumn("is_rep", F.col("r").isNull()).withColumn("rep_rank", F.coalesce("r", "rank")).drop("r")


def link_mates(pairs: DataFrame, least: int = 10, errors: int = 1) -> DataFrame:
    """Contigs of (id, r1, r2): R2's reverse complement laid over the end of R1 at the longest overlap with few errors.

    contig (from 1), seq, length, overlap, mismatch_no and mismatch_pos (from 1). Every place where both letters are
    known and differ doubles the contigs; an N takes the other mate's letter; N against N is an error. Pairs without an overlap give no row.
    """
    n = F.least(F.length("r1"), F.length("r2"))
    both = pairs.withColumn("b", S.reverse_complement("r2")).withColumn("n", n).where(F.col("n") >= least)

    def window(k):
        a, b = F.substr("r1", F.length("r1") - k + 1, k), F.substr("b", F.lit(1), k)
        wrong = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x != y) | ((x == "N") & (y == "N")), 1).otherwise(0))
        return F.aggregate(wrong, F.lit(0), lambda s, x: s + x)

    # by pigeonhole, of errors + 1 blocks at the beginning of b one stands in r1 as it is; only there the overlap is gone through
    edges = [least * i // (errors + 1) for i in range(errors + 2)]

    def may(k):
        at = F.length("r1") - k
        same = [F.substr("r1", at + x + 1, F.lit(y - x)) == F.substr("b", F.lit(x + 1), F.lit(y - x)) for x, y in zip(edges, edges[1:], strict=False)]
        return reduce(or_, same)

    both = both.withColumn("ks", F.filter(F.sequence(F.col("n"), F.lit(least)), may))
    # a generator, so that a row's overlap is looked for once
    joined = both.select("*", F.explode(F.slice(F.filter("ks", lambda k: window(k) <= errors), 1, 1)).alias("k")).withColumn("head", F.length("r1") - F.col("k"))
    cells = F.transform(
        F.sequence(F.lit(1), F.col("k")),
        lambda i: F.struct(i.alias("i"), F.substr("r1", F.col("head") + i, F.lit(1)).alias("x"), F.substr("b", i, F.lit(1)).alias("y")),
    )
    joined = joined.withColumn("cells", cells)
    joined = joined.withColumn("wrong", F.filter("cells", lambda c: (c.x != c.y) | ((c.x == "N") & (c.y == "N"))))
    joined = joined.withColumn("forks", F.transform(F.filter("cells", lambda c: (c.x != c.y) & (c.x != "N") & (c.y != "N")), lambda c: c.i))
    joined = joined.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size("forks")).cast("long") - 1)))

    def letter(c):
        place = F.array_position("forks", c.i)  # from 1, 0 if there is no fork
        odd = F.floor(F.col("t") / F.pow(F.lit(2.0), F.size("forks") - place)) % 2 == 1
        return F.when(c.x == "N", c.y).when(c.y == "N", c.x).when((place > 0) & odd, c.y).otherwise(c.x)

    middle = F.array_join(F.transform("cells", letter), "")
    seq = F.concat(F.substr("r1", F.lit(1), F.col("head")), middle, F.substr("b", F.col("k") + 1, F.length("b")))
    return joined.select(
        "id", (F.col("t") + 1).alias("contig"), seq.alias("seq"), (F.length("r1") + F.length("b") - F.col("k")).cast("long").alias("length"), F.col("k").cast("long").alias("overlap"),
        F.size("wrong").cast("long").alias("mismatch_no"), F.array_join(F.transform("wrong", lambda c: (c.i + F.col("head")).cast("string")), ",").alias("mismatch_pos"),
    )


def join_mates(pairs: DataFrame, length: int) -> DataFrame:
    """(id, seq): the first ``length`` letters of R1 and of R2's reverse complement from its end, without an overlap."""
    b = S.reverse_complement("r2")
    return pairs.select("id", F.concat(F.substring("r1", 1, length), F.substr(b, F.greatest(F.lit(1), F.length("r2") - length + 1), F.lit(length))).alias("seq"))
