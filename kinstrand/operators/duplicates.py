"""Duplicate reads: exact, prefix and mismatch-tolerant, abundances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.operators import greedy


def exact(ranked: DataFrame) -> DataFrame:
    """``ranked`` (rank, seq) with rep_rank, is_rep and abundance: equal sequences join the one of smallest rank.

    Sequences meet by 128 bits of their SHA-256, so letters are dealt only if a caller wants them.
    """
    keyed = ranked.withColumn("__key", F.substring(F.unhex(F.sha2("seq", 256)), 1, 16))
    groups = keyed.groupBy("__key").agg(F.min("rank").alias("rep_rank"), F.count("*").alias("abundance"))
    return keyed.join(groups, "__key").drop("__key").withColumn("is_rep", F.col("rank") == F.col("rep_rank"))


#: Sequences meet first by so many letters.
HEAD = 12


def _head(n: Column | int) -> Column:
    return F.substr("seq", F.lit(1), F.lit(n) if isinstance(n, int) else n)


def _exact_prefixes(classes: DataFrame) -> DataFrame:
    """(q, r): q is the beginning of the longer r.

    Two levels: sequences that begin alike know which lengths occur among them, so a sequence makes a hash only for a
    length at which it may meet another. Sequences of fewer than ``HEAD`` letters are looked up at each such length that occurs.
    """
    keyed = classes.withColumn("head", F.when(F.col("len") >= HEAD, F.xxhash64(_head(HEAD))))
    lengths = keyed.where("head is not null").groupBy("head").agg(F.collect_set("len").alias("ls"))
    short = classes.where(F.col("len") < HEAD).agg(F.collect_set("len").alias("shorts"))  # HEAD numbers at most
    at = keyed.join(lengths, "head", "left").crossJoin(F.broadcast(short))
    at = at.withColumn("l", F.explode(F.filter(F.concat("shorts", F.coalesce("ls", F.array().cast("array<int>"))), lambda x: x < F.col("len"))))
    heads = at.select(F.col("rank").alias("r"), F.xxhash64(_head(F.col("l"))).alias("h"), "l")
    whole = classes.select(F.col("rank").alias("q"), F.xxhash64("seq").alias("h"), F.col("len").alias("l"))
    return whole.join(heads, ["h", "l"]).where("r < q").select("q", "r")


def _blocks(rows: DataFrame, pieces: int, width: Column) -> DataFrame:
    """(rank, w, i, b): hashes of the ``pieces`` blocks of the first ``width`` letters; an empty block is one, too."""
    rows = rows.withColumn("w", width)
    end = lambda i: F.floor(F.col("w") * i / pieces).cast("int")
    cut = F.array(*(F.struct(F.lit(i).alias("i"), F.xxhash64(F.substr("seq", end(i) + 1, end(i + 1) - end(i))).alias("b")) for i in range(pieces)))
    return rows.select("rank", "w", F.explode(cut).alias("x")).select("rank", "w", "x.i", "x.b")


def prefix_pairs(ranked: DataFrame, errors: int = 0, same_length: bool = False) -> DataFrame:
    """(q, r, exact): r < q and q differs from the first len(q) letters of r in ``errors`` places at most.

    Hashes are what is dealt; texts are fetched for the pairs found, and compared. With errors, by pigeonhole: of errors + 1 blocks a
    pair agrees in one. Blocks are those of the whole sequence if lengths must be equal, else of its
    first 2**k letters for the greatest such number; a longer sequence has them for each k. Equal sequences are joined as one.
    """
    classes = ranked.groupBy("seq", "len").agg(F.min("rank").alias("rank"))
    if same_length and not errors:
        return _none(ranked)
    classes = greedy.stored(classes.select("rank", "len", "seq").where("len > 0"))
    if not errors:
        pairs = _exact_prefixes(classes)
    elif same_length:
        blocks = greedy.stored(_blocks(classes, errors + 1, F.col("len")))
        pairs = blocks.withColumnRenamed("rank", "q").join(blocks.withColumnRenamed("rank", "r"), ["w", "i", "b"]).where("r < q").select("q", "r").distinct()
    else:
        level = F.floor(F.log2("len")).cast("int")
        own = _blocks(classes, errors + 1, F.pow(F.lit(2), level).cast("int")).withColumnRenamed("rank", "q")
        every = classes.withColumn("k", F.explode(F.sequence(F.lit(0), level)))
        pairs = own.join(_blocks(every, errors + 1, F.pow(F.lit(2), "k").cast("int")).withColumnRenamed("rank", "r"), ["w", "i", "b"]).where("r < q").select("q", "r").distinct()
    of = lambda x: classes.select(F.col("rank").alias(x), F.col("seq").alias(f"{x}s"))
    both = pairs.join(of("q"), "q").join(of("r"), "r").withColumn("rs", F.substr("rs", F.lit(1), F.length("qs")))
    alike = S.mismatches("qs", "rs") <= errors if errors else F.col("qs") == F.col("rs")
    return both.where(alike).select("q", "r", F.lit(False).alias("exact"))


def _none(ranked: DataFrame) -> DataFrame:
    return ranked.sparkSession.createDataFrame([], "q long, r long, exact boolean")


def cluster(ranked: DataFrame, errors: int = 0, same_length: bool = True) -> DataFrame:
    """``ranked`` with rep_rank, is_rep, abundance: each joins the earliest representative that it equals, or else is a prefix of within ``errors``."""
    ranked = greedy.stored(ranked)
    classes = exact(ranked)
    pairs = greedy.stored(prefix_pairs(ranked, errors, same_length))
    reps = greedy.representatives(pairs)
    first = pairs.join(reps.where("is_rep").select(F.col("rank").alias("r")), "r", "left_semi").join(reps.where(~F.col("is_rep")).select(F.col("rank").alias("q")), "q", "left_semi").groupBy("q").agg(F.min("r").alias("to"))
    out = classes.join(first, F.col("rep_rank") == F.col("q"), "left").withColumn("rep_rank", F.coalesce("to", "rep_rank"))
    return out.withColumn("is_rep", F.col("rank") == F.col("rep_rank")).withColumn("abundance", F.count("*").over(Window.partitionBy("rep_rank"))).drop("q", "to")


def abundances(reads: DataFrame, descr: str = "descr") -> DataFrame:
    """Abundance of each read as its description says, 1 if it doesn't."""
    return reads.withColumn("abundance", S.abundance(descr))


def common_primer(reads: DataFrame, seq: str = "seq", least: int = 15) -> DataFrame:
    """One row ``primer_length``: the longest prefix of all, 0 if shorter than ``least``. It is what the smallest and the largest string have in common."""
    ends = reads.agg(F.min(seq).alias("a"), F.max(seq).alias("b"))
    n = S.common_prefix_length("a", "b")
    return ends.select(F.coalesce(F.when(n >= least, n), F.lit(0)).cast("long").alias("primer_length"))
