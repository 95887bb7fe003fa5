"""Smaller operators around words and pairs: fragments, complements, distances, shuffles, paired representatives."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions import kmers as K
from kinstrand.functions import sequences as S
from kinstrand.operators.ranking import numbered


def fragment_postings(sequences: DataFrame, k: int, size: int) -> DataFrame:
    """(rank, frag, word, cnt): words of each stretch of ``size`` letters; a word belongs to the stretch it begins in."""
    at = F.posexplode(K.words("seq", k)).alias("i", "word")
    return sequences.select("rank", at).groupBy("rank", F.floor(F.col("i") / size).cast("long").alias("frag"), "word").agg(F.count("*").cast("int").alias("cnt"))


def fragment_shared(queries: DataFrame, fragments: DataFrame, reach: int) -> DataFrame:
    """(q, r, shared): the most words that a query shares with ``reach`` neighbouring stretches of a target."""
    a = queries.select(F.col("rank").alias("q"), "word", F.col("cnt").alias("n"))
    b = fragments.select(F.col("rank").alias("r"), "frag", "word", F.col("cnt").alias("m"))
    each = a.join(b, "word").groupBy("q", "r", "frag").agg(F.sum(F.least("n", "m")).alias("s"))
    w = Window.partitionBy("q", "r").orderBy("frag").rangeBetween(0, reach - 1)
    return each.withColumn("s", F.sum("s").over(w)).groupBy("q", "r").agg(F.max("s").cast("long").alias("shared"))


def complement_words(postings: DataFrame) -> DataFrame:
    """``postings`` with each nucleotide word as its reverse complement."""
    return postings.withColumn("word", S.reverse_complement("word"))


def distance_matrix(pairs: DataFrame) -> DataFrame:
    """(a, b, distance) both ways and zero on the diagonal, from aligned pairs (q, r, distance)."""
    ids = pairs.select(F.col("q").alias("a")).union(pairs.select("r")).distinct()
    both = pairs.select(F.col("q").alias("a"), F.col("r").alias("b"), "distance").union(pairs.select("r", "q", "distance"))
    return both.groupBy("a", "b").agg(F.min("distance").alias("distance")).union(ids.select("a", F.col("a").alias("b"), F.lit(0.0)))


def shuffled(sequences: DataFrame, seed: int, key: str = "seq_idx") -> DataFrame:
    """``sequences`` with ``order``, a reproducible permutation key."""
    return sequences.withColumn("order", F.xxhash64(F.lit(seed), F.col(key)))


def drop_empty(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    return sequences.where(F.length(seq) > 0)


def fetch(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``records`` whose ``key`` is among ``ids`` (any number of times), as they are."""
    return records.join(ids.select(key), key, "left_semi").select(*records.columns)


def exclude(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``records`` whose ``key`` isn't among ``ids``; a null key stays."""
    return records.join(ids.select(key), key, "left_anti").select(*records.columns)


def pool(sources: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """All rows of some tables of the same columns, ids told apart by the table's name: ``name|id``."""
    named = [rows.withColumn(key, F.concat(F.lit(f"{name}|"), F.col(key).cast("string"))) for name, rows in sources.items()]
    return reduce(DataFrame.unionByName, named)


def paired_representatives(clusters: DataFrame, mates: DataFrame) -> DataFrame:
    """Read pairs of which a mate's id represents a cluster; an id may end in /1 or /2."""
    bare = lambda c: F.regexp_replace(c, r"/[12]$", "")
    reps = clusters.where("is_rep").select(bare(F.col("id")).alias("__rep")).distinct()
    return mates.join(reps, bare(F.col("id")) == F.col("__rep"), "left_semi")


def sort_tree(tree: DataFrame, by: str = "no") -> DataFrame:
    """A cluster tree with ``place``: most leaves first (no), longest member first (len) or by the representative's name (des)."""
    order = {"no": F.desc("n_leaves"), "len": F.desc(F.array_max(F.transform("nodes", lambda x: x.len))), "des": F.asc("rep")}[by]
    return numbered(tree, order, "cluster_id", start=1)


def weighted_sizes(clusters: DataFrame, inner: DataFrame) -> DataFrame:
    """cluster_id, n: members counted with the sizes of the inner clusters that they represent (id, n)."""
    joined = clusters.join(inner.select("id", F.col("n").alias("__n")), "id", "left")
    return joined.groupBy("cluster_id").agg(F.sum(F.coalesce("__n", F.lit(1))).cast("long").alias("n"))
