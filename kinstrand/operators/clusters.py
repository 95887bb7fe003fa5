"""Relational operators on cluster tables.

A cluster table has cluster_id, member_no, id, len, is_rep, identity (null for the
representative). Operators are windows and aggregates over cluster_id, so one shuffle serves a chain of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions.storage import stored
from kinstrand.operators.ranking import numbered


def _in_cluster():
    return Window.partitionBy("cluster_id")


def _long(c: Column) -> Column:
    return c.cast("long")


def representative(clusters: DataFrame) -> DataFrame:
    """cluster_id, rep, n."""
    return clusters.groupBy("cluster_id").agg(F.max(F.when(F.col("is_rep"), F.col("id"))).alias("rep"), _long(F.count("*")).alias("n"))


def size_statistics(clusters: DataFrame) -> DataFrame:
    """size, n_clusters, n_sequences."""
    sizes = clusters.groupBy("cluster_id").agg(_long(F.count("*")).alias("size"))
    return sizes.groupBy("size").agg(_long(F.count("*")).alias("n_clusters"), _long(F.sum("size")).alias("n_sequences"))


def size_histogram(clusters: DataFrame, width: int = 100) -> DataFrame:
    """low, high, n_clusters, n_sequences of bins of ``width`` sizes, empty bins up to the largest included."""
    sizes = size_statistics(clusters).withColumn("bin", F.floor((F.col("size") - 1) / width))
    sums = sizes.groupBy("bin").agg(F.sum("n_clusters").alias("c"), F.sum("n_sequences").alias("s"))
    bins = sums.agg(F.max("bin").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("bin"))
    joined = bins.join(sums, "bin", "left")
    zero = F.lit(0)
    return joined.select(_long(F.col("bin") * width + 1).alias("low"), _long((F.col("bin") + 1) * width).alias("high"), _long(F.coalesce("c", zero)).alias("n_clusters"), _long(F.coalesce("s", zero)).alias("n_sequences"))


def size_length_table(clusters: DataFrame, size_class: Column, length_class: Column) -> DataFrame:
    """size_class, length_class, n_sequences, n_clusters, n_reps, with a total row for each size class and over all."""
    sized = clusters.withColumn("size", F.count("*").over(_in_cluster())).withColumn("sc", size_class).withColumn("lc", length_class).where("sc is not null")
    out = sized.rollup("sc", "lc").agg(_long(F.count("*")).alias("n_sequences"), _long(F.countDistinct("cluster_id")).alias("n_clusters"), _long(F.sum(F.col("is_rep").cast("int"))).alias("n_reps"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") >= 2, "total").otherwise(F.col("sc")).alias("size_class"), F.when(F.col("g") >= 1, "total").otherwise(F.col("lc")).alias("length_class"), "n_sequences", "n_clusters", "n_reps")


def flat_table(clusters: DataFrame) -> DataFrame:
    """id, cluster_id, cluster_size, len, is_rep, identity (100 for the representative), coverage (whole percent of the representative), place (representative first, then by length)."""
    rep_len = F.max(F.when(F.col("is_rep"), F.col("len"))).over(_in_cluster())
    place = F.row_number().over(_in_cluster().orderBy(F.desc("is_rep"), F.desc("len"), "member_no")) - 1
    return clusters.select(
        "id", "cluster_id", _long(F.count("*").over(_in_cluster())).alias("cluster_size"), "len", "is_rep", F.when(F.col("is_rep"), 100.0).otherwise(F.col("identity")).alias("identity"),
        _long(F.floor(F.try_divide(100 * F.col("len"), rep_len))).alias("coverage"), _long(place).alias("place"),
    )


def as_hits(clusters: DataFrame) -> DataFrame:
    """Members against their representatives as hit rows: qid, sid, iden, aln_len, mismatches, qfrom, qend, sfrom, send, bits. Needs q_beg, q_end, r_beg, r_end."""
    reps = clusters.where("is_rep").select("cluster_id", F.col("id").alias("sid"))
    aln = F.abs(F.col("q_end") - F.col("q_beg")) + 1
    mis = _long(F.floor(aln * (100 - F.col("identity")) / 100))
    return clusters.where(~F.col("is_rep")).join(reps, "cluster_id").select(
        F.col("id").alias("qid"), "sid", F.col("identity").alias("iden"), _long(aln).alias("aln_len"), mis.alias("mismatches"),
        F.col("q_beg").alias("qfrom"), F.col("q_end").alias("qend"), F.col("r_beg").alias("sfrom"), F.col("r_end").alias("send"), _long(3 * aln - 6 * mis).alias("bits"),
    )


def renumber(clusters: DataFrame, *order: Column | str) -> DataFrame:
    """Consecutive cluster ids in the order of ``order`` (columns that are equal within a cluster), old ids last; consecutive members."""
    heads = clusters.groupBy("cluster_id").agg(*(F.first(o if isinstance(o, Column) else F.col(o)).alias(f"k{i}") for i, o in enumerate(order)), F.count("*").alias("n"))
    keys = [F.desc(f"k{i}") for i in range(len(order))]
    new = numbered(heads, *keys, "cluster_id", name="new").select(F.col("cluster_id").alias("old"), "new")
    members = F.row_number().over(_in_cluster().orderBy("member_no")) - 1
    out = clusters.join(new, F.col("cluster_id") == F.col("old")).withColumn("member_no", _long(members))
    return out.withColumn("cluster_id", _long(F.col("new"))).select(*clusters.columns)


def sort_by_size(clusters: DataFrame) -> DataFrame:
    """Largest cluster first; equal sizes keep their order."""
    sized = clusters.withColumn("__s", F.count("*").over(_in_cluster()))
    return renumber(sized, "__s").drop("__s")


def sort_by_length(clusters: DataFrame) -> DataFrame:
    """Cluster with the longest member first."""
    sized = clusters.withColumn("__s", F.max("len").over(_in_cluster()))
    return renumber(sized, "__s").drop("__s")


def sort_members(clusters: DataFrame, by: str = "len") -> DataFrame:
    """Members renumbered: the representative first, then by ``len`` (longest first) or ``id``."""
    order = F.desc("len") if by == "len" else F.asc(by)
    return clusters.withColumn("member_no", _long(F.row_number().over(_in_cluster().orderBy(F.desc("is_rep"), order, "member_no")) - 1))


def cut_top(clusters: DataFrame, n: int) -> DataFrame:
    """The first ``n`` members; a later representative takes the last place."""
    before = _in_cluster().orderBy("member_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.col("is_rep").cast("int")).over(before)
    row = F.row_number().over(_in_cluster().orderBy("member_no"))
    return clusters.withColumn("__r", row).withColumn("__s", seen).where(F.col("is_rep") | (F.col("__r") <= F.when(F.col("__s") == 1, n).otherwise(n - 1))).drop("__r", "__s")


def select_by_size(clusters: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    size = F.count("*").over(_in_cluster())
    out = clusters.withColumn("__s", size).where(F.col("__s") >= low)
    return (out.where(F.col("__s") <= high) if high is not None else out).drop("__s")


def select_ids(clusters: DataFrame, low: int = 1, high: int | None = None, reps_only: bool = True) -> DataFrame:
    chosen = select_by_size(clusters, low, high)
    return (chosen.where("is_rep") if reps_only else chosen).select("id")


def reduce_classes(clusters: DataFrame, size_class: Column, every: int) -> DataFrame:
    """Of each class of sizes every ``every``-th cluster, beginning with the first; sizes in no class go."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).withColumn("sc", size_class).where("sc is not null")
    nth = F.row_number().over(Window.partitionBy("sc").orderBy("cluster_id")) - 1
    kept = sizes.withColumn("nth", nth).where(F.col("nth") % every == 0).select("cluster_id")
    return clusters.join(kept, "cluster_id", "left_semi")


def merge(masters: DataFrame, *others: DataFrame) -> DataFrame:
    """Members of other tables' clusters, their representatives left out, appended to the master cluster with the same representative id."""
    reps = masters.where("is_rep").select(F.col("id").alias("rep"), F.col("cluster_id").alias("target"))
    out = masters.withColumn("__t", F.lit(0))
    for i, other in enumerate(others, 1):
        heads = other.where("is_rep").select("cluster_id", F.col("id").alias("rep")).join(reps, "rep")
        rows = other.where(~F.col("is_rep")).join(heads.select(F.col("cluster_id").alias("c"), "target"), F.col("cluster_id") == F.col("c"))
        out = out.unionByName(rows.withColumn("cluster_id", F.col("target")).select(*other.columns).withColumn("__t", F.lit(i)))
    place = F.row_number().over(_in_cluster().orderBy("__t", "member_no", "id")) - 1
    return out.withColumn("member_no", _long(place)).drop("__t")


def expand(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Each parent member replaced by the child cluster that it represents; members that represent none pass.

    cluster_id of the parent; path is the identity in the parent, then in the child.
    """
    heads = children.where("is_rep").select(F.col("id").alias("pid"), F.col("cluster_id").alias("child"))
    inner = children.select(F.col("cluster_id").alias("child"), F.col("id").alias("cid"), F.col("len").alias("clen"), F.col("is_rep").alias("crep"), F.col("identity").alias("ciden"), F.col("member_no").alias("cno"))
    joined = parents.join(heads, F.col("id") == F.col("pid"), "left").join(inner, "child", "left")
    place = F.row_number().over(_in_cluster().orderBy("member_no", F.coalesce("cno", F.lit(0)))) - 1
    shown = lambda c: F.when(F.col(c).isNull(), "*").otherwise(F.format_string("%.2f", F.col(c)))
    return joined.select(
        "cluster_id", _long(place).alias("member_no"), F.coalesce("cid", "id").alias("id"), F.coalesce("clen", "len").alias("len"), (F.col("is_rep") & F.coalesce("crep", F.lit(True))).alias("is_rep"),
        F.when(F.col("cid").isNull(), shown("identity")).otherwise(F.concat_ws(",", shown("identity"), shown("ciden"))).alias("path"),
    )


def levels(first: DataFrame, *others: DataFrame) -> DataFrame:
    """id, len and (cid_i, rep_i) for each level; a level above the first is found through the representative of the level below, -1 if none."""
    reps = first.where("is_rep").select("cluster_id", F.col("id").alias("__up"))
    out = first.join(reps, "cluster_id").select("id", "len", F.col("cluster_id").alias("cid_1"), F.col("is_rep").cast("long").alias("rep_1"), "__up")
    for i, level in enumerate(others, 2):
        heads = level.where("is_rep").select("cluster_id", F.col("id").alias("__next"))
        here = level.join(heads, "cluster_id").select(F.col("id").alias("__id"), F.col("cluster_id").alias(f"cid_{i}"), F.col("is_rep").alias("__r"), "__next")
        out = out.join(here, F.col("__up") == F.col("__id"), "left").select(
            *[c for c in out.columns if c != "__up"],
            F.coalesce(f"cid_{i}", F.lit(-1)).cast("long").alias(f"cid_{i}"),
            F.coalesce((F.col("__r") & (F.col("id") == F.col("__id"))).cast("long"), F.lit(0).cast("long")).alias(f"rep_{i}"),
            F.coalesce("__next", "__up").alias("__up"),
        )
    return out.drop("__up")


def sort_levels(table: DataFrame, *numbers: int) -> DataFrame:
    """A level table with ``place``, from 1, in order of the given levels: cluster, then representatives first."""
    return numbered(table, *(x for i in numbers for x in (F.asc(f"cid_{i}"), F.desc(f"rep_{i}"))), "id", start=1)


def tree(parents: DataFrame, children: DataFrame) -> DataFrame:
    """cluster_id, rep, n_leaves, nodes: array of (id, len, identity, leaves: array of ids), child clusters attached under their representatives."""
    heads = children.where("is_rep").select(F.col("id").alias("pid"), F.col("cluster_id").alias("child"))
    leaves = children.groupBy(F.col("cluster_id").alias("child")).agg(F.transform(F.array_sort(F.collect_list(F.struct("member_no", "id"))), lambda x: x.id).alias("leaves"))
    nodes = parents.join(heads.join(leaves, "child"), F.col("id") == F.col("pid"), "left").withColumn("leaves", F.coalesce("leaves", F.array("id")))
    packed = F.array_sort(F.collect_list(F.struct("member_no", "id", "len", "identity", "leaves")))
    return nodes.groupBy("cluster_id").agg(F.max(F.when(F.col("is_rep"), F.col("id"))).alias("rep"), _long(F.sum(F.size("leaves"))).alias("n_leaves"), packed.alias("nodes"))


def forest(top: DataFrame, *finer: DataFrame) -> DataFrame:
    """A row for each node of the trees under the clusters of ``top``: cluster_id, path, id, len, identity, is_rep, leaf and n_leaves.

    ``finer`` are cluster tables of as many levels as there are, from coarse to fine; a member that represents a cluster of the next level has its members
    for children. ``path`` has the member numbers from the top, so trees are in order when sorted by it. A join for each level; leaves are counted
    for all nodes above them at once.
    """
    columns = ["cluster_id", "path", "id", "len", "identity", "is_rep"]
    nodes = top.select("cluster_id", F.array(F.col("member_no").cast("long")).alias("path"), "id", "len", "identity", "is_rep")
    levels = []
    for level in finer:
        heads = level.where("is_rep").select(F.col("id").alias("__id"), F.col("cluster_id").alias("__child"))
        met = stored(nodes.join(heads, F.col("id") == F.col("__id"), "left").drop("__id"))
        levels.append(met.select(*columns, F.col("__child").isNull().alias("leaf")))
        below = level.select(F.col("cluster_id").alias("__child"), F.col("member_no").cast("long").alias("__no"), "id", "len", "identity", "is_rep")
        nodes = met.where("__child is not null").select("cluster_id", "path", "__child").join(below, "__child").withColumn("path", F.concat("path", F.array("__no"))).select(*columns)
    rows = stored(reduce(DataFrame.unionByName, [*levels, nodes.withColumn("leaf", F.lit(True))]))
    # a leaf is one; only what is above leaves is counted and joined
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.slice("path", 1, k))).alias("path")
    counts = rows.where("leaf AND size(path) > 1").select("cluster_id", above).groupBy("cluster_id", "path").agg(F.count("*").alias("n_leaves"))
    inner = rows.where("NOT leaf").join(counts, ["cluster_id", "path"])
    return inner.unionByName(rows.where("leaf AND cluster_id IS NOT NULL").withColumn("n_leaves", F.lit(1).cast("long")))


def sort_forest(nodes: DataFrame, by: str = "no") -> DataFrame:
    """cluster_id, rep, n_leaves, longest and place of the trees of a forest: most leaves first (no), longest member at the top first (len) or by the representative's name (des)."""
    tops = nodes.where(F.size("path") == 1).groupBy("cluster_id")
    trees = tops.agg(F.max(F.when(F.col("is_rep"), F.col("id"))).alias("rep"), _long(F.sum("n_leaves")).alias("n_leaves"), _long(F.max("len")).alias("longest"))
    return numbered(trees, {"no": F.desc("n_leaves"), "len": F.desc("longest"), "des": F.asc("rep")}[by], "cluster_id", start=1)


def newick(clusters: DataFrame) -> DataFrame:
    """cluster_id, tree: ``rep:1.0`` for one member, else the members with their distances from the representative."""
    share = F.format_string("%.4f", 1 - F.coalesce("identity", F.lit(100.0)) / 100)
    part = F.concat("id", F.lit(":"), share)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("member_no", part.alias("p")))), lambda x: x.p)
    out = clusters.groupBy("cluster_id").agg(texts.alias("t"), F.max(F.when(F.col("is_rep"), F.col("id"))).alias("rep"), F.min("identity").alias("least"))
    return out.select("cluster_id", F.when(F.size("t") == 1, F.concat("rep", F.lit(":1.0"))).otherwise(F.concat(F.lit("("), F.array_join("t", ","), F.lit("):"), F.format_string("%.4f", F.coalesce("least", F.lit(100.0)) / 100))).alias("tree"))


def keep_per_cluster(sequences: DataFrame, clusters: DataFrame, most: int) -> DataFrame:
    """``sequences`` (id, ...) without members beyond ``most`` of their cluster, representative first; ids in no cluster stay."""
    place = F.row_number().over(_in_cluster().orderBy(F.desc("is_rep"), "member_no"))
    over = clusters.withColumn("__p", place).where(F.col("__p") > most).select("id")
    return sequences.join(over, "id", "left_anti")


def best_reference(clusters: DataFrame, is_sample: Column) -> DataFrame:
    """Sample members and, of the others, the one with the highest identity (the first of equals; a representative counts as 100)."""
    score = F.when(F.col("is_rep"), 100.0).otherwise(F.col("identity"))
    nth = F.row_number().over(Window.partitionBy("cluster_id", "__sample").orderBy(F.desc(score), "member_no"))
    return clusters.withColumn("__sample", is_sample).withColumn("__n", nth).where(F.col("__sample") | (F.col("__n") == 1)).drop("__sample", "__n")


def drop_reference_only(clusters: DataFrame, is_sample: Column) -> DataFrame:
    return clusters.withColumn("__any", F.bool_or(is_sample).over(_in_cluster())).where("__any").drop("__any")


def drop_small(clusters: DataFrame, cutoff: int) -> DataFrame:
    """Clusters of more than ``cutoff`` members."""
    return select_by_size(clusters, cutoff + 1)
