"""Tables of the operators' own kind made from the provided ones, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.operators import ranking

#: DuckDB text of the same tables.
AA = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
NT = f"translate({AA}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}')"
CLUSTERS = """
  SELECT l_orderkey AS cluster_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) - 1 AS member_no,
    concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CAST(floor(l_quantity) AS BIGINT) AS len,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1 AS is_rep,
    CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) > 1 THEN 100 - 100 * l_discount END AS identity,
    l_partkey, l_suppkey, l_returnflag
  FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aa(spark: SparkSession, sf_dir: str, keep: int = 0, least: int = 10, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """seq_idx, seq: residue-like sequences of texts, longer than ``least`` letters before they are cut to ``keep``."""
    base = table(spark, sf_dir, name).select(F.col(key).alias("seq_idx"), S.letters_only(F.coalesce("text", F.lit(""))).alias("seq"))
    return base.where(S.long_enough("seq", least)).withColumn("seq", S.trim("seq", keep))


def aa_sql(keep: int = 0, least: int = 10, name: str = "documents", key: str = "doc_id") -> str:
    cut = f"substring({AA}, 1, {keep})" if keep else AA
    return f"SELECT {key} AS seq_idx, {cut} AS seq FROM {name} WHERE length({AA}) > {least}"


def ranked(spark: SparkSession, sf_dir: str, keep: int = 0) -> DataFrame:
    return ranking.rank_by_length(aa(spark, sf_dir, keep))


def ranked_sql(keep: int = 0) -> str:
    return f"SELECT *, length(seq) AS len, row_number() OVER (ORDER BY length(seq) DESC, seq_idx) - 1 AS rank FROM ({aa_sql(keep)})"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order: the line with the highest price represents."""
    lines = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag").withColumn("n", n)
    return lines.select(
        F.col("l_orderkey").alias("cluster_id"), (F.col("n") - 1).cast("long").alias("member_no"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.floor("l_quantity").cast("long").alias("len"), (F.col("n") == 1).alias("is_rep"), F.when(F.col("n") > 1, 100 - 100 * F.col("l_discount")).alias("identity"),
        "l_partkey", "l_suppkey", "l_returnflag",
    )


#: A second level: representatives of orders, by customer; the costliest order represents.
PARENTS = f"""
  SELECT o_custkey AS cluster_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS member_no,
    r.id AS id, r.len AS len, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 AS is_rep,
    CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 1 THEN 90.0 END AS identity
  FROM orders JOIN (SELECT * FROM ({CLUSTERS}) WHERE is_rep) r ON o_orderkey = r.cluster_id"""


def parents(spark: SparkSession, sf_dir: str, inner: DataFrame | None = None) -> DataFrame:
    """The second level; ``inner``: the first one, if it is at hand."""
    reps = (clusters(spark, sf_dir) if inner is None else inner).where("is_rep").select(F.col("cluster_id").alias("o_orderkey"), "id", "len")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(reps, "o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.withColumn("n", n).select(
        F.col("o_custkey").alias("cluster_id"), (F.col("n") - 1).cast("long").alias("member_no"), "id", "len", (F.col("n") == 1).alias("is_rep"), F.when(F.col("n") > 1, 90.0).alias("identity")
    )


#: A third level: representatives of customers' clusters, by nation; the richest customer represents.
GRANDPARENTS = f"""
  SELECT c_nationkey AS cluster_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS member_no,
    r.id AS id, r.len AS len, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1 AS is_rep,
    CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) > 1 THEN 60.0 END AS identity
  FROM customer JOIN (SELECT * FROM ({PARENTS}) WHERE is_rep) r ON c_custkey = r.cluster_id"""


def grandparents(spark: SparkSession, sf_dir: str, inner: DataFrame | None = None) -> DataFrame:
    """The third level; ``inner``: the second one, if it is at hand."""
    reps = (parents(spark, sf_dir) if inner is None else inner).where("is_rep").select(F.col("cluster_id").alias("c_custkey"), "id", "len")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(reps, "c_custkey")
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return rows.withColumn("n", n).select(
        F.col("c_nationkey").alias("cluster_id"), (F.col("n") - 1).cast("long").alias("member_no"), "id", "len", (F.col("n") == 1).alias("is_rep"), F.when(F.col("n") > 1, 60.0).alias("identity")
    )
