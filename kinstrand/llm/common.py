"""Shared bits of the training-data operators: tables, keys, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id wherever ids are ordered or joined; the smallest long, so null comes first.
NULL_ID = -(1 << 63)

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="kinstrand-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps don't recompute what is above.

    A table there outlives executors, unlike a cached or locally checkpointed one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinstrand/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/kinstrand/" in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_key(column: str | Column = "doc_id") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID).cast("long"))


def words(text: Column) -> Column:
    """The array of maximal runs of characters other than ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII goes the fast way."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)
