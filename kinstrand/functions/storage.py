"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinstrand-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: what comes after doesn't recompute it, and a lost executor costs no more than a stage. ``codec``: how it is compressed, if not as the session says."""
    path = f"{shared_folder(df.sparkSession)}/kinstrand/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/kinstrand/rounds-" in path.toString():
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
