"""Abundances that grow as rows arrive: a stateful aggregate for each sequence, its representative the first row that came.

State is in RocksDB under the query's checkpoint, a row for each digest, so it may outgrow memory and a restarted query goes on where it was. A batch
combines its own copies of a sequence before they reach the state. What a batch changed is a version in the output folder, overwritten if the
batch is run again; the latest version of each digest is the table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "digest string, seq_idx long, len int, abundance long, fresh boolean, at long"


def abundances(stream: DataFrame, after: int = 0) -> DataFrame:
    """Updates (digest, seq_idx of the representative, len, abundance, fresh, at) of a stream (seq_idx, seq): of rows of one batch the smallest seq_idx is first.

    ``at``: when the representative's batch began, in microseconds, which tells batches apart; later than ``after``, whatever the clock says.
    """
    now = F.greatest(F.unix_micros(F.current_timestamp()), F.lit(after + 1).cast("long"))  # one value for a batch
    rows = stream.select(F.sha2("seq", 256).alias("digest"), F.struct(now.alias("at"), "seq_idx", F.length("seq").alias("len")).alias("x"))
    sums = rows.groupBy("digest").agg(F.min("x").alias("x"), F.count("*").alias("abundance"))
    return sums.select("digest", "x.seq_idx", "x.len", "abundance", (F.col("x.at") == now).alias("fresh"), "x.at")


def _latest(spark: SparkSession, folder: str) -> int:
    """The latest ``at`` in ``folder``, 0 if nothing has been counted."""
    try:
        changes = spark.read.schema(f"{_ROWS}, batch long").parquet(f"{folder}/changes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return changes.agg(F.coalesce(F.max("at"), F.lit(0)).alias("at")).first()["at"]


def count_stream(stream: DataFrame, folder: str, trigger: str | None = None) -> StreamingQuery:
    """Starts counting ``stream`` (seq_idx, seq) into ``folder``; progress and state are in folder/checkpoint."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    writer = abundances(stream, _latest(spark, folder)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    # a query keeps the settings that it is started with
    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(setting, PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """digest, seq_idx, len and abundance as of the last batch in ``folder``."""
    changes = spark.read.schema(f"{_ROWS}, batch long").parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max_by(F.struct("seq_idx", "len", "abundance"), "batch").alias("x")).select("digest", "x.*")
