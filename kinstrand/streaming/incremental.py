"""Structured Streaming: clusters that grow, and duplicates found as rows arrive.

Representatives in a stream follow arrival, batch by batch: results equal those of
incremental clustering (new rows against known representatives, then among themselves), not of
clustering everything again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from kinstrand.functions.storage import stored
from kinstrand.operators.similarity import Options
from kinstrand.operators.word_index import WordIndex


def exact_duplicates(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each sequence; the state keeps a hash for each."""
    return stream.withColumn("digest", F.sha2(seq, 256)).dropDuplicates(["digest"]).drop("digest")


def recent_duplicates(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key within a time span; older state is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, span: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, span), *keys).agg(F.count("*").alias("n"))


def incremental_batch(folder: str, options: Options, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows (seq_idx, seq) join representatives of the index in ``folder``/index or become clusters.

    Writes folder/index and folder/members, a version or partition for each batch, overwritten if the batch is run again. Of earlier representatives
    only the buckets with the batch's words are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch.select("seq_idx", "seq"))
        hits, rest = WordIndex(batch.sparkSession, f"{folder}/index", options, buckets).grow(rows, batch_id)
        own = rest.where("is_rep").select(F.col("seq_idx").alias("rep_idx"), "cluster_id")
        inside = rest.join(own, "cluster_id").select("seq_idx", "rep_idx", "is_rep", F.col("identity").cast("float").alias("identity"))
        members = hits.select(F.col("q").alias("seq_idx"), F.col("r").alias("rep_idx"), F.lit(False).alias("is_rep"), "identity").unionByName(inside)
        members.write.mode("overwrite").parquet(f"{folder}/members/batch={batch_id}")

    return run


def cluster_stream(stream: DataFrame, folder: str, options: Options = Options(), trigger: str | None = None) -> StreamingQuery:  # noqa: B008
    """Starts clustering ``stream`` (seq_idx, seq) into ``folder``; progress is in folder/checkpoint."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(incremental_batch(folder, options)).option("checkpointLocation", f"{folder}/checkpoint")
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()
