"""A word index of representatives that grows: postings by bucket of their word, a version for each batch that was added.

    folder/reps/version=V              key, seq_idx, len, seq: key is dense, later versions come after earlier ones
    folder/postings/version=V/bucket=B word, rank (the key), cnt

A batch is looked up in the buckets of its own words, which is a partition filter, and of these only in postings that have one of its words. Adding
writes the words of the new representatives and reads no old ones. A version that is written again replaces itself, so a batch may be run twice.
:meth:`WordIndex.compacted` puts versions together when there are many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.operators import greedy, similarity
from kinstrand.operators.similarity import Options

_REPS = "key long, seq_idx long, len int, seq string, version long"
_POSTINGS = "word string, rank long, cnt int, version long, bucket int"


@dataclass(frozen=True)
class WordIndex:
    """The index in ``folder``, which executors share; ``options`` and ``buckets`` stay the same as long as it lives."""

    spark: SparkSession
    folder: str
    options: Options
    buckets: int = 256

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").where(F.col("version") < before)

    def reps(self, before: int = 1 << 62) -> DataFrame:
        """key, seq_idx, len and seq of the representatives of versions ``before`` one."""
        return self._read("reps", _REPS, before).drop("version")

    def bucket(self, word: str | Column = "word") -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def postings(self, words: DataFrame, before: int = 1 << 62) -> DataFrame:
        """rank, word and cnt of the postings that have one of ``words`` (word): no other buckets are read."""
        mine = words.select("word").distinct()
        needed = sorted(r.bucket for r in mine.select(self.bucket().alias("bucket")).distinct().collect())  # as many as there are buckets at most
        return self._read("postings", _POSTINGS, before).where(F.col("bucket").isin(needed)).join(mine, "word", "left_semi").select("rank", "word", "cnt")

    def add(self, fresh: DataFrame, version: int) -> None:
        """Adds representatives (seq_idx, seq), normalised or not, longest first."""
        last = self.reps(version).agg(F.max("key")).first()[0]
        rows = similarity.prepare(fresh.select("seq_idx", "seq"), self.options)
        rows = greedy.stored(rows.select((F.col("rank") + (0 if last is None else last + 1)).alias("rank"), "seq_idx", "len", "seq"))
        self._write("reps", rows.withColumnRenamed("rank", "key"), version)
        words = similarity._postings(rows, self.options).withColumn("bucket", self.bucket())
        self._write("postings", words.select("word", "rank", "cnt", "bucket").repartition("bucket").sortWithinPartitions("bucket", "word"), version, "bucket")

    def _write(self, name: str, rows: DataFrame, version: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/version={version}")

    def compare(self, batch: DataFrame, before: int = 1 << 62) -> DataFrame:
        """Each row of ``batch`` (seq_idx, seq) that joins a representative: as :func:`similarity.compare` has it, with earlier representatives first."""
        o = self.options
        queries = greedy.stored(similarity.prepare(batch.select("seq_idx", "seq"), o, ranked=False))
        words = similarity._postings(queries, o).select("word")
        if o.both_strands:
            words = words.union(similarity._postings(queries.withColumn("seq", S.reverse_complement("seq")), o).select("word"))
        reps = self.reps(before).withColumnRenamed("key", "rank")
        found = greedy.stored(self.postings(words, before))
        pairs = greedy.stored(similarity._in_order(similarity.candidates(queries, reps, o, within=False, postings=found), o))
        best = similarity.asked(pairs, queries, reps, o).where("r is not null")
        names = reps.select(F.col("rank").alias("r"), F.col("seq_idx").alias("r_idx"))
        return best.join(names, "r").select("q", F.col("r_idx").alias("r"), "strand", "identity", "distance", "q_beg", "q_end", "r_beg", "r_end")

    def grow(self, batch: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
        """Rows of ``batch`` join representatives of versions before, the rest clusters among itself, and its representatives are added: (hits, clusters of the rest)."""
        hits = greedy.stored(self.compare(batch, version))
        rest = greedy.stored(similarity.unmatched(batch, hits))
        clusters = greedy.stored(similarity.cluster(rest, self.options))
        self.add(rest.join(clusters.where("is_rep").select("seq_idx"), "seq_idx", "left_semi"), version)
        return hits, clusters

    def compacted(self, folder: str) -> WordIndex:
        """The same index in another folder, with one version."""
        new = WordIndex(self.spark, folder, self.options, self.buckets)
        new._write("reps", self.reps(), 0)
        new._write("postings", self._read("postings", _POSTINGS, 1 << 62).select("word", "rank", "cnt", "bucket").repartition("bucket").sortWithinPartitions("bucket", "word"), 0, "bucket")
        return new

