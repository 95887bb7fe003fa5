"""Growing abundances: the stream's table, also after a restart, is that of a batch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinstrand.streaming import abundances


def test_counts_after_a_restart_equal_a_batch(spark, tmp_path):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ACGT") for _ in range(n)) for n in range(12, 40)]
    rows = [(i, rng.choice(pool[: 10 + i // 20])) for i in range(400)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for part in range(3):  # each part is a run of its own, restarted from the checkpoint
        seen += rows[part * 130 : (part + 1) * 130]
        for half in range(2):
            chunk = rows[part * 130 + 65 * half : part * 130 + 65 * (half + 1)]
            spark.createDataFrame(chunk, "seq_idx long, seq string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("seq_idx long, seq string").option("maxFilesPerTrigger", 1).parquet(source)
        query = abundances.count_stream(stream, out)
        query.awaitTermination()
        assert query.exception() is None
        batch = spark.createDataFrame(seen, "seq_idx long, seq string").groupBy("seq").agg(F.min("seq_idx").alias("i"), F.count("*").alias("n"))
        found = abundances.current(spark, out)
        assert {(r.seq_idx, r.len, r.abundance) for r in found.collect()} == {(r.i, len(r.seq), r.n) for r in batch.collect()}
    fresh = spark.read.parquet(f"{out}/changes").where("fresh").groupBy("digest").count()
    assert fresh.where("count <> 1").count() == 0 and fresh.count() == len({s for _, s in seen})


def test_first_comes_first_whatever_its_number(spark, tmp_path, monkeypatch):
    """The representative is of the first batch, also if later ones have smaller numbers or the clock was set back; state is an aggregate, no Python call for each digest."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, chunk in enumerate(([(9, "AC"), (7, "AC"), (8, "GG")], [(1, "AC"), (2, "TT")], [(0, "GG"), (3, "TT")])):
        spark.createDataFrame(chunk, "seq_idx long, seq string").coalesce(1).write.mode("append").parquet(source)
        if k:  # as if the batches before had been counted in the future
            monkeypatch.setattr(abundances, "_latest", lambda *_, k=k: (1 << 60) + k, raising=False)
        query = abundances.count_stream(spark.readStream.schema("seq_idx long, seq string").parquet(source), out)
        query.awaitTermination()
        assert "TransformWithState" not in query._jsq.explainInternal(False)
    assert {(r.seq_idx, r.abundance) for r in abundances.current(spark, out).collect()} == {(7, 3), (8, 2), (2, 2)}
    assert spark.read.parquet(f"{out}/changes").where("fresh").count() == 3
