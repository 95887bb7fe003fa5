"""FASTQ records from split files."""

from __future__ import annotations

import gzip
import random

import pytest

from kinstrand.sources import fastq, formats


def fold(text, width):
    return "\n".join(text[i : i + width] for i in range(0, len(text), width)) if width else text


def written(rng, n, long_one=False):
    """(records, text): some folded, qualities that begin as headers and separators do, an empty one, one that fills several splits."""
    records, text = [], []
    for i in range(n):
        size = rng.choice([1, 5, 40, 90, 150]) if i % 50 else 0
        seq = "".join(rng.choice("ACGTN") for _ in range(9000 if long_one and i == n // 2 else size))
        qual = "".join(rng.choice("@+I#A>") for _ in seq)
        qual = rng.choice(["@", "+", ""]) + qual
        qual = qual[: len(seq)]
        records.append((f"r{i}", f"r{i} of {n}", seq, qual))
        width = rng.choice([0, 0, 17, 60])
        text.append(f"@r{i} of {n}\n{fold(seq, width)}\n+{rng.choice(['', f'r{i} of {n}'])}\n{fold(qual, width)}\n")
    return records, "".join(text)


@pytest.mark.parametrize(("split", "long_one"), [(700, False), (1500, True), (1 << 20, True)])
def test_folded_records_in_several_splits(spark, tmp_path, split, long_one):
    rng = random.Random(split)
    wanted = []
    for name in ("a.fq", "b.fq"):
        records, text = written(rng, 150, long_one)
        wanted += records
        (tmp_path / name).write_text(text)
    for key, value in (("maxPartitionBytes", split), ("openCostInBytes", 1), ("minPartitionNum", 1)):
        spark.conf.set(f"spark.sql.files.{key}", str(value))
    try:
        lines = spark.read.text(str(tmp_path))
        assert split > 10_000 or lines.rdd.getNumPartitions() > 20
        found = formats.read_fastq(spark, str(tmp_path)).orderBy("file", "n").collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert [(r.id, r.descr, r.seq_raw, r.qual) for r in found] == wanted
    assert len({(r.file, r.n) for r in found}) == len(found)


def test_folded_and_packed_files(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@r1 q\r\nACGT\r\n+\r\n@@II\r\n\r\n@r2\nACGT\nACGTAC\n+\nIIII\nIIIIII\n")
    (tmp_path / "e.fq").write_text("")
    with gzip.open(tmp_path / "y.fq.gz", "wt") as f:
        f.write("@g " + "d" * 5000 + "\nAC\nG\n+g\n@\n++")
    found = formats.read_fastq(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.seq_raw, r.qual) for r in found] == [("g", "ACG", "@++"), ("r1", "ACGT", "@@II"), ("r2", "ACGTACGTAC", "IIIIIIIIII")]
    assert len(found[0].descr) == 5002


@pytest.mark.parametrize("text", ["ACGT\n", "@r\nACGT\n+\nIII\n@s\nA\n+\nI\n", "@r\nACGT\n+\nIIIIII\n", "@r\nACGT\n@s\nA\n+\nI\n", "@r\nACGT\n+\nII"])
def test_what_is_no_record_is_refused(spark, tmp_path, text):
    (tmp_path / "x.fq").write_text(text)
    with pytest.raises(Exception, match="BrokenRecord"):
        formats.read_fastq(spark, str(tmp_path / "x.fq")).count()


def test_headers_are_found_by_what_follows():
    lines = ["@II", "ACGT", "+", "IIII", "@h", "AC", "+", "II", "@i", "A", "+", "I"]
    assert fastq._follows(["@@@", "@r", "A", "+", "I"]) is False and fastq._follows(lines[4:]) is None and fastq._follows(lines[4:] * 2) is True
