"""Compositions on hand-made reads; smaller operators; SQL functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinstrand.functions import kmers as K
from kinstrand.functions import registry
from kinstrand.functions import sequences as S
from kinstrand.operators import fragments
from kinstrand.plans import pipelines


@pytest.fixture(scope="module")
def bases():
    rng = random.Random(21)
    return ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(3)]


def test_sample_otus(spark, bases):
    rows, i = [], 0
    for s, copies in zip(bases, (8, 6, 5), strict=True):
        for _ in range(copies):
            rows.append((i, f"r{i}", s[:60], s[60:]))
            i += 1
    rows.append((i, f"r{i}", bases[0][:60], bases[1][60:]))  # a chimera
    table = spark.createDataFrame(rows, "seq_idx long, id string, r1 string, r2 string")
    out = pipelines.otus_of_sample(table, identity=0.97).collect()
    assert len({r.cluster_id for r in out}) == 3 and f"r{i}" not in {r.id for r in out}
    assert len(out) == 19 and sum(r.is_rep for r in out) == 3


def test_small_rna_table(spark, bases):
    short = [b[:24] for b in bases]
    reads, i = [], 0
    for k, s in enumerate(short):
        for sample in ("a", "b"):
            for _ in range(k + 2):
                reads.append((i, f"Sample|{sample}|{i}", s))
                i += 1
    table = spark.createDataFrame(reads, "seq_idx long, id string, seq string")
    refs = spark.createDataFrame([(k, f"mir{k}", s) for k, s in enumerate(short[:2])], "seq_idx long, id string, seq string")
    out = {r.annotation: (r.a, r.b) for r in pipelines.small_rna_table(table, refs, ["a", "b"]).collect()}
    assert out == {"mir0": (2, 2), "mir1": (3, 3), None: (4, 4)}
    spikes = spark.createDataFrame([(0, "spike2", short[2]), (1, "other", bases[0][60:84])], "seq_idx long, id string, seq string")
    out = {(r.annotation, r.spike): (r.a, r.b) for r in pipelines.small_rna_table(table, refs, ["a", "b"], spike_ins=spikes).collect()}
    assert out == {("mir0", None): (2, 2), ("mir1", None): (3, 3), (None, "spike2"): (4, 4)}


def test_three_stage_otus(spark, bases):
    rows = [(i, s) for i, s in enumerate(b for b in bases for _ in range(3))]
    out = pipelines.three_stage_otus(spark.createDataFrame(rows, "seq_idx long, seq string"))
    assert out.where("is_rep").count() == 3


def test_splice(spark, bases):
    refs = spark.createDataFrame([(0, bases[0])], "seq_idx long, seq string")
    inner = bases[0][10:110]
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    mates = spark.createDataFrame([(inner[:50], turn(inner)[:50])] * 4, "r1 string, r2 string")
    out = pipelines.spliced_references(refs, mates.select(F.col("r1").alias("seq")), mates.select(F.col("r2").alias("seq")), 30, 30).first()
    assert out.r1 == inner[:30] and out.r2 == turn(inner)[:30]
    # wrong letters in either primer, a letter too many, one that begins within the consensus, and an unrelated reference
    other = lambda s, *at: "".join("ACGT"["CGTA".index(c)] if i in at else c for i, c in enumerate(s))
    wrong, longer = other(bases[0], 13, 18, 100, 104), bases[0][:35] + "A" + bases[0][35:]
    table = spark.createDataFrame([(1, wrong), (2, longer), (3, bases[0][13:]), (4, bases[1]), (5, turn(bases[0])), (6, None)], "seq_idx long, seq string")
    found = {r.seq_idx: (r.r1, r.r2) for r in pipelines.spliced_references(table, mates.select(F.col("r1").alias("seq")), mates.select(F.col("r2").alias("seq")), 30, 30).collect()}
    assert found == {
        1: (wrong[10:40], turn(wrong[80:110])),
        2: (longer[10:40], turn(longer[81:111])),
        3: ("NNN" + bases[0][13:40], turn(bases[0][80:110])),
    }


def test_mates_with_ragged_ends(spark, bases):
    """A chimera whose mates carry foreign letters at their ends, which a local alignment leaves out."""
    rng = random.Random(5)
    noise = "".join(rng.choice("ACGT") for _ in range(30))
    rows, i = [], 0
    for s, copies in zip(bases, (8, 6, 5), strict=True):
        for _ in range(copies):
            rows.append((i, f"r{i}", s[:60] + noise[:10], s[60:] + noise[10:20]))
            i += 1
    rows.append((i, f"r{i}", bases[0][:60], bases[1][60:]))
    table = spark.createDataFrame(rows, "seq_idx long, id string, r1 string, r2 string")
    out = pipelines.otus_of_sample(table, identity=0.97).collect()
    assert len({r.cluster_id for r in out}) == 3 and f"r{i}" not in {r.id for r in out}


def test_fragments(spark, bases):
    rows = spark.createDataFrame(list(enumerate(bases[:2])), "rank long, seq string")
    whole = K.postings(rows, 6)
    parts = fragments.fragment_postings(rows, 6, 30)
    assert parts.groupBy("rank", "word").agg(F.sum("cnt").alias("c")).join(whole, ["rank", "word"]).where("c <> cnt").count() == 0
    got = {(r.q, r.r): r.shared for r in fragments.fragment_shared(whole, parts, 4).collect()}
    assert got[0, 0] == 115
    words = {r.word for r in fragments.complement_words(whole.where("rank = 0")).collect()}
    flipped = rows.where("rank = 0").select("rank", S.reverse_complement("seq").alias("seq"))
    assert words == {r.word for r in K.postings(flipped, 6).collect()}
    assert fragments.distance_matrix(spark.createDataFrame([(1, 0, 0.1)], "q long, r long, distance double")).count() == 4
    a, b = (fragments.shuffled(rows, s, "rank").orderBy("order").select("rank").collect() for s in (1, 1))
    assert a == b


def test_sql_functions(spark):
    registry.register(spark)
    rows = spark.sql("SELECT word, place FROM VALUES ('ACGTA') AS t(seq), LATERAL kmers(seq, 3)").collect()
    assert [(r.word, r.place) for r in rows] == [("ACG", 1), ("CGT", 2), ("GTA", 3)]
    row = spark.sql("SELECT hamming('ACGT', 'ACCTA') AS h, identity_nt('ACGTACGTAA', 'ACGTACGTAA') AS i, identity_aa('MKVLAARND', 'MKVLAARNE') AS j").first()
    assert row.h == 2 and row.i == 1.0 and abs(row.j - 8 / 9) < 1e-9
