"""The growing word index, and candidates by classes of length."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from kinstrand.functions import kmers as K
from kinstrand.functions import sequences as S
from kinstrand.operators import greedy, similarity
from kinstrand.operators.similarity import Options
from kinstrand.operators.word_index import WordIndex

LETTERS = "ARNDCQEGHILKMFPSTWYV"


def families(rng, n, letters=LETTERS):
    rows = []
    for f in range(n):
        base = "".join(rng.choice(letters) for _ in range(70 + 6 * f))
        for k in range(5):
            seq = list(base[k:])
            for _ in range(3):
                seq[rng.randrange(len(seq))] = rng.choice(letters)
            rows.append((f, "".join(seq)))
    rng.shuffle(rows)
    return rows


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("options", [Options(identity=0.8), Options.nucleotide(identity=0.85, word=7)])
def test_batches_join_what_is_there(spark, tmp_path, options):
    """Batches: the same hits as comparing each with all representatives so far, without touching what is there."""
    rng = random.Random(6)
    rows = families(rng, 5, LETTERS if options.alphabet == "aa" else "ACGT")
    table = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "seq_idx long, seq string")
    index = WordIndex(spark, str(tmp_path / "index"), options, 32)
    reps = table.where("false")
    for version in range(2):
        batch = table.where(F.col("seq_idx") % 2 == version)
        wanted, rest = similarity.incremental(reps, batch, options)
        before = files(index.folder)
        hits, clusters = index.grow(batch, version)
        family = lambda found: {(r.q, rows[r.r][0], round(r.identity, 5)) for r in found.collect()}
        assert family(hits) == family(wanted)
        same = lambda found: {(r.seq_idx, r.is_rep) for r in found.collect()}
        assert same(clusters) == same(rest)
        assert before.items() <= files(index.folder).items()  # nothing is written again
        reps = greedy.stored(reps.union(batch.join(rest.where("is_rep").select("seq_idx"), "seq_idx", "left_semi")))
    if options.alphabet == "nt":
        return
    keys = [r.key for r in index.reps().orderBy("key").collect()]
    assert keys == list(range(reps.count()))
    again = index.grow(table.where("seq_idx % 2 = 1"), 1)  # a batch that is run twice
    assert index.reps().count() == reps.count() and again[0].count() == hits.count()
    small = index.compacted(str(tmp_path / "compact"))
    assert small.compare(batch).count() == index.compare(batch).count() == batch.count() and len(files(small.folder)) < len(files(index.folder))


def test_a_batch_reads_its_buckets(spark, tmp_path):
    rng = random.Random(1)
    rows = families(rng, 12)
    index = WordIndex(spark, str(tmp_path / "index"), Options(identity=0.8), 64)
    index.add(spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "seq_idx long, seq string"), 0)
    words = spark.createDataFrame([(rows[0][1][i : i + 5],) for i in range(4)], "word string").select(S.encode_residues("word").alias("word"))
    found = index.postings(words)
    plan = found._jdf.queryExecution().executedPlan().toString()
    read = found._jdf.queryExecution().optimizedPlan().toString()
    mine = {r.b for r in words.select(index.bucket().alias("b")).collect()}
    assert len(mine) <= 4 and "PartitionFilters" in plan and "bucket" in read
    rest = {r.bucket for r in spark.read.parquet(f"{index.folder}/postings").select("bucket").distinct().collect()}
    assert len(rest) > 50
    assert {r.word for r in found.collect()} == {r.word for r in words.collect()}


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("options", [Options(identity=0.4, word=2, length_share=0.8, length_share2=0.7, length_gap2=1000), Options(identity=0.4, word=2, length_gap=7, length_share2=0.9, length_gap2=4), Options.nucleotide(identity=0.8, word=4, cover_long=0.9, length_share2=0.5, length_gap2=1000)])
def test_length_bands_lose_no_pair(spark, options, within):
    """The pairs of all lengths that fit, from words of classes that bounds reach, and fewer meetings of words."""
    rng = random.Random(4)
    letters = "ARND" if options.alphabet == "aa" else "ACGT"
    seqs = ["".join(rng.choice(letters) for _ in range(int(11 * 1.07 ** rng.randrange(45)))) for _ in range(70)]
    table = spark.createDataFrame(list(enumerate(seqs)), "seq_idx long, seq string")
    rows = greedy.stored(similarity.prepare(table, options))
    queries = rows if within else greedy.stored(similarity.prepare(table.where("seq_idx < 30"), options, ranked=False))
    found = {(r.q, r.r, r.strand, r.shared, r.first_word) for r in similarity.candidates(queries, rows, options, within).collect()}
    # what is compared: the query, or in two sets no more of it than the shortest target that it may join has
    shortest = min(len(r.seq) for r in rows.collect())
    least = {r["rank"]: len(r.seq) if within else min(len(r.seq), max(shortest, int(len(r.seq) * options.length_share2), len(r.seq) - options.length_gap2)) for r in queries.collect()}
    sized = queries.join(spark.createDataFrame(list(least.items()), "rank long, compared long"), "rank")
    q = {r["rank"]: (r.seq, r.need) for r in sized.select("rank", "seq", K.required_words("compared", options.identity, options.word, 2 if options.alphabet == "aa" else 4, 2, options.alphabet == "nt")["required_aan"].alias("need")).collect()}
    r_ = {r["rank"]: r.seq for r in rows.collect()}
    bounds = {r["rank"]: (r.low, r.high) for r in queries.select("rank", S.lower_length("len", options.length_share2, options.length_gap2).alias("low"), S.upper_length("len", options.length_share, options.length_gap, options.cover_long, options.cover_long_gap).alias("high")).collect()}
    coded = (lambda s: s.translate(str.maketrans("ACGT", "0123"))) if options.alphabet == "nt" else (lambda s: "".join(chr(97 + S.AMINO_CODES[c]) for c in s))
    wanted = set()
    for a, (s, need) in q.items():
        for strand, seq in (("+", s), ("-", s[::-1].translate(str.maketrans("ACGT", "TGCA")))) if options.both_strands else (("+", s),):
            x = [coded(seq)[i : i + options.word] for i in range(len(seq) - options.word + 1)]
            for b, t in r_.items():
                y = [coded(t)[i : i + options.word] for i in range(len(t) - options.word + 1)]
                both = set(x) & set(y)
                n = sum(min(x.count(w), y.count(w)) for w in both)
                fits = len(t) <= bounds[a][1] and (b < a if within else len(t) >= bounds[a][0])
                if fits and n >= max(1, need):
                    wanted.add((a, b, strand, n, min(both)))
    assert found == wanted and len(wanted) > 40


def test_bands_are_in_the_join(spark):
    """With bounds words of distant lengths don't meet: candidates of a table of two lengths come without one joined row between them."""
    rng = random.Random(7)
    base = "".join(rng.choice(LETTERS) for _ in range(300))
    seqs = [base] * 6 + [base[:60]] * 6
    rows = greedy.stored(similarity.prepare(spark.createDataFrame(list(enumerate(seqs)), "seq_idx long, seq string"), Options(length_share=0.9)))
    met = []
    plain = K.pairs_sharing

    def counted(queries, targets, *more, **named):
        met.append(queries.join(targets.withColumnRenamed("rank", "r"), "word").count())
        return plain(queries, targets, *more, **named)

    K.pairs_sharing = counted
    try:
        bounded = similarity.candidates(rows, rows, Options(length_share=0.9), within=True).count()
        similarity.candidates(rows, rows, Options(), within=True).count()
    finally:
        K.pairs_sharing = plain
    assert bounded == 30 and met[0] < 0.9 * met[1]
