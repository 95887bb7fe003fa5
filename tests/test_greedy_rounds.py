"""Greedy rounds with alignments inside, against a plain sequential greedy, and what they cost."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinstrand.functions import alignment as A
from kinstrand.operators import greedy, similarity
from kinstrand.operators.similarity import Options

LETTERS = "ARNDCQEGHILKMFPSTWYV"


def family(rng, letters, length, members, edits):
    base = "".join(rng.choice(letters) for _ in range(length))
    for _ in range(members):
        seq = list(base)
        for _ in range(rng.randrange(edits + 1)):
            seq[rng.randrange(len(seq))] = rng.choice(letters)
        yield "".join(seq)


def plain(pairs, seqs, options):
    """(q, r, identity) of redundant rows: one after another against the representatives so far."""
    scoring, reps, out, aligned = options.scoring(), set(), [], 0
    by_q = {}
    for p in pairs:
        by_q.setdefault(p["q"], []).append(p)
    order = (lambda p: (p["strand"], p["first_word"], p["r"])) if options.mode == "fast" else (lambda p: (p["r"], p["strand"]))
    for q in sorted(seqs):
        best = None
        for p in sorted(by_q.get(q, []), key=order):
            if p["r"] not in reps:
                continue
            seq = seqs[q] if p["strand"] == "+" else seqs[q][::-1].translate(str.maketrans("ACGT", "TGCA"))
            a, b = scoring.encode(seq), scoring.encode(seqs[p["r"]])
            band = A.best_band(a, b, scoring.unit, options.identity, options.band, p["required_aa1"])
            if band.shared < p["required_aas"]:
                continue
            aligned += 1
            found = similarity._accept(p | {"place": 0}, a, b, A.align([(a, b, band)], scoring)[0], options)
            if found and (best is None or found[3] > best[3]):
                best = found
                if options.mode == "fast":
                    break
        if best is None:
            reps.add(q)
        else:
            out.append((q, best[1], best[2], round(best[3], 6)))
    return out, aligned


def rows_of(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_idx long, seq string")


@pytest.mark.parametrize("mode", ["fast", "accurate"])
@pytest.mark.parametrize("alphabet", ["aa", "nt"])
def test_rounds_equal_the_sequential_greedy(spark, mode, alphabet):
    """Families that overlap, reverse complements, and rows whose candidates mostly reject them."""
    rng = random.Random(3)
    letters = LETTERS if alphabet == "aa" else "ACGT"
    seqs = [s for k in range(6) for s in family(rng, letters, 90 + 3 * k, 7, 22)]
    if alphabet == "nt":
        seqs += [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in seqs[3:12]]
    options = Options(identity=0.8, mode=mode) if alphabet == "aa" else Options.nucleotide(identity=0.85, word=6, mode=mode)
    table = greedy.stored(similarity.prepare(rows_of(spark, seqs), options))
    pairs = greedy.stored(similarity.candidates(table, table, options, within=True))
    wanted, _ = plain([r.asDict() for r in pairs.collect()], {r["rank"]: r.seq for r in table.collect()}, options)
    found = similarity._best(similarity.settled(pairs, table, options), options).collect()
    assert sorted((r.q, r.r, r.strand, round(r.identity, 6)) for r in found) == wanted
    assert len(wanted) > 20


def test_members_align_once(spark):
    """Five families of forty: a member meets its representative and no other member."""
    rng = random.Random(8)
    seqs = [s for _ in range(5) for s in family(rng, LETTERS, 150, 40, 4)]
    options = Options(identity=0.8)
    table = greedy.stored(similarity.prepare(rows_of(spark, seqs), options))
    pairs = greedy.stored(similarity.candidates(table, table, options, within=True))
    answers = similarity.settled(pairs, table, options)
    assert pairs.count() >= 5 * 40 * 39 / 2 and answers.agg(F.sum("aligned")).first()[0] == 195
    out = similarity.cluster(rows_of(spark, seqs), options)
    assert out.where("is_rep").count() == 5 and out.groupBy("cluster_id").count().where("count <> 40").count() == 0


def test_state_crosses_batches(spark):
    """A query with more candidates than a batch has rows stops at the first that passes, and keeps the best in accurate mode."""
    rng = random.Random(5)
    base = "".join(rng.choice(LETTERS) for _ in range(60))
    edited = ["".join(rng.choice(LETTERS) if rng.random() < share else c for c in base) for share in [0.35] * 12 + [0.1, 0.05, 0.0, 0.2]]
    first, second = rows_of(spark, [e + "A" for e in edited]), rows_of(spark, [base])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for mode in ("fast", "accurate"):
            options = Options(identity=0.6, word=2, mode=mode)
            targets, queries = greedy.stored(similarity.prepare(first, options)), greedy.stored(similarity.prepare(second, options, ranked=False))
            pairs = greedy.stored(similarity._in_order(similarity.candidates(queries, targets, options, within=False), options))
            (row,) = similarity.asked(pairs, queries, targets, options).collect()
            assert pairs.count() > 8
            every = similarity.asked(pairs, queries, targets, options, every=True).where("r is not null").collect()
            best = min(every, key=lambda r: r.place if mode == "fast" else (-r.identity, r.place))
            assert (row.r, row.identity) == (best.r, best.identity)
            if mode == "fast":
                assert row.aligned <= best.place
            else:
                assert row.aligned < pairs.count()  # identical at the fifteenth: the last one isn't asked
        hits = similarity.compare(first, second, Options(identity=0.6, word=2, mode="accurate")).collect()
        assert [(r.r, round(r.identity, 6)) for r in hits] == [(14, 1.0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reads_with_other_letters_join(spark):
    """Words with N are in no posting; they aren't asked for either: identical reads with N are one cluster, also on the other strand."""
    rng = random.Random(1)
    for n in (1, 5, 7, 12):
        seq = list("".join(rng.choice("ACGT") for _ in range(100)))
        for i in range(n):
            seq[4 + 48 // n * i] = "N"
        seq = "".join(seq)
        turned = seq[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
        out = similarity.cluster(rows_of(spark, [seq, seq, turned]), Options.nucleotide(identity=0.95 if n < 6 else 0.8)).collect()
        assert sum(r.is_rep for r in out) == 1, n


def test_one_length_is_ranked_by_several_tasks(spark):
    """Places of equally long rows come from ranges of ids: no task sees them all, and no sequence is sorted."""
    from kinstrand.operators import ranking

    rows = spark.range(20_000).select(F.col("id").alias("seq_idx"), F.lit("ACGTACGTAC").alias("seq")).union(spark.createDataFrame([(-1, "A" * 50)], "seq_idx long, seq string"))
    ranked = ranking.rank_by_length(rows)
    found = ranked.select("seq_idx", "rank").collect()
    assert {(r.seq_idx, r["rank"]) for r in found} == {(-1, 0)} | {(i, i + 1) for i in range(20_000)}
    places = ranking.numbered(rows.select("seq_idx"), "seq_idx")
    assert tuple(places.orderBy("place").first()) == (-1, 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = ranking.numbered(rows.select("seq_idx"), "seq_idx")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(spark.read.parquet(f).count() for f in places.inputFiles())
    assert len(sizes) > 4 and sizes[-1] < 10_000


def test_fragments(spark):
    """A query whose words lie scattered over a long target is no candidate with fragments, one whose words lie together is."""
    rng = random.Random(4)
    long_ = "".join(rng.choice(LETTERS) for _ in range(900))
    together = long_[300:360]
    scattered = "".join(long_[k : k + 12] for k in (0, 200, 400, 600, 800))
    first, second = rows_of(spark, [long_]), rows_of(spark, [together, scattered])
    base = {"identity": 0.9, "length_share2": 0.01, "length_gap2": similarity.UNSET, "least_length": 5}

    def found(**more):
        options = Options(**(base | more))
        a, b = greedy.stored(similarity.prepare(first, options)), greedy.stored(similarity.prepare(second, options, ranked=False))
        return {r.q: r.shared for r in similarity.candidates(b, a, options, within=False).collect()}

    assert found() == {0: 56, 1: 40} and found(fragment=60) == {0: 56}
    assert [r.q for r in similarity.compare(first, second, Options(**base, fragment=60)).collect()] == [0]
    with pytest.raises(ValueError, match="residues"):
        Options.nucleotide(fragment=50)


def test_requirements_follow_what_is_compared(spark):
    """Half of a read, or a representative shorter than the query, has fewer words than the whole query: neither is lost."""
    rng = random.Random(31)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    shared = letters(60)
    reads = spark.createDataFrame([(0, shared + letters(80)), (1, shared + letters(70)), (2, letters(130))], "seq_idx long, seq string")
    local = Options.nucleotide(identity=0.95, global_identity=False, cover_least=50, both_strands=False)
    found = {r.seq_idx: r.cluster_id for r in similarity.cluster(reads, local).collect()}
    assert found[0] == found[1] != found[2]
    assert similarity.cluster(reads, Options.nucleotide(identity=0.95, both_strands=False)).where("is_rep").count() == 3

    short = letters(60, "ACDEFGHIKLMNPQRSTVWY")
    near = "".join("W" if i in (20, 41) else c for i, c in enumerate(short))
    first = spark.createDataFrame([(7, short)], "seq_idx long, seq string")
    second = spark.createDataFrame([(0, letters(50, "ACDEFGHIKLMNPQRSTVWY") + near + letters(50, "ACDEFGHIKLMNPQRSTVWY")), (1, letters(160, "ACDEFGHIKLMNPQRSTVWY")), (2, near)], "seq_idx long, seq string")
    hits = similarity.compare(first, second, Options(identity=0.9, length_share2=0.3, length_gap2=similarity.UNSET)).collect()
    assert {(r.q, r.r, r.q_beg, r.q_end) for r in hits} == {(0, 7, 51, 110), (2, 7, 1, 60)}
    covered = Options(identity=0.9, length_share2=0.3, length_gap2=similarity.UNSET, cover_short=0.9)  # of the 60 letters that the shortest representative has
    assert {r.q for r in similarity.compare(first, second, covered).collect()} == {0, 2}
    assert similarity.compare(first.limit(0), second, covered).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 120])
def test_stretches_meet_in_cells(spark, monkeypatch, block):
    """Pairs by neighbouring stretches are those of the definition, masked letters and short rows among them, and no pair that shares too little becomes a row."""
    rng = random.Random(8)
    base = "".join(rng.choice("ACD") for _ in range(150))
    texts = [base, base[40:110], base[:30] + base[90:], base[60:75] + "W" * 5, "ACDAC", *("".join(rng.choice("ACD") for _ in range(n)) for n in (33, 80, 81, 120))]
    options = Options(distance=0.06, fragment=30, length_share2=0.01, length_gap2=similarity.UNSET, least_length=4, mask="W")
    rows = greedy.stored(similarity.prepare(rows_of(spark, texts), options))
    coded = {r["rank"]: r.seq for r in rows.collect()}
    words = lambda s, i, j: Counter(w for x in range(i, min(j, len(s) - 4)) if "#" not in (w := s[x : x + 5]))

    def shared(q, r):
        reach = (len(q) - 5 + 20) // 30 + 2
        return max(sum(sum((words(q, 0, len(q)) & words(r, 30 * f, 30 * f + 30)).values()) for f in range(g, g + reach)) for g in range((len(r) - 5) // 30 + 1))

    each = [(q, r, shared(coded[q], coded[r])) for q in coded for r in coded]
    monkeypatch.setattr(similarity.K, "STRETCH_BLOCK", block)
    monkeypatch.setattr(similarity.K, "pairs_sharing", lambda *a, **b: pytest.fail("all pairs with a word in common are listed first"))
    found = {(x.q, x.r, x.shared) for x in similarity.candidates(rows, rows, options, within=False).collect()}
    assert found == {x for x in each if x[2]} and len(found) > 20  # the shortest target has one word, so one is asked for
    least = lambda s: max(1, min(16 - 5, len(s) - 5 + 1))
    assert {(x.q, x.r, x.shared) for x in similarity.candidates(rows, rows, options, within=True).collect()} == {x for x in each if x[1] < x[0] and x[2] >= least(coded[x[0]])}


def test_two_sets_list_no_words(spark, monkeypatch):
    """Documents meet items in cells: no word of a document becomes a row; words of ten letters count as defined."""
    from kinstrand.plans import sequence_queries

    monkeypatch.setattr(similarity.K, "postings", lambda *a, **b: pytest.fail("each word of each text becomes a row"))
    sequence_queries.QUERIES["compare_2d_kmer"](spark, "/root/testdata/sf0.001").collect()
    rng = random.Random(5)
    texts = ["".join(rng.choice("AZ") for _ in range(rng.randrange(8, 60))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "rank long, seq string")
    words = [Counter(x[i : i + 10] for i in range(len(x) - 9)) for x in texts]
    want = {(q, r, n, min(words[q] & words[r])) for q in range(30) for r in range(30) if (n := sum((words[q] & words[r]).values())) >= max(1, r % 3)}
    found = similarity.K.pairs_in_stretches(rows.selectExpr("rank", "1 need", "1 reach", "seq"), rows.selectExpr("rank", "rank % 3 need", "seq"), 10, 0, within=False).collect()
    assert {tuple(x) for x in found} == want and len(want) > 60


@pytest.mark.parametrize("summed", [4_000_000, 50])
def test_word_totals_add_up_in_tasks(spark, monkeypatch, summed):
    """Words of all sequences with their numbers, whatever a task holds; words of copies in a task are dealt once."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("AZ") for _ in range(rng.randrange(5, 60))) for _ in range(40)] * 2
    words = [Counter(x[i : i + 10] for i in range(len(x) - 9)) for x in texts]
    want = {w: (sum(w in x for x in words), sum(x[w] for x in words)) for w in set().union(*words)}
    monkeypatch.setattr(similarity.K, "_SUMMED", summed)
    rows = spark.createDataFrame([(x,) for x in texts], "seq string")
    assert {r.word: (r.n_sequences, r.n_words) for r in similarity.K.word_totals(rows, 10).collect()} == want
    batch = pa.RecordBatch.from_arrays([pa.array([x.encode() for x in texts if len(x) > 9])], names=["b"])
    dealt = sum(x.num_rows for x in similarity.K._totals(10)([batch]))
    assert dealt == len(want) if summed > 50 else dealt < sum(map(len, words))


def test_rounds_write_little(spark, monkeypatch):
    """A chain of many rounds: the first maximal independent set, two tables written for each round and two besides."""
    from kinstrand.operators import greedy

    written = []
    keep = greedy.stored
    monkeypatch.setattr(greedy, "stored", lambda df: written.append(1) or keep(df))
    pairs = [(k, k // 3) for k in range(1, 250)] + [(k, k // 2) for k in range(100, 160)]
    found = {r["rank"]: r.is_rep for r in greedy.representatives(spark.createDataFrame(pairs, "q long, r long")).collect()}
    reps = set()
    for k in range(250):
        if not any(q == k and r in reps for q, r in pairs):
            reps.add(k)
    assert found == {k: k in reps for k in range(250)}
    assert len(written) <= 2 * 4 + 2
