"""Formats, alignment, clustering, reads and streams on hand-made rows."""

from __future__ import annotations

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinstrand.functions import alignment as A
from kinstrand.functions import kmers as K
from kinstrand.functions import sequences as S
from kinstrand.operators import chimeras, duplicates, evaluation, greedy, hsp, ranking, reads, similarity
from kinstrand.operators import clusters as C
from kinstrand.operators.similarity import Options
from kinstrand.sources import formats
from kinstrand.streaming import incremental

RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def protein(rng, n):
    return "".join(rng.choice(RESIDUES) for _ in range(n))


def edited(rng, seq, edits):
    letters = list(seq)
    for _ in range(edits):
        i = rng.randrange(len(letters))
        letters[i] = rng.choice([x for x in RESIDUES if x != letters[i]])
    return "".join(letters)


def test_normal_forms(spark):
    rows = spark.createDataFrame([("acg t* ",), ("ac-g",), ("AC GT",), ("ac**",)], "s string")
    assert [r[0] for r in rows.select(S.normalise("s")).collect()] == ["ACGT", None, "ACGT", None]
    one = spark.createDataFrame([(">seq1|x some text", "ACGTN", "AACC", "GG")], "d string, s string, a string, b string")
    row = one.select(
        S.short_id("d"), S.short_id("d", 5), S.reverse_complement("s"), S.merge_mates("a", "b"), S.pad_and_join("a", "b", 3), S.encode_nucleotides("s"), S.mismatches("a", "b"), S.common_prefix_length("s", "a")
    ).first()
    assert tuple(row) == ("seq1|x", "seq1", "NACGT", "GGAACC", "AACGGN", "01234", 4, 1)


def test_fasta_and_fastq(spark, tmp_path):
    text = ">a first\nACGT\nACGTACGTAC\n>b\nAC-GT\n>c third\nACGTACGTACGTA*\n"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(text)
    for name in ("x.fa", "y.fa.gz"):
        good, bad = formats.sequences(formats.read_fasta(spark, str(tmp_path / name)))
        assert [(r.seq_idx, r.id, r.seq) for r in good.orderBy("seq_idx").collect()] == [(0, "a", "ACGTACGTACGTAC"), (1, "c", "ACGTACGTACGTA")]
        assert [r.id for r in bad.collect()] == ["b"]
    (tmp_path / "x.fq").write_text("@r1 q\nACGT\n+\n@@II\n@r2\nGGGG\n+r2\nIIII\n")
    rows = formats.read_fastq(spark, str(tmp_path / "x.fq")).orderBy("n").collect()
    assert [(r.id, r.seq_raw, r.qual) for r in rows] == [("r1", "ACGT", "@@II"), ("r2", "GGGG", "IIII")]
    (tmp_path / "z.fa").write_text(">only\nACGT\n")
    with pytest.raises(ValueError, match="differ"):
        formats.read_mates(spark, str(tmp_path / "x.fa"), str(tmp_path / "z.fa"))
    pairs = formats.read_mates(spark, str(tmp_path / "x.fa"), str(tmp_path / "y.fa.gz"))
    assert pairs.count() == 3 and pairs.where("r1 <> r2").count() == 0
    good, _ = formats.sequences(formats.read_fasta(spark, str(tmp_path / "x.fa")))
    formats.write_fasta(good, str(tmp_path / "out"))
    assert formats.read_fasta(spark, str(tmp_path / "out")).select("id").distinct().count() == 2


def test_cluster_text_round_trip(spark, tmp_path):
    text = (
        ">Cluster 0\n0\t120aa, >long... *\n1\t100aa, >x y... at 98.50%\n>Cluster 1 chimeric_parent1=3,chimeric_parent2=4\n0\t80nt, >r... *\n1\t70nt, >s... at 70:1:5:74/-/91.00%\n2\t60nt, >t... at 1:60:1:60/+/90.25%/3.10%\n>Cluster 2\n0\t9aa, >old... *\n1\t8aa, >p... at 80%\n"
    )
    (tmp_path / "x.clstr").write_text(text)
    found = formats.read_clusters(spark, str(tmp_path / "x.clstr"))
    rows = {(r.cluster_id, r.member_no): r for r in found.collect()}
    assert len(rows) == 7 and rows[0, 1].identity == 98.5 and rows[1, 1].strand == "-" and rows[1, 1].q_beg == 70 and rows[1, 2].distance == 3.1 and rows[2, 1].identity == 80
    assert rows[1, 0].note == "chimeric_parent1=3,chimeric_parent2=4" and rows[1, 0].is_rep and not rows[1, 1].is_rep
    plain = found.where("cluster_id = 0").drop("distance", "strand")
    formats.write_clusters(plain, str(tmp_path / "out"))
    again = formats.read_clusters(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in again.select("cluster_id", "member_no", "id", "identity").collect() if r[3]) == [(0, 1, "x y", 98.5)]


def test_hits_ids_and_sheets(spark, tmp_path):
    (tmp_path / "h.m8").write_text("# c\n1.200\t2.100\t95.0\t50\t2\t0\t1\t50\t60\t11\t1e-10\t90\n1.200\t2.100\t90.0\t20\t2\t0\t60\t79\t61\t80\t1e-5\t30\n")
    rows = formats.read_hits(spark, str(tmp_path / "h.m8")).orderBy("hsp_no").collect()
    assert [(r.q_len, r.s_len, r.frame, r.hsp_no) for r in rows] == [(200, 100, "+-", 1), (200, 100, "++", 2)]
    (tmp_path / "ids").write_text(">a x\nb\n\n")
    assert sorted(r.id for r in formats.read_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]
    (tmp_path / "tax").write_text("id1 k__A; p__B c\n")
    assert tuple(formats.read_pairs(spark, str(tmp_path / "tax")).first()) == ("id1", "k__A;.p__B.c")
    (tmp_path / "sheet").write_text("# s\ns1 a.fq b.fq\n")
    assert tuple(formats.read_sample_sheet(spark, str(tmp_path / "sheet")).first()) == ("s1", ["a.fq", "b.fq"])


def test_biom(spark):
    import json

    table = spark.createDataFrame([(1, 2, 0), (2, 0, 3)], "otu long, a long, b long")
    out = json.loads(formats.sample_biom(table, ["a", "b"]).first().value)
    assert out["shape"] == [2, 2] and out["data"] == [[0, 0, 2], [1, 1, 3]] and [r["id"] for r in out["rows"]] == ["1", "2"]


def _global_score(q, r, scoring):
    """Plain dynamic programming with cheap gaps at the borders, without a band."""
    m, n = len(q), len(r)
    score = [[(scoring.extend * (i + j), "T" if j == 0 else "L") if not i or not j else None for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            edge = i == m or j == n
            best = (score[i - 1][j - 1][0] + int(scoring.matrix[q[i - 1], r[j - 1]]), "D")
            for (s, how), move in ((score[i][j - 1], "L"), (score[i - 1][j], "T")):
                value = s + (scoring.extend if edge or how == move else scoring.gap)
                if value > best[0]:
                    best = (value, move)
            score[i][j] = best
    return score[m][n][0]


def test_alignment_equals_plain_programme():
    rng, scoring = random.Random(7), A.Scoring.amino()
    for _ in range(40):
        q = protein(rng, rng.randrange(12, 40))
        r = edited(rng, q, 3)
        if rng.random() < 0.5:
            r = r[:5] + r[6:]
        a, b = scoring.encode(q), scoring.encode(r)
        score, _ = A._fill([(a, b, A.Band(-len(a) + 1, 0, len(b) - 1, 0))], scoring)
        assert round(score[0][len(a)][len(b) - len(a) + len(a) - 1] / A.SCALE) == _global_score(a, b, scoring)
    (one,) = A.align([(scoring.encode("ARNDCQEGHILK"), scoring.encode("ARNDCQEGHILK"), A.Band(0, 0, 0, 12))], scoring)
    assert one.matches == 12 and one.distance == 0 and (one.q_beg, one.q_end) == (1, 12)
    for _ in range(300):
        q, r = protein(rng, rng.randrange(3, 50)), protein(rng, rng.randrange(3, 50))
        a, b = scoring.encode(q), scoring.encode(r)
        A.align([(a, b, A.best_band(a, b, 2, 0.6, 20, 3))], scoring)
        x, y = A.gapped(q, r, scoring)
        assert len(x) == len(y) and x.replace("-", "") == q and y.replace("-", "") == r


@pytest.fixture(scope="module")
def families(spark):
    rng = random.Random(11)
    rows, truth = [], {}
    for f in range(6):
        base = protein(rng, 120 - f)
        for k in range(4):
            i = len(rows)
            rows.append((i, base if k == 0 else edited(rng, base[: 119 - f - k], 4)))
            truth[i] = f
    rows += [(len(rows), "SHORT"), (len(rows) + 1, "AB1C" * 10)]
    return spark.createDataFrame(rows, "seq_idx long, seq string"), truth


def test_clusters_are_the_families(families):
    rows, truth = families
    for mode in ("fast", "accurate"):
        out = similarity.cluster(rows, Options(identity=0.8, mode=mode)).collect()
        groups = {}
        for r in out:
            groups.setdefault(r.cluster_id, set()).add(r.seq_idx)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in truth if truth[i] == f) for f in set(truth.values()))
        assert all(r.is_rep == (r.identity is None) and (r.is_rep or r.identity >= 0.8) for r in out)
    levels = similarity.hierarchical(rows, Options(identity=0.9), Options(identity=0.6, word=4))
    assert levels[1].count() == levels[0].where("is_rep").count()


def test_two_sets_and_increments(families):
    rows, truth = families
    first, second = rows.where("seq_idx % 4 = 0"), rows.where("seq_idx % 4 > 0 and seq_idx < 24")
    hits = similarity.compare(first, second, Options(identity=0.8, mode="accurate")).collect()
    assert {r.q for r in hits} == {i for i in truth if i % 4} and all(truth[r.q] == truth[r.r] for r in hits)
    hits, rest = similarity.incremental(first.where("seq_idx < 8"), second, Options(identity=0.8))
    assert all(truth[r.q] == truth[r.r] for r in hits.collect()) and rest.count() + hits.count() == 18


def test_strands(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("ACGT") for _ in range(100))
    other = base[:99].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = spark.createDataFrame([(0, base), (1, other)], "seq_idx long, seq string")
    out = similarity.cluster(rows, Options.nucleotide(identity=0.9)).orderBy("seq_idx").collect()
    assert [r.is_rep for r in out] == [True, False] and out[1].strand == "-" and out[1].q_beg > out[1].q_end
    assert similarity.cluster(rows, Options.nucleotide(identity=0.9, both_strands=False)).where("is_rep").count() == 2


def test_required_words_by_hand(spark):
    """Figures worked out from the stated rules: n - w - w * ceil((1 - c) n), the shares, and 1/d - w for a distance."""
    from kinstrand.functions import kmers as K

    rows = spark.createDataFrame([(50,), (100,), (200,)], "len int")
    get = lambda **k: {r.len: tuple(r)[1:] for r in rows.select("len", *(c.alias(n) for n, c in K.required_words("len", **k).items())).collect()}
    # identity 0.99: in floating point one per cent of 100 is a little over 1, so two errors count: 98 - 4 and 95 - 10
    assert {n: v[2] for n, v in get(identity=0.99, k=5).items()} == {50: 40, 100: 85, 200: 180}
    assert get(identity=0.99, k=5)[100][:2] == (94, 94)
    # identity 0.8: no weight on the worst case; shares 0.6 and 0.27 of tolerance 2
    assert get(identity=0.8, k=5)[100] == (79, 60, 27)
    assert get(identity=0.8, k=5, tolerance=4)[200] == (159, 126, 68)
    assert get(identity=0.95, k=10, small=4, nucleotides=True, distance=0.1) == {n: (5, 5, 1) for n in (50, 100, 200)}
    assert K.kept_share(0.79, 5) == 0.17 and K.kept_share(0.9, 2, 1) == 0.75 and K.kept_share(0.39, 2) == 0.0


def test_pairs_sharing_loses_none(spark):
    """All pairs of random multisets of words at their thresholds, with common words and queries made of nothing else."""
    from kinstrand.functions import kmers as K

    rng = random.Random(2)
    rare, usual = [f"r{i}" for i in range(60)], [f"c{i}" for i in range(8)]
    bags = [[rng.choice(usual if rng.random() < (0.3 if i % 5 else 1.0) else rare) for _ in range(rng.randrange(1, 25))] for i in range(70)]
    bags += [bags[3] + ["r1"], bags[5]]
    posts = greedy.stored(spark.createDataFrame([(i, w, b.count(w)) for i, b in enumerate(bags) for w in set(b)], "rank long, word string, cnt int"))
    need = [max(1, len(b) // 3) for b in bags]
    asked = spark.createDataFrame(list(enumerate(need)), "q long, need long")

    def wanted(pairs):
        out = {}
        for q, r in pairs:
            both = set(bags[q]) & set(bags[r])
            n = sum(min(bags[q].count(w), bags[r].count(w)) for w in both)
            if n >= need[q]:
                out[q, r] = (n, min(both))
        return out

    got = {(x.q, x.r): (x.shared, x.first_word) for x in K.pairs_sharing(posts, posts, asked, True, 5).collect()}
    assert got == wanted((q, r) for q in range(len(bags)) for r in range(q))
    first, second = greedy.stored(posts.where("rank < 30")), greedy.stored(posts.where("rank >= 30"))
    got = {(x.q, x.r): (x.shared, x.first_word) for x in K.pairs_sharing(first, second, asked.where("q < 30"), False, 5).collect()}
    assert got == wanted((q, r) for q in range(30) for r in range(30, len(bags)))


@pytest.mark.parametrize(("errors", "same_length"), [(0, False), (1, False), (2, False), (2, True), (3, True)])
def test_prefix_pairs_are_all_pairs(spark, errors, same_length):
    rng = random.Random(errors)
    reads = {"".join(rng.choice("AC") for _ in range(rng.randrange(1, 30))) for _ in range(40)}
    reads |= {r[: rng.randrange(1, len(r) + 1)] for r in list(reads)} | {r[:5] + rng.choice("ACGT") + r[6:] for r in list(reads) if len(r) > 6} | {"A", "G", "AC"}
    order = sorted(reads, key=lambda r: (-len(r), r))
    rows = spark.createDataFrame([(i, r, len(r)) for i, r in enumerate(order)], "rank long, seq string, len int")
    got = {(x.q, x.r) for x in duplicates.prefix_pairs(rows, errors, same_length).collect()}
    fits = lambda q, r: (len(q) == len(r) or not same_length) and sum(a != b for a, b in zip(q, r, strict=False)) <= errors
    want = {(i, j) for i in range(len(order)) for j in range(i) if fits(order[i], order[j])}
    assert got == want


def test_distance_mode(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    other = list(base)
    for i in range(7, 400, 14):  # 29 of 400 letters: 7.25 %
        other[i] = "ACGT"[("ACGT".index(other[i]) + 1) % 4]
    rows = spark.createDataFrame([(0, base), (1, "".join(other))], "seq_idx long, seq string")
    count = lambda **k: similarity.cluster(rows, Options.nucleotide(word=6, **k)).where("is_rep").count()
    assert count(distance=0.1) == 1 and count(distance=0.07) == 2 and count(identity=0.95) == 2
    for bad in ({"distance": 0.1, "identity": 0.9}, {"distance": 1.5}):
        with pytest.raises(ValueError, match="distance"):
            Options(**bad)
    with pytest.warns(UserWarning, match="too long"):
        Options.nucleotide(distance=0.1)


def test_options():
    for bad in ({"identity": 0.2}, {"word": 9}, {"mode": "x"}, {"tolerance": 9}, {"global_identity": False}, {"both_strands": True}):
        with pytest.raises(ValueError, match="."):
            Options(**bad)
    with pytest.warns(UserWarning, match="ignored"):
        Options(threads=4)


@pytest.mark.parametrize("seed", [0, 1])
def test_representatives_are_the_greedy_ones(spark, seed):
    rng = random.Random(seed)
    pairs = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(160)) if a != b}
    want = {}
    for q in range(80):
        want[q] = not any(want[r] for a, r in pairs if a == q)
    got = {r["rank"]: r.is_rep for r in greedy.representatives(spark.createDataFrame(sorted(pairs), "q long, r long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in p for p in pairs)}


def test_links(spark):
    rng = random.Random(3)
    whole = "".join(rng.choice("ACGT") for _ in range(60))
    turn = lambda s: s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    wrong = whole[:25] + ("A" if whole[25] != "A" else "C") + whole[26:]
    rows = spark.createDataFrame([(1, whole[:40], turn(whole[20:])), (2, whole[:40], turn(wrong[20:])), (3, whole[:20], turn(whole[40:])), (4, whole[:30] + "N" + whole[31:40], turn(whole[20:]))], "id long, r1 string, r2 string")
    out = {(r.id, r.contig): r for r in reads.link_mates(rows, 10, 1).collect()}
    assert out[1, 1].seq == whole and out[1, 1].overlap == 20 and out[1, 1].mismatch_no == 0
    assert {out[2, 1].seq, out[2, 2].seq} == {whole, wrong} and out[2, 1].mismatch_pos == "26" and (3, 1) not in out
    assert out[4, 1].seq == whole and out[4, 1].mismatch_no == 1


def test_overlaps(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    turned = base[60:118].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = ranking.rank_by_length(spark.createDataFrame([(0, base[:80]), (1, base[50:115]), (2, turned), (3, "ACGT" * 10)], "seq_idx long, seq string"))
    out = {r.seq_idx: r for r in reads.overlap_clusters(rows, 20).collect()}
    assert out[0].is_rep and not out[1].is_rep and out[1].overlap == 30 and out[1].rep_rank == 0
    assert out[2].rep_rank == 0 and out[2].strand == "-" and out[2].overlap == 20 and out[3].is_rep


def _plain_chimeras(rows, shared=30, fold=1.0):
    """One read after another; the parents so far are a list."""
    parents, out = [], []
    for qid, q, qa in sorted(rows, key=lambda r: (-r[2], r[0])):
        n = len(q)
        few, some = int(0.01 * n), int(0.015 * n)
        words = {}
        for i in range(n - shared + 1):
            words.setdefault(q[i : i + shared], []).append(i)
        heads, tails, singles = [], [], []
        for pid, p, pa in parents if n >= 2 * shared else []:
            offsets = {}
            for j in range(len(p) - shared + 1):
                for i in words.get(p[j : j + shared], []):
                    offsets[j - i] = offsets.get(j - i, 0) + 1
            if not offsets or pa < fold * qa:
                continue

            def wrong(i, off, p=p):
                return not 0 <= i + off < len(p) or q[i] != p[i + off]

            head = max(k for k in range(n + 1) if sum(wrong(i, 0) for i in range(k)) <= few)
            tail, shift = 0, 0
            for off in sorted(offsets, key=lambda o: (-offsets[o], abs(o), o))[:2]:
                end = min(n, len(p) - off)
                start = min(k for k in range(end + 1) if sum(wrong(i, off) for i in range(k, end)) <= few)
                if end - start >= shared:
                    tail, shift = end - start, off
                    tails.append((start, pid, wrong, off))
                    break
            if head >= shared:
                heads.append((-pa, pid, head, wrong))
            cut = (head + n - tail) // 2 if head + tail >= n else n
            singles.append(sum(wrong(i, 0) for i in range(cut)) + sum(wrong(i, shift) for i in range(cut, n)))
        best = min([m for m in singles if m <= some], default=None)
        if best is not None and best <= few:
            continue
        limit = some if best is None else best
        found = None
        for _, a, head, wa in sorted(heads, key=lambda x: x[:2]):
            for start, b, wb, off in sorted(tails, key=lambda x: x[:2]):
                x = (head + start) // 2
                good = sum(wa(i, 0) for i in range(x)) + sum(wb(i, off) for i in range(x, n))
                if not found and a != b and start <= head and good <= limit and sum(wb(i, 0) for i in range(x)) > limit + few and sum(wa(i, 0) for i in range(x, n)) > limit + few:
                    found = (qid, a, b, x)
        if found:
            out.append(found)
        else:
            parents.append((qid, q, qa))
    return sorted(out)


def test_chimeras(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = letters(100), letters(100)
    rows = [(1, a, 20), (2, b, 15), (3, a[:50] + b[50:], 1), (4, a[:99] + ("A" if a[99] != "A" else "C"), 2)]
    kind = "id long, seq string, abundance long"
    assert [(r.id, r.parent_head, r.parent_tail) for r in chimeras.chimeras(spark.createDataFrame(rows, kind)).collect()] == [(3, 1, 2)]
    assert chimeras.chimeras(spark.createDataFrame([], kind)).collect() == []

    # parents of other lengths, shifted tails, wrong letters, chimeras of chimeras and of reads close to one parent
    base = [letters(rng.randrange(90, 240)) for _ in range(8)]
    rows = {x: 50 + i for i, x in enumerate(base)}

    def wrong(x, k):
        for _ in range(k):
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice("ACGT") + x[i + 1 :]
        return x

    for _ in range(120):
        x, y = rng.sample(list(rows), 2)
        i, j = rng.randrange(len(x)), rng.randrange(len(y))
        rows.setdefault(wrong(x[:i] + y[j:], rng.randrange(3)) if rng.random() < 0.7 else wrong(x, rng.randrange(1, 5)), rng.randrange(1, 9))
    rows = [(i, x, n) for i, (x, n) in enumerate(rows.items())] + [(1000, "", 3), (1001, "ACGT", 3)]
    for fold in (1.0, 2.0):
        found = chimeras.chimeras(spark.createDataFrame([*rows, (1002, None, 4)], kind), fold=fold).collect()
        expected = _plain_chimeras(rows, fold=fold)
        assert len(expected) > 10 and sorted(tuple(r) for r in found) == expected


def test_mismatch_duplicates(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(3)]
    rows = [(i, s) for i, s in enumerate(base)] + [(10 + i, s[:20] + ("A" if s[20] != "A" else "C") + s[21:]) for i, s in enumerate(base)]
    ranked = ranking.rank_by_length(spark.createDataFrame(rows, "seq_idx long, seq string"))
    assert duplicates.cluster(ranked, errors=1).where("is_rep").count() == 3
    assert duplicates.cluster(ranked, errors=0).where("is_rep").count() == 6


def test_colinear(spark):
    cells = "qid long, sid long, qfrom long, qend long, sfrom long, send long, frame string, hsp_no long"
    rows = spark.createDataFrame([(1, 1, 1, 50, 1, 50, "++", 1), (1, 1, 40, 80, 60, 100, "++", 2), (1, 1, 60, 90, 60, 90, "++", 3), (1, 1, 100, 120, 55, 58, "++", 4), (2, 1, 1, 5, 1, 5, "++", 1)], cells)
    assert sorted((r.qid, r.hsp_no) for r in hsp.colinear(rows).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "cluster_id long, member_no long, id string, len long, is_rep boolean, identity double")
    for out in (C.representative(none), C.size_histogram(none), C.flat_table(none), C.sort_by_size(none), C.cut_top(none, 2), C.merge(none, none), C.expand(none, none), C.newick(none)):
        assert out.count() == 0
    assert evaluation.pair_quality(spark.createDataFrame([], "cluster_id long, term string")).first().sensitivity is None
    assert similarity.cluster(spark.createDataFrame([], "seq_idx long, seq string")).count() == 0


def test_stream_of_duplicates_and_clusters(spark, families, tmp_path):
    rows, truth = families
    source = str(tmp_path / "in")
    for k in range(2):
        rows.where(f"seq_idx % 2 = {k} and seq_idx < 24").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = incremental.exact_duplicates(stream).writeStream.format("memory").queryName("unique_rows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("unique_rows").count() == 24
    query = incremental.cluster_stream(stream, str(tmp_path / "out"), Options(identity=0.8))
    query.awaitTermination(240)
    members = spark.read.parquet(str(tmp_path / "out/members"))
    assert members.count() == 24
    assert all(truth[r.seq_idx] == truth[r.rep_idx] for r in members.collect())
    assert np.isclose(members.where("is_rep").count(), 6, atol=6)
    assert members.select(F.countDistinct("seq_idx")).first()[0] == 24


def test_last_round_over_several_subjects(spark):
    rows = [(1, 2, 1, 90.0), (1, 1, 1, 80.0), (1, 3, 1, 70.0), (1, 1, 2, 60.0), (2, 9, 1, 10.0), (2, 5, 1, 20.0)]
    wanted = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 5, 1), (2, 9, 1)]
    for order in (rows, rows[::-1]):  # rounds don't depend on the order of the table
        hits = spark.createDataFrame(order, "qid long, sid long, hsp_no long, score double").coalesce(1)
        assert sorted((r.qid, r.sid, r.hsp_no) for r in hsp.last_round(hits).collect()) == wanted


def test_percentages_are_rounded_as_printf_does(spark):
    shares = [(a, b) for b in range(1, 900, 7) for a in range(b // 2, b + 1, 3)] + [(425, 800), (505, 800), (0, 5), (1, 3)]
    rows = spark.createDataFrame([(a, b, 100.0 * a / b) for a, b in shares] + [(0, 0, x) for x in (1.005, 0.125, 99.995, 1e-9, -53.125, 2.675)], "a long, b long, x double")
    assert [r.t for r in rows.select("x", formats.two_places("x").alias("t")).collect()] == ["%.2f" % r.x for r in rows.collect()]
    first = spark.createDataFrame([(7, "i7", 400)], "seq_idx long, id string, len int")
    second = spark.createDataFrame([(1, "d1", 800)], "seq_idx long, id string, len int")
    hits = spark.createDataFrame([(1, 7, 425, 800)], "q long, r long, shared long, n long").select("q", "r", (100.0 * F.col("shared") / F.col("n")).alias("percent"))
    assert formats.cluster_text(formats.two_set_clusters(first, hits, second)).first()["value"].endswith("at 53.12%")


def test_common_words_of_queries_that_need_many_do_not_join(spark):
    """Sixty sequences share most of their words; the pairs that share enough come from the other ones."""
    rng = random.Random(5)
    common = protein(rng, 60)
    rows = [(i, common + protein(rng, 60)) for i in range(60)] + [(60, common + protein(rng, 60))]
    rows.append((61, rows[60][1]))
    posts = greedy.stored(K.postings(spark.createDataFrame(rows, "rank long, seq string"), 5))
    need = spark.createDataFrame([(i, 80) for i in range(62)], "q long, need int")
    seen = []
    plain, K.stored = K.stored, lambda df: seen.append(plain(df)) or seen[-1]
    kept, K.forget = K.forget, lambda *tables: None
    try:
        pairs = [(r.q, r.r, r.shared) for r in K.pairs_sharing(posts, posts, need, True).collect()]
    finally:
        K.stored, K.forget = plain, kept
    assert pairs == [(61, 60, 116)]
    assert max(t.count() for t in seen if "least" in t.columns and "shared" in t.columns) <= 5  # candidates, of 1,891 pairs with common words


def test_words_of_rows_with_one_key_count_together(spark):
    rows = spark.createDataFrame([(1, "ACACA"), (1, "CAC"), (2, "AC"), (3, "zZ@9yACA")], "rank long, seq string")
    found = sorted((r.rank, r.word, r.cnt) for r in K.postings(rows, 3).collect())
    assert found == sorted([(1, "ACA", 2), (1, "CAC", 2), *((3, "zZ@9yACA"[i : i + 3], 1) for i in range(6))])


def test_overlaps_meet_without_letters(spark):
    """Rows that are dealt to meet hold numbers: no letters travel with each place of a sequence."""
    rng = random.Random(8)
    whole = protein(rng, 60)
    rows = ranking.rank_by_length(spark.createDataFrame([(1, whole[:40]), (2, whole[25:]), (3, whole[10:30])], "seq_idx long, seq string"))
    pairs = reads.overlap_pairs(rows, 12, both_strands=False)
    assert sorted((r.q, r.r, r.overlap, r.q_off, r.r_off, r.side) for r in pairs.collect()) == [(1, 0, 15, 0, 25, 0)]

    def columns(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        mine = [node.output().apply(i).name() for i in range(node.output().size())] if node.nodeName() == "Generate" else []
        return mine + [c for kid in kids for c in columns(kid)]

    made = columns(pairs._jdf.queryExecution().optimizedPlan())
    assert made and not [c for c in made if "seq" in c]


def test_pairs_sharing_counts_in_cells_what_a_join_gives(spark, monkeypatch):
    """Sequences made of a few syllables: a join of words would make a row for each word that two of them have."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["AB", "CD", "ABC", "E", "AA", "XYZ"][: rng.randint(1, 6)]) for _ in range(rng.randint(2, 40)))) for i in range(120)]
    seqs = spark.createDataFrame(rows, "rank long, seq string")
    posts, need = greedy.stored(K.postings(seqs, 3)), seqs.select(F.col("rank").alias("q"), (F.col("rank") % 30 + 1).alias("need"))
    plain = lambda a, b: K.shared_words(a, b).join(need, "q").where("shared >= need")
    told = lambda df: sorted((x.q, x.r, x.shared, x.first_word) for x in df.collect())
    monkeypatch.setattr(K, "BLOCK", 800)  # several blocks on both sides
    joins = []
    shared = K._in_cells
    monkeypatch.setattr(K, "_in_cells", lambda *a: joins.append(a[-2:]) or shared(*a))
    assert told(K.pairs_sharing(posts, posts, need, True, dense=0)) == told(plain(posts, posts).where("r < q"))
    few, many = greedy.stored(posts.where("rank in (3, 4, 5)")), greedy.stored(posts.where("rank >= 40"))
    for a, b in ((few, many), (many, few)):
        assert told(K.pairs_sharing(a, b, need, False, dense=0)) == told(plain(a, b))
    assert len(joins) == 3 and all(min(x) >= 1 and max(x) > 1 for x in joins)


def test_dense_words_are_counted_without_a_join(spark, monkeypatch):
    """By itself: where every word is in most sequences, cells count."""
    rng = random.Random(4)
    seqs = spark.createDataFrame([(i, "".join(rng.choice("AB") for _ in range(60))) for i in range(400)], "rank long, seq string")
    posts = greedy.stored(K.postings(seqs, 3))
    used, shared = [], K._in_cells
    monkeypatch.setattr(K, "_in_cells", lambda *a: used.append(1) or shared(*a))
    need = seqs.select(F.col("rank").alias("q"), F.lit(50).alias("need"))
    assert K.pairs_sharing(posts, posts, need, True).count() == K.shared_words(posts, posts).where("r < q and shared >= 50").count() and used


def test_chimera_seeds_find_all_common_words(spark):
    """Every offset at which two reads have a word of thirty letters has a seed, and words are far more than seeds."""
    rng = random.Random(12)
    base = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(6)]
    reads = base + [a[: rng.randrange(30, 200)] + b[rng.randrange(100, 270) :] for a in base for b in base] + ["ACG" * 40, "AC" * 50, base[0][:30], base[0][5:35], "A" * 90]
    rows = spark.createDataFrame([(i, x, 50 - i, len(x), 3) for i, x in enumerate(reads)], "id long, seq string, abundance long, n int, primer int")
    at = {}
    for i, x in enumerate(reads):
        for j in range(3, len(x) - 29):
            at.setdefault(x[j : j + 30], []).append((i, j))
    want = {(q, p, pat - qat) for met in at.values() for q, qat in met if len(reads[q]) >= 63 for p, pat in met if p < q}
    found = {(r.q, r.p, x) for r in chimeras._pairs(rows, 30, 1.0).collect() for x in r.offsets}
    assert want <= found and len(want) > 100
    pandas = rows.toPandas().assign(asks=True)
    assert 3 * sum(len(x) for x in chimeras._seeds(30)([pandas[pandas["n"] >= 33]])) < sum(len(x) - 32 for x in reads if len(x) > 32)


def test_pair_lists_in_blocks(spark, monkeypatch):
    """Groups of many blocks, null groups and a null term: the pairs of a plain loop, with none of them dealt after they are made."""
    monkeypatch.setattr(evaluation, "PAIR_BLOCK", 7)
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 2, 3, None]), i, rng.choice(["a", "b", "b", None])) for i in range(150)]
    out = evaluation.pair_list(spark.createDataFrame(rows, "cluster_id long, id long, term string"))
    wanted = []
    for c, i, t in rows:
        for d, j, u in rows[i + 1 :]:
            if (c is not None and c == d) or (t is not None and t == u):
                wanted.append((i, j, "B" if c is None or c != d else "T" if t is not None and t == u else "C"))
    assert sorted(map(tuple, out.collect())) == sorted(wanted)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "Aggregate [a#" not in plan


def test_fasta_numbers_over_splits(spark, tmp_path):
    """Numbers are dense in file order over many small splits; what is written costs once for a row, not again for the sample that cuts ranges."""
    rng, seen = random.Random(4), spark.sparkContext.accumulator(0)
    rows = [(i, "".join(rng.choice("ACDE GH") for _ in range(rng.randrange(40))) + rng.choice(["", "*", "*\n", "-", "**"])) for i in range(700)]

    def text(i, s):
        seen.add(1)
        return s

    dealt = formats.in_order(spark.createDataFrame(rows, "i long, s string").repartition(5), "i")
    formats.write_fasta(dealt.select(F.col("i").cast("string").alias("descr"), F.udf(text, "string")("i", "s").alias("seq_raw")), str(tmp_path / "x"), order=None)
    assert seen.value == len(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        records = formats.read_fasta(spark, str(tmp_path / "x"))
        assert records.select("block").distinct().count() > 10
        good, bad = formats.sequences(records)
        found, rejected = sorted((r.seq_idx, r.id, r.seq) for r in good.collect()), {int(r.id) for r in bad.collect()}
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{name}", value)
    valid = [(str(i), s.replace(" ", "").rstrip("\n").removesuffix("*")) for i, s in rows if "-" not in s and "**" not in s]
    assert found == [(k, i, s) for k, (i, s) in enumerate(x for x in valid if len(x[1]) > 10)]
    assert rejected == {i for i, s in rows if "-" in s or "**" in s}


def test_postings_are_dealt_by_letters(spark, monkeypatch):
    """Many letters make more tasks than partitions that are set, with the same words; few don't."""
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(200)))) for i in range(120)], "rank long, seq string")
    few = K.postings(rows, 6)
    assert few.rdd.getNumPartitions() == 8
    monkeypatch.setattr(K, "DEALT", 300, raising=False)
    many = K.postings(rows, 6)
    assert many.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_member_lines_are_matched_once(spark, tmp_path):
    """Ids like the rest of a line, other line ends and lines that are no members; one expression matches a line, whatever columns are asked for."""
    text = ">Cluster 7 note\r\n0\t120aa, >a... at b... *\r\n1\t9nt, >x\ty... at 1:9:2:10/+/98.50%\r\nno member\n2 8aa, >.. ... at 80%\n\n>Cluster 8\n"
    (tmp_path / "x.clstr").write_bytes(text.encode())
    found = formats.read_clusters(spark, str(tmp_path / "x.clstr"))
    rows = sorted((r.cluster_id, r.member_no, r.len, r.unit, r.id, r.is_rep, r.identity, r.strand, r.q_beg, r.r_end, r.note) for r in found.collect())
    assert rows == [
        (7, 0, 120, "aa", "a", False, None, None, None, None, "note"),  # the first "... at " ends the id
        (7, 1, 9, "nt", "x\ty", False, 98.5, "+", 1, 10, "note"), (7, 2, 8, "aa", ".. ", False, 80.0, None, None, None, "note"),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count(formats._MEMBER[:20]) == 1


def test_blocks_of_sequences_count_what_a_join_gives(spark, monkeypatch):
    """Many small blocks, few meetings at once, words that a sequence has often, and bounded lengths."""
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ABC") for _ in range(rng.randint(3, 120))) for _ in range(120)] + ["A" * 90, "A" * 50, "A" * 30]
    seqs.sort(key=len, reverse=True)
    rows = spark.createDataFrame([(i, rng.randint(0, 25), x) for i, x in enumerate(seqs)], "rank long, need long, seq string")
    posts = K.postings(rows, 4)
    shared = K.shared_words(posts, posts).where("r < q").join(rows.selectExpr("rank AS q", "need"), "q").where("shared >= need")
    whole = {(x.q, x.r, x.shared, x.first_word) for x in shared.collect()}
    monkeypatch.setattr(K, "MEETING_BLOCK", 1500)
    monkeypatch.setattr(K, "_MET", 100)
    told = [tuple(x) for x in K.pairs_in_blocks(rows, 4).collect()]
    assert len(told) == len(whole) and set(told) == whole
    near = K.pairs_in_blocks(rows.withColumn("reach", F.length("seq") + 5), 4)
    assert {tuple(x) for x in near.collect()} == {x for x in whole if len(seqs[x[1]]) <= len(seqs[x[0]]) + 5}
    assert K.pairs_in_blocks(rows.where("rank < 0"), 4).count() == 0


def test_documents_meet_without_a_row_for_each_common_word(spark, monkeypatch):
    """The queries on pairs of documents list no postings and deal no pairs that share too little."""
    from kinstrand.plans import sequence_queries

    for name in ("pairs_sharing", "postings", "shared_words"):
        monkeypatch.setattr(sequence_queries.K, name, lambda *a, **b: pytest.fail("words are rows"))
    texts = [(i, protein(random.Random(i % 7), 80)) for i in range(14)]
    monkeypatch.setattr(sequence_queries, "ranked", lambda s, d: ranking.rank_by_length(spark.createDataFrame(texts, "seq_idx long, seq string")))
    assert {(x.q, x.r) for x in sequence_queries.QUERIES["candidates"](spark, "").collect()} == {(i + 7, i) for i in range(7)}
