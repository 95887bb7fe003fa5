"""Local alignments with statistics, the hit finder, and hierarchies down to thirty per cent."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kinstrand.functions import local
from kinstrand.functions.alignment import Scoring
from kinstrand.operators import hsp
from kinstrand.plans import pipelines

LETTERS = "ARNDCQEGHILKMFPSTWYV"
SCORING = Scoring.amino()


def plain(q, s, diagonal, reach):
    """The best local score within a band, cell by cell; a gap of n letters costs 11 + n."""
    low, best = -(10**9), 0
    h, e, f = {}, {}, {}
    for i in range(len(q) + 1):
        for j in range(max(0, i + diagonal - reach), min(len(s), i + diagonal + reach) + 1):
            if not i or not j:
                h[i, j], e[i, j], f[i, j] = 0, low, low
                continue
            e[i, j] = max(h.get((i, j - 1), low) - 12, e.get((i, j - 1), low) - 1)
            f[i, j] = max(h.get((i - 1, j), low) - 12, f.get((i - 1, j), low) - 1)
            h[i, j] = max(0, h.get((i - 1, j - 1), 0) + int(SCORING.matrix[q[i - 1], s[j - 1]]), e[i, j], f[i, j])
            best = max(best, h[i, j])
    return best


def changed(rng, seq, share):
    return "".join(rng.choice(LETTERS) if rng.random() < share else c for c in seq)


def test_local_alignments():
    rng = random.Random(2)
    pairs, texts = [], []
    for _ in range(250):
        core = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 60)))
        other = list(changed(rng, core, 0.35))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(other))
            other[k:k] = [rng.choice(LETTERS)] * rng.randrange(4)
        a, b = rng.randrange(20), rng.randrange(20)
        q, s = "".join(rng.choice(LETTERS) for _ in range(a)) + core, "".join(rng.choice(LETTERS) for _ in range(b)) + "".join(other) + "AAWC"
        pairs.append((SCORING.encode(q), SCORING.encode(s), b - a + rng.randrange(-3, 4)))
        texts.append((q, s))
    gapped = 0
    for (q, s, d), x in zip(pairs, local.align(pairs, SCORING, 12), strict=True):
        assert x.score == plain(q, s, d, 12)
        if x.score:
            assert (x.q_end - x.q_from + 1) + (x.s_end - x.s_from + 1) + x.gaps == 2 * x.length
            # what lies between the ends has this score, as a whole
            assert plain(q[x.q_from - 1 : x.q_end], s[x.s_from - 1 : x.s_end], d + x.q_from - x.s_from, 12) == x.score
            gapped += x.gaps > 0
    assert gapped > 20
    assert local.evalue(100, 300, 10**6) == pytest.approx(0.041 * 300 * 1e6 * math.exp(-26.7))


@pytest.fixture(scope="module")
def superfamilies(spark):
    """Three bases, each with two distant relatives at some 45 %, of these two at 75 % each, of these two at 95 %; and two strangers."""
    rng, rows = random.Random(11), []
    for family in range(3):
        base = "".join(rng.choice(LETTERS) for _ in range(300))
        for far in (base, changed(rng, base, 0.55)):
            for mid in (far, changed(rng, far, 0.25)):
                for near in (mid, changed(rng, mid, 0.04)):
                    rows.append((family, near))
    rows += [(9, "".join(rng.choice(LETTERS) for _ in range(280))), (8, "".join(rng.choice(LETTERS) for _ in range(120)))]
    return rows, spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "seq_idx long, seq string")


def test_search(superfamilies):
    rows, table = superfamilies
    found = table.withColumnRenamed("seq_idx", "id")
    hits = hsp.search(found, found, evalue=1e-6, within=True).collect()
    pairs = {(r.qid, r.sid) for r in hits}
    # two relatives that both moved away from what they share are at some 25 %: seeds of four letters may miss them
    distant = lambda q, s: (q % 8 // 2, s % 8 // 2) == (3, 1)
    wanted = {(q, s) for q in range(24) for s in range(q) if rows[q][0] == rows[s][0]}
    assert {x for x in wanted if not distant(*x)} <= pairs <= wanted
    letters = sum(len(s) for _, s in rows)
    for r in hits:
        assert r.evalue == pytest.approx(local.evalue(r.score, r.q_len, letters)) and r.mismatches + r.gaps <= r.aln_len
    banded = {(r.qid, r.sid) for r in hsp.search(found, found, evalue=1e-6, within=True, cover_long=0.9).collect()}
    assert banded == {(q, s) for q, s in pairs if min(len(rows[q][1]), len(rows[s][1])) >= 0.9 * max(len(rows[q][1]), len(rows[s][1]))}


def test_down_to_thirty_per_cent(spark, superfamilies):
    rows, table = superfamilies
    names = table.selectExpr("seq_idx", "'s' || seq_idx AS id")
    sizes = lambda out: sorted(r["count"] for r in out.groupBy("cluster_id").count().collect())
    assert sizes(pipelines.down_to(table, names, 0.9, 0.6)) == [1, 1, 4, 4, 4, 4, 4, 4]
    out = pipelines.down_to(table, names, 0.9, 0.6, hits=0.3)
    assert sizes(out) == [1, 1, 8, 8, 8]
    families = {}
    for r in out.collect():
        families.setdefault(r.cluster_id, set()).add(rows[int(r.id[1:])][0])
    assert all(len(f) == 1 for f in families.values())


def test_bands_are_aligned_by_many_tasks(spark, superfamilies, monkeypatch):
    """Tasks follow the number of bands, not their bytes; hits are the same, with words as numbers or as text."""
    _, table = superfamilies
    found = table.withColumnRenamed("seq_idx", "id")
    hits = lambda: sorted(map(tuple, hsp.search(found, found, evalue=1e-6, within=True).drop("hsp_no", "evalue").collect()))
    few, tasks, many = hits(), [], hsp._extended
    monkeypatch.setattr(hsp, "ALIGNED", 4, raising=False)

    def counted(reach):
        seen = spark.sparkContext.accumulator(0)
        tasks.append(seen)
        run = many(reach)

        def each(batches):
            seen.add(1)
            yield from run(batches)

        return each

    monkeypatch.setattr(hsp, "_extended", counted)
    assert hits() == few and tasks[0].value > 15
    word = lambda i: F.substr("seq", i, F.lit(4))
    plain = found.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seq") - 3), word)).alias("at", "word"))
    spelled = lambda n: "".join(chr(n >> 8 * (3 - i) & 255) for i in range(4))
    assert sorted((r.id, r.at, spelled(r.word)) for r in hsp.K.places(found, 4, "at").collect()) == sorted(map(tuple, plain.collect()))
