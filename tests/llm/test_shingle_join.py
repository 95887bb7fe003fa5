"""Near duplicates of the pipeline: all pairs at a five-word Jaccard of 0.8 or more, and none below."""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from kinstrand.llm import shingle_join, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, t=Fraction(4, 5)):
    """doc_id -> smallest doc_id of its component, by all pairs."""
    sets = {}
    for d, text in rows:
        w = (text or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d, _ in rows}
    for a in sets:
        for b in sets:
            same, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and (same * t.denominator >= t.numerator * both):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return root


def texts():
    rng, rows = random.Random(4), []
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((8, 40, 200, 500)))]
        rows.append(" ".join(base))
        for edits in (1, 2, 4, 8, 12):
            copy = list(base)
            for _ in range(max(1, edits * len(base) // 400)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
        rows.append(" ".join(base[: len(base) * 4 // 5 + rng.randrange(3)]))
    rows += ["", None, " \n", "One two", "one TWO", "one three"]
    exact = [f"x{i}" for i in range(44)]  # 40 shingles; 36 words have 32, which is 0.8 exactly
    rows += [" ".join(exact), " ".join(exact[:36])]
    order = list(enumerate(rows))
    rng.shuffle(order)
    return [(i, r) for i, (_, r) in enumerate(order)]


def test_all_pairs_and_no_others(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs).collect()}
    assert got == plain(rows)
    assert shingle_join.near_duplicates(docs.where("false")).count() == 0


def test_pipeline_stage_keeps_one_of_each_group(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(plain(rows).values()))


def test_candidates_span_and_exact_links_connect():
    """Links of a dense group are as many as its sets; exact links connect what all pairs between labels do, and near misses give none."""
    rng = np.random.default_rng(2)
    base = np.arange(100, dtype=np.uint64)
    t = Fraction(4, 5)
    sets = [np.unique(np.r_[rng.permutation(base)[:95], rng.integers(1000, 1 << 60, 3).astype(np.uint64)]) for _ in range(300)]
    sets += [np.unique(np.r_[base[:30], rng.integers(1000, 1 << 60, 70).astype(np.uint64)]) for _ in range(20)]
    size = np.array([len(s) for s in sets])
    maps = [shingle_join.bitmap(s) for s in sets]
    spans = shingle_join.candidate_links(size, maps, t)
    assert len(spans) == 299
    label = np.r_[np.zeros(150, int), np.ones(150, int), np.arange(2, 22)]
    alike = {(i, j) for i in range(320) for j in range(i + 1, 320) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (size[i] + size[j])}
    for label in (label, np.arange(320), np.zeros(320, int)):
        found = shingle_join.exact_links(sets, label, t)
        assert all(tuple(sorted(p)) in alike and label[p[0]] != label[p[1]] for p in found)

        def roots(pairs):
            root = label.copy()
            for a, b in pairs:
                root[root == root[b]] = root[a]
            return [int(np.flatnonzero(root == r)[0]) for r in root]

        assert roots(found) == roots(alike) and len(found) == len(set(label.tolist())) - len(set(roots(alike)))
    missed = [np.r_[base[:88], base[:12] + np.uint64(1000 * k)] for k in range(2, 50)]  # 88 of 112 in common
    assert shingle_join.exact_links([np.sort(s) for s in missed], np.arange(48), t) == []


def test_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(5)
    t = Fraction(4, 5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 40, 60, 66, 500)]
    sets += [np.unique(np.r_[s[: max(1, len(s) * k // 10)], rng.integers(0, 1 << 63, len(s) // 12).astype(np.uint64)]) for s in sets[:5] for k in (5, 9, 10)]
    size = np.array([len(s) for s in sets])
    bitmaps = shingle_join._Bitmaps([shingle_join.bitmap(s) for s in sets], size)
    for i in range(len(sets)):
        may = bitmaps.may(i, np.arange(len(sets)), t)
        for j in range(len(sets)):
            same = len(np.intersect1d(sets[i], sets[j]))
            if same * 5 >= 4 * (size[i] + size[j] - same):
                assert may[j]
        assert may.sum() < len(sets) / 2


def test_passages_of_many_texts_bring_none_together(spark, monkeypatch):
    """A passage that different texts share must not make each of them a candidate of all others; the near copies among them still meet."""
    seen, cut = {}, shingle_join.cut
    monkeypatch.setattr(shingle_join, "cut", lambda df, label: seen.setdefault(label, cut(df, label)))
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(300)]
    rows.append((300, rows[7][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs).collect()}
    assert got == {i: 7 if i == 300 else i for i in range(301)}
    assert seen["groups"].groupBy("g").count().agg({"count": "max"}).first()[0] == 2


def test_rare_hashes_first_whatever_is_known():
    hashes = np.array([2, 5, 7, 9], np.uint64)
    assert shingle_join.rare_first(hashes, np.empty(0, np.uint64), np.empty(0, int)).tolist() == [2, 5, 7, 9]
    assert shingle_join.rare_first(hashes, np.array([1, 2, 7, 20], np.uint64), np.array([-3, 0, -1, -2])).tolist() == [5, 9, 7, 2]


def test_fingerprints_link_first_and_the_exact_join_does_the_rest(spark, monkeypatch):
    """Links of the first pass are alike sets within five bits of a SimHash; what they connect is not looked at again; farther pairs are found all the same."""
    seen, edges, cut, components = {}, [], shingle_join.cut, shingle_join.components
    monkeypatch.setattr(shingle_join, "cut", lambda df, label: seen.setdefault(label, cut(df, label)))
    monkeypatch.setattr(shingle_join, "components", lambda df: edges.append({tuple(r) for r in df.collect()}) or components(df))
    rows = texts()
    sets = {d: shingle_join.shingle_set(t, 5) for d, t in rows}
    sims = {int(shingle_join.set_hash(sets[d]).view(np.int64)): simhash.majority(simhash.shingle_hashes(t, 5)) for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs).collect()}
    assert got == plain(rows)
    first, last = ([(sims[u] ^ sims[v]).bit_count() for u, v in pairs] for pairs in (edges[0], edges[1] - {tuple(r) for r in seen["known"].collect()}))
    assert first and max(first) <= 5 and max(last) > 5

    seen.clear()
    base = " ".join(f"w{i}" for i in range(2000))
    near = spark.createDataFrame([(1, base), (2, base + " end"), (3, "other " + base)], "doc_id long, text string")
    assert {r.component_id for r in shingle_join.near_duplicates(near).collect()} == {1}
    assert seen["groups"].count() > 0 and seen["open"].count() == 0
