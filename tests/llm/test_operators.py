"""Each operator against a plain version on awkward small tables, and what it says about itself."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinstrand.llm import ann, html_render, licenses, line_dedup, mixing, packing, quality, simhash, substring_dedup, toxicity
from kinstrand.llm.components import components
from kinstrand.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, n int, `first` string"


def texts():
    """(doc_id, text): nulls, empty and very long texts, copies, repeated rows, shared passages and lines, odd characters."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ñandú", "THE", "the"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(55), "  A Shared LINE of Text\t"
    rows = [(i, say(rng.randrange(1, 120))) for i in range(10, 40)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "one"), (44, say(9000)), (45, "x" * 50_000), (None, say(60)), (46, "a b c " * 40)]
    rows += [(50 + i, say(20) + " " + passage + " " + say(15)) for i in range(5)]
    rows += [(60 + i, say(30) + "\n" + line + "\n" + say(5) + "\n" + line.strip() + "\nshort\n") for i in range(4)]
    whole = say(200)
    rows += [(70 + i, whole) for i in range(6)] + [(76, whole.replace("w1 ", "w2 ", 1)), (77, whole.upper())]
    rows += [(80, say(40)), (81, say(10) * 3)]
    rows += [(80, rows[-2][1]), (80, passage + " twice the same id")]
    rows += [(90, "Licensed under the Apache License, Version 2.0.\ncc BY-nc cc by\nall  rights-reserved!"), (91, "a general public license cc. by cc")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 4}" if d != 43 else None, len(t or ""), 1, 2, "x") for d, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, wanted):
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(map(tuple, wanted), key=order)


def test_substring_dedup(docs, empty):
    found = substring_dedup.dedup_substrings(docs)
    rows = found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    same(rows, brute.substring_dedup(texts()))
    words = {d: brute.words(t) for d, t in texts() if d != 80}
    for r in found.where("doc_id <> 80 and size(factors) > 0").collect():
        for f in r.factors:  # a factor's words stand at its source
            if f.ref_doc_id in words and f.length >= 20:
                assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref_doc_id][f.ref_start : f.ref_start + f.length]
    for r in found.collect():  # the factors, and nothing else, decide what goes
        covered = {k for f in r.factors for k in range(f.start, f.start + f.length)}
        assert len(covered) == r.n_removed and all(f.length >= 20 for f in r.factors)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_greedy_factors():
    """Factors of a document against one made of copied passages, by hand."""
    runs = np.array([[0, 3, 7, 10], [3, 1, 7, 13], [4, 2, 9, 0], [40, 1, 9, 36]])
    factors = substring_dedup.parse(*runs.T)
    assert factors.tolist() == [[0, 23, 7, 10], [4, 21, 9, 0], [40, 20, 9, 36]]
    assert np.flatnonzero(substring_dedup.duplicate_words(factors, 70)).tolist() == [*range(25), *range(40, 60)]


def test_simhash(docs, empty):
    same(simhash.near_duplicates(docs).collect(), brute.simhash(texts()))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("distance", "segments"), [(4, 3), (4, 2), (4, 5), (6, 4), (3, 2)])
def test_all_links_are_found(spark, distance, segments):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 9), replace=False)) for b in base for _ in range(4)]
    fps = sorted({int(np.uint64(x).view(np.int64)) for x in [*base.tolist(), *near, 0, (1 << 64) - 1]})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in components(simhash.links(table, distance, segments)).collect()}
    array = np.array(fps).view(np.uint64)
    wanted = {x: x for x in fps}
    for _ in range(30):
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= distance):
                wanted[fps[i]] = wanted[fps[int(j)]] = min(wanted[fps[i]], wanted[fps[int(j)]])
    assert {x: got.get(x, x) for x in fps} == wanted


def test_dense_slots_span_their_components():
    rng = np.random.default_rng(1)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    found = simhash.slot_links(fps, fps, 4)
    assert len(found) == len(fps) - 1


@pytest.mark.parametrize("distance", [4, 3])
def test_hot_slots_are_dealt_by_pieces(spark, monkeypatch, distance):
    """Many fingerprints in few slots: the same components as those of all links."""
    monkeypatch.setattr(simhash, "DENSE", 6)
    monkeypatch.setattr(simhash, "SPREAD", 10)
    rng = np.random.default_rng(7)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 7), replace=False).astype(np.uint64)) for _ in range(300)])
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    assert sum(map(len, simhash.hot_slots(table, 3).values())) >= 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # slots go on over several batches
    try:
        got = {r.node: r.root for r in components(simhash.links(table, distance, 3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = list(range(len(fps)))
    for _ in range(40):
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
                root[i] = root[int(j)] = min(root[i], root[int(j)])
    groups = lambda of: {frozenset(k for k in of if of[k] == r) for r in set(of.values())}
    signed = fps.view(np.int64).tolist()
    assert groups({x: got.get(x, x) for x in signed}) == groups({x: signed[root[i]] for i, x in enumerate(signed)})


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == got[100] == 100 and got[300] == got[250] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    found = packing.pack_documents(docs, tokenizer_path())
    rows = found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids").collect()
    n, least = brute.check_packing([tuple(r)[:7] for r in rows], texts(), Tokenizer.from_file(tokenizer_path()))
    assert n <= least + 1
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    histogram = {s: rng.randrange(0, 30) for s in range(1, capacity) if rng.random() < 0.5}
    ranges, stats = packing.plan(histogram, capacity)
    ends = {}
    for size, low, _, _ in sorted(ranges, reverse=True):
        ends.setdefault(size, []).append(low)
    fill, upper = {}, dict(histogram)
    for size, low, first, offset in sorted(ranges, reverse=True):
        for k in range(low, upper[size]):
            fill.setdefault(first + k - low, []).append((offset, size))
        upper[size] = low
    assert all(v == 0 for v in upper.values() if v) and len(fill) == stats["sequences"]
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    total = sum(s * n for s, n in histogram.items())
    assert stats["sequences"] <= 11 / 9 * max(-(-total // capacity), 1) + 4


def _optimum(items, capacity):
    """The least number of bins, by search."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                k = bins.index(room)
                go(i + 1, [*bins[:k], room - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    items = sorted((rng.randrange(1, 20) for _ in range(9)), reverse=True)
    histogram = {s: items.count(s) for s in set(items)}
    ranges, stats = packing.plan(histogram, 20)
    if stats["fixed"] == len(items):
        assert stats["sequences"] == _optimum(items, 20)
    assert _optimum(items, 20) <= stats["sequences"] <= _optimum(items, 20) + 1


def _rest(histogram, ranges, fixed):
    """Counts of lengths that are left after the first ``fixed`` pieces of a plan's ranges in the order in which they were made."""
    left = dict(histogram)
    for (size, low, _, _), high in zip(ranges, [None] * len(ranges), strict=True):
        nxt = min((lo for s, lo, _, _ in ranges if s == size and lo > low), default=histogram[size])
        n = min(nxt - low, fixed)
        left[size] -= n
        fixed -= n
        if not fixed:
            break
    return left


@pytest.mark.parametrize("seed", range(60))
def test_fixed_sets_are_in_an_optimum(seed):
    """What the reduction fixes, and the best packing of what is left, is a best packing of all."""
    rng = random.Random(1000 + seed)
    capacity = 20
    items = sorted((rng.choice([1, 2, 3, 3, 4, 4, 5, 6, 7, 8, 10, 11, 13]) for _ in range(9)), reverse=True)
    histogram = {s: items.count(s) for s in set(items)}
    ranges, stats = packing.plan(histogram, capacity)
    left = _rest(histogram, ranges, stats["fixed"])
    sequences = len({first + k for size, low, first, _ in _until(ranges, stats["fixed"], histogram) for k in range(_)})
    assert sequences + _optimum([s for s, n in sorted(left.items(), reverse=True) for _ in range(n)], capacity) == _optimum(items, capacity)


def _until(ranges, fixed, histogram):
    """(length, low, first sequence, how many) of the ranges that the first ``fixed`` pieces take."""
    for size, low, first, _ in ranges:
        if not fixed:
            return
        n = min(min((lo for s, lo, _, _ in ranges if s == size and lo > low), default=histogram[size]) - low, fixed)
        fixed -= n
        yield size, low, first, n


@pytest.mark.parametrize(("histogram", "capacity", "least"), [({10: 1, 8: 1, 4: 3, 3: 3}, 20, 2), ({90: 1, 46: 2, 8: 1, 3: 3}, 100, 2)])
def test_triples_are_no_smaller_than_they_are(histogram, capacity, least):
    assert packing.plan(histogram, capacity)[1]["sequences"] == least


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    sizes = [2048] * 300 + [1024] * 200 + [600, 700, 748] * 50 + [30] * 5
    parts = spark.createDataFrame([(i % 290, 0, 0, n, i % 3, b"x") for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    rows = packing.place(parts).collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == 300 + 100 + 51


def test_chunks_tokenize_as_whole_texts():
    from tokenizers import Tokenizer

    whole, chunked = Tokenizer.from_file(tokenizer_path()), packing.Chunked(tokenizer_path())
    odd = ["a <|endoftext|>b <|startoftext|> c", "é ́x  y", "don't WON'T\tI'll\n\n", "ΟΔΟΣ Σ", "a b c　d\u0085e", "日本語 テキスト", "", "  ", "123 4x5", "\U0001f600\U0001f600 ok"]
    for text in [*odd, *(t or "" for _, t in texts())]:
        assert chunked.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_quality(docs, empty):
    book = quality.ledger(docs)
    base = quality.POLICIES["base", 1]
    rows = quality.apply_policy(book, base).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ~F.col("kept")).collect()
    same(rows, brute.quality(texts()))
    assert quality.ledger(empty).count() == 0
    policy = quality.POLICIES["prose", 2]
    failed = [r.failed & policy.mask for r in book.collect()]
    for r in quality.ablations(book, policy).collect():
        bit = 1 << quality.RULES.index(r.rule)
        assert (r.failed, r.failed_only_this, r.kept_without) == (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed), sum(not f & ~bit for f in failed))


def test_line_dedup(docs, empty):
    found = line_dedup.dedup_lines(docs)
    rows = found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    same(rows, brute.line_dedup(texts()))
    assert set(docs.columns) < set(found.columns)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
        assert r.size == len(brute.words(r.text)) and r.taken in (0, r.size, 2 * r.size)
    wanted = brute.mix_targets(size)
    assert len(rows) == len(texts())
    assert all(abs(r.target - wanted[r.source]) < 1e-6 * (1 + r.target) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix_sizes(empty).count() == 0
    names = ["once", "below", "place", "rank", "weight", "budget", "bucket"]
    more = docs.withColumns({n: F.lit(n) for n in [*names, "size", "target", "times", "a.b"]})
    clash = mixing.mix(more)
    assert sorted(clash.columns) == sorted([*docs.columns, *names, "a.b", *mixing.RESULT])
    assert all(r[n] == n for r in clash.collect() for n in [*names, "a.b"])
    assert sorted(map(str, clash.select(*mixing.mix(docs).columns).collect())) == sorted(map(str, rows))
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, (F.col("id") % 4).cast("string")).alias("source"))
    for r in mixing.mix_sizes(many).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) <= 50


def test_licenses(spark, docs, empty):
    rows = licenses.scan(docs).collect()
    same([tuple(r)[:6] for r in rows], brute.licenses(texts()))
    assert licenses.scan(empty).count() == 0
    rng = random.Random(8)
    notices = list(licenses.TEMPLATES)
    filler = ["the", "under", "and", "is", "work", "wor\u212a", "license", "x1", "É", "version", "2", "0"]
    cases = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            notice = rng.choice(notices).split()
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(notice) + 1)
                notice[k : k + rng.randrange(2)] = [rng.choice(filler)] * rng.randrange(3)
            parts += [rng.choice(filler) for _ in range(rng.randrange(12))] + notice
        cases.append((i, rng.choice(["", " ", "\n"]) + "".join(w.title() + rng.choice([" ", "\n", ", "]) for w in parts) + rng.choice(["", "end"])))
    got = licenses.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()
    same([tuple(r)[:6] for r in got], brute.licenses(cases))
    found = 0
    for r, text in [*((r, dict(cases)[r.doc_id]) for r in got), *((r, dict(texts())[r.doc_id]) for r in rows if r.doc_id != 80)]:
        wanted = brute.license_labels(text, licenses.TEMPLATES)
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(base | set(wanted)))
        assert r.score == (1.0 if base else max(wanted.values(), default=0.0))
        found += len(wanted)
    assert found > 100


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = [rng.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["idiot", "scum", "blorg"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x"), (5, rows[5][1])], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (1002, 1, None), (None, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, marks)
    got = toxicity.score_toxicity(table, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert toxicity.score_toxicity(docs, model).columns == [*docs.columns, "held_out", "score", "predicted"]
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, marks)).count() == 0


def test_toxicity_against_plain_versions():
    """Features by loops, every split of every tree against all possible ones, leaves and calibration by their formulas."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)] + ["idiot", "you", "kill", "your", "scum", "Don't", "u"]
    said = [" ".join(rng.choice(vocabulary) + rng.choice(["", "!", "?!", "."]) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    y = np.array([float("idiot" in s or "scum" in s) if rng.random() < 0.9 else float(rng.random() < 0.5) for s in said])
    lexicon = toxicity.Lexicon({"v3": 2.0, "v7": 1.6, "scum": 3.0})
    rows = [toxicity.features(s, lexicon) for s in said]
    for s, row in zip(said, rows, strict=True):
        for name, value in brute.toxic_features(s, toxicity.INSULTS, toxicity.THREATS, toxicity.SECOND_PERSON, lexicon.odds).items():
            assert row[toxicity.FEATURES.index(name)] == pytest.approx(value, abs=1e-9), name
    x = np.array(rows)[:, :9].round(2)  # fewer values than bins, so every split is open to the trees
    model = toxicity.Boosted.fit(x, y, rounds=6, bins=4000)
    margin = np.full(len(y), model.start)
    assert model.start == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = {0: (np.arange(len(y)), 0)}
        for node in range(len(tree.feature)):
            rows_, level = at[node]
            g, h = grad[rows_].sum(), hess[rows_].sum()
            assert tree.value[node] == pytest.approx(-g / (h + 1.0))
            best = brute.best_gain(x[rows_], grad[rows_], hess[rows_], 2.0, 1.0) if level < 3 else 0.0
            if tree.feature[node] < 0:
                assert level == 3 or best <= 2e-6
                continue
            right = x[rows_, tree.feature[node]] > tree.cut[node]
            gl, hl = grad[rows_[~right]].sum(), hess[rows_[~right]].sum()
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            assert gain == pytest.approx(best, rel=1e-6)
            at[tree.left[node]], at[tree.left[node] + 1] = (rows_[~right], level + 1), (rows_[right], level + 1)
        margin += model.rate * tree.predict(x)
    assert margin == pytest.approx(model.margin(x))
    scores = np.round(rng_normal(200), 3)
    knots, levels = toxicity.isotonic(scores, y)
    assert np.interp(np.sort(scores), knots, levels) == pytest.approx(sorted(brute.monotone_fit(scores.tolist(), y.tolist(), float(y.mean()))), abs=0.02)


def rng_normal(n):
    return np.random.default_rng(9).permutation(np.linspace(-3, 3, n))


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    knots, levels = toxicity.isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all() and 0 <= levels.min() and levels.max() <= 1


def _neighbours(table, **more):
    found = {}
    for r in ann.nearest(table, **more).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in found.items()}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 32))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.4 * rng.normal(size=32)], 0) for i in range(1200)]
    rows += [(2001 + i, rows[0][1], 0) for i in range(30)] + [(3000, None, 0), (3100, [0.0] * 32, 0), (3200, [float("nan")] * 32, 0), (3300, [1.0, None], 0), (3400, [float("inf")] * 32, 0), (None, rows[1][1], 0)]
    rows += [(7, rows[0][1], 0), (7, rows[0][1], 0), (11, rows[3][1], 0)]  # ids of several rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    found = _neighbours(table, block_rows=400)
    wanted = brute.nearest(rows_of(rows))
    assert set(found) == set(wanted)
    hits = total = 0
    for q, best in wanted.items():
        got = found[q]
        assert [x[0] for x in got] == list(range(1, len(got) + 1)) and [x[2] for x in got] == sorted(x[2] for x in got)
        distances = [x[2] for x in got]
        hits += sum(any(abs(d - x) < 1e-12 for x in distances) for _, d in best)
        total += len(best)
    assert hits / total >= 0.9
    assert [x[1] for x in found[0]] == [7, 7, *range(2001, 2009)]
    assert ann.nearest(table.limit(0)).count() == 0


def test_a_query_row_finds_others_of_its_id(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0]), (5, [2.0, 1.0, 0.0])]
    got = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == sorted([(1, 100, 0.0), (2, 3, 1.0), (3, 100, 2**0.5)] * 2 + [(1, 3, 1.0), (2, 100, 2**0.5), (3, 100, 2**0.5)])


@pytest.mark.parametrize("size", [1e-170, 1e-300, 1e160, 1e300])
def test_distances_beyond_squares(spark, size):
    rng = np.random.default_rng(4)
    plain = rng.integers(-9, 10, size=(60, 8)) + 0.5
    small = _neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(plain)], "vec_id long, embedding array<double>"), every=20)
    large = _neighbours(spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(plain)], "vec_id long, embedding array<double>"), every=20)
    for q, best in small.items():
        assert len(large[q]) == 10
        assert all(abs(y[2] / size - x[2]) < 1e-9 * x[2] for x, y in zip(best, large[q], strict=True))


def rows_of(rows):
    return [(i, v) for i, v, _ in rows if i is not None and (v is None or len(v) == 32)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two  three\n four</p>", "one\n\ntwo three four"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>after", "- x\n- y\n  - z\n\nafter"),
        ("<ol start=3><li>x<li value=9>y</ol>", "3. x\n9. y"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<table><tr><th colspan=2>head<tr><td>x<td>y</table>z", "head\nx  y\n\nz"),
        ("<head><title>no</title><style>p{}</style></head><body>yes<script>var a='</p>';</script></body>", "yes"),
        ("a<span hidden>b</span><span style='color:red;display: none'>c</span><i aria-hidden=true>d</i>", "ad"),
        ("x<!-- y > z -->w", "xw"),
        ("<pre>  a\n   b</pre>", "  a\n   b"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("1 < 2 <b>bold</b> <unknown>t</unknown> </nope>", "1 < 2 bold t"),
        ("<a href='x>y' title=\"q\">link</a> <img alt=no>", "link"),
        ("<p>open <a href='never", "open"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        (f"<table><tr><td>{'w' * 70}<td>b<tr><td>c<td>d</table>", f"{'w' * 70}  b\nc{' ' * 71}d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>cc<tr><td>d<td>e</table>", "a  b\n   cc\nd  e"),
        ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td colspan=3>f</table>", "a  b  c\nd     e\nf"),
        (f"<table><tr><td colspan=900>a<td>b<tr>{'<td>' * 900}<td>c</table>", "a  b\n   c"),
        ("x <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>TeX</annotation></math> y", "x a+b y"),
        ("x<svg><title>t</title><text>one</text><path d=z>no</path><g><text>two</text></g></svg>y", "x one two y"),
        ("<xmp> <b>a</b>\n  &amp; c</xmp>z", " <b>a</b>\n  &amp; c\n\nz"),
    ],
)
def test_render(page, text):
    assert html_render.render(page) == text


def test_render_is_linear_and_deep():
    assert html_render.render("<div>" * 50_000 + "x") == "x"
    assert html_render.render("<table><tr><td>" * 3000 + "x").strip() == "x"
    assert html_render.render("<a '" * 20_000 + "<p>x") is not None
    assert html_render.render("</p>" * 2000 + "x") == "x"
    rows = "<tr><td>a<td>b" * 20_000
    wide = html_render.render(f"<table><tr><td>{'w' * 200_000}<td>x{rows}</table>")
    assert wide.split("\n")[1] == "a  b" and len(wide) < 400_000


def test_render_round_trip():
    """Trees written as markup come back as their text."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "&", "<x>"]

    def make(depth):
        import html as h

        kind = rng.choice(["p", "ul", "h2", "div"] if depth else ["p", "h2"])
        text = " ".join(rng.choice(words) for _ in range(4))
        if kind in ("p", "h2"):
            return f"<{kind}>{h.escape(text)}</{kind}>", [text]
        if kind == "ul":
            items = [" ".join(rng.choice(words) for _ in range(2)) for _ in range(3)]
            return "<ul>" + "".join(f"<li>{h.escape(x)}</li>" for x in items) + "</ul>", ["\n".join(f"- {x}" for x in items)]
        inner = [make(depth - 1) for _ in range(2)]
        return "<div>" + "\n ".join(x for x, _ in inner) + "</div>", [y for _, x in inner for y in x]

    for _ in range(100):
        parts = [make(3) for _ in range(3)]
        assert html_render.render("".join(x for x, _ in parts)) == "\n\n".join(y for _, x in parts for y in x)


def test_pages_against_a_plain_version(spark):
    """All visible letters of the provided pages, in order, by another parser."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    found = {r.page_id: r.text for r in html_render.extract(pages).collect()}
    assert found
    import re

    for r in pages.collect():
        shown = re.sub(r"(?m)^\s*\d+\. ", "", found[r.page_id])  # numbers of lists are no text of the page
        assert re.sub(r"[\W_]+", "", shown) == brute.visible_letters(r.html), r.page_id


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (None, "v", ""), (1, "u", "<p>a")], "page_id long, url string, html string")
    assert sorted(map(tuple, html_render.extract(pages).collect()), key=str) == sorted([(1, "u", "a"), (2, None, None), (None, "v", ""), (1, "u", "a")], key=str)
    assert html_render.extract(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "'mine' AS text", "7 AS `a b`", "page_id AS tag")
    assert sorted(map(tuple, html_render.extract(clash).select("page_id", "url", "text", "`a b`", "tag").collect()), key=str)[0][3:] == (7, 1)
    assert html_render.extract(clash).columns == ["page_id", "url", "a b", "tag", "text"]
