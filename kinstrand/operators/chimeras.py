"""Chimeras: reads that two more abundant ones explain much better than any single one does.

Reads stand in an order, by abundance and then by id, and an earlier read can be a parent of a later one. Three
outcomes depend on those before: a chimera and a read close to a single parent are no parents themselves. What two
reads have to do with each other doesn't, so all of that is found first: pairs, then triples with the mismatch
counts that accept them. Only reads with a close parent or such a triple are open; rounds decide at once all
whose possible parents are decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.functions.storage import forget, stored
from kinstrand.operators.duplicates import common_primer

_ROLES = "q long, p long, few int, some int, mm int, head int, start int, left array<int>, right array<int>"


def _seeds(shared: int):
    """(id, abundance, asks, w, at): of each word of ``shared`` letters behind the primer the seed, two thirds as long, that has the least hash; a seed is a row once.

    Equal words have the same seed at the same place, so reads with a common word have a common seed on its diagonal; some one in six places is a seed.
    """
    k = shared * 2 // 3

    def of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(letters) - k + 1
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x100000001B3) + letters[i : i + n]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        windows = np.lib.stride_tricks.sliding_window_view(h, shared - k + 1)
        at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
        return h[at].view(np.int64), at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [of(np.frombuffer(x.encode(), np.uint8)[primer:].astype(np.uint64)) for x, primer in zip(frame["seq"], frame["primer"], strict=True)]
            rows = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
            w, at = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
            yield pd.DataFrame({"id": frame["id"].to_numpy()[rows], "abundance": frame["abundance"].to_numpy()[rows], "asks": frame["asks"].to_numpy()[rows], "w": w, "at": at.astype(np.int32)})

    return run


def _pairs(reads: DataFrame, shared: int, fold: float) -> DataFrame:
    """(q, p, offsets): earlier reads that may have a word of q, with every offset at which they may; seeds meet, so letters decide."""
    spread = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks = (F.col("n") >= 2 * shared + F.col("primer")).alias("asks")
    rows = reads.where(F.col("n") >= F.col("primer") + shared).repartition(spread, "id").select("id", "abundance", asks, "primer", "seq")
    seeds = stored(rows.mapInPandas(_seeds(shared), "id long, abundance long, asks boolean, w long, at int"))
    mine = seeds.where("asks").select(F.col("id").alias("q"), F.col("abundance").alias("qa"), "w", F.col("at").alias("qat"))
    met = mine.join(seeds.select(F.col("id").alias("p"), F.col("abundance").alias("pa"), "w", F.col("at").alias("pat")), "w")
    met = met.where(((F.col("pa") > F.col("qa")) | ((F.col("pa") == F.col("qa")) & (F.col("p") < F.col("q")))) & (F.col("pa") >= fold * F.col("qa")))
    return met.groupBy("q", "p").agg(F.collect_set(F.col("pat") - F.col("qat")).alias("offsets"))


def _unlike(q: np.ndarray, p: np.ndarray, offset: int) -> np.ndarray:
    """For each letter of q whether p has another one, or none, at that offset."""
    out = np.ones(len(q), bool)
    a, b = max(0, -offset), min(len(q), len(p) - offset)
    if a < b:
        out[a:b] = q[a:b] != p[a + offset : b + offset]
    return out


def _roles(shared: int, percent: float):
    """What a pair can be: the head's length if p explains that much, where a tail begins that p explains, mm if p alone is close, and the mismatches that decide."""

    def common(a: np.ndarray, b: np.ndarray, primer: int, offset: int) -> int:
        """How many words behind the primer both have at that offset."""
        alike = np.cumsum(np.concatenate(([0], ~_unlike(a, b, offset)[max(primer, primer - offset) :])))
        return int(np.count_nonzero(alike[shared:] - alike[:-shared] == shared))

    def of(q: str, p: str, primer: int, found: list[int]) -> tuple | None:
        a, b = np.frombuffer(q.encode(), np.uint8), np.frombuffer(p.encode(), np.uint8)
        n = len(a)
        counts = [(-c, abs(x), x) for x in map(int, found) if (c := common(a, b, primer, x))]
        if not counts:
            return None
        offsets = [x for _, _, x in sorted(counts)[:2]]  # what most words agree on, smaller shifts first among equals
        few, some = int(0.01 * n * percent), int(0.015 * n * percent)
        plain = _unlike(a, b, 0)
        at = np.flatnonzero(plain)
        reach = int(at[few]) if len(at) > few else n
        tail, start, shift = 0, None, plain
        for offset in offsets:
            moved = _unlike(a, b, offset)
            end = min(n, len(b) - offset)
            wrong = np.flatnonzero(moved[:end])
            begin = int(wrong[-few - 1]) + 1 if len(wrong) > few else 0
            if end - begin >= shared:
                tail, start, shift = end - begin, begin, moved
                break
        cut = (reach + n - tail) // 2
        mm = int(plain[:cut].sum() + shift[cut:].sum()) if reach + tail >= n else len(at)
        head = reach if reach >= primer + shared else None
        if head is None and start is None and mm > some:
            return None
        return few, some, mm if mm <= some else None, head, start, at[: 2 * few + some + 1].tolist(), np.flatnonzero(shift)[-some - 1 :].tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(x.q, x.p, *found) for x in frame.itertuples() if (found := of(x.qs, x.ps, x.primer, x.offsets))]
            out = pd.DataFrame(rows, columns=["q", "p", "few", "some", "mm", "head", "start", "left", "right"])
            yield out.astype({c: "Int32" for c in ("mm", "head", "start")})

    return run


def _triples(roles: DataFrame) -> DataFrame:
    """(q, a, b, start, cut, lo, hi): a head and a tail that together explain q, if the closest single read has lo to hi mismatches."""
    heads = roles.where("head IS NOT NULL").select("q", F.col("p").alias("a"), "few", "some", "head", F.col("left").alias("la"))
    tails = roles.where("start IS NOT NULL").select("q", F.col("p").alias("b"), "start", F.col("left").alias("lb"), F.col("right").alias("rb"))
    both = heads.join(tails, "q").where("a <> b AND start <= head").withColumn("cut", F.floor((F.col("head") + F.col("start")) / 2).cast("int"))
    count = lambda c, before: F.size(F.filter(c, lambda x: x < F.col("cut") if before else x >= F.col("cut")))
    both = both.withColumn("lo", count("la", True) + count("rb", False)).withColumn("hi", F.least(count("lb", True), count("la", False)) - F.col("few") - 1)
    return both.where((F.col("lo") <= F.col("hi")) & (F.col("lo") <= F.col("some"))).select("q", "a", "b", "few", "some", "start", "cut", "lo", "hi")


def chimeras(reads: DataFrame, shared: int = 30, least: int = 1, fold: float = 1.0, percent: float = 1.0) -> DataFrame:
    """Chimeras among distinct reads (id, seq, abundance): id, parent_head, parent_tail, crossover.

    Reads rarer than ``least`` take no part. A parent stands earlier, is at least ``fold`` times as abundant and has a word of
    ``shared`` letters (20 at least) of the read, at any place. It explains a head at its own beginning, a tail at one of the two
    offsets that most common words have, ``shared`` letters or more and 1 % mismatches times ``percent``; letters beyond its ends are
    mismatches. The crossover lies midway in what both explain. A pair is accepted if together it has no more mismatches
    than the closest single read (1.5 % if none is as close), and each in the other's part more than that plus 1 %. A read
    with a single one within 1 % is neither a chimera nor a parent. Of several pairs the one with the most abundant head counts, then the one whose tail begins
    first, then the smaller ids. Letters that all reads begin with, 15 or more, are left out of the words. Reads shorter than two such parts are parents only.
    """
    shared = max(shared, 20)
    rows = reads.where((F.col("abundance") >= least) & F.col("seq").isNotNull()).select("id", "seq", "abundance")
    rows = stored(rows.withColumn("n", F.length("seq")).crossJoin(F.broadcast(common_primer(rows).select(F.col("primer_length").cast("int").alias("primer")))))
    letters = lambda x: rows.select(F.col("id").alias(x), F.col("seq").alias(f"{x}s"))
    pairs = _pairs(rows, shared, fold).join(letters("p"), "p").join(rows.select(F.col("id").alias("q"), F.col("seq").alias("qs"), "primer"), "q")
    roles = stored(pairs.select("q", "p", "primer", "offsets", "qs", "ps").mapInPandas(_roles(shared, percent), _ROLES))
    ranks = rows.select(F.col("id").alias("a"), (-F.col("abundance")).alias("rank"))
    triples = stored(_triples(roles).join(ranks, "a"))
    close = stored(roles.where("mm IS NOT NULL").select("q", "p", "few", "mm"))
    open_ = stored(close.select("q").union(triples.select("q")).distinct())
    found = [triples.sparkSession.createDataFrame([], "id long, parent_head long, parent_tail long, crossover int")]
    while not open_.isEmpty():
        waits = lambda df, c: df.join(open_.select(F.col("q").alias(c)), c, "left_semi").select("q")  # noqa: B023, E731
        ready = stored(open_.join(waits(close, "p").union(waits(triples, "a")).union(waits(triples, "b")), "q", "left_anti"))
        single = stored(close.join(ready, "q", "left_semi").groupBy("q").agg(F.min("mm").alias("mm"), F.first("few").alias("few")))
        mine = triples.join(ready, "q", "left_semi").join(single.select("q", "mm"), "q", "left").withColumn("m", F.coalesce("mm", "some"))
        mine = mine.where("(mm IS NULL OR mm > few) AND m BETWEEN lo AND hi")
        first = F.min(F.struct("rank", "a", "start", "b", "cut")).alias("x")
        crossed = stored(mine.groupBy(F.col("q").alias("id")).agg(first).select("id", F.col("x.a").alias("parent_head"), F.col("x.b").alias("parent_tail"), F.col("x.cut").alias("crossover")))
        found.append(crossed)
        dead = stored(single.where("mm <= few").select("q").union(crossed.select("id")))
        gone = lambda c: dead.select(F.col("q").alias(c))  # noqa: B023, E731
        still = stored(open_.join(ready, "q", "left_anti"))
        nearer = stored(close.join(still, "q", "left_semi").join(gone("p"), "p", "left_anti"))
        fewer = stored(triples.join(still, "q", "left_semi").join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti"))
        forget(open_, close, triples, ready, single, dead)
        open_, close, triples = still, nearer, fewer
    forget(open_, close, triples, roles, rows)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
