"""Near duplicates by SimHash, checked and completed by the exact Jaccard similarity of word shingles.

A text is the set of the XXH64 hashes of its word shingles, and has the fingerprint that :mod:`kinstrand.llm.simhash` takes from
them, repeats included. Three passes look for pairs of Jaccard t or more:

1. Fingerprints that differ in ``distance`` bits or fewer link by that module's multi-index hashing, and different sets of one fingerprint link
   to one of them. Links are verified by a join with whole sets. What they connect is known.
2. Fingerprints of alike sets can lie farther apart, so a set-similarity join with prefix filtering looks for what they leave open. Two sets
   of Jaccard t or more share at least ceil(t * n) hashes, n being the size of either, so under any common order
   their first n - ceil(t * n) + 1 hashes meet. Rare hashes come first: those that a sample of the texts does not know as frequent, by value,
   then the frequent ones, by their number of texts in the sample. All sets have the one order, so the sample decides how many sets meet and never which
   links are found. Prefixes are dealt by hash, and sets that meet at a hash, with sizes that allow t, are a group. Groups of the same sets are one,
   and a group that pass 1 connected is done. In the others small bitmaps bound what two sets can share: a bit that only one of them has stands for a hash
   that the other lacks. Pairs whose bound is below t are none; the others part the group.
3. Parts that are not connected by pass 1 bring their whole sets together and count exactly; only
   links that connect something leave the task, near misses don't.

Every pair at t or more is connected by the first pass, or both are in a part of the third, so the components are those of all such
pairs: nothing is estimated, and no pair is left out. A task of the second pass holds the bitmaps of a group, four to eight bits for each hash; one of
the third some forty bytes for each hash of a part.

Equal sets are one entry, so groups of copies cost one row.

A text without words (null, empty) is the empty set, equal to every other such text and to nothing else. A null
doc_id orders before all others and shows as null. Repeated rows and ids keep a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import NULL_ID, cut, id_key
from kinstrand.llm.components import components
from kinstrand.llm.simhash import _Forest, links, majority, shingle_hashes
from kinstrand.llm.wordhash import mix


#: So many texts, or about, tell which hashes are frequent, and so many hashes are taken for that at most. Both are bounds on what the order costs.
SAMPLE, FREQUENT = 1 << 14, 1 << 16


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, ascending."""
    return np.unique(shingle_hashes(text, size))


def set_hash(hashes: np.ndarray) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())) if len(hashes) else np.uint64(0)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash, by its lowest bits, in a power of two of them: four to eight for each hash."""
    n = max(64, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    bits = np.zeros(n, bool)
    bits[(hashes & np.uint64(n - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def frequent_hashes(texts: DataFrame, size: int) -> np.ndarray:
    """The hashes that three or more of the sample's different texts have, most frequent first."""
    part = max(1, -(-texts.count() // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text").distinct()
    found = some.mapInArrow(_sets(size), "fp long, hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return found.where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow().column("h").to_numpy().view(np.uint64)


def rare_first(hashes: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ascending hashes in the common order; ``frequent`` ascends and ``place`` tells where each of these comes among them."""
    if not len(frequent):
        return hashes
    at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
    known = frequent[at] == hashes
    return np.r_[hashes[~known], hashes[known][np.argsort(place[at[known]])]]


def _prefixes(size: int, t: Fraction, often: np.ndarray):
    order = np.argsort(often)
    frequent, place = often[order], -order  # the most frequent comes last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, 1000) for batch in batches for a in range(0, batch.num_rows, 1000)):
            hashes = [shingle_hashes(x.as_py(), size) for x in part.column("text")]
            sims = np.fromiter(map(majority, hashes), np.uint64, len(hashes))
            sets = list(map(np.unique, hashes))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            first = n - -(-t.numerator * n // t.denominator) + (n > 0)
            fps = np.fromiter(map(set_hash, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("d"), pa.array(fps.view(np.int64)), pa.array(sims.view(np.int64)), pa.array(n), _lists([rare_first(s, frequent, place)[:k] for s, k in zip(sets, first.tolist(), strict=True)]), pa.array([bitmap(s) for s in sets], pa.binary())],
                names=["d", "fp", "sim", "n", "prefix", "bits"],
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                sets = [shingle_set(x.as_py(), size) for x in batch.column("text")[a : a + 1000]]
                fps = np.fromiter(map(set_hash, sets), np.uint64, len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), _lists(sets)], names=["fp", "hashes"])

    return run


def _groups(t: Fraction):
    """Of rows (h, n, fp) sorted by all three: (g, fp) of sets that meet at an h; a gap in the sizes that t does not allow parts them."""

    def found(h: np.ndarray, n: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        once = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])][: len(h)])
        h, n, fp = h[once], n[once], fp[once]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (n[:-1] * t.denominator < n[1:] * t.numerator)][: len(h)])
        many = np.diff(np.r_[start, len(h)])
        group = np.add.reduceat(mix(fp.view(np.uint64)), start) if len(h) else np.empty(0, np.uint64)
        keep = np.repeat(many > 1, many)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(group, many)[keep].view(np.int64)), pa.array(fp[keep])], names=["g", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            rows = [np.r_[a, batch.column(i).to_numpy()] for i, a in enumerate(rest)]
            done = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            rest = tuple(x[done:] for x in rows)
            yield found(*(x[:done] for x in rows))
        yield found(*rest)

    return run


def _spanning(n: int, near, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (asked, other) that span the components of all pairs that are near; ``near(i)`` tells which of the ``n`` places are near to i.

    Places of one ``label``, small numbers from 0, are connected already.
    """
    label = np.arange(n) if label is None else label.copy()
    asked = np.zeros(n, bool)
    out = []
    while True:
        open_ = np.flatnonzero(~asked & (label != np.bincount(label).argmax()))
        if not len(open_):
            return out
        i = int(open_[0])
        asked[i] = True
        found = near(i)
        found[i] = True
        some = np.flatnonzero(found)
        met, first = np.unique(label[some], return_index=True)
        out += [(i, int(some[k])) for c, k in zip(met.tolist(), first.tolist(), strict=True) if c != label[i]]
        label[np.isin(label, met)] = met[0]


def _enough(shared: np.ndarray, sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets with that many hashes in common, and that many together, are alike to t."""
    return shared * (t.denominator + t.numerator) >= t.numerator * sizes


def _windows(ascending: np.ndarray, size: np.ndarray, t: Fraction) -> np.ndarray:
    """For each size from where to where in ``ascending`` the sizes are that t allows."""
    least, most = -(-t.numerator * size // t.denominator), t.denominator * size // t.numerator
    return np.stack([np.searchsorted(ascending, least), np.searchsorted(ascending, most, "right")], axis=1)


class _Bitmaps:
    """Bitmaps of some sets, by their lengths; of two lengths the longer is folded to the shorter."""

    def __init__(self, maps: list[bytes], size: np.ndarray) -> None:
        self.size = size
        self.length = np.fromiter(map(len, maps), np.int64, len(maps))
        self.at = np.zeros(len(maps), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            mine = np.flatnonzero(self.length == n)
            self.at[mine] = np.arange(len(mine))
            self.rows[n] = np.frombuffer(b"".join(maps[i] for i in mine.tolist()), np.uint64).reshape(len(mine), n // 8)

    def may(self, i: int, some: np.ndarray, t: Fraction) -> np.ndarray:
        """Which of the places ``some`` can be alike to i. Sizes that t allows have lengths that differ by one doubling at most if t is over a half."""
        n = int(self.length[i])
        ok = np.zeros(len(some), bool)
        for length in np.unique(self.length[some]).tolist():
            which = np.flatnonzero(self.length[some] == length)
            for a in range(0, len(which), 4096):
                part = which[a : a + 4096]
                mine, theirs = self.rows[n][self.at[i]][None], self.rows[length][self.at[some[part]]]
                while theirs.shape[1] > mine.shape[1]:
                    theirs = theirs[:, : theirs.shape[1] // 2] | theirs[:, theirs.shape[1] // 2 :]
                while mine.shape[1] > theirs.shape[1]:
                    mine = mine[:, : mine.shape[1] // 2] | mine[:, mine.shape[1] // 2 :]
                only_mine = np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64)
                only_theirs = np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64)
                size = self.size[some[part]]
                ok[part] = _enough(np.minimum(self.size[i] - only_mine, size - only_theirs), size + self.size[i], t)
        return ok


def candidate_links(size: np.ndarray, maps: list[bytes], t: Fraction) -> list[tuple[int, int]]:
    """Pairs of places that span the candidates."""
    bitmaps, order = _Bitmaps(maps, size), np.argsort(size, kind="stable")
    window = _windows(size[order], size, t)

    def near(i: int) -> np.ndarray:
        found, some = np.zeros(len(size), bool), order[window[i, 0] : window[i, 1]]
        found[some] = bitmaps.may(i, some, t)
        return found

    return _spanning(len(size), near)


def exact_links(sets: list[np.ndarray], label: np.ndarray, t: Fraction) -> list[tuple[int, int]]:
    """Pairs of places, all alike to t, that connect what pairs alike to t and equal labels do."""
    order = np.argsort(np.fromiter(map(len, sets), np.int64, len(sets)), kind="stable")
    sets, label = [sets[k] for k in order.tolist()], label[order]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start, window = np.r_[0, np.cumsum(size)], _windows(size, size, t)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, mine = codes.astype(np.int32), np.zeros(len(names), bool)

    def near(i: int) -> np.ndarray:
        a, b = window[i].tolist()
        own, found = codes[start[i] : start[i + 1]], np.zeros(len(sets), bool)
        mine[own] = True
        shared = np.add.reduceat(mine[codes[start[a] : start[b]]], start[a:b] - start[a], dtype=np.int64)
        mine[own] = False
        found[a:b] = _enough(shared, size[a:b] + size[i], t)
        return found

    return [(int(order[i]), int(order[j])) for i, j in _spanning(len(sets), near, label)]


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list, ...]]:
    """The columns of each run of equal g; lists come as arrays."""
    last, rows = None, []
    for batch in batches:
        parts = [batch.column("g").to_pylist()]
        for c in columns:
            x = batch.column(c)
            if pa.types.is_list(x.type):
                ends, values = x.offsets.to_numpy(), x.values.to_numpy()
                parts.append([values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            else:
                parts.append(x.to_pylist())
        for g, *row in zip(*parts, strict=True):
            if g != last and rows:
                yield tuple(map(list, zip(*rows, strict=True)))
                rows = []
            last = g
            rows.append(row)
    if rows:
        yield tuple(map(list, zip(*rows, strict=True)))


def _links(names: list[int], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([names[x[k]] for x in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _candidates(t: Fraction):
    """Of rows (g, fp, label, n, bits) sorted by g: the parts (g, fp, label) of each group that candidates connect and labels don't; the same part has the same g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, labels, sizes, maps in _grouped(batches, ("fp", "label", "n", "bits")):
            forest, fp, label = _Forest(len(names)), np.array(names, np.int64), np.array(labels, np.int64)
            for u, v in candidate_links(np.array(sizes, np.int64), maps, t):
                forest.join(u, v)
            part = np.fromiter(map(forest.root, range(len(names))), np.int64, len(names))
            order = np.lexsort((label, part))
            start = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            many = np.diff(np.r_[start, len(order)])
            fp, label = fp[order], label[order]
            open_ = np.repeat(label[start] != label[start + many - 1], many)
            g = np.repeat(np.add.reduceat(mix(fp.view(np.uint64)), start), many)
            yield pa.RecordBatch.from_arrays([pa.array(g[open_].view(np.int64)), pa.array(fp[open_]), pa.array(label[open_])], names=["g", "fp", "label"])

    return run


def _connecting(t: Fraction):
    """Of rows (g, fp, label, hashes) sorted by g: alike pairs (u, v) that connect labels of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, labels, sets in _grouped(batches, ("fp", "label", "hashes")):
            yield _links(names, exact_links(sets, np.unique(labels, return_inverse=True)[1], t))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (u, v) whose sets are alike to t. u is in many pairs, so it is v's set that moves to it."""
    moved = pairs.join(sets.select(F.col("fp").alias("v"), F.col("hashes").alias("vs")), "v")
    both = moved.join(sets.select(F.col("fp").alias("u"), F.col("hashes").alias("us")), "u")
    shared = F.size(F.array_intersect("us", "vs"))
    # shared / (both - shared) >= t
    alike = shared * (t.denominator + t.numerator) >= t.numerator * (F.size("us") + F.size("vs"))
    return both.where(alike).select("u", "v")


def _whole_sets(texts: DataFrame, entries: DataFrame, wanted: DataFrame, shingle: int, label: str) -> DataFrame:
    """fp and hashes of the sets ``wanted`` (fp), each once. Their ids are a table, so a plan knows its size before texts move."""
    ids = cut(wanted.distinct().join(entries, "fp").select("fp", F.col("least").alias("d")), f"ids-of-{label}")
    sets = texts.join(ids, "d", "left_semi").select("text").mapInArrow(_sets(shingle), "fp long, hashes array<long>")
    # rows that repeat a doc_id may bring other texts along
    return cut(sets.join(ids, "fp", "left_semi").dropDuplicates(["fp"]), f"sets-of-{label}")


def _fingerprint_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (u, v) of different sets: one set of each of two linked fingerprints, and the sets of one fingerprint with one of them."""
    heads = cut(prints.groupBy("sim").agg(F.min("fp").alias("head")), "fingerprints")
    near = links(heads.select(F.col("sim").alias("fp")), distance).distinct()
    near = near.join(heads.select(F.col("sim").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("sim").alias("v"), F.col("head").alias("b")), "v")
    same = prints.select("sim", "fp").distinct().join(heads, "sim").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return near.select("a", "b").unionByName(same).where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: str = "0.8", distance: int = 5) -> DataFrame:
    """doc_id and component_id of every row of ``docs`` (doc_id, text); component_id is the smallest doc_id that
    chains of pairs at ``similarity``, a decimal number taken exactly, reach, the row's own included.

    ``distance``, up to which fingerprints link, decides which pass finds a pair and never whether it is found.
    """
    t = Fraction(similarity)
    if not 0 < t <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    texts = docs.select(id_key().alias("d"), "text")
    prints = cut(texts.mapInArrow(_prefixes(shingle, t, frequent_hashes(texts, shingle)), "d long, fp long, sim long, n long, prefix array<long>, bits binary"), "prefixes")
    entries = cut(prints.groupBy("fp").agg(F.min("d").alias("least")), "sets")
    pairs = cut(_fingerprint_pairs(prints, distance), "pairs")
    first = _verified(pairs, _whole_sets(texts, entries, pairs.select(F.explode(F.array("u", "v")).alias("fp")), shingle, "pairs"), t)
    known = cut(components(first), "known")

    postings = prints.select(F.explode("prefix").alias("h"), "n", "fp").repartition("h").sortWithinPartitions("h", "n", "fp")
    groups = cut(postings.mapInArrow(_groups(t), "g long, fp long").distinct(), "groups")
    placed = groups.join(known.select(F.col("node").alias("fp"), F.col("root").alias("label")), "fp", "left").select("g", "fp", F.coalesce("label", "fp").alias("label"))
    open_ = placed.groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("g")
    open_ = cut(placed.join(open_, "g", "left_semi"), "open")
    heads = prints.join(open_.select("fp").distinct(), "fp", "left_semi").select("fp", "n", "bits").dropDuplicates(["fp"])
    members = open_.join(heads, "fp").select("g", "fp", "label", "n", "bits")
    parts = cut(members.repartition("g").sortWithinPartitions("g").mapInArrow(_candidates(t), "g long, fp long, label long").distinct(), "parts")

    whole = parts.join(_whole_sets(texts, entries, parts.select("fp"), shingle, "parts"), "fp").select("g", "fp", "label", "hashes")
    connecting = whole.repartition("g").sortWithinPartitions("g").mapInArrow(_connecting(t), "u long, v long").distinct()
    roots = cut(components(known.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(connecting)), "roots")
    placed = entries.join(roots, entries.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    classes = placed.join(least, "root").select("fp", "component")

    def shown(key: str):
        return F.when(F.col(key) != NULL_ID, F.col(key))

    return prints.select("d", "fp").join(classes, "fp").select(shown("d").alias("doc_id"), shown("component").alias("component_id"))
