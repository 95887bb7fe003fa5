"""SimHash near-dedup with multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Fingerprints link at ``distance`` differing bits or fewer. The 64 bits are
cut into segments; two linked fingerprints agree in some segment up to
``distance // segments`` bits, so each fingerprint is entered in the table of each
segment and looks up the Hamming ball around its own segment there. Complete
distances are then verified, so results are exact. Ball members are asked for
only by clearing bits: of two fingerprints one has a set bit where the other has not, and
that one asks.

Equal fingerprints are one entry, so groups of copies cost one row. Entries that share a table slot come
together by a sort, not by a group in memory; in a slot, verified links that
only repeat what is known to be connected are left out, so a dense group of g near copies gives at
most g - 1 links there and components stay those of all links. A slot that holds more than ``DENSE`` entries and a ``SPREAD``-th of all
fingerprints is dealt by pieces of all 64 bits as well, of which linked entries share one; there are at
most ``SPREAD`` such slots for each segment, so the list of them is small. Any slot of more than ``DENSE`` entries is
cut so where it is looked at.

Texts are lower-cased in A-Z only; words are maximal runs of characters other than
space, \\t, \\n, \\v, \\f, \\r. Fewer words than a shingle: the whole sequence is the one
shingle. No words (null, empty): fingerprint zero, linked like any other. A null
doc_id orders before all others and shows as null. Repeated rows and
ids keep a row each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import NULL_ID, cut, id_key
from kinstrand.llm.components import components

SEED = 42
#: A slot with more entries than this is cut by its remaining bits before pairs are looked at.
DENSE = 2048
#: A slot with this part of all fingerprints is dealt to several tasks.
SPREAD = 1024
#: Segments of a fingerprint. Three of 21 or 22 bits have balls of one bit at distance 4: 3 entries and about 32 look-ups
#: a fingerprint, whatever the table's size. From some 10**9 distinct fingerprints on, two segments of 32 bits
#: (balls of two bits) meet fewer entries by chance than they cost in look-ups.
SEGMENTS = 3
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-size]].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and d (its key) with fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(x.as_py(), shingle)) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(fps.view(np.int64))], names=["d", "fp"])

    return docs.select(id_key().alias("d"), "text").mapInArrow(run, "d long, fp long")


def bounds(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _below(values: np.ndarray, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, value) for the values made by clearing up to ``radius`` of the set bits, or for radius 2 by
    clearing one and setting one; of two values that differ in two bits exactly one asks for the other."""
    every = np.arange(len(values))
    one = np.uint64(1)
    if radius >= 1:
        for i in range(width):
            has = every[(values >> np.uint64(i)) & one == one]
            yield has, values[has] ^ (one << np.uint64(i))
    if radius >= 2:
        for i in range(width):
            for j in range(i):
                has = every[(values >> np.uint64(i)) & one == one]
                yield has, values[has] ^ (one << np.uint64(i)) ^ (one << np.uint64(j))


def hot_slots(fps: DataFrame, segments: int) -> dict[int, np.ndarray]:
    """Of each segment the slots, ascending, that are dealt by pieces: ``SPREAD`` of them at most."""
    least = max(DENSE, fps.count() // SPREAD)
    own = F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("slot")) for k, (shift, width) in enumerate(bounds(segments))))
    rows = fps.select(F.explode(own).alias("x")).groupBy("x.k", "x.slot").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()
    return {k: np.array(sorted(r.slot for r in rows if r.k == k), np.uint64) for k in range(segments)}


def _entries(segments: int, distance: int, hot: dict[int, np.ndarray]):
    def rows(k: int, value: np.ndarray, ask: bool, piece: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(piece), pa.array(np.full(len(value), ask)), pa.array(fps.view(np.int64))],
            names=["segment", "slot", "piece", "ask", "fp"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k, (shift, width) in enumerate(bounds(segments)):
                own = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                asked = [(np.arange(len(fps)), own, False), *((a, b, True) for a, b in _below(own, width, distance // segments))]
                for which, value, ask in asked:
                    spread = np.isin(value, hot[k]) if len(hot[k]) else np.zeros(len(value), bool)
                    yield rows(k, value[~spread], ask, np.full(int((~spread).sum()), -1, np.int64), fps[which[~spread]])
                    if spread.any():
                        some = fps[which[spread]]
                        for i, (a, w) in enumerate(bounds(distance + 1)):
                            piece = ((some >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) * (distance + 1) + i
                            yield rows(k, value[spread], ask, piece, some)

    return run


class _Forest:
    """Union-find over a few entries."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def slot_links(table: np.ndarray, asks: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of all pairs table x table and table x asks within ``distance``."""
    entries = np.unique(np.r_[table, asks])
    left = np.unique(np.searchsorted(entries, table))
    forest, out = _Forest(len(entries)), []

    def look(rows: np.ndarray, columns: np.ndarray) -> None:
        for a in range(0, len(rows), 256):
            near = np.bitwise_count(entries[rows[a : a + 256], None] ^ entries[None, columns]) <= distance
            x, y = np.nonzero(near)
            for i, j in zip(rows[a + x].tolist(), columns[y].tolist(), strict=True):
                if i != j and forest.join(i, j):
                    out.append((int(entries[i]), int(entries[j])))

    if len(left) * len(entries) <= DENSE * DENSE:
        look(left, np.arange(len(entries)))
        return out
    # By distance + 1 pieces of all 64 bits: linked entries are equal in one of them.
    for shift, width in bounds(distance + 1):
        piece = (entries >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        order = np.argsort(piece, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(piece[order]) != 0, True])
        in_table = np.zeros(len(entries), bool)
        in_table[left] = True
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            group = order[a:b]
            if b - a > 1 and in_table[group].any():
                look(group[in_table[group]], group)
    return out


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by slot. The last slot of a batch may go on in the next one; its parts wait and are put together once."""
        waits: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            segment, slot, piece, ask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(fp):
                continue
            edge = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (slot[1:] != slot[:-1]) | (piece[1:] != piece[:-1])])
            same = last == (segment[0], slot[0], piece[0])
            last = (segment[-1], slot[-1], piece[-1])
            if waits and not same:
                yield _batch(_whole(waits, distance))
                waits = []
            tail = edge[-1]
            if same and len(edge) == 1:
                waits.append((ask, fp))
                continue
            start = 0
            if same:
                start = edge[1]
                yield _batch(_whole([*waits, (ask[:start], fp[:start])], distance))
            yield _batch(_slots(edge[edge >= start] - start, ask[start:tail], fp[start:tail], distance))
            waits = [(ask[tail:], fp[tail:])]
        if waits:
            yield _batch(_whole(waits, distance))

    return run


def _whole(parts: list[tuple[np.ndarray, np.ndarray]], distance: int) -> list[tuple[int, int]]:
    ask, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    return [] if ask.all() else slot_links(fp[~ask].view(np.uint64), fp[ask].view(np.uint64), distance)


def _slots(edge: np.ndarray, ask: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links in each whole slot; slots of two rows, nearly all of them, are looked at together."""
    size = np.diff(edge)
    pair = edge[:-1][size == 2]
    a, b = fp[pair].view(np.uint64), fp[pair + 1].view(np.uint64)
    near = (np.bitwise_count(a ^ b) <= distance) & (a != b) & ~(ask[pair] & ask[pair + 1])
    yield from zip(a[near].tolist(), b[near].tolist(), strict=True)
    for i in np.flatnonzero(size > 2):
        x, y = edge[i], edge[i + 1]
        asks = ask[x:y]
        if not asks.all():
            yield from slot_links(fp[x:y][~asks].view(np.uint64), fp[x:y][asks].view(np.uint64), distance)


def _batch(links) -> pa.RecordBatch:
    pairs = np.array(list(links), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def links(fps: DataFrame, distance: int = 4, segments: int = SEGMENTS) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` that span the components of all links."""
    if distance // segments > 2:
        raise ValueError("balls beyond two bits are too large: take more segments")
    slots = fps.mapInArrow(_entries(segments, distance, hot_slots(fps, segments)), "segment int, slot long, piece long, ask boolean, fp long")
    keys = ["segment", "slot", "piece"]
    return slots.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(distance), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included.
    """
    prints = cut(fingerprints(docs, shingle), "fingerprints")
    entries = cut(prints.groupBy("fp").agg(F.min("d").alias("least")), "entries")
    roots = cut(components(links(entries.select("fp"), distance, segments)), "roots")
    placed = entries.join(roots, entries.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    classes = placed.join(least, "root").select("fp", "component")

    def shown(key: str):
        return F.when(F.col(key) != NULL_ID, F.col(key))

    return prints.join(classes, "fp").select(shown("d").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown("component").alias("component_id"))
