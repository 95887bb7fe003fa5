"""Substring dedup by Relative Lempel-Ziv parsing.

Every document is a reference block for the documents after it. Index and parse
are two exchanges of fixed-width rows; texts are dealt by document once.

1. *Index.* Of each 20-word window the smallest hash among its 5-word grams is an
   anchor (about one word in nine). Equal windows have equal anchors, so a window
   can repeat only where its anchor does. Anchors meet by hash; those met again
   go back to their documents.
2. *Look-up.* Windows over a repeated anchor meet by a 96-bit hash and learn the
   smallest (doc_id, start) that holds the same words: their source.
3. *Parse.* Going left to right, a factor starts at the first window with a source and grows
   a word at a time while the reference goes on with the document's words, which the next window's
   source tells. Where it doesn't, the factor ends, and the windows across its end are judged by
   their own sources: the first that has one starts the next factor, which may overlap the last
   one. A factor has a window's words at least and is a duplicate span; the words of all spans,
   and no others, are removed.

Whatever one task sees twice is settled there, and only one row for each hash
and batch is sent: a passage that a third of all documents share
costs a row for each batch, not for each document. Documents that repeat a whole
earlier text send no windows at all.

Words are maximal runs of characters other than space, \\t, \\n, \\v, \\f, \\r.
Null and empty texts have no words and keep an empty text. A null doc_id orders
before all others. Rows that repeat doc_id and text are one document: each is
returned, with the same result. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import id_key
from kinstrand.llm.wordhash import Slice, mix, slices

WINDOW = 20
GRAM = 5
_LOW = np.int64(0xFFFFFFFF)

FACTORS = "array<struct<start:long,length:long,ref_doc_id:long,ref_start:long>>"
_MET = "kind int, h long, d long"
_ROWS = "kind int, w1 long, w2 long, d long, p long, s long, q long"
_HITS = "d long, p long, s long, q long"


def _anchored(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the word number of each one's anchor, and the gram hash at every word."""
    hashes = part.hashes(1)
    starts = np.empty(0, np.int64)
    grams = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= WINDOW:
        starts = np.flatnonzero(part.doc[: len(hashes) - WINDOW + 1] == part.doc[WINDOW - 1 :])
        at, values = part.windows(hashes, GRAM, 1)
        grams[at] = values
    if not len(starts):
        return starts, starts, grams
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    return starts, starts + view[starts].argmin(axis=1), grams


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: an anchor and its only document in this batch; 1: an anchor met twice here; 2: it goes back to d."""
    for batch in batches:
        ids = batch.column("d").to_numpy()
        found, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for part in slices(batch.column("text"), 2 << 20):
            _, at, grams = _anchored(part)
            at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
            found.append(grams[at])
            owner.append(part.doc[at] + part.first_row)
        h, row = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(h)])
        again = np.repeat(count > 1, count)
        back = np.unique(np.stack([h[again].view(np.int64), ids[row[again]]]), axis=1) if again.any() else np.empty((2, 0), np.int64)
        one, many = first[count == 1], first[count > 1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1, 2], np.int32), [len(one), len(many), back.shape[1]])),
                pa.array(np.concatenate([h[one].view(np.int64), h[many].view(np.int64), back[0]])),
                pa.array(np.concatenate([ids[row[one]], np.zeros(len(many), np.int64), back[1]])),
            ],
            names=["kind", "h", "d"],
        )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h: the anchors found more than once, to their documents. A row waits for the next one's hash."""
    held: tuple[int, int, int] | None = None  # the last row of kinds 0 and 1, not yet known to be met
    last = None  # the hash before it
    for batch in batches:
        kind, h, d = (batch.column(i).to_numpy() for i in range(3))
        back = kind == 2
        out_h, out_d = [h[back]], [d[back]]
        kind, h, d = kind[~back], h[~back], d[~back]
        if held is not None:
            kind, h, d = np.r_[held[0], kind], np.r_[held[1], h], np.r_[held[2], d]
        if len(h):
            same = h[1:] == h[:-1]
            met = np.r_[h[0] == last if last is not None else False, same] | np.r_[same, False]
            met[:-1] &= kind[:-1] == 0
            out_h.append(h[:-1][met[:-1]])
            out_d.append(d[:-1][met[:-1]])
            if len(h) > 1:
                last = h[-2]
            held = (kind[-1], h[-1], d[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_d)), pa.array(np.concatenate(out_h))], names=["d", "h"])
    if held is not None and held[0] == 0 and last == held[1]:
        yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[1]], pa.int64())], names=["d", "h"])


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a window to look up, the first with its words in this batch; 1: a run of windows with a source in this batch.

    p: start << 32 | low half of the text's hash; q: start in the source << 32 | windows in the run.
    """
    for batch in batches:
        ids, texts = batch.column("d").to_numpy(), batch.column("t").to_numpy()
        lists = batch.column("anchors")
        needed = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        copy = pa.compute.fill_null(batch.column("copy"), False).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(ids)), needed).astype(np.uint64)
        wanted = np.sort(lists.flatten().to_numpy().view(np.uint64) ^ mix(of)) if len(of) else np.empty(0, np.uint64)
        w1, w2, row, start = [], [], [], []
        for part in slices(batch.column("text"), 2 << 20):
            starts, at, grams = _anchored(part)
            key = grams[at] ^ mix((part.doc[at] + part.first_row).astype(np.uint64))
            here = np.searchsorted(wanted, key)
            take = (here < len(wanted)) & ~copy[part.doc[starts] + part.first_row] if len(starts) else np.empty(0, bool)
            take[take] = wanted[here[take]] == key[take]
            starts = starts[take]
            if not len(starts):
                continue
            for lane, out in ((0, w1), (1, w2)):
                hashes = part.hashes(lane)
                where, values = part.windows(hashes, WINDOW, lane)
                out.append(values[np.searchsorted(where, starts)])
            row.append(part.doc[starts] + part.first_row)
            start.append(starts - part.word_at[part.doc[starts]])
        if not row:
            continue
        w1, w2, row, start = np.concatenate(w1).view(np.int64), np.concatenate(w2).view(np.int64) & _LOW, np.concatenate(row), np.concatenate(start)
        d, tag = ids[row], texts[row] & _LOW
        order = np.lexsort((start, d, w2, w1))
        new = np.r_[True, (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])]
        source = np.empty(len(order), np.int64)
        source[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = (d > d[source]) | ((d == d[source]) & (start > start[source]))
        ask = ~later
        run = np.flatnonzero(later)  # in the order of the rows, so windows of a document stand together
        if len(run):
            a, b = run[:-1], run[1:]
            go = (row[a] == row[b]) & (start[b] == start[a] + 1) & (d[source[b]] == d[source[a]]) & (start[source[b]] == start[source[a]] + 1)
            head = np.flatnonzero(np.r_[True, ~go])
            length = np.diff(np.r_[head, len(run)])
            run = run[head]
        else:
            length = run
        zero = np.zeros(int(ask.sum()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.zeros(len(zero), np.int32), np.ones(len(run), np.int32)]),
                pa.array(np.r_[w1[ask], mix(d[run].view(np.uint64)).view(np.int64)]),
                pa.array(np.r_[w2[ask], np.zeros(len(run), np.int64)]),
                pa.array(np.r_[d[ask], d[run]]),
                pa.array(np.r_[start[ask] << 32 | tag[ask], start[run] << 32 | tag[run]]),
                pa.array(np.r_[zero, d[source[run]]]),
                pa.array(np.r_[zero, start[source[run]] << 32 | length]),
            ],
            names=["kind", "w1", "w2", "d", "p", "s", "q"],
        )


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by kind, window and place: each later window with its source, and the runs as they are."""
    lead: tuple[int, int, int, int] | None = None  # window, and place of its first row
    for batch in batches:
        kind, w1, w2, d, p, s, q = (batch.column(i).to_numpy() for i in range(7))
        n = int((kind == 0).sum())
        a, b, x, y = w1[:n], w2[:n], d[:n], p[:n]
        if lead is not None:
            a, b, x, y = np.r_[lead[0], a], np.r_[lead[1], b], np.r_[lead[2], x], np.r_[lead[3], y]
        out = [(d[n:], p[n:], s[n:], q[n:])]
        if len(a):
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (x > x[first]) | ((x == x[first]) & (y >> 32 > y[first] >> 32))
            lead = (a[first[-1]], b[first[-1]], x[first[-1]], y[first[-1]])
            out.append((x[later], y[later], x[first[later]], (y[first[later]] >> 32) << 32 | 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["d", "p", "s", "q"])


_PARSED = "doc_id long, n_words long, n_removed long, kept_text string, factors " + FACTORS


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("t").to_numpy() & _LOW
        copy_of = batch.column("copy_of").to_pylist()
        lists = batch.column("hits")
        counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        p, s, q = (flat.field(i).to_numpy() for i in range(3)) if len(flat) else (np.empty(0, np.int64),) * 3
        row = np.repeat(np.arange(len(texts)), counts)
        mine = (p & _LOW) == texts[row]
        row, start, s, at, length = row[mine], p[mine] >> 32, s[mine], q[mine] >> 32, q[mine] & _LOW
        order = np.lexsort((start, row))
        row, start, s, at, length = (x[order] for x in (row, start, s, at, length))
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        kept, totals, removed, found = [], [], [], []
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            n, mine = len(words), slice(edge[i], edge[i + 1])
            factors = np.empty((0, 4), np.int64)
            if copy_of[i] is not None and n >= WINDOW:
                factors = np.array([[0, n, copy_of[i], 0]])  # the whole text is one factor
            elif edge[i] < edge[i + 1]:
                factors = parse(start[mine], length[mine], s[mine], at[mine])
            if len(factors):
                stays = ~duplicate_words(factors, n)
                words = [words[k] for k in np.flatnonzero(stays)]
            kept.append(b" ".join(words))
            totals.append(n)
            removed.append(n - len(words))
            found.append([{"start": a, "length": b, "ref_doc_id": c, "ref_start": e} for a, b, c, e in factors.tolist()])
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "ref_doc_id", "ref_start")]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, kind)],
            names=["doc_id", "n_words", "n_removed", "kept_text", "factors"],
        )


def parse(start: np.ndarray, length: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The greedy factors (start, length, reference, start there) of one document.

    ``start`` (ascending), ``length``, ``ref`` and ``at`` are its runs of windows with a source: the k-th window of a run
    starts at start + k and its source at ``at`` + k of ``ref``. A run that goes on where the last one
    ended, in the same reference, makes the factor grow; any other starts a factor of its own.
    """
    grows = (start[1:] == start[:-1] + length[:-1]) & (ref[1:] == ref[:-1]) & (at[1:] == at[:-1] + length[:-1])
    first = np.flatnonzero(np.r_[True, ~grows])
    last = np.r_[first[1:], len(start)] - 1
    words = start[last] + length[last] - 1 + WINDOW - start[first]
    return np.stack([start[first], words, ref[first], at[first]], axis=1)


def duplicate_words(factors: np.ndarray, n: int) -> np.ndarray:
    """Which of a document's ``n`` words are in a factor of a window's words or more."""
    long_ = factors[factors[:, 1] >= WINDOW]
    steps = np.bincount(long_[:, 0], minlength=n + 1) - np.bincount(long_[:, 0] + long_[:, 1], minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the factors of each document of ``docs`` (doc_id, text).

    A word goes if a window of 20 words over it has the words of a window that starts
    earlier, in a smaller doc_id or further up in the same document.
    """
    rows = docs.select("doc_id", id_key().alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    anchors = rows.select("d", "text").mapInArrow(_index, _MET)
    met = anchors.repartition(F.when(F.col("kind") == 2, F.xxhash64("d")).otherwise(F.col("h"))).sortWithinPartitions("h", "kind").mapInArrow(_met, "d long, h long")
    whole = rows.select("d", "t", F.md5("text").alias("whole"))
    copies = whole.join(whole.groupBy("whole").agg(F.min("d").alias("first")), "whole").where("d > first")
    copies = copies.groupBy("d").agg(F.map_from_entries(F.collect_set(F.struct("t", "first"))).alias("firsts"))
    needs = met.groupBy("d").agg(F.collect_set("h").alias("anchors"))

    copied = rows.join(copies, "d", "left").withColumn("first", F.try_element_at("firsts", F.col("t"))).drop("firsts")
    # Both joins ask for the same columns of ``copied``, so its texts are dealt once and the exchange is used again.
    candidates = copied.join(needs, "d", "left").select("doc_id", "d", "t", "text", "anchors", F.col("first").isNotNull().alias("copy"))
    looked = candidates.mapInArrow(_look_up, _ROWS)
    hits = looked.repartition("w1", "w2").sortWithinPartitions("kind", "w1", "w2", "d", "p").mapInArrow(_sources, _HITS)
    hits = hits.groupBy("d").agg(F.collect_list(F.struct("p", "s", "q")).alias("hits"))
    return copied.join(hits, "d", "left").select("doc_id", "text", "t", "hits", F.col("first").alias("copy_of")).mapInArrow(_parse, _PARSED)
