"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

A document is its token ids and one end id. Longer ones are cut into full pieces and
a rest; all others stay whole. The packing instance is the histogram of piece
lengths: at most ``capacity`` numbers, however many documents there are. On it the
driver works in multiplicities:

1. *Reduction.* For each length, longest first: if a set of at most three pieces with it dominates
   every alternative, as many sequences as the counts allow are fixed for good. The cases are: nothing else fits;
   a piece that fills the sequence exactly; the longest that fits, where no number of the others
   that fit come to more than it; the longest pair, where no three fit and the pair covers every other pair.
2. *Best fit.* The remainder goes longest first to the fullest open sequence that takes it. Where this needs more
   sequences than the sum of all lengths does, the remainder is also packed sequence by sequence, each with the
   longest piece left and the company that fills it best, and the better of both counts.

The plan is a list of ranges (length, first rank, last rank) -> sequences, offset.
Pieces get their rank within their length from counts by (length, bucket); a length has as many buckets as
its pieces ask for, so one that a third of all pieces have is ranked by many tasks. Each bucket gets
the few ranges of the plan that its ranks meet, and one join on (length, bucket) places each piece.

Texts are tokenised by white-space-separated chunks with a bounded cache of chunk to
ids; the tokenizer never merges across white space, which the tests check.
Null text is empty: one piece, the end id. Repeated rows are packed as often as they occur. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.llm.common import cut

CAPACITY = 2048
END_ID = 0
#: Chunks whose ids a worker keeps; a full cache is emptied.
CACHE = 800_000
#: Pieces of a length that are ranked together, about.
BUCKET_ROWS = 4096


#: Characters whose lower case, normal form and class are sure: printable ASCII and the Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-z0-9à-öø-ÿß]+")
_MADE_OF = {"NFC", "Lowercase", "Split", "ByteLevel"}


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones as they are, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_BYTES = _byte_letters()


class Chunked:
    """Ids of whole texts through a cache of white-space-separated chunks."""

    def __init__(self, path: str) -> None:
        # tasks are the parallelism; threads of the library's own would only contend
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Plain chunks of a tokenizer of the known make are split here, so that its words are cached and not its chunks only.
        self.split = _SPLIT.findall if _MADE_OF <= set(re.findall(r'"type":\s*"(\w+)"', self.tokenizer.to_str()[:20_000])) and '\\\\p{N}]|' in self.tokenizer.to_str()[:20_000] else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, bytes] = {}  # chunk to its ids, little-endian 32 bits
        self.parts: dict[str, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        slow, known, parts, plain, split, bpe = [], self.known, self.parts, _PLAIN.fullmatch, self.split, self.tokenizer.model.tokenize
        for chunk in chunks:
            text = chunk.decode()
            if split is None or not plain(text) or "<|" in text:
                slow.append((chunk, text))
                continue
            out = []
            for part in split(text.lower()):
                ids = parts.get(part)
                if ids is None:
                    shown = part if part.isascii() else "".join([_BYTES[b] for b in part.encode()])
                    ids = parts[part] = _packed([t.id for t in bpe(shown)])
                out.append(ids)
            known[chunk] = out[0] if len(out) == 1 else b"".join(out)
        for a in range(0, len(slow), 1000):
            some = slow[a : a + 1000]
            for (chunk, _), found in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False), strict=True):
                known[chunk] = _packed(found.ids)

    def encode(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        unknown = set(words).difference(self.known)
        if unknown:
            if len(self.known) + len(unknown) > CACHE:
                self.clear()
                unknown = set(words)
            self.learn(unknown)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()


_CODERS: dict[str, Chunked] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, in ``with_ids``) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.setdefault(tokenizer, None) or Chunked(tokenizer)
        _CODERS[tokenizer] = coder
        for batch in batches:
            row, piece, start, length, crc, binary = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(coder.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity].tobytes()
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        binary.append(part)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(binary, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _fullest(sizes: list[int], count: dict[int, int], room: int) -> int:
    """The most that pieces of ``sizes``, each as often as there are, come to within ``room``."""
    reach, inside = 1, (1 << room + 1) - 1  # bit i: i can be made
    for s in sizes:
        left, step = min(count[s], room // s), 1
        while left:
            take = min(step, left)
            reach |= reach << take * s & inside
            left, step = left - take, 2 * step
    return reach.bit_length() - 1


def _dominant(sizes: list[int], count: dict[int, int], j: int, capacity: int) -> tuple[int, ...] | None:
    """The pieces that dominate every other company of j, the longest left; None: no such set is found.

    ``sizes`` are the lengths left beside one j in ascending order, ``count`` how many of each.
    """
    room = capacity - j
    fits = bisect_right(sizes, room)
    if not fits:
        return ()
    if sizes[fits - 1] == room:
        return (room,)
    small = []
    for x in sizes[:3]:
        small += [x] * min(3, count[x])
    small = sorted(small)[:3]
    best = sizes[fits - 1]
    if len(small) < 2 or small[0] + small[1] > room:
        return (best,)
    # the largest sum of two that fits, by two pointers
    a, b, top, pair = 0, fits - 1, 0, (0, 0)
    while a <= b:
        total = sizes[a] + sizes[b]
        if total > room:
            b -= 1
            continue
        if (a < b or count[sizes[a]] > 1) and total > top:
            top, pair = total, (sizes[b], sizes[a])
        a += 1
    pairs_only = len(small) < 3 or sum(small) > room
    if top <= best and (pairs_only or _fullest(sizes[:fits], count, room) <= best):
        return (best,)
    if pairs_only:
        # no three fit: a pair covers all others if it has the longest piece that fits and, beside it, a second piece as long as any second piece
        second = bisect_right(sizes, room - best)
        while second and sizes[second - 1] == best and count[best] < 2:
            second -= 1
        if second:
            mate = sizes[second - 1]
            half = bisect_right(sizes, room // 2)
            while half and not (count[sizes[half - 1]] > 1 or bisect_right(sizes, room - sizes[half - 1]) > half):
                half -= 1
            if not half or sizes[half - 1] <= mate:
                return (best, mate)
    return None


def _fullest_set(sizes: list[int], count: dict[int, int], room: int) -> list[int]:
    """Pieces of ``sizes`` that come to as much within ``room`` as any do, long ones first."""
    reach, inside, steps = 1, (1 << room + 1) - 1, []
    for s in sizes:
        left, step = min(count[s], room // s), 1
        while left:
            take = min(step, left)
            steps.append((s, take, reach))
            reach |= reach << take * s & inside
            left, step = left - take, 2 * step
    at, out = reach.bit_length() - 1, []
    for s, take, before in reversed(steps):
        if not before >> at & 1:
            out += [s] * take
            at -= take * s
    return out


class _Work:
    """What is left of a histogram, and the ranges made so far."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.ranges: list[tuple[int, int, int, int]] = []
        self.sequences = 0

    def copy(self) -> _Work:
        other = _Work(self.left)
        other.used, other.ranges, other.sequences = dict(self.used), list(self.ranges), self.sequences
        return other

    def take(self, size: int, n: int, sequence: int, offset: int) -> None:
        self.ranges.append((size, self.used[size], sequence, offset))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def group(self, pieces: tuple[int, ...] | list[int]) -> int:
        """As many sequences of these pieces as there are pieces for."""
        times = min(self.left[s] // pieces.count(s) for s in set(pieces))
        offset = 0
        for s in pieces:
            self.take(s, times, self.sequences, offset)
            offset += s
        self.sequences += times
        return times

    def beside(self, j: int) -> list[int]:
        """The lengths that are left beside one j."""
        return self.sizes if self.left[j] > 1 else [s for s in self.sizes if s != j]


def _reduce(work: _Work, capacity: int) -> int:
    """Fixes dominating sets, longest piece first; a length without one is left. How many pieces were fixed."""
    fixed = 0
    for j in work.sizes[::-1]:
        while j in work.left:
            view = work.beside(j)
            work.left[j] -= 1
            company = _dominant(view, work.left, j, capacity)
            work.left[j] += 1
            if company is None:
                break
            fixed += work.group((j, *company)) * (1 + len(company))
    return fixed


def _best_fit(work: _Work, capacity: int) -> None:
    """Longest first, each piece to the fullest open sequence that takes it."""
    rooms: list[int] = []
    opened: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)

    def leave(room: int, first: int, n: int) -> None:
        if room:
            if room not in opened:
                opened[room] = []
                insort(rooms, room)
            opened[room].append((first, n))

    while work.sizes:
        s = work.sizes[-1]
        k = bisect_left(rooms, s)
        if k == len(rooms):
            per = min(capacity // s, work.left[s])
            n = work.left[s] // per
            for i in range(per):
                work.take(s, n, work.sequences, i * s)
            leave(capacity - per * s, work.sequences, n)
            work.sequences += n
        else:
            room = rooms[k]
            first, have = opened[room].pop()
            n = min(have, work.left[s])
            if n < have:
                opened[room].append((first + n, have - n))
            if not opened[room]:
                del opened[room]
                rooms.pop(k)
            work.take(s, n, first, capacity - room)
            leave(room - s, first, n)


def _fullest_first(work: _Work, capacity: int) -> None:
    """Each sequence has the longest piece left and the company that fills it best. A step uses up a length."""
    while work.sizes:
        j = work.sizes[-1]
        view = work.beside(j)
        work.left[j] -= 1
        company = _fullest_set(view, work.left, capacity - j)
        work.left[j] += 1
        work.group([j, *company])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], dict[str, int]]:
    """Ranges (length, first rank, first sequence, offset), each up to the next one's first rank, and what was done.

    The n-th piece of a range goes to the n-th of its sequences. Ranges are as many as
    the steps taken: each step uses up a length or a group of equal sequences.
    """
    work = _Work(histogram)
    least = -(-sum(s * n for s, n in work.left.items()) // capacity)
    fixed = _reduce(work, capacity)
    done, other = work.copy(), work
    _best_fit(done, capacity)
    if done.sequences > least:  # perhaps one could do with fewer
        _fullest_first(other, capacity)
        if other.sequences < done.sequences:
            done = other
    return done.ranges, {"sequences": done.sequences, "fixed": fixed, "ranges": len(done.ranges)}


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with length) with sequence_id and offset; ``parts`` must be a stored table.

    Full pieces are sequences of their own, numbered after those of the plan.
    """
    spark = parts.sparkSession
    # Equal pieces are interchangeable: all columns but binary ones decide the bucket, and the order within it.
    order = [c for c, kind in parts.dtypes if kind != "binary"]
    # at most ``capacity`` rows, here and in the broadcast
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = spark.createDataFrame([(s, -(-n // BUCKET_ROWS)) for s, n in histogram.items()], "length long, buckets long")
    keyed = parts.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), F.col("buckets"))).drop("buckets")
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))

    full = histogram.pop(capacity, 0)
    ranges, stats = plan(histogram, capacity)
    if full:
        ranges.append((capacity, 0, stats["sequences"], 0))
    # Some ten ranges for each length, however many pieces. A range of the plan starts where another one ends.
    steps = spark.createDataFrame(ranges, "length long, low long, first long, offset long")
    steps = steps.withColumn("high", F.lead("low").over(Window.partitionBy("length").orderBy("low")))
    met = spans.join(steps, "length").where((F.col("low") < F.col("upto")) & (F.col("high").isNull() | (F.col("high") > F.col("before"))))
    met = met.groupBy("length", "bucket", "before").agg(F.array_sort(F.collect_list(F.struct("low", "first", "offset"))).alias("steps"))

    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = keyed.withColumn("inside", rank).join(met, ["length", "bucket"]).withColumn("rank", F.col("inside") + F.col("before"))
    placed = ranked.withColumn("step", F.element_at(F.filter("steps", lambda x: x.low <= F.col("rank")), -1))
    return placed.select(*parts.columns, (F.col("step.first") + F.col("rank") - F.col("step.low")).alias("sequence_id"), F.col("step.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return place(cut(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
