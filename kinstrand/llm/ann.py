"""Approximate nearest neighbours by collision-counting hashing.

Each vector is in one block; a block is an index of its own: its vectors' values on ``projections``
random lines, one sorted array for each line. A query's window on a line is centred on the query's own
value. Virtual rehashing widens all windows step by step from the arrays as they are: in each step
only the entries that enter a window are counted. Vectors that collide on at least
``threshold`` of the lines are verified by their true distance. A query is done in a block when ``k``
verified vectors are nearer than the radius the windows stand for, or when all have been verified. The
best ``k`` of all blocks are the result.

Block counts follow the number of rows, so a block's memory doesn't grow with the input; every row is
indexed; queries, one in a hundred rows, visit every block. Rows and queries of a block come to their task in that order
as a stream: it holds one block and one batch of queries, however many there are.

Vectors that are null, zero, or hold null, NaN or infinite components take no part,
neither do rows without an id. A row is a candidate and, by its id, a query of its own even if others have the same id or
vector; only the query's own row is left out. Only vectors of a query's own dimension are its candidates. Distances
whose squares leave double precision are scaled first. Equal distances go to smaller ids. Other columns are
ignored. No queries or no candidates: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.llm.common import cut

#: Rows of a block, about.
BLOCK_ROWS = 50_000
PROJECTIONS = 48
THRESHOLD = 0.5
_FOUND = "asker long, query_id long, vec_id long, score double"


def lines(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; those that overflow or vanish when squared are made again from scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        apart = rows - query
        out = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        if len(odd):
            most = np.abs(apart[odd]).max(axis=1)
            safe = np.where((most > 0) & np.isfinite(most), most, 1.0)
            out[odd] = np.where(np.isfinite(most), safe * np.sqrt(((apart[odd] / safe[:, None]) ** 2).sum(axis=1)), np.inf)
    return out


class Block:
    """The index of some vectors: ids are shown, ``own`` tells rows apart."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vectors: np.ndarray, projections: int, threshold: float, seed: int) -> None:
        self.ids, self.own, self.vectors = ids, own, vectors
        self.lines = lines(vectors.shape[1], projections, seed)
        largest = float(np.abs(vectors).max(initial=0.0))
        self.unit = largest if largest > 1e100 else 1.0  # sums on the lines stay finite
        values = (vectors / self.unit) @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.least = max(1, math.ceil(threshold * projections))

    def search(self, asker: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found."""
        n = len(self.ids)
        open_ = self.own != asker
        k = min(k, int(open_.sum()))
        if not k:
            return self.ids[:0], np.empty(0)
        centre = np.clip(query / self.unit, -1e200, 1e200) @ self.lines
        # radii from where a typical line's window holds a hundredth of the block to where all hold everything
        middle = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        near = np.clip(middle + max(4, n // 200), 0, n - 1)
        first = max(float(np.median(np.abs(self.sorted[np.arange(len(centre)), near] - centre))), 1e-9) / REACH
        last = max(float(np.abs(self.sorted[:, [0, -1]] - centre[:, None]).max()) / REACH, first)
        radii = first * STEP ** np.arange(math.ceil(math.log(last / first, STEP)) + 2)
        low = np.array([np.searchsorted(s, c - REACH * radii, "left") for s, c in zip(self.sorted, centre, strict=True)])
        high = np.array([np.searchsorted(s, c + REACH * radii, "right") for s, c in zip(self.sorted, centre, strict=True)])
        hits = np.zeros(n, np.int64)
        distance = np.full(n, np.inf)
        verified = np.zeros(n, bool)
        for t, radius in enumerate(radii):
            if t:
                enter = [x for o, a, b, c, d in zip(self.order, low[:, t], low[:, t - 1], high[:, t - 1], high[:, t], strict=True) for x in (o[a:b], o[c:d])]
            else:
                enter = [o[a:b] for o, a, b in zip(self.order, low[:, 0], high[:, 0], strict=True)]
            hits += np.bincount(np.concatenate(enter), minlength=n)
            fresh = np.flatnonzero(open_ & (hits >= self.least))
            if len(fresh):
                distance[fresh] = distances(self.vectors[fresh], query)
                open_[fresh] = False
                verified[fresh] = True
            if verified.sum() >= k and np.partition(distance, k - 1)[k - 1] <= radius * self.unit / SAFETY:
                break
        best = np.flatnonzero(verified)
        best = best[np.lexsort((self.ids[best], distance[best]))][:k]
        return self.ids[best], distance[best]


#: A line's value differs by the distance times a normal number; half of such numbers are below this.
REACH = 0.6745
#: Windows of a step are this much wider than before.
STEP = 2.0**0.5
#: The windows stand for this many times the distance of the k-th neighbour before a search ends.
SAFETY = 1.25


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles): the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, projections: int = PROJECTIONS, threshold: float = THRESHOLD, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""

    def found(block: Block, own: np.ndarray, ids: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        out = [block.search(a, v, k) for a, v in zip(own.tolist(), asked, strict=True)]
        n = [len(x) for x, _ in out]
        columns = [np.repeat(own, n), np.repeat(ids, n), np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asker", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by dimension, block, and rows before queries."""
        now, rows, block = None, [], None
        for batch in batches:
            key = np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("dim", "block", "asks")], axis=1)
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True]) if len(key) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                dim, number, asks = key[a].tolist()
                part = batch.slice(a, b - a)
                some = part.column("vec_id").to_numpy(), part.column("own").to_numpy(), _matrix(part.column("v"), dim)
                if now != (dim, number):
                    now, rows, block = (dim, number), [], None
                if not asks:
                    rows.append(some)
                    continue
                if rows:
                    block, rows = Block(*(np.concatenate(x) for x in zip(*rows, strict=True)), projections, threshold, seed), []
                if block is not None:
                    for c in range(0, b - a, 500):
                        yield found(block, some[1][c : c + 500], some[0][c : c + 500], some[2][c : c + 500])

    rows = cut(usable(vectors).withColumn("own", F.monotonically_increasing_id()), "vectors")
    blocks = max(1, math.ceil(rows.count() / block_rows))
    data = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("own"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "own", "v")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.size("v").alias("dim"), every_block, F.lit(1).alias("asks"), "vec_id", "own", "v")
    both = data.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "asks")
    hits = both.mapInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
