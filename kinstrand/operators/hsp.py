"""Operators on local hits (high-scoring segment pairs).

A hit table has qid, q_len, sid, s_len, iden, aln_len, mismatches, gaps, qfrom, qend, sfrom,
send, evalue, score, frame and hsp_no, the order within (qid, sid), best first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions import alignment, local
from kinstrand.functions import kmers as K
from kinstrand.functions.storage import stored
from kinstrand.operators import greedy, ranking


def _pair() -> Window:
    return Window.partitionBy("qid", "sid").orderBy("hsp_no")


def frame(qfrom: str = "qfrom", qend: str = "qend", sfrom: str = "sfrom", send: str = "send") -> Column:
    sign = lambda a, b: F.when(F.col(a) <= F.col(b), "+").otherwise("-")
    return F.concat(sign(qfrom, qend), sign(sfrom, send))


def top_strand(hits: DataFrame) -> DataFrame:
    """Hits on the strand of the best hit of their subject."""
    return hits.withColumn("__f", F.first("frame").over(_pair())).where("frame = __f").drop("__f")


def last_round(hits: DataFrame) -> DataFrame:
    """Hits of the last search round: a round begins where the score goes up again within a query's list in the order of ``hsp_no``, then ``sid``."""
    w = Window.partitionBy("qid").orderBy("hsp_no", "sid")
    up = F.when(F.col("score") > F.lag("score").over(w), 1).otherwise(0)
    rounds = hits.withColumn("__u", up).withColumn("__r", F.sum("__u").over(w)).withColumn("__m", F.max("__r").over(Window.partitionBy("qid")))
    return rounds.where("__r = __m").drop("__u", "__r", "__m")


def best_of_subject(hits: DataFrame) -> DataFrame:
    return hits.withColumn("__n", F.row_number().over(_pair())).where("__n = 1").drop("__n")


def rebase_circular(hits: DataFrame) -> DataFrame:
    """Coordinates counted from the start of the best hit of each subject, negative ones wrapped by the length."""
    moved = hits
    for place, length, key in (("q", "q_len", ("qfrom", "qend")), ("s", "s_len", ("sfrom", "send"))):
        start = F.first(F.least(*key)).over(_pair())
        moved = moved.withColumn(f"__{place}", start - 1)
        for c in key:
            shifted = F.col(c) - F.col(f"__{place}")
            moved = moved.withColumn(c, F.when(shifted <= 0, shifted + F.col(length)).otherwise(shifted).cast("long"))
    return moved.drop("__q", "__s")


def _overlap(a1: int, a2: int, b1: int, b2: int) -> int:
    """Shared extent; one shared endpoint is none."""
    return max(0, min(a2, b2) - max(a1, b1))


def _clash(a, b) -> bool:
    aq, bq = sorted((a.qfrom, a.qend)), sorted((b.qfrom, b.qend))
    as_, bs = sorted((a.sfrom, a.send)), sorted((b.sfrom, b.send))
    if _overlap(*aq, *bq) or _overlap(*as_, *bs) or a.frame != b.frame:
        return True
    same = a.frame[0] == a.frame[1]
    return (aq[0] < bq[0]) != (as_[0] < bs[0] if same else as_[1] > bs[1])


def colinear(hits: DataFrame) -> DataFrame:
    """Of each query and subject, best first: hits that neither overlap nor cross one that is kept. A fold over a pair's few hits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []  # of the pair at hand; pairs follow each other, so they may span batches
        for frame in batches:
            stay = []
            for i, row in enumerate(frame.itertuples(index=False)):
                if (row.qid, row.sid) != last:
                    last, kept = (row.qid, row.sid), []
                if not any(_clash(row, k) for k in kept):
                    kept.append(row)
                    stay.append(i)
            yield frame.iloc[stay]

    return hits.repartition("qid", "sid").sortWithinPartitions("qid", "sid", "hsp_no").mapInPandas(run, hits.schema)


def identity(hits: DataFrame, local: bool = False) -> DataFrame:
    """qid, sid, identity (percent, cut to two decimals), aln_len, evalue, q_cover, s_cover from the kept hits of each pair."""
    short = F.least("q_len", "s_len")
    if local:
        one = best_of_subject(hits)
        return one.select("qid", "sid", F.col("iden").alias("identity"), "aln_len", "evalue", (F.col("aln_len") / F.col("q_len")).alias("q_cover"), (F.col("aln_len") / F.col("s_len")).alias("s_cover"))
    sums = hits.groupBy("qid", "sid").agg(
        F.sum(F.floor(F.col("iden") * F.col("aln_len") / 100)).alias("same"), F.sum("aln_len").cast("long").alias("aln_len"), F.min("evalue").alias("evalue"), F.min(short).alias("short"), F.min("q_len").alias("ql"), F.min("s_len").alias("sl")
    )
    percent = F.floor(F.col("same") / F.col("short") * 10000) / 100
    return sums.select("qid", "sid", percent.alias("identity"), "aln_len", "evalue", (F.col("aln_len") / F.col("ql")).alias("q_cover"), (F.col("aln_len") / F.col("sl")).alias("s_cover"))


def accept(pairs: DataFrame, cutoff: float = 0.3, evalue: float = -1.0, cover_short: float = 0.0, cover_long: float = 0.0) -> DataFrame:
    """Pairs identical enough or significant enough, and covered."""
    return pairs.where(((F.col("identity") / 100 > cutoff) | (F.col("evalue") < evalue)) & (F.col("q_cover") >= cover_short) & (F.col("s_cover") >= cover_long))


def cluster(ranked: DataFrame, pairs: DataFrame, longest: int = 0) -> DataFrame:
    """Greedy clusters of ``ranked`` (rank, len) from accepted pairs (qid and sid are ranks): the smallest evalue wins, then the earlier representative.

    Sequences longer than ``longest`` (0: none) stay alone.
    """
    edges = pairs.select(F.greatest("qid", "sid").alias("q"), F.least("qid", "sid").alias("r"), "evalue").where("q > r")
    if longest:
        over = ranked.where(F.col("len") > longest).select(F.col("rank").alias("o"))
        edges = edges.join(over, F.col("q") == F.col("o"), "left_anti").join(over, F.col("r") == F.col("o"), "left_anti")
    best = edges.groupBy("q", "r").agg((-F.min("evalue")).alias("score"))
    return greedy.assign(ranked, greedy.stored(best), "accurate")


def search_window(ranked: DataFrame, cover_long: float) -> DataFrame:
    """rank, low, high: lengths that a subject must have for a query under a coverage of the longer one."""
    return ranked.select("rank", F.ceil(F.col("len") * cover_long).cast("long").alias("low"), F.floor(F.col("len") / cover_long).cast("long").alias("high"))


def report(hits: DataFrame, least: int = 0) -> DataFrame:
    """qid, sid, n_hits, aligned, segments: per query and subject the hits kept, their total length, and their places as text."""
    place = F.format_string("%d-%d:%d-%d", "qfrom", "qend", "sfrom", "send")
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hsp_no", place.alias("p")))), lambda x: x.p), ",")
    return hits.groupBy("qid", "sid").agg(F.count("*").alias("n_hits"), F.sum("aln_len").cast("long").alias("aligned"), packed.alias("segments")).where(F.col("aligned") >= least)


def find(queries: DataFrame, targets: DataFrame, k: int = 11, least: int = 1) -> DataFrame:
    """Ungapped hits by seed and extension: runs of exact ``k``-words on one diagonal. (id, seq) tables; a hit table without gaps.

    A small finder for when no search tool's output is at hand: words meet by an equi-join; runs of neighbouring
    seeds on a diagonal are islands of one window.
    """
    words = lambda t: t.select("id", F.length("seq").alias("n"), F.posexplode(F.when(F.length("seq") >= k, F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substr("seq", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))).alias("at", "word"))
    q = words(queries).select(F.col("id").alias("qid"), F.col("n").alias("q_len"), F.col("at").alias("qa"), "word")
    s = words(targets).select(F.col("id").alias("sid"), F.col("n").alias("s_len"), F.col("at").alias("sa"), "word")
    seeds = q.join(s, "word").where("qid <> sid").withColumn("d", F.col("sa") - F.col("qa"))
    w = Window.partitionBy("qid", "sid", "d").orderBy("qa")
    islands = seeds.withColumn("new", F.when(F.col("qa") - F.lag("qa").over(w) <= k, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    runs = islands.groupBy("qid", "sid", "d", "island", "q_len", "s_len").agg(F.min("qa").alias("a"), F.max("qa").alias("b"), F.count("*").alias("seeds")).where(F.col("seeds") >= least)
    length = F.col("b") - F.col("a") + k
    # letters outside all seeds of a run count as different
    same = F.least(length, F.col("seeds") + (k - 1))
    hits = runs.select(
        "qid", "q_len", "sid", "s_len", (100.0 * same / length).alias("iden"), length.cast("long").alias("aln_len"), (length - same).cast("long").alias("mismatches"), F.lit(0).cast("long").alias("gaps"),
        (F.col("a") + 1).cast("long").alias("qfrom"), (F.col("b") + k).cast("long").alias("qend"), (F.col("a") + F.col("d") + 1).cast("long").alias("sfrom"), (F.col("b") + F.col("d") + k).cast("long").alias("send"),
        F.pow(F.lit(2.0), -same.cast("double")).alias("evalue"), (2 * same - 3 * (length - same)).cast("double").alias("score"), F.lit("++").alias("frame"),
    )
    return hits.withColumn("hsp_no", F.row_number().over(Window.partitionBy("qid", "sid").orderBy(F.desc("score"), "qfrom", "sfrom")).cast("long"))


def _class(length: Column) -> Column:
    return F.floor(F.ln(length) / F.lit(math.log(1.25))).cast("int")


def _seeds(queries: DataFrame, targets: DataFrame, k: int, least: int, reach: int, cover_long: float, within: bool) -> DataFrame:
    """(qid, sid, d): the diagonals with most common words of each band of ``reach`` diagonals that has ``least``.

    Words, numbers up to ten letters, meet by an equi-join; with a coverage of the longer one only under classes of length that a query's window reaches. Counts by diagonal are combined before they are dealt.
    """
    n = F.length("seq")
    low, high = (F.ceil(n * cover_long), F.floor(n / cover_long)) if cover_long else (F.lit(1), F.lit(1 << 30))
    reached = F.sequence(_class(F.greatest(low, F.lit(1))), _class(high)) if cover_long else F.array(F.lit(0))
    q = queries.where(n >= k).select(F.col("id").alias("qid"), low.alias("low"), high.alias("high"), F.explode(reached).alias("class"), "seq")
    s = targets.where(n >= k).select(F.col("id").alias("sid"), n.alias("n"), (_class(n) if cover_long else F.lit(0)).alias("class"), "seq")
    if k <= 10:
        q, s = K.places(q, k, "qa"), K.places(s, k, "sa")
    else:
        at = F.posexplode(F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substr("seq", i, F.lit(k)))).alias("at", "word")
        q, s = q.select("qid", "low", "high", "class", at).withColumnRenamed("at", "qa"), s.select("sid", "n", "class", at).withColumnRenamed("at", "sa")
    met = q.join(s, ["class", "word"]).where((F.col("sid") < F.col("qid") if within else F.lit(True)) & F.col("n").between(F.col("low"), F.col("high")))
    counts = met.groupBy("qid", "sid", (F.col("sa") - F.col("qa")).alias("d")).agg(F.count("*").alias("c"))
    bands = counts.groupBy("qid", "sid", F.floor(F.col("d") / reach).alias("band")).agg(F.max_by("d", F.struct("c", F.col("d"))).alias("d"), F.sum("c").alias("c"))
    return bands.where(F.col("c") >= least).select("qid", "sid", "d")


_FOUND = "qid long, sid long, q_len long, s_len long, score double, matches long, aln_len long, gaps long, qfrom long, qend long, sfrom long, send long"


def _extended(reach: int):
    scoring = alignment.Scoring.amino()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in _FOUND.split(", ")]
        for batch in batches:
            rows = batch.to_pylist()
            found = local.align([(scoring.encode(r["q_seq"]), scoring.encode(r["s_seq"]), r["d"]) for r in rows], scoring, reach)
            out = [(r["qid"], r["sid"], len(r["q_seq"]), len(r["s_seq"]), float(x.score), x.matches, x.length, x.gaps, x.q_from, x.q_end, x.s_from, x.s_end) for r, x in zip(rows, found, strict=True) if x.score]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


#: Bands that a task aligns, about.
ALIGNED = 5_000


def search(queries: DataFrame, targets: DataFrame, k: int = 4, least: int = 2, reach: int = 24, evalue: float = 10.0, cover_long: float = 0.0, within: bool = False) -> DataFrame:
    """Gapped hits of residue sequences (id long, seq) with E-values, a hit table.

    Seeds are ``least`` common ``k``-words in a band of diagonals; around the best diagonal of each such band the best local alignment is taken, within
    ``reach`` diagonals at either side. A score is worth K m n exp(-lambda S) hits by chance, with n the letters of all targets; hits above ``evalue`` are left out, and so is
    what two bands of a pair have both found. ``cover_long``: only pairs whose lengths have this ratio. ``within``: one table against itself, each pair once (sid < qid).
    """
    pairs = stored(_seeds(queries, targets, k, least, reach, cover_long, within))
    letters = targets.agg(F.sum(F.length("seq")).cast("double").alias("letters"))  # one row
    both = pairs.join(targets.select(F.col("id").alias("sid"), F.col("seq").alias("s_seq")), "sid").join(queries.select(F.col("id").alias("qid"), F.col("seq").alias("q_seq")), "qid")
    # an alignment costs much more than its bytes tell, so tasks are cut by their number
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / ALIGNED))
    both = both.select("qid", "sid", "d", "q_seq", "s_seq").repartition(tasks, "qid", "sid", "d")
    found = both.mapInArrow(_extended(reach), _FOUND).dropDuplicates(["qid", "sid", "qfrom", "qend", "sfrom", "send"])
    value = F.lit(local.K) * F.col("q_len") * F.col("letters") * F.exp(-F.lit(local.LAMBDA) * F.col("score"))
    hits = found.crossJoin(F.broadcast(letters)).withColumn("evalue", value).where(F.col("evalue") <= evalue)
    hits = hits.select(
        "qid", "q_len", "sid", "s_len", (100.0 * F.col("matches") / F.col("aln_len")).alias("iden"), "aln_len", (F.col("aln_len") - F.col("matches") - F.col("gaps")).alias("mismatches"), "gaps",
        "qfrom", "qend", "sfrom", "send", "evalue", "score", F.lit("++").alias("frame"),
    )
    return hits.withColumn("hsp_no", F.row_number().over(Window.partitionBy("qid", "sid").orderBy(F.desc("score"), "qfrom", "sfrom", "qend", "send")).cast("long"))


def cluster_by_hits(sequences: DataFrame, cutoff: float = 0.3, evalue: float = 1e-6, cover_long: float = 0.0, **more: float) -> DataFrame:
    """Greedy clusters of residue sequences (seq_idx, seq) at low identities: cluster_id, member_no, seq_idx, len, is_rep and identity (percent, from the hits that don't cross)."""
    ranked = stored(ranking.rank_by_length(sequences.select("seq_idx", "seq")))
    rows = ranked.select(F.col("rank").alias("id"), "seq")
    hits = stored(search(rows, rows, evalue=evalue, cover_long=cover_long, within=True, **more))
    pairs = stored(accept(identity(colinear(hits)), cutoff))
    placed = cluster(ranked.select("rank", "seq_idx", "len"), pairs)
    named = placed.join(pairs.select(F.col("qid").alias("rank"), F.col("sid").alias("rep_rank"), "identity"), ["rank", "rep_rank"], "left")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("rank")) - 1
    return named.select("cluster_id", place.cast("long").alias("member_no"), "seq_idx", "len", "is_rep", F.when(~F.col("is_rep"), F.col("identity")).alias("identity"))
