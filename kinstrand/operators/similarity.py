"""Clustering and two-set comparison by alignment identity.

Plan: k-mer postings -> rare words listed, common ones looked up -> pairs with enough shared words and fitting lengths ->
rounds. In a round, sequences align with representatives that are decided and with nothing else: each asks those among its candidates in
look-up order and stops at the first that passes (fast), or asks all (accurate). Who passes is redundant, and pairs with it as a
representative are dropped unaligned; who has no candidates left represents itself. So a member costs one alignment and those with representatives that reject it,
however large its cluster is, and one more for each representative that is decided later, comes earlier in its order and passes as well.
When a round leaves more than half of the undecided so, most candidates reject each other; they are aligned at once and settled as a graph.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions import alignment as A
from kinstrand.functions import kmers as K
from kinstrand.functions import sequences as S
from kinstrand.operators import greedy, ranking

UNSET = 99999999


@dataclass(frozen=True)
class Options:
    """What a clustering run may be told; the defaults are those of residues."""

    alphabet: str = "aa"
    identity: float | None = None  # 0.9 for residues, 0.95 for nucleotides
    word: int = 5
    band: int = 20
    fragment: int = 0  # letters of a target's stretches; a query's words must come from as many neighbouring ones as it covers
    least_length: int = 10
    tolerance: int = 2
    global_identity: bool = True
    mode: str = "fast"
    both_strands: bool = False
    distance: float | None = None
    longest_gap: int | None = None  # pyro mode
    length_share: float = 0.0
    length_gap: int = UNSET
    length_share2: float = 1.0
    length_gap2: int = 0
    cover_long: float = 0.0
    cover_long_gap: int = UNSET
    cover_short: float = 0.0
    cover_short_gap: int = UNSET
    cover_least: int = 0
    unmatched_long: float = 1.0
    unmatched_short: float = 1.0
    unmatched: int = UNSET
    mask: str = ""
    match: int = 2
    mismatch: int = -2
    gap: int | None = None
    extend: int = -1
    trim1: int = 0
    trim2: int = 0
    sort_clusters: bool = False
    strict_float: bool = True
    memory_mb: int | None = None
    threads: int | None = None

    def __post_init__(self) -> None:
        low, longest = (0.4, 5) if self.alphabet == "aa" else (0.8, 12)
        if self.alphabet not in ("aa", "nt"):
            raise ValueError("alphabet must be aa or nt")
        if self.distance is not None:
            if self.identity is not None:
                raise ValueError("identity and distance exclude each other")
            if not 0 <= self.distance <= 1:
                raise ValueError("distance must be in 0..1")
            if self.distance * self.word >= 1:
                warnings.warn("words are too long for this distance: one shared word will do", stacklevel=3)
        if self.identity is None:
            object.__setattr__(self, "identity", 0.9 if self.alphabet == "aa" else 0.95)
        if not low <= self.identity <= 1:
            raise ValueError(f"identity must be in {low}..1")
        if not 2 <= self.word <= longest:
            raise ValueError(f"word must be in 2..{longest}")
        if not 0 <= self.tolerance <= 5:
            raise ValueError("tolerance must be in 0..5")
        if self.mode not in ("fast", "accurate"):
            raise ValueError("mode must be fast or accurate")
        if not self.global_identity and not (self.cover_long or self.cover_short or self.cover_least):
            raise ValueError("local identity needs a coverage option")
        if self.fragment < 0 or (self.fragment and self.alphabet == "nt"):
            raise ValueError("fragments are of residues")
        if self.both_strands and self.alphabet == "aa":
            raise ValueError("residues have one strand")
        if self.memory_mb is not None or self.threads is not None:
            warnings.warn("memory and threads are Spark's to decide; both are ignored", stacklevel=3)
        if self.cover_long > self.cover_short:
            object.__setattr__(self, "cover_short", self.cover_long)

    @classmethod
    def nucleotide(cls, **more) -> Options:
        return cls(**({"alphabet": "nt", "word": 10, "both_strands": True} | more))

    @classmethod
    def pyro(cls, **more) -> Options:
        """Duplicates of pyrosequencing reads: same start, short indels."""
        return cls(**({"alphabet": "nt", "identity": None if "distance" in more else 0.98, "word": 10, "band": 10, "longest_gap": 1, "mismatch": -1, "gap": -3} | more))

    def scoring(self) -> A.Scoring:
        if self.alphabet == "aa":
            return A.Scoring.amino(gap=self.gap or -11, extend=self.extend)
        return A.Scoring.nucleotide(self.match, self.mismatch, self.gap or -6, self.extend)


def prepare(sequences: DataFrame, options: Options, ranked: bool = True) -> DataFrame:
    """Normalised, filtered, trimmed, masked and (longest first) ranked rows of (seq_idx, seq)."""
    rows = sequences.withColumn("seq", S.normalise("seq")).where(F.col("seq").isNotNull() & S.long_enough("seq", options.least_length))
    rows = rows.withColumn("seq", S.trim("seq", options.trim1))
    if options.mask:
        rows = rows.withColumn("seq", S.mask("seq", options.mask))
    return ranking.rank_by_length(rows) if ranked else rows.withColumns({"len": F.length("seq"), "rank": F.col("seq_idx")})


def _coded(seq: str, options: Options):
    return S.encode_residues(seq) if options.alphabet == "aa" else S.encode_nucleotides(seq)


def _postings(rows: DataFrame, options: Options, seq: str = "seq") -> DataFrame:
    skip = "[45]" if options.alphabet == "nt" else "#"
    return K.postings(rows.select("rank", _coded(seq, options).alias("seq")), options.word, skip=skip)


def _skipped_words(seq: str, options: Options) -> Column:
    """How many words of a sequence of nucleotides have a letter other than ACGT."""
    of = lambda n: F.greatest(n - (options.word - 1), F.lit(0))
    runs = F.split(_coded(seq, options), "[45]")
    return of(F.length(seq)) - F.aggregate(runs, F.lit(0), lambda n, run: n + of(F.length(run)))


#: Lengths of one class differ by this factor at most.
LENGTH_CLASS = 1.25
_CLASSES = 256


def _class(length: Column | str) -> Column:
    return F.floor(F.ln(F.greatest(F.col(length) if isinstance(length, str) else length, F.lit(1))) / F.lit(math.log(LENGTH_CLASS))).cast("int")


def _by_length(words: DataFrame, classes: DataFrame) -> DataFrame:
    """Postings with their words under classes of lengths: ``classes`` (rank, class), a row for each class; rank * 256 + class tells copies apart."""
    each = words.join(classes, "rank")
    return each.select((F.col("rank") * _CLASSES + F.col("class")).alias("rank"), F.concat(F.chr(F.col("class") + 64), "word").alias("word"), "cnt")


def banded(queries: DataFrame, targets: DataFrame, need: DataFrame, reach: DataFrame, sizes: DataFrame, within: bool) -> DataFrame:
    """As :func:`kmers.pairs_sharing`, of pairs whose lengths may fit: words meet only where a target's class of length is in a query's reach.

    ``reach`` (rank, low, high: lengths that a query may join), ``sizes`` (rank, len of targets). A query stands for itself in each class from low to high, with its own need.
    """
    low, high = _class("low"), F.least(_class("high"), F.lit(_CLASSES - 1))
    classes = greedy.stored(reach.where("low <= high").select("rank", F.explode(F.sequence(low, F.greatest(low, high))).alias("class")))
    mine = greedy.stored(_by_length(queries, classes))
    own = targets.join(sizes.select("rank", _class("len").alias("class")), "rank")
    other = greedy.stored(own.select("rank", F.concat(F.chr(F.col("class") + 64), "word").alias("word"), "cnt"))
    asked = need.join(classes.withColumnRenamed("rank", "q"), "q").select((F.col("q") * _CLASSES + F.col("class")).alias("q"), "need")
    found = K.pairs_sharing(mine, other, asked, within=False, before=F.expr(f"r < q div {_CLASSES}") if within else None)
    return found.select(F.expr(f"q div {_CLASSES}").alias("q"), "r", "shared", F.expr("substring(first_word, 2)").alias("first_word"))


def _stretches(length: str, options: Options) -> Column:
    """How many neighbouring stretches of a target a query covers with its band."""
    return F.floor((F.col(length) - options.word + options.band) / F.lit(max(options.fragment, 1))) + 2


def _compared(queries: DataFrame, targets: DataFrame, options: Options, within: bool) -> DataFrame:
    """``queries`` with ``compared``, the letters of a query that the shortest representative it may join can match, and ``least_s``, those that an alignment must cover."""
    if within:
        rows = queries.withColumn("compared", F.col("len"))
    else:
        shortest = F.broadcast(targets.agg(F.min("len").alias("shortest")))  # one row
        allowed = F.greatest("shortest", F.floor(F.col("len") * options.length_share2), F.col("len") - options.length_gap2)
        rows = queries.crossJoin(shortest).withColumn("compared", F.least("len", F.coalesce(allowed, "len")).cast("long")).drop("shortest")
    bounded = options.cover_short > 0 or options.cover_least > 0
    return rows.withColumn("least_s", S.coverage_minimum("compared", options.cover_short, options.cover_short_gap, options.cover_least) if bounded else F.lit(0).cast("long"))


def candidates(queries: DataFrame, targets: DataFrame, options: Options, within: bool, postings: DataFrame | None = None) -> DataFrame:
    """(q, r, strand, shared, first_word, required, required_aas, required_aa1, least_s) of pairs that may pass.

    What is required follows the letters that are compared: those of the query, or of the shortest target that it may join if that is
    shorter, and with a local identity the part of them that an alignment must cover.

    ``within``: one ranked table against itself, r < q; else every target may be joined. ``postings``: those of the targets, as far as queries
    have their words, if they are known. Where lengths are bounded on both sides, words meet by classes of length (:func:`banded`).
    """
    length = F.greatest("compared" if options.global_identity else "least_s", F.lit(1))
    need = K.required_words(length, options.identity, options.word, 2 if options.alphabet == "aa" else 4, options.tolerance, options.alphabet == "nt", options.distance)
    floor = 1 if options.alphabet == "nt" else 0
    # words with other letters than ACGT can't be shared, so they aren't asked for
    lost = _skipped_words("seq", options) if options.alphabet == "nt" else F.lit(0)
    sized = _compared(queries, targets, options, within)
    q = sized.select(F.col("rank").alias("q"), F.col("len").alias("q_len"), "least_s", *(F.greatest(c - lost, F.lit(floor)).alias(n) for n, c in need.items()))
    asked = q.select("q", F.greatest("required_aan", F.lit(1)).alias("need"))
    target = postings if postings is not None or options.fragment else greedy.stored(_postings(targets, options))
    longest = S.upper_length("q_len", options.length_share, options.length_gap, options.cover_long, options.cover_long_gap)
    shortest = F.col("q_len") if within else S.lower_length("q_len", options.length_share2, options.length_gap2)
    bounded = options.length_share > 0 or options.length_gap < UNSET or options.cover_long > 0 or options.cover_long_gap < UNSET
    reach = q.select(F.col("q").alias("rank"), shortest.alias("low"), longest.alias("high"))

    def meet(words: DataFrame, self_join: bool) -> DataFrame:
        if bounded:
            return banded(words, target, asked, reach, targets.select("rank", "len"), within)
        return K.pairs_sharing(words, target, asked, self_join, before=F.expr("r < q") if within and not self_join else None)

    if options.fragment:
        coded = lambda rows, *more: rows.select("rank", *more, _coded("seq", options).alias("seq"))
        asks = coded(sized, F.greatest(need["required_aan"], F.lit(1)).alias("need"), _stretches("len", options).alias("reach"))
        found = K.pairs_in_stretches(asks, coded(targets), options.word, options.fragment, within, skip=S.MASK)
    else:
        found = meet(target if within else greedy.stored(_postings(queries, options)), within)
    found = found.withColumn("strand", F.lit("+"))
    if options.both_strands:
        flipped = greedy.stored(_postings(queries.select("rank", S.reverse_complement("seq").alias("seq")), options))
        found = found.unionByName(meet(flipped, False).withColumn("strand", F.lit("-")))
    r = targets.select(F.col("rank").alias("r"), F.col("len").alias("r_len"))
    pairs = found.join(q, "q").join(r, "r")
    pairs = pairs.where(F.col("r_len") <= longest)
    return pairs if within else pairs.where(F.col("r_len") >= shortest)


#: What a query gets: its representative and the alignment to it, or nothing; and how many alignments it took.
_ASKED = "q long, r long, strand string, identity float, distance float, aln_len long, q_beg int, q_end int, r_beg int, r_end int, place long, aligned long"
_TURN = "q long, place long, r long, strand string, required_aas long, required_aa1 long, least_s long, reached double, seq string"


class _Query:
    """A query that asks candidates one by one; what it has reached outlives the batch that its row came in."""

    def __init__(self, row: dict, scoring: A.Scoring) -> None:
        self.q, self.forward, self.reversed = row["q"], A.Words(scoring.encode(row["seq"]), scoring.unit), None
        self.seq, self.waiting, self.ready, self.found, self.aligned, self.done = row["seq"], [], [], [], 0, False
        self.reached = -1.0

    def coded(self, strand: str, scoring: A.Scoring) -> A.Words:
        if strand == "+":
            return self.forward
        if self.reversed is None:
            self.reversed = A.Words(scoring.encode(self.seq[::-1].translate(_TURNED)), scoring.unit)
        return self.reversed


_TURNED = str.maketrans("ACGTNacgtn", "TGCANTGCAN")


def _best_identity(q: np.ndarray, r: np.ndarray, matches: int, o: Options) -> float:
    """The greatest identity of an alignment with so many matches at most. Not judged where letters are masked."""
    high = 4 if o.alphabet == "nt" else 21
    if not o.global_identity or o.distance is not None or not len(q) or not len(r) or q.max() >= high or r.max() >= high:
        return math.inf
    return float(np.float32(matches) / np.float32(min(len(q), len(r))))


#: Candidates of a query that are looked at together, before those that may pass are aligned.
_LOOKED_AT = 32
#: Sequences whose words a task keeps.
_KEPT = 2048


def _ask(options: Options, every: bool):
    """Arrow batches of queries and their candidates, sorted, to one row for each query, or for each candidate that passes and one more."""
    scoring, fast = options.scoring(), options.mode == "fast" and not every
    centred = options.band if options.longest_gap is not None else None
    names = [c.split()[0] for c in _ASKED.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "float": pa.float32(), "int": pa.int32()}[c.split()[1]] for c in _ASKED.split(", ")]
    at_once = 1 if fast else 1 << 30 if every else 8
    slack = 0.0 if options.strict_float else 1e-6

    kept: dict[str, A.Words] = {}

    def coded(seq: str) -> A.Words:
        if seq not in kept:
            if len(kept) >= _KEPT:
                kept.clear()
            kept[seq] = A.Words(scoring.encode(seq), scoring.unit)
        return kept[seq]

    def look(queries: list[_Query]) -> None:
        """The next candidates of queries that have none ready: those with enough short words in their band, and enough equal letters on any path there, get ready."""
        work = []
        for x in queries:
            for _ in range(min(len(x.waiting), len(x.waiting) if every else _LOOKED_AT)):
                row = x.waiting.pop()
                work.append((x, row, x.coded(row["strand"], scoring), coded(row["seq"])))
        bands = A.best_bands([(q, r, row["required_aa1"]) for _, row, q, r in work], options.identity, options.band, centred)
        work = [(x, row, q.seq, r.seq, band) for (x, row, q, r), band in zip(work, bands, strict=True) if band.shared >= row["required_aas"]]
        for (x, row, q, r, band), most in zip(work, A.most_matches([w[2:] for w in work]).tolist(), strict=True):
            best = _best_identity(q, r, most, options)
            if most >= row["required_aa1"] and best + slack >= options.identity:
                x.ready.append((row, q, r, band, best))

    def turn(queries: list[_Query]) -> list[_Query]:
        """The next candidates of each query; those that have more to ask."""
        while idle := [x for x in queries if x.waiting and not x.ready]:
            look(idle)
        work, of = [], []
        for x in queries:
            x.ready.reverse()
            taken = 0
            while x.ready and taken < at_once:
                row, q, r, band, best = x.ready.pop()
                if not fast and not every and best <= x.reached:
                    continue
                work.append((q, r, band))
                of.append((x, row))
                taken += 1
            x.ready.reverse()
        for (x, row), (q, r, _), a in zip(of, work, A.align(work, scoring), strict=True):
            x.aligned += 1
            found = _accept(row, q, r, a, options)
            if found is None:
                continue
            score = found[3] if options.distance is None else -found[4]
            if every:
                x.found.append(found)
            elif not x.found or score > x.reached:
                x.found, x.reached = [found], score
                x.done = fast or (options.distance is None and score >= 1)
        return [x for x in queries if (x.waiting or x.ready) and not x.done]

    def told(queries: list[_Query]) -> pa.RecordBatch:
        rows = []
        for x in queries:
            nothing = [(x.q, *[None] * 10)] if every or not x.found else []
            rows += [(*found, x.aligned * (not i)) for i, found in enumerate(nothing + x.found)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            queries = [last] if last else []
            for row in batch.to_pylist():
                if row["place"] < 0:
                    queries.append(_Query(row, scoring))
                elif not queries[-1].done:
                    queries[-1].waiting.append(row)
                    if row["reached"] is not None and not queries[-1].found:
                        queries[-1].reached = row["reached"]
            if not queries:
                continue
            for x in queries:
                x.waiting.reverse()
            active = [x for x in queries if x.waiting and not x.done]
            while active:
                active = turn(active)
            *full, last = queries
            if full:
                yield told(full)
        if last:
            yield told([last])

    return run


def asked(pairs: DataFrame, queries: DataFrame, targets: DataFrame, options: Options, every: bool = False) -> DataFrame:
    """A row for each query of ``pairs`` (q, r, strand, place, required_aas, required_aa1, least_s, reached), of :data:`_ASKED`; ``every``: for each pair that passes.

    Candidates are asked by ``place``. A query's sequence travels once, ahead of its candidates'; an alignment that can't be better than
    ``reached``, what the query has from before, isn't made.
    """
    rs = targets.select(F.col("rank").alias("r"), "seq")
    fields = [c.split() for c in _TURN.split(", ")]
    mine = queries.select(F.col("rank").alias("q"), "seq").join(pairs.select("q").distinct(), "q", "left_semi").withColumn("place", F.lit(-1).cast("long"))
    mine = mine.select(*(F.col(c) if c in mine.columns else F.lit(None).cast(t).alias(c) for c, t in fields))
    other = pairs.join(rs, "r").select(*(F.col(c).cast(t).alias(c) for c, t in fields))
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # alignments cost more than their rows' bytes tell
    return mine.unionByName(other).repartition(spread, "q").sortWithinPartitions("q", "place").mapInArrow(_ask(options, every), _ASKED)


def _in_order(pairs: DataFrame, options: Options) -> DataFrame:
    """``pairs`` with ``place``, the order in which a query asks: look-up order, plus strand first; by rank in accurate mode, where the first of equals counts."""
    order = ["strand", "first_word", "r"] if options.mode == "fast" else ["r", "strand"]
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return pairs.select("q", "r", "strand", place.alias("place"), "required_aas", "required_aa1", "least_s", F.lit(None).cast("double").alias("reached"))


def settled(pairs: DataFrame, rows: DataFrame, options: Options) -> DataFrame:
    """Rows of :data:`_ASKED` for ``pairs`` (of :func:`candidates` within ``rows``): with an r, passing pairs of redundant rows and their representatives. Stored.

    Rows without such a pair represent themselves. Each round decides half of the undecided rows at least, or is the last one.
    """
    fast = options.mode == "fast"
    left = greedy.stored(_in_order(pairs, options).withColumn("sure", F.lit(False)))
    open_, answers = left.select("q").distinct().count(), []
    while open_:
        undecided = left.where("not sure").select(F.col("q").alias("r")).distinct().withColumn("later", F.lit(True))
        marked = greedy.stored(left.join(undecided, "r", "left"))
        answers.append(greedy.stored(asked(marked.where("later is null").drop("later", "sure"), rows, rows, options)))
        passed = answers[-1].where("r is not null").select("q", F.col("identity").cast("double").alias("identity"), F.col("distance").cast("double").alias("distance"), F.col("place").alias("at"))
        rest = marked.where("later").drop("later").join(passed.select(F.col("q").alias("r")), "r", "left_anti").join(passed, "q", "left")
        # in fast mode only what comes before a representative that passes can still take its place
        rest = rest.where("at is null or place < at") if fast else rest
        score = F.col("identity") if options.distance is None else -F.col("distance")
        rest = rest.select("q", "r", "strand", "place", "required_aas", "required_aa1", "least_s", F.greatest("reached", score).alias("reached"), (F.col("sure") | F.col("at").isNotNull()).alias("sure"))
        greedy.forget(left)
        left = greedy.stored(rest)
        greedy.forget(marked)
        before, open_ = open_, left.where("not sure").select("q").distinct().count()
        if 2 * open_ > before or (not open_ and not left.isEmpty()):
            answers.append(greedy.stored(_together(left, rows, options)))
            break
    greedy.forget(left)
    if not answers:
        return rows.sparkSession.createDataFrame([], _ASKED)
    return rows.sparkSession.read.schema(answers[0].schema).parquet(*(x.inputFiles()[0].rsplit("/", 1)[0] for x in answers if x.inputFiles()))


def _together(left: DataFrame, rows: DataFrame, options: Options) -> DataFrame:
    """What is left of the rounds, all aligned: rows of :data:`_ASKED`, with an r only for pairs with a representative."""
    found = greedy.stored(asked(left.drop("sure"), rows, rows, options, every=True))
    sure = left.where("sure").select("q").distinct()
    status = greedy.representatives(found.where("r is not null").select("q", "r").join(sure, "q", "left_anti"))
    return found.join(status.where("not is_rep").select(F.col("rank").alias("r")), "r", "left_anti").select(*(c.split()[0] for c in _ASKED.split(", ")))


def _best(answers: DataFrame, options: Options) -> DataFrame:
    """One answer for each query that has any: the first in its order, or in accurate mode the best."""
    found = answers.where("r is not null")
    score = F.lit(0) if options.mode == "fast" else -F.col("identity") if options.distance is None else F.col("distance")
    return found.groupBy("q").agg(F.min_by(F.struct(*(c for c in found.columns if c != "q")), F.struct(score, "place")).alias("x")).select("q", "x.*")


def _accept(row: dict, q: np.ndarray, r: np.ndarray, a: A.Alignment, o: Options) -> tuple | None:
    """The row of an accepted pair. Shares are single, cut-offs double precision, as identities on the border tell."""
    if not a.ok:
        return None
    matches = a.matches if o.global_identity else a.local_matches
    if matches < row["required_aa1"]:
        return None
    short, long_ = min(len(q), len(r)), max(len(q), len(r))
    length = short - a.masked if o.global_identity else a.local_length - a.masked
    if length <= 0:
        return None
    identity = np.float32(matches) / np.float32(length)
    if o.distance is None:
        if (float(identity) if o.strict_float else float(identity) + 1e-6) < o.identity:
            return None
    elif a.distance > o.distance:
        return None
    if o.longest_gap is not None and (a.longest_gap > o.longest_gap or a.q_beg > 2 or a.r_beg > 2):
        return None
    if a.overhang > min(o.unmatched, len(q) * o.unmatched_short, len(r) * o.unmatched_long):
        return None
    if o.cover_short > 0 or o.cover_least > 0:
        least_l = max(int(len(r) * o.cover_long), len(r) - o.cover_long_gap, o.cover_least)
        if a.r_end - a.r_beg + 1 < least_l or a.q_end - a.q_beg + 1 < row["least_s"]:
            return None
    beg, end = (a.q_beg, a.q_end) if row["strand"] == "+" else (len(q) - a.q_beg + 1, len(q) - a.q_end + 1)
    return row["q"], row["r"], row["strand"], float(identity), a.distance, min(length, long_), beg, end, a.r_beg, a.r_end, row["place"]


def _members(rows: DataFrame, chosen: DataFrame, options: Options) -> DataFrame:
    """Cluster rows from ``rows`` with rep_rank, is_rep, cluster_id and the alignments to their representatives."""
    pairs = chosen.select(F.col("q").alias("rank"), F.col("r").alias("rep_rank"), "strand", "identity", "distance", "q_beg", "q_end", "r_beg", "r_end")
    out = rows.join(pairs, ["rank", "rep_rank"], "left")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("rank")) - 1
    return out.withColumn("member_no", place.cast("long")).withColumn("unit", F.lit(options.alphabet))


def cluster(sequences: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Greedy clusters of (seq_idx, seq): cluster_id, member_no, seq_idx, len, unit, is_rep, strand, identity, distance and extents.

    fast: the first passing representative in look-up order; accurate: the most identical.
    """
    rows = greedy.stored(prepare(sequences, options))
    one = greedy.stored(_best(settled(candidates(rows, rows, options, within=True), rows, options), options))
    placed = greedy.placed(rows, one.select(F.col("q").alias("rank"), F.col("r").alias("rep_rank")))
    out = _members(placed, one, options)
    keep = ["cluster_id", "member_no", "seq_idx", "len", "unit", "is_rep", "strand", "identity", "distance", "q_beg", "q_end", "r_beg", "r_end"]
    if options.sort_clusters:
        size = F.count("*").over(Window.partitionBy("cluster_id"))
        heads = ranking.numbered(out.withColumn("size", size).where("is_rep").select("cluster_id", "size"), F.desc("size"), "cluster_id", name="new").withColumnRenamed("cluster_id", "old")
        out = out.join(heads, F.col("cluster_id") == F.col("old")).withColumn("cluster_id", F.col("new"))
    return out.select(*keep)


def compare(first: DataFrame, second: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Each sequence of ``second`` with the sequence of ``first`` that it joins: q (its seq_idx), r, strand, identity, distance, extents.

    Every row of ``first`` is a representative; there is no order among queries, so this is one join and one ranking.
    """
    rows, queries = greedy.stored(prepare(first, options)), greedy.stored(prepare(second, options, ranked=False))
    pairs = greedy.stored(_in_order(candidates(queries, rows, options, within=False), options))
    best = asked(pairs, queries, rows, options).where("r is not null")
    names = rows.select(F.col("rank").alias("r"), F.col("seq_idx").alias("r_idx"))
    return best.join(names, "r").select("q", F.col("r_idx").alias("r"), "strand", "identity", "distance", "q_beg", "q_end", "r_beg", "r_end")


def unmatched(second: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of ``second`` that join nothing."""
    return second.join(hits.select(F.col("q").alias("seq_idx")), "seq_idx", "left_anti")


def incremental(reps: DataFrame, batch: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """New rows against known representatives, the rest among themselves: (hits, clusters of the rest)."""
    hits = greedy.stored(compare(reps, batch, options))
    return hits, cluster(unmatched(batch, hits), options)


def hierarchical(sequences: DataFrame, *levels: Options) -> list[DataFrame]:
    """Clusters, then clusters of their representatives at each further level."""
    out, rows = [], sequences
    for options in levels:
        clusters = greedy.stored(cluster(rows, options))
        out.append(clusters)
        rows = rows.join(clusters.where("is_rep").select("seq_idx"), "seq_idx", "left_semi")
    return out
