"""Queries on alignments, reads and hits. Those that SQL can't express are held against plain versions in the tests."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.functions.storage import shared_folder
from kinstrand.operators import chimeras, duplicates, evaluation, greedy, hsp, ranking, reads, similarity
from kinstrand.operators.similarity import Options
from kinstrand.operators.word_index import WordIndex
from kinstrand.plans import pipelines
from kinstrand.plans.cluster_queries import with_places
from kinstrand.plans.fixtures import AA, CLUSTERS, clusters, table
from kinstrand.sources import formats

QUERIES, SQL = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _turns(s, d, nucleotides=False):
    """Whole turns of conversations as sequences; turns of one number are told apart by the order of role and text."""
    same = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = table(s, d, "conversations").withColumn("same", same)
    rows = rows.select(((F.col("conv_id") * 1000 + F.col("turn")) * 100 + F.col("same") - 1).alias("seq_idx"), S.letters_only(F.coalesce("text", F.lit(""))).alias("seq")).where(F.length("seq") > 10)
    return rows.withColumn("seq", S.as_nucleotides("seq")) if nucleotides else rows


_TURNS = f"SELECT (conv_id * 1000 + turn) * 100 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) - 1 AS seq_idx, {AA} AS seq FROM conversations QUALIFY length({AA}) > 10"


def _items(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("seq_idx"), S.letters_only("text").alias("seq"))


_add("cluster_align_aa", lambda s, d: similarity.cluster(_turns(s, d), Options(identity=0.8)))
_add("cluster_align_aa_accurate", lambda s, d: similarity.cluster(_turns(s, d), Options(identity=0.8, mode="accurate")))
_add("cluster_align_nt", lambda s, d: similarity.cluster(_turns(s, d, True), Options.nucleotide(identity=0.9)))
_add("cluster_2d_aa", lambda s, d: similarity.compare(_items(s, d), _turns(s, d), Options(identity=0.6, word=4, length_share2=0.5, length_gap2=similarity.UNSET)))


def _in_fragments(s, d):
    """Candidates by words of neighbouring stretches of thirty letters: four of them, as a distance of a tenth leaves."""
    options = Options(distance=0.1, fragment=30, length_share2=0.1, length_gap2=similarity.UNSET)
    rows, queries = greedy.stored(similarity.prepare(_items(s, d), options)), greedy.stored(similarity.prepare(_turns(s, d), options, ranked=False))
    return similarity.candidates(queries, rows, options, within=False).select("q", "r", "shared")


_CODED = f"translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{''.join(chr(97 + S.AMINO_CODES[c]) for c in 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}')"
_add("candidates_fragments", _in_fragments, f"""WITH q AS (SELECT seq_idx AS q, length(seq) AS len, {_CODED} AS seq FROM ({_TURNS})), r AS (SELECT row_number() OVER (ORDER BY length(seq) DESC, item_id) - 1 AS r, {_CODED} AS seq FROM (SELECT item_id, {AA} AS seq FROM benchmark) WHERE length(seq) > 10),
  a AS (SELECT q, len, substring(seq, i::INT, 5) AS word, count(*) AS n FROM (SELECT *, unnest(range(1, len - 3)) AS i FROM q) GROUP BY ALL),
  b AS (SELECT r, (i - 1) // 30 AS frag, substring(seq, i::INT, 5) AS word, count(*) AS m FROM (SELECT *, unnest(range(1, length(seq) - 3)) AS i FROM r) GROUP BY ALL),
  s AS MATERIALIZED (SELECT q, len, r, frag, sum(least(n, m)) AS s FROM a JOIN b USING (word) GROUP BY ALL),
  w AS (SELECT x.q, x.r, x.len, x.frag, sum(y.s) AS shared FROM s x JOIN s y ON x.q = y.q AND x.r = y.r AND y.frag >= x.frag AND y.frag < x.frag + (x.len - 5 + 20) // 30 + 2 GROUP BY ALL)
  SELECT q, r, max(shared)::BIGINT AS shared FROM w GROUP BY q, r, len HAVING max(shared) >= greatest(1, least(4, len - 4))""")  # fmt: skip
_add("pyro_dup", lambda s, d: similarity.cluster(_turns(s, d, True), Options.pyro()))
_add("dup_mismatch", lambda s, d: duplicates.cluster(ranking.rank_by_length(_turns(s, d, True)), errors=2, same_length=True).select("seq_idx", "rank", "rep_rank", "is_rep"),
     f"""WITH RECURSIVE t AS (SELECT seq_idx, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({_TURNS})),
  rk AS (SELECT *, row_number() OVER (ORDER BY length(seq) DESC, seq_idx) - 1 AS rank FROM t), c AS (SELECT seq, min(rank) AS rank FROM rk GROUP BY 1),
  p AS (SELECT a.rank AS q, b.rank AS r FROM c a JOIN c b ON b.rank < a.rank AND length(a.seq) = length(b.seq) AND hamming(a.seq, b.seq) <= 2),
  nb AS (SELECT row_number() OVER (ORDER BY c.rank) - 1 AS i, c.rank, coalesce(list(p.r) FILTER (p.r IS NOT NULL), []) AS ns FROM c LEFT JOIN p ON p.q = c.rank GROUP BY c.rank),
  g(i, reps) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT g.i + 1, CASE WHEN list_has_any(nb.ns, g.reps) THEN g.reps ELSE list_append(g.reps, nb.rank) END FROM g JOIN nb ON nb.i = g.i + 1),
  reps AS (SELECT unnest(reps) AS r FROM g WHERE i = (SELECT max(i) FROM g)), best AS (SELECT q, min(r) AS r FROM p WHERE r IN (FROM reps) AND q NOT IN (FROM reps) GROUP BY 1)
  SELECT rk.seq_idx, rk.rank, coalesce(best.r, c.rank) AS rep_rank, coalesce(best.r, c.rank) = rk.rank AS is_rep FROM rk JOIN c USING (seq) LEFT JOIN best ON q = c.rank""")  # fmt: skip
_add("lap_overlap", lambda s, d: reads.overlap_clusters(ranking.rank_by_length(_turns(s, d, True)), 12).select("seq_idx", "rank", "is_rep", "rep_rank", F.col("overlap").cast("long").alias("overlap")),
     f"""WITH RECURSIVE t AS (SELECT seq_idx, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({_TURNS})),
  rk AS (SELECT *, row_number() OVER (ORDER BY length(seq) DESC, seq_idx) - 1 AS rank, length(seq) AS n FROM t), qs AS (SELECT rank, '+' AS strand, seq, n FROM rk UNION ALL SELECT rank, '-', reverse(translate(seq, 'ACGT', 'TGCA')), n FROM rk),
  qe AS (SELECT rank, strand, n, k, left(seq, k::INT) AS h, right(seq, k::INT) AS t FROM (SELECT *, unnest(range(12, n + 1)) AS k FROM qs)), re AS (SELECT rank, k, left(seq, k::INT) AS h, right(seq, k::INT) AS t FROM (SELECT *, unnest(range(12, n + 1)) AS k FROM rk)),
  p AS MATERIALIZED (SELECT a.rank AS q, b.rank AS r, strand, a.k AS overlap, 0 AS side FROM qe a JOIN re b ON a.k = b.k AND a.h = b.t AND b.rank < a.rank AND a.k < a.n UNION ALL SELECT a.rank, b.rank, strand, a.k, 1 FROM qe a JOIN re b ON a.k = b.k AND a.t = b.h AND b.rank < a.rank),
  nb AS (SELECT rk.rank, coalesce(list(p.r) FILTER (p.r IS NOT NULL), []) AS ns FROM rk LEFT JOIN p ON p.q = rk.rank GROUP BY rk.rank),
  g(i, reps) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT g.i + 1, CASE WHEN list_has_any(nb.ns, g.reps) THEN g.reps ELSE list_append(g.reps, nb.rank) END FROM g JOIN nb ON nb.rank = g.i + 1),
  reps AS (SELECT unnest(reps) AS r FROM g WHERE i = (SELECT max(i) FROM g)), best AS (SELECT q, r, overlap FROM p WHERE r IN (FROM reps) AND q NOT IN (FROM reps) QUALIFY row_number() OVER (PARTITION BY q ORDER BY side, overlap DESC, strand, r) = 1)
  SELECT seq_idx, rank, best.q IS NULL AS is_rep, coalesce(best.r, rank) AS rep_rank, overlap FROM rk LEFT JOIN best ON best.q = rank""")  # fmt: skip
_add("overlap_pairs", lambda s, d: reads.overlap_pairs(ranking.rank_by_length(_turns(s, d)), 12, both_strands=False).select("q", "r", F.col("overlap").cast("long").alias("overlap"), F.col("side").cast("long").alias("side")),
     f"""WITH rk AS (SELECT *, row_number() OVER (ORDER BY length(seq) DESC, seq_idx) - 1 AS rank, length(seq) AS n FROM ({_TURNS})),
  c AS (SELECT rank, seq, n, unnest(range(12, n + 1)) AS k FROM rk),
  ends AS (SELECT rank, k, right(seq, k::INT) AS t, left(seq, k::INT) AS h, n FROM c)
  SELECT a.rank AS q, b.rank AS r, a.k AS overlap, 0::BIGINT AS side FROM ends a JOIN ends b ON a.k = b.k AND a.h = b.t AND b.rank < a.rank AND a.k < a.n
  UNION ALL SELECT a.rank, b.rank, a.k, 1 FROM ends a JOIN ends b ON a.k = b.k AND a.t = b.h AND b.rank < a.rank""")  # fmt: skip


def _mates(s, d):
    """Both halves of a turn, overlapping by twelve letters, the second turned round."""
    rows = _turns(s, d, True).withColumn("h", F.floor(F.length("seq") / 2).cast("int"))
    return rows.select(F.col("seq_idx").alias("id"), F.substr("seq", F.lit(1), F.col("h") + 6).alias("r1"), S.reverse_complement(F.substr("seq", F.greatest(F.col("h") - 5, F.lit(1)), F.length("seq"))).alias("r2"))


_add("read_link", lambda s, d: reads.link_mates(_mates(s, d), 10, 1), f"""WITH t AS (SELECT seq_idx AS id, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({_TURNS})),
  m AS (SELECT id, substring(seq, 1, (length(seq) // 2 + 6)::INT) AS a, substring(seq, greatest(length(seq) // 2 - 5, 1)::INT) AS b FROM t),
  k AS (SELECT *, unnest(range(10, least(length(a), length(b)) + 1))::INT AS k FROM m), w AS (SELECT *, hamming(right(a, k), left(b, k)) AS wrong FROM k),
  x AS (SELECT * FROM w WHERE wrong <= 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
  p AS (SELECT *, coalesce(list_filter(range(1, k + 1), lambda i: substring(right(a, k), i::INT, 1) <> substring(left(b, k), i::INT, 1))[1] + length(a) - k, 0) AS spot FROM x)
  SELECT id, c AS contig, CASE WHEN c = 1 THEN a || substring(b, k + 1) ELSE left(a, length(a) - k) || b END AS seq, (length(a) + length(b) - k)::BIGINT AS length, k::BIGINT AS overlap, wrong::BIGINT AS mismatch_no, CASE WHEN spot > 0 THEN spot::VARCHAR ELSE '' END AS mismatch_pos
  FROM (SELECT *, unnest(range(1, wrong + 2)) AS c FROM p)""")  # fmt: skip
_add("read_join", lambda s, d: reads.join_mates(_mates(s, d), 30), f"""WITH t AS (SELECT seq_idx AS id, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({_TURNS})),
  m AS (SELECT id, substring(seq, 1, (length(seq) // 2 + 6)::INT) AS r1, substring(seq, greatest(length(seq) // 2 - 5, 1)::INT) AS b FROM t) SELECT id, substring(r1, 1, 30) || right(b, 30) AS seq FROM m""")  # fmt: skip


def _crossed(s, d):
    """Whole turns at their counts, and as rare reads the first half of each with the second half of the next one of its conversation."""
    turns = _turns(s, d, True)
    unique = turns.groupBy("seq").agg(F.min("seq_idx").alias("id"), (F.count("*") + 5).alias("abundance"))
    half = lambda c: F.floor(F.length(c) / 2).cast("int")
    after = F.lead("seq").over(Window.partitionBy(F.floor(F.col("seq_idx") / 100_000)).orderBy("seq_idx"))
    crossed = turns.withColumn("next", after).where("next IS NOT NULL").select("seq_idx", F.concat(F.substr("seq", F.lit(1), half("seq")), F.substr("next", half("next") + 1, F.length("next"))).alias("seq"))
    crossed = crossed.join(unique, "seq", "left_anti").groupBy("seq").agg((-F.min("seq_idx") - 1).alias("id"), F.lit(1).cast("long").alias("abundance"))
    return unique.select("id", "seq", "abundance").unionByName(crossed.select("id", "seq", "abundance"))


_add("chimera_detect", lambda s, d: chimeras.chimeras(_crossed(s, d)), f"""WITH RECURSIVE t AS (SELECT seq_idx, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({_TURNS})),
  u AS (SELECT seq, min(seq_idx) AS id, count(*) + 5 AS ab FROM t GROUP BY seq), nx AS (SELECT *, lead(seq) OVER (PARTITION BY seq_idx // 100000 ORDER BY seq_idx) AS next FROM t),
  cx AS (SELECT left(seq, length(seq) // 2) || substring(next, length(next) // 2 + 1) AS seq, seq_idx FROM nx WHERE next IS NOT NULL),
  rd AS MATERIALIZED (SELECT id, seq, ab, length(seq) AS n FROM u UNION ALL SELECT -min(seq_idx) - 1, seq, 1, length(seq) FROM cx WHERE seq NOT IN (SELECT seq FROM u) GROUP BY seq),
  pm AS MATERIALIZED (SELECT coalesce(max(k) FILTER (k >= 15), 0) AS primer FROM (SELECT a, b, unnest(range(0, length(a) + 1)) AS k FROM (SELECT min(seq) AS a, max(seq) AS b FROM rd)) WHERE left(a, k) = left(b, k)),
  w AS MATERIALIZED (SELECT id, ab, n, primer, i, substring(seq, i, 30) AS w FROM (SELECT *, unnest(range(primer + 1, n - 28)) AS i FROM rd, pm)),
  hits AS (SELECT q.id AS q, p.id AS p, p.i - q.i AS off, count(*) AS c FROM w q JOIN w p ON q.w = p.w AND (p.ab > q.ab OR (p.ab = q.ab AND p.id < q.id)) WHERE q.n >= 60 + q.primer GROUP BY ALL),
  best AS MATERIALIZED (SELECT q, p, off, row_number() OVER (PARTITION BY q, p ORDER BY c DESC, abs(off), off) AS k FROM hits QUALIFY k <= 2),
  laid AS (SELECT DISTINCT q, p, off FROM (SELECT q, p, off FROM best UNION ALL SELECT q, p, 0 FROM best)),
  m AS MATERIALIZED (SELECT q, p, off, a.n, b.n AS pn, floor(0.01::DOUBLE * a.n)::BIGINT AS few, floor(0.015::DOUBLE * a.n)::BIGINT AS most,
    list_filter(range(0, a.n), lambda i: i + off < 0 OR i + off >= b.n OR substring(a.seq, i + 1, 1) <> substring(b.seq, i + off + 1, 1)) AS x FROM laid JOIN rd a ON a.id = q JOIN rd b ON b.id = p),
  ends AS (SELECT *, least(n, pn - off) AS e, list_filter(x, lambda i: i < least(n, pn - off)) AS y FROM m JOIN best USING (q, p, off)),
  tl AS (SELECT q, p, x, e - start AS tail, start FROM (SELECT *, CASE WHEN len(y) > few THEN y[len(y) - few] + 1 ELSE 0 END AS start FROM ends) WHERE e - start >= 30 QUALIFY row_number() OVER (PARTITION BY q, p ORDER BY k) = 1),
  ro AS (SELECT q, p, n, few, most, m.x AS l, coalesce(tl.x, m.x) AS r, coalesce(m.x[few + 1], n) AS head, coalesce(tail, 0) AS tail, start FROM m LEFT JOIN tl USING (q, p) WHERE off = 0),
  mm AS MATERIALIZED (SELECT *, CASE WHEN head + tail >= n THEN len(list_filter(l, lambda i: i < (head + n - tail) // 2)) + len(list_filter(r, lambda i: i >= (head + n - tail) // 2)) ELSE len(l) END AS mm FROM ro),
  x AS (SELECT a.q, a.few, a.most, a.p AS a, b.p AS b, b.start, (a.head + b.start) // 2 AS cut, a.l AS la, b.l AS lb, b.r AS rb FROM mm a JOIN mm b ON a.q = b.q AND a.p <> b.p AND b.start <= a.head, pm WHERE a.head >= primer + 30),
  tr AS (SELECT x.*, -ab AS rank, len(list_filter(la, lambda i: i < cut)) + len(list_filter(rb, lambda i: i >= cut)) AS lo, least(len(list_filter(lb, lambda i: i < cut)), len(list_filter(la, lambda i: i >= cut))) - few - 1 AS hi FROM x JOIN rd ON id = a),
  tq AS (SELECT q, list({{'a': a, 'b': b, 'cut': cut, 'lo': lo, 'hi': hi}} ORDER BY rank, a, start, b) AS ts FROM tr WHERE lo <= least(hi, most) GROUP BY q), cq AS (SELECT q, list({{'p': p, 'mm': mm}}) AS ps FROM mm WHERE mm <= most GROUP BY q),
  nb AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ab DESC, id) - 1 AS i, id, floor(0.01::DOUBLE * n)::BIGINT AS few, floor(0.015::DOUBLE * n)::BIGINT AS most, coalesce(ps, []) AS ps, coalesce(ts, []) AS ts FROM rd LEFT JOIN tq ON tq.q = id LEFT JOIN cq ON cq.q = id WHERE ps IS NOT NULL OR ts IS NOT NULL),
  g(i, dead, id, x) AS (SELECT -1::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::STRUCT(a BIGINT, b BIGINT, cut BIGINT, lo BIGINT, hi BIGINT)
    UNION ALL SELECT i, CASE WHEN m <= few OR y IS NOT NULL THEN list_append(dead, id) ELSE dead END, id, y
    FROM (SELECT *, CASE WHEN m IS NULL OR m > few THEN list_filter(ts, lambda z: NOT list_contains(dead, z.a) AND NOT list_contains(dead, z.b) AND coalesce(m, most) BETWEEN z.lo AND z.hi)[1] END AS y
      FROM (SELECT nb.*, g.dead, list_min(list_transform(list_filter(nb.ps, lambda z: NOT list_contains(g.dead, z.p)), lambda z: z.mm)) AS m FROM g JOIN nb ON nb.i = g.i + 1)))
  SELECT id, x.a AS parent_head, x.b AS parent_tail, x.cut::INT AS crossover FROM g WHERE x IS NOT NULL""")  # fmt: skip
_add("seq_consensus", lambda s, d: evaluation.consensus(_items(s, d)), f"""WITH t AS (SELECT substring({AA}, 1, 45) AS seq FROM benchmark), l AS (SELECT substring(seq, i::INT, 1) AS letter, i AS place FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM t)),
  c AS (SELECT place, letter, count(*) AS c, sum(count(*)) OVER (PARTITION BY place) AS n FROM l GROUP BY 1, 2)
  SELECT place, letter, c / n AS share, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY place ORDER BY c DESC, letter) = 1""")  # fmt: skip
_add("consensus_columns", lambda s, d: evaluation.consensus_length(evaluation.consensus(_items(s, d), 60), low=0.2), """WITH c AS (%s), w AS (SELECT place, sum((share < 0.2)::INT) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w, max(place) OVER () AS m FROM c)
  SELECT coalesce(min(place - 1) FILTER (w = 3 AND place >= m * 0.33), max(place))::BIGINT AS keep FROM w""" % SQL["seq_consensus"].replace("1, 45)", "1, 60)"))  # fmt: skip
_add("splice_ref", lambda s, d: pipelines.splice(_turns(s, d, True), _turns(s, d, True).select("seq_idx", F.lit(5).alias("start")), _turns(s, d, True).select("seq_idx", F.length("seq").alias("start")), 20, 20),
     f"""WITH t AS (SELECT seq_idx, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({_TURNS})) SELECT seq_idx, rpad(substring(seq, 5, 20), 20, 'N') AS r1, reverse(translate(lpad(right(seq, 20), 20, 'N'), 'ACGT', 'TGCA')) AS r2 FROM t""")

# hits made from lines: query = order, subject = supplier
HITS = """SELECT l_orderkey AS qid, 500::BIGINT AS q_len, l_suppkey % 5 AS sid, 400::BIGINT AS s_len, 100 - 100 * l_discount AS iden, (l_quantity::BIGINT + 20) AS aln_len, 0::BIGINT AS mismatches, 0::BIGINT AS gaps,
  (l_partkey % 300 + 1) AS qfrom, (l_partkey % 300 + l_quantity::BIGINT + 20) AS qend,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 250 + 1 ELSE l_partkey % 250 + l_quantity::BIGINT + 20 END AS sfrom, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 250 + l_quantity::BIGINT + 20 ELSE l_partkey % 250 + 1 END AS send,
  l_tax AS evalue, l_extendedprice AS score, CASE WHEN l_linenumber % 2 = 0 THEN '++' ELSE '+-' END AS frame,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS hsp_no FROM lineitem"""


def _hits(s, d):
    n = F.col("l_quantity").cast("long") + 20
    p, even = F.col("l_partkey"), F.col("l_linenumber") % 2 == 0
    low, high = p % 250 + 1, p % 250 + n
    order = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_suppkey") % 5).orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"))
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("qid"), F.lit(500).cast("long").alias("q_len"), (F.col("l_suppkey") % 5).alias("sid"), F.lit(400).cast("long").alias("s_len"), (100 - 100 * F.col("l_discount")).alias("iden"), n.alias("aln_len"),
        F.lit(0).cast("long").alias("mismatches"), F.lit(0).cast("long").alias("gaps"), (p % 300 + 1).alias("qfrom"), (p % 300 + n).alias("qend"), F.when(even, low).otherwise(high).alias("sfrom"), F.when(even, high).otherwise(low).alias("send"),
        F.col("l_tax").alias("evalue"), F.col("l_extendedprice").alias("score"), F.when(even, "++").otherwise("+-").alias("frame"), order.cast("long").alias("hsp_no"),
    )


_H = f"WITH h AS ({HITS})"
_C = ["qid", "sid", "hsp_no", "frame", "aln_len"]
_add("hsp_strand_filter", lambda s, d: hsp.top_strand(_hits(s, d)).select(_C), f"{_H} SELECT qid, sid, hsp_no, frame, aln_len FROM h QUALIFY frame = first(frame) OVER (PARTITION BY qid, sid ORDER BY hsp_no)")
_add("hsp_best_of_subject", lambda s, d: hsp.best_of_subject(_hits(s, d)).select(_C), f"{_H} SELECT qid, sid, hsp_no, frame, aln_len FROM h WHERE hsp_no = 1")
_add("hsp_last_round", lambda s, d: hsp.last_round(_hits(s, d)).select(_C), f"""{_H}, u AS (SELECT *, CASE WHEN score > lag(score) OVER (PARTITION BY qid ORDER BY hsp_no, sid) THEN 1 ELSE 0 END AS up FROM h), r AS (SELECT *, sum(up) OVER (PARTITION BY qid ORDER BY hsp_no, sid) AS round FROM u)
  SELECT qid, sid, hsp_no, frame, aln_len FROM r QUALIFY round = max(round) OVER (PARTITION BY qid)""")  # fmt: skip
_add("hsp_circular", lambda s, d: hsp.rebase_circular(_hits(s, d)).select("qid", "sid", "hsp_no", "qfrom", "qend", "sfrom", "send"), f"""{_H}, b AS (SELECT *, first(least(qfrom, qend)) OVER w - 1 AS q0, first(least(sfrom, send)) OVER w - 1 AS s0 FROM h WINDOW w AS (PARTITION BY qid, sid ORDER BY hsp_no))
  SELECT qid, sid, hsp_no, """ + ", ".join(f"(CASE WHEN {c} - {o} <= 0 THEN {c} - {o} + {n} ELSE {c} - {o} END)::BIGINT AS {c}" for c, o, n in (("qfrom", "q0", "q_len"), ("qend", "q0", "q_len"), ("sfrom", "s0", "s_len"), ("send", "s0", "s_len"))) + " FROM b")  # fmt: skip
_add("hsp_global_identity", lambda s, d: hsp.identity(_hits(s, d)), f"""{_H} SELECT qid, sid, floor(sum(floor(iden * aln_len / 100)) / 400 * 10000) / 100 AS identity, sum(aln_len)::BIGINT AS aln_len, min(evalue) AS evalue, sum(aln_len) / 500 AS q_cover, sum(aln_len) / 400 AS s_cover FROM h GROUP BY 1, 2""")
_add("hsp_local_identity", lambda s, d: hsp.identity(_hits(s, d), local=True), f"{_H} SELECT qid, sid, iden AS identity, aln_len, evalue, aln_len / 500 AS q_cover, aln_len / 400 AS s_cover FROM h WHERE hsp_no = 1")
_add("hsp_accept", lambda s, d: hsp.accept(hsp.identity(_hits(s, d), local=True), 0.95, 0.01, 0.05, 0.1).select("qid", "sid"), f"{_H} SELECT qid, sid FROM h WHERE hsp_no = 1 AND (iden / 100 > 0.95 OR evalue < 0.01) AND aln_len / 500 >= 0.05 AND aln_len / 400 >= 0.1")
_add("hsp_report", lambda s, d: hsp.report(_hits(s, d), 60), f"""{_H} SELECT qid, sid, count(*)::BIGINT AS n_hits, sum(aln_len)::BIGINT AS aligned, string_agg(printf('%d-%d:%d-%d', qfrom, qend, sfrom, send), ',' ORDER BY hsp_no) AS segments FROM h GROUP BY 1, 2 HAVING sum(aln_len) >= 60""")
_CLASH = """k.f <> h.frame OR least(k.qb, h.qb) > greatest(k.qa, h.qa) OR least(k.sb, h.sb) > greatest(k.sa, h.sa)
    OR (h.qa < k.qa) <> CASE WHEN h.frame IN ('++', '--') THEN h.sa < k.sa ELSE h.sb > k.sb END"""
_add("hsp_colinear", lambda s, d: hsp.colinear(_hits(s, d)).select(_C), f"""WITH RECURSIVE h AS MATERIALIZED (SELECT *, least(qfrom, qend) AS qa, greatest(qfrom, qend) AS qb, least(sfrom, send) AS sa, greatest(sfrom, send) AS sb FROM ({HITS})),
  g(qid, sid, i, stay, kept) AS (SELECT qid, sid, 1::BIGINT, true, [{{'f': frame, 'qa': qa, 'qb': qb, 'sa': sa, 'sb': sb}}] FROM h WHERE hsp_no = 1
    UNION ALL SELECT qid, sid, i, stay, CASE WHEN stay THEN list_append(kept, new) ELSE kept END FROM (SELECT g.qid, g.sid, h.hsp_no AS i, len(list_filter(g.kept, lambda k: {_CLASH})) = 0 AS stay, kept, {{'f': h.frame, 'qa': h.qa, 'qb': h.qb, 'sa': h.sa, 'sb': h.sb}} AS new
      FROM g JOIN h ON h.qid = g.qid AND h.sid = g.sid AND h.hsp_no = g.i + 1))
  SELECT h.qid, h.sid, hsp_no, frame, aln_len FROM g JOIN h ON h.qid = g.qid AND h.sid = g.sid AND h.hsp_no = g.i WHERE stay""")  # fmt: skip
_add("hsp_find", lambda s, d: hsp.find(_turns(s, d).select(F.col("seq_idx").alias("id"), "seq"), _items(s, d).select((-F.col("seq_idx") - 1).alias("id"), "seq"), 11).select("qid", "sid", "aln_len", "qfrom", "sfrom"),
     f"""WITH q AS (SELECT seq_idx AS qid, unnest(range(length(seq) - 10)) AS qa, seq FROM ({_TURNS}) WHERE length(seq) >= 11), s AS (SELECT -item_id - 1 AS sid, unnest(range(length(seq) - 10)) AS sa, seq FROM (SELECT item_id, {AA} AS seq FROM benchmark) WHERE length(seq) >= 11),
  m AS (SELECT qid, sid, qa, sa - qa AS dia FROM (SELECT qid, qa, substring(seq, (qa + 1)::INT, 11) AS word FROM q) JOIN (SELECT sid, sa, substring(seq, (sa + 1)::INT, 11) AS word FROM s) USING (word)),
  n AS (SELECT *, CASE WHEN qa - lag(qa) OVER w <= 11 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY qid, sid, dia ORDER BY qa)), i AS (SELECT *, sum(new) OVER (PARTITION BY qid, sid, dia ORDER BY qa) AS island FROM n)
  SELECT qid, sid, (max(qa) - min(qa) + 11)::BIGINT AS aln_len, (min(qa) + 1)::BIGINT AS qfrom, (min(qa) + dia + 1)::BIGINT AS sfrom FROM i GROUP BY qid, sid, dia, island""")  # fmt: skip
_add("hsp_search", lambda s, d: hsp.search(_turns(s, d).select(F.col("seq_idx").alias("id"), "seq"), _items(s, d).select((-F.col("seq_idx") - 1).alias("id"), "seq"), k=8, least=4, evalue=1e-6).select("qid", "sid", "hsp_no", "aln_len", "gaps", "qfrom", "qend", "sfrom", "send", "score"))
_add("psi_windows", lambda s, d: hsp.search_window(ranking.rank_by_length(_turns(s, d)), 0.8), f"SELECT row_number() OVER (ORDER BY length(seq) DESC, seq_idx) - 1 AS rank, ceil(length(seq) * 0.8)::BIGINT AS low, floor(length(seq) / 0.8)::BIGINT AS high FROM ({_TURNS})")


def _hit_clusters(s, d):
    o = table(s, d, "orders")
    ranked = o.select((F.col("o_orderkey")).alias("rank"), F.lit(100).alias("len"))
    pairs = o.select(F.col("o_orderkey").alias("qid"), F.floor(F.col("o_orderkey") / 3).cast("long").alias("sid"), (F.col("o_orderkey") % 5).cast("double").alias("evalue"))
    keys = o.select(F.col("o_orderkey").alias("sid"))
    return hsp.cluster(ranked, pairs.join(keys, "sid", "left_semi")).select("rank", "rep_rank", "is_rep")


# each order may join one other only, the third of its number, so a chain of joins settles who represents
_add("cluster_hits", _hit_clusters, """WITH RECURSIVE o AS (SELECT o_orderkey AS k FROM orders), e AS (SELECT a.k AS q, b.k AS r FROM o a JOIN o b ON b.k = a.k // 3 WHERE a.k <> b.k),
  s(k, is_rep, rep) AS (SELECT k, true, k FROM o WHERE k NOT IN (SELECT q FROM e) UNION ALL SELECT q, NOT is_rep, CASE WHEN is_rep THEN s.k ELSE q END FROM e JOIN s ON s.k = r) SELECT k AS rank, rep AS rep_rank, is_rep FROM s""")  # fmt: skip

# formats
_add("clstr_text", lambda s, d: formats.cluster_text(clusters(s, d).withColumn("unit", F.lit("aa"))), f"""WITH c AS ({CLUSTERS}) SELECT cluster_id, '>Cluster ' || cluster_id || chr(10) || string_agg(member_no || chr(9) || len || 'aa, >' || id || '... ' || CASE WHEN is_rep THEN '*' ELSE 'at ' || printf('%.2f', identity) || '%' END, chr(10) ORDER BY member_no) AS value FROM c GROUP BY 1""")
_add("clstr_text_places", lambda s, d: formats.cluster_text(with_places(clusters(s, d)).withColumns({"unit": F.lit("nt"), "strand": F.lit("+")}), places=True, width=20), f"""WITH c AS ({CLUSTERS}) SELECT cluster_id, '>Cluster ' || cluster_id || chr(10) || string_agg(member_no || chr(9) || len || 'nt, >' || substring(id, 1, 19) || '... ' || CASE WHEN is_rep THEN '*' ELSE 'at 1:' || len || ':' || (member_no + 1) || ':' || (member_no + len) || '/+/' || printf('%.2f', identity) || '%' END, chr(10) ORDER BY member_no) AS value FROM c GROUP BY 1""")
_add("clstr_backup", lambda s, d: formats.backup_lines(clusters(s, d).withColumns({"unit": F.lit("aa"), "seq_idx": F.col("id")})).withColumnRenamed("seq_idx", "id"), f"""WITH c AS ({CLUSTERS}) SELECT id, cluster_id || chr(9) || member_no || chr(9) || len || 'aa, >' || id || '... ' || CASE WHEN is_rep THEN '*' ELSE 'at ' || printf('%.2f', identity) || '%' END AS value FROM c""")
_add("fasta_text", lambda s, d: table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("descr"), S.letters_only("text").alias("seq_raw")).select("doc_id", formats.fasta_text().alias("value")), f"SELECT doc_id, '>' || doc_id || chr(10) || {AA} AS value FROM documents")
_add("annotate_refs", lambda s, d: formats.annotate_references(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("ACGU").alias("seq_raw")), table(s, d, "nation").where("n_nationkey > 3").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text"))).select("id", "descr", "seq_raw"),
     "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey || CASE WHEN n_nationkey > 3 THEN '|' || n_name ELSE '' END AS descr, 'ACGT' AS seq_raw FROM nation")


# incremental: first turns of a number go into a growing index, others of it follow
def _incremental(s, d):
    rows = greedy.stored(_turns(s, d))
    index = WordIndex(s, f"{shared_folder(s)}/kinstrand/index-{uuid.uuid4().hex}", Options(identity=0.8))
    first = F.col("seq_idx") % 100_000 < 100
    index.grow(rows.where(first), 0)
    hits, rest = index.grow(rows.where(~first), 1)
    return hits.select(F.col("q").alias("seq_idx"), F.lit("old").alias("joins")).unionByName(rest.select("seq_idx", F.when(F.col("is_rep"), "none").otherwise("new").alias("joins")))


_add("incremental_cluster", _incremental)
_add("hierarchy", lambda s, d: pipelines.down_to(_turns(s, d), _turns(s, d).select("seq_idx", F.col("seq_idx").cast("string").alias("id")), 0.9, 0.6).select("cluster_id", "id", "is_rep"))
