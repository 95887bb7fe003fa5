"""Queries on sequences, words, greedy and duplicate clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinstrand.functions import kmers as K
from kinstrand.functions import sequences as S
from kinstrand.operators import duplicates, fragments, greedy, ranking
from kinstrand.plans.fixtures import AA, NT, aa, aa_sql, ranked, ranked_sql, table

QUERIES, SQL = {}, {}


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


_BODY = r"regexp_replace(regexp_replace(text, '\s+$', ''), '\*$', '')"
_TEXTS = lambda s, d: table(s, d, "documents").select("doc_id", "text")
_LINES = lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "[.]")).alias("text"))
_LINES_SQL = "(SELECT doc_id, unnest(string_split(coalesce(text, ''), '.')) AS text FROM documents)"
_add("seq_normalize", lambda s, d: _LINES(s, d).where(S.is_valid("text")).select("doc_id", S.normalise("text").alias("seq")),
     rf"SELECT doc_id, upper(regexp_replace({_BODY}, '\s+', '', 'g')) AS seq FROM {_LINES_SQL} WHERE NOT regexp_matches({_BODY}, '[^A-Za-z\s]')")
_add("seq_invalid", lambda s, d: _LINES(s, d).where(~S.is_valid("text")).groupBy("doc_id").agg(F.count("*").alias("n")),
     rf"SELECT doc_id, count(*)::BIGINT AS n FROM {_LINES_SQL} WHERE regexp_matches({_BODY}, '[^A-Za-z\s]') GROUP BY 1")
_add("seq_letters", lambda s, d: _TEXTS(s, d).select("doc_id", S.letters_only("text").alias("seq")), f"SELECT doc_id, {AA} AS seq FROM documents")
_add("seq_short_id", lambda s, d: table(s, d, "pages").select("page_id", S.short_id(F.concat(F.lit("> "), F.regexp_replace("url", "[/?]", " "))).alias("id"), S.short_id(F.concat(F.lit(">"), "url"), 20).alias("id20")),
     r"SELECT page_id, regexp_extract(regexp_replace('> ' || regexp_replace(url, '[/?]', ' ', 'g'), '^[>@+]? ?', ''), '^\S*') AS id, substring(regexp_extract(url, '^\S*'), 1, 19) AS id20 FROM pages")
_add("seq_trim", lambda s, d: aa(s, d, 300), aa_sql(300))  # trimming is the feature
_add("seq_mask", lambda s, d: aa(s, d).select("seq_idx", S.mask("seq", "QX").alias("seq")), f"SELECT seq_idx, translate(seq, 'QX', '##') AS seq FROM ({aa_sql()})")
_NTS = lambda s, d: aa(s, d).select("seq_idx", S.as_nucleotides("seq").alias("seq"))
_NTS_SQL = f"SELECT doc_id AS seq_idx, {NT} AS seq FROM documents WHERE length({AA}) > 10"
_add("seq_revcomp", lambda s, d: _NTS(s, d).select("seq_idx", S.reverse_complement("seq").alias("seq")), f"SELECT seq_idx, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM ({_NTS_SQL})")
_add("seq_encode_nt", lambda s, d: _NTS(s, d).select("seq_idx", S.encode_nucleotides("seq").alias("seq")), f"SELECT seq_idx, translate(seq, 'ACGT', '0123') AS seq FROM ({_NTS_SQL})")
_add("seq_encode_aa", lambda s, d: aa(s, d).select("seq_idx", S.encode_residues("seq").alias("seq")),
     f"SELECT seq_idx, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{''.join(chr(97 + S.AMINO_CODES[c]) for c in 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}') AS seq FROM ({aa_sql()})")
_add("seq_hash", lambda s, d: _TEXTS(s, d).select("doc_id", F.md5("text").alias("md5"), F.hex("text").alias("hex")), "SELECT doc_id, md5(text) AS md5, hex(encode(text)) AS hex FROM documents")
_add("seq_prefix_compare", lambda s, d: aa(s, d).join(table(s, d, "benchmark").select("item_id", S.letters_only("text").alias("b")), F.col("seq_idx") == F.col("item_id")).select("seq_idx", S.common_prefix_length("seq", "b").alias("prefix"), S.mismatches("seq", "b").alias("diff")),
     f"""WITH j AS (SELECT seq_idx, list_transform(range(1, greatest(length(seq), length(b)) + 1), lambda i: substring(seq, i, 1) <> substring(b, i, 1)) AS x, least(length(seq), length(b)) AS n
  FROM ({aa_sql()}) JOIN (SELECT item_id, {AA} AS b FROM benchmark) ON seq_idx = item_id)
  SELECT seq_idx, coalesce(nullif(list_position(x, true), 0) - 1, n)::BIGINT AS prefix, len(list_filter(x, lambda y: y))::BIGINT AS diff FROM j""")  # fmt: skip
_add("seq_length_rank", lambda s, d: ranked(s, d).select("seq_idx", F.col("len").cast("long").alias("len"), "rank"), f"SELECT seq_idx, len, rank FROM ({ranked_sql()})")
_add("db_stats_n50", lambda s, d: ranking.statistics(aa(s, d)), f"""WITH q AS (SELECT length(seq) AS len FROM ({aa_sql()})), c AS (SELECT len, sum(len) OVER (ORDER BY len DESC) AS upto FROM q)
  SELECT count(*)::BIGINT AS n, sum(len)::BIGINT AS letters, min(len)::BIGINT AS min_len, max(len)::BIGINT AS max_len, (SELECT max(len) FROM c WHERE upto >= (SELECT sum(len) // 2 FROM q))::BIGINT AS n50 FROM q""")  # fmt: skip
_add("div_by_letters", lambda s, d: ranking.divide_by_letters(ranked(s, d), 4).select("seq_idx", "part"), f"""WITH RECURSIVE q AS ({ranked_sql()}), l AS (SELECT sum(len) // 4 + max(len) AS cap FROM q),
  f(rank, part, acc) AS (SELECT -1::BIGINT, 0::BIGINT, 0::HUGEINT UNION ALL SELECT q.rank, CASE WHEN f.acc >= cap THEN f.part + 1 ELSE f.part END, CASE WHEN f.acc >= cap THEN 0 ELSE f.acc END + q.len FROM f JOIN q ON q.rank = f.rank + 1, l)
  SELECT seq_idx, part FROM f JOIN q USING (rank)""")  # fmt: skip
_add("div_round_robin", lambda s, d: ranking.divide_round_robin(ranked(s, d), 5, "rank").select("seq_idx", "part"), f"SELECT seq_idx, (rank % 5)::BIGINT AS part FROM ({ranked_sql()})")
_add("seq_fetch_ids", lambda s, d: fragments.fetch(_TEXTS(s, d), table(s, d, "labels").where("toxic = 1"), "doc_id"), "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_add("seq_exclude_ids", lambda s, d: fragments.exclude(_TEXTS(s, d), table(s, d, "labels"), "doc_id"), "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
_add("pool_union", lambda s, d: fragments.pool({"d": table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "b": table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")}),
     "SELECT 'd|' || doc_id AS id, text FROM documents UNION ALL SELECT 'b|' || item_id, text FROM benchmark")
_add("seq_abundance", lambda s, d: table(s, d, "orders").select("o_orderkey", S.abundance(F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("read_abundance_"), F.col("o_orderkey") % 9 + 1)).otherwise("none")).alias("abundance")),
     "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 9 + 1 ELSE 1 END::BIGINT AS abundance FROM orders")
_LINEAGE = lambda s, d: table(s, d, "part").select("p_partkey", F.concat_ws(";", F.concat(F.lit("k__"), F.translate("p_brand", "#", "_")), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("g__"), F.element_at(F.split("p_type", " "), 1))), F.concat(F.lit("s__"), F.when(F.col("p_size") % 2 > 0, F.concat("p_type", F.lit("."))).otherwise(""), F.translate("p_name", " ", "_"))).alias("t"))
_add("taxon_fields", lambda s, d: _LINEAGE(s, d).select("p_partkey", S.taxon("t", "k").alias("k"), S.taxon("t", "g").alias("g"), S.species_name(S.taxon("t", "g"), S.taxon("t", "s")).alias("s")),
     "SELECT p_partkey, translate(p_brand, '#', '_') AS k, g, CASE WHEN g IS NULL OR starts_with(x, g) THEN x ELSE g || '_' || x END AS s FROM (SELECT *, CASE WHEN p_size % 3 > 0 THEN split_part(p_type, ' ', 1) END AS g, CASE WHEN p_size % 2 > 0 THEN p_type || '.' ELSE '' END || translate(p_name, ' ', '_') AS x FROM part)")


# mates: a user turn and the assistant turn after it
def _pairs(s, d):
    c = table(s, d, "conversations").where("text is not null")
    a = c.where("role = 'user'").select("conv_id", "turn", S.letters_only("text").alias("r1"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), S.letters_only("text").alias("r2"))
    return a.join(b, ["conv_id", "turn"])


_PAIRS = f"(SELECT a.conv_id, a.turn, {AA.replace('text', 'a.text')} AS r1, {AA.replace('text', 'b.text')} AS r2 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant' WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"
_add("mate_zip", lambda s, d: _pairs(s, d).where(F.length("r1") + F.length("r2") > 10), f"SELECT * FROM {_PAIRS} WHERE length(r1) + length(r2) > 10")
_add("pe_merge", lambda s, d: _pairs(s, d).select("conv_id", "turn", S.merge_mates("r1", "r2").alias("seq"), F.length("r2").cast("long").alias("len_r2")), f"SELECT conv_id, turn, reverse(r2) || r1 AS seq, length(r2)::BIGINT AS len_r2 FROM {_PAIRS}")
_add("pe_pad_join", lambda s, d: _pairs(s, d).select("conv_id", "turn", S.pad_and_join("r1", "r2", 50).alias("seq")), f"SELECT conv_id, turn, rpad(r1, 50, 'N') || rpad(r2, 50, 'N') AS seq FROM {_PAIRS}")

# words
_K = 10
_POST = f"post AS (SELECT rank, word, count(*)::INT AS cnt FROM (SELECT rank, substring(seq, i::INT, {_K}) AS word FROM (SELECT rank, seq, unnest(range(1, length(seq) - {_K} + 2)) AS i FROM rk)) GROUP BY ALL)"


def _post(s, d):
    return K.postings(ranked(s, d).select("rank", "seq"), _K)


_add("kmer_counts", lambda s, d: _post(s, d), f"WITH rk AS ({ranked_sql()}), {_POST} SELECT rank, word, cnt FROM post")
_add("kmer_index", lambda s, d: K.word_totals(aa(s, d), _K).where("n_sequences > 1"),
     f"WITH rk AS ({ranked_sql()}), {_POST} SELECT word, count(*)::BIGINT AS n_sequences, sum(cnt)::BIGINT AS n_words FROM post GROUP BY 1 HAVING count(*) > 1")
_SHARED = f"WITH rk AS ({ranked_sql()}), {_POST}, sh AS (SELECT a.rank AS q, b.rank AS r, sum(least(a.cnt, b.cnt))::BIGINT AS shared, min(word) AS first_word FROM post a JOIN post b USING (word) WHERE b.rank < a.rank GROUP BY 1, 2)"


def _shared(s, d, need=None, **more):
    """Pairs of ranks that share ``need`` words or more."""
    return K.pairs_in_blocks(ranked(s, d).select("rank", "seq", need.alias("need"), *(c.alias(n) for n, c in more.items())), _K)


_add("shared_words", lambda s, d: _shared(s, d, F.lit(20)), f"{_SHARED} SELECT * FROM sh WHERE shared >= 20")
_add("length_bounds", lambda s, d: ranked(s, d).select("seq_idx", S.upper_length("len", s=0.8, S=40).alias("longest"), S.lower_length("len", 0.9, 5).alias("shortest"), S.coverage_minimum("len", 0.8, 30, 10).alias("cover")),
     f"SELECT seq_idx, least(floor(len::FLOAT / 0.8), len + 40)::BIGINT AS longest, least(len - 5, floor(len * 0.9))::BIGINT AS shortest, greatest(floor(len * 0.8), len - 30, 10)::BIGINT AS cover FROM ({ranked_sql()})")


def _required_sql(c: float, k: int) -> str:
    ss, sk = max(1 - 2 * (1 - c), K.kept_share(c, 2)), max(1 - k * (1 - c), K.kept_share(c, k))
    return f"""WITH q AS (SELECT seq_idx, len::DOUBLE AS n FROM ({ranked_sql()})), w AS (SELECT *, greatest(0, n - 2 - floor(2 * ceil({1 - c} * n))) AS w2, greatest(0, n - {k} - floor({k} * ceil({1 - c} * n))) AS wk, (n - {k}) / (n * {k}) AS rest FROM q),
  f AS (SELECT *, CASE WHEN {c} > 1 - rest THEN ({c} - (1 - rest)) / rest ELSE 0 END AS fnew FROM w)
  SELECT seq_idx, floor(fnew * w2 + (1 - fnew) * (floor({c} * n) - 1))::BIGINT AS required_aa1, floor(fnew * w2 + (1 - fnew) * floor({ss} * n))::BIGINT AS required_aas, floor(fnew * wk + (1 - fnew) * floor({sk} * n))::BIGINT AS required_aan FROM f"""


_add("required_words", lambda s, d: ranked(s, d).select("seq_idx", *(v.alias(n) for n, v in K.required_words("len", 0.9, 5).items())), _required_sql(0.9, 5))
_add("required_words_distance", lambda s, d: ranked(s, d).select("seq_idx", *(v.alias(n) for n, v in K.required_words("len", 0.95, 10, 4, nucleotides=True, distance=0.03).items())),
     f"SELECT seq_idx, greatest(1, least(33 - 4, len - 3))::BIGINT AS required_aa1, greatest(1, least(33 - 4, len - 3))::BIGINT AS required_aas, greatest(1, least(33 - 10, len - 9))::BIGINT AS required_aan FROM ({ranked_sql()})")


def _passing(s, d, **more):
    """Pairs that share two fifths of the later one's letters or more."""
    return _shared(s, d, F.ceil(F.col("len") * 4 / 10), **more)


_add("candidates", lambda s, d: _passing(s, d).select("q", "r", "shared", "first_word"), f"{_SHARED} SELECT q, r, shared, first_word FROM sh JOIN rk ON rk.rank = q WHERE 10 * shared >= 4 * len")


def greedy_sql(mode: str) -> str:
    order = "first_word, r" if mode == "fast" else "shared DESC, r"
    return f"""WITH RECURSIVE rk AS ({ranked_sql()}), {_POST}, p AS (SELECT a.rank AS q, b.rank AS r, sum(least(a.cnt, b.cnt))::BIGINT AS shared, min(word) AS first_word FROM post a JOIN post b USING (word) WHERE b.rank < a.rank GROUP BY 1, 2),
  pass AS (SELECT p.* FROM p JOIN rk ON rk.rank = q WHERE 10 * shared >= 4 * len),
  nb AS (SELECT rk.rank, coalesce(list(r) FILTER (r IS NOT NULL), []) AS ns FROM rk LEFT JOIN pass ON q = rk.rank GROUP BY 1),
  g(i, reps) AS (SELECT -1::BIGINT, []::BIGINT[] UNION ALL SELECT g.i + 1, CASE WHEN list_has_any(nb.ns, g.reps) THEN g.reps ELSE list_append(g.reps, nb.rank) END FROM g JOIN nb ON nb.rank = g.i + 1),
  reps AS (SELECT unnest(reps) AS r FROM g WHERE i = (SELECT max(i) FROM g)),
  best AS (SELECT q, r FROM pass WHERE r IN (SELECT r FROM reps) AND q NOT IN (SELECT r FROM reps) QUALIFY row_number() OVER (PARTITION BY q ORDER BY {order}) = 1),
  num AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS cluster_id FROM reps)
  SELECT rk.seq_idx, rk.rank, best.q IS NULL AS is_rep, coalesce(best.r, rk.rank) AS rep_rank, num.cluster_id FROM rk LEFT JOIN best ON best.q = rk.rank JOIN num ON num.r = coalesce(best.r, rk.rank)"""


def _greedy(mode):
    def query(s, d):
        pairs = greedy.stored(_passing(s, d).withColumn("score", F.col("shared")))
        return greedy.assign(ranked(s, d), pairs, mode).select("seq_idx", "rank", "is_rep", "rep_rank", "cluster_id")

    return query


_add("cluster_kmer_greedy_fast", _greedy("fast"), greedy_sql("fast"))
_add("cluster_kmer_greedy_accurate", _greedy("accurate"), greedy_sql("accurate"))


# two sets: benchmark is the first; a document joins the item of which it has most words, half of them at least
def _two(s, d):
    first = aa(s, d, name="benchmark", key="item_id").select(F.col("seq_idx").alias("rank"), F.ceil(F.length("seq") * 5 / 10).alias("need"), "seq")
    second = aa(s, d).select(F.col("seq_idx").alias("rank"), F.lit(1).alias("need"), F.lit(1).alias("reach"), "seq")
    pairs = K.pairs_in_stretches(second, first, _K, 0, within=False)
    return pairs.groupBy("q").agg(F.min_by(F.struct("r", "shared"), F.struct(-F.col("shared"), "r")).alias("b")).select("q", "b.r", "b.shared")


_TWO = f"""WITH x AS ({aa_sql()}), y AS ({aa_sql(name='benchmark', key='item_id')}),
  px AS (SELECT seq_idx AS q, substring(seq, i::INT, {_K}) AS word, count(*) AS n FROM (SELECT seq_idx, seq, unnest(range(1, length(seq) - {_K} + 2)) AS i FROM x) GROUP BY 1, 2),
  py AS (SELECT seq_idx AS r, substring(seq, i::INT, {_K}) AS word, count(*) AS m FROM (SELECT seq_idx, seq, unnest(range(1, length(seq) - {_K} + 2)) AS i FROM y) GROUP BY 1, 2),
  sh AS (SELECT q, r, sum(least(n, m))::BIGINT AS shared FROM px JOIN py USING (word) GROUP BY 1, 2),
  hit AS (SELECT q, r, shared FROM sh JOIN y ON seq_idx = r WHERE 10 * shared >= 5 * length(seq) QUALIFY row_number() OVER (PARTITION BY q ORDER BY shared DESC, r) = 1)"""
_add("compare_2d_kmer", _two, f"{_TWO} SELECT q, r, shared FROM hit")
_add("compare_2d_unmatched", lambda s, d: aa(s, d).select("seq_idx").join(_two(s, d).select(F.col("q").alias("seq_idx")), "seq_idx", "left_anti"), f"{_TWO} SELECT seq_idx FROM x WHERE seq_idx NOT IN (SELECT q FROM hit)")

# duplicates
_add("cluster_exact_dup", lambda s, d: duplicates.exact(ranked(s, d)).select("seq_idx", "rank", "rep_rank", "is_rep", "abundance"),
     f"SELECT seq_idx, rank, min(rank) OVER w AS rep_rank, rank = min(rank) OVER w AS is_rep, count(*) OVER w AS abundance FROM ({ranked_sql()}) WINDOW w AS (PARTITION BY seq)")
# reads: the sentences of all texts
_SENTENCES = f"SELECT doc_id * 1000000 + p AS seq_idx, seq FROM (SELECT doc_id, unnest(range(len(x))) AS p, unnest(list_transform(x, lambda t: upper(regexp_replace(t, '[^A-Za-z]', '', 'g')))) AS seq FROM (SELECT doc_id, string_split(coalesce(text, ''), '.') AS x FROM documents)) WHERE length(seq) > 10"
_PREFIX = f"""WITH rk AS (SELECT *, row_number() OVER (ORDER BY len DESC, seq_idx) - 1 AS rank FROM (SELECT seq_idx, seq, length(seq) AS len FROM ({_SENTENCES}))),
  s AS (SELECT seq, len, min(rank) AS rank FROM rk GROUP BY 1, 2), l AS (SELECT DISTINCT len FROM s),
  h AS (SELECT s.rank, l.len, substring(s.seq, 1, l.len::INT) AS head FROM s JOIN l ON l.len < s.len),
  p AS (SELECT s.rank AS q, min(h.rank) AS r FROM s JOIN h ON h.len = s.len AND h.head = s.seq GROUP BY 1)"""


def _reads(s, d):
    parts = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.]")).alias("p", "t"))
    reads = parts.select((F.col("doc_id") * 1000000 + F.col("p")).alias("seq_idx"), S.letters_only("t").alias("seq")).where(F.length("seq") > 10)
    return ranking.rank_by_length(reads)


# the earliest read that another one is a prefix of is a representative: were it a prefix itself, there would be an earlier one
_add("cluster_prefix_dup", lambda s, d: duplicates.cluster(_reads(s, d), 0, same_length=False).select("seq_idx", "rank", "rep_rank", "is_rep"),
     f"{_PREFIX} SELECT rk.seq_idx, rk.rank, coalesce(p.r, s.rank) AS rep_rank, p.r IS NULL AND s.rank = rk.rank AS is_rep FROM rk JOIN s USING (seq) LEFT JOIN p ON p.q = s.rank")
_add("dup_abundance", lambda s, d: ranking.numbered(duplicates.exact(ranked(s, d)).where("is_rep").select("seq_idx", "rank", "abundance"), F.desc("abundance"), "rank", start=1).drop("rank"),
     f"SELECT seq_idx, abundance, row_number() OVER (ORDER BY abundance DESC, rank) AS place FROM (SELECT seq_idx, rank, count(*) OVER w AS abundance, min(rank) OVER w AS m FROM ({ranked_sql()}) WINDOW w AS (PARTITION BY seq)) WHERE m = rank")
# reads that begin with the same letters as far as two texts of one language do: the primer is what all of them share
_add("dup_primer", lambda s, d: duplicates.common_primer(table(s, d, "part").select(F.regexp_replace(F.concat(F.lit("PROMO"), "p_name"), " ", "").alias("seq")), least=3),
     "WITH r AS (SELECT replace('PROMO' || p_name, ' ', '') AS seq FROM part), e AS (SELECT min(seq) AS a, max(seq) AS b FROM r), n AS (SELECT max(i) AS n FROM e, range(0, (SELECT max(length(seq)) + 1 FROM r)) AS t(i) WHERE i <= least(length(a), length(b)) AND left(a, i::INT) = left(b, i::INT)) SELECT CASE WHEN n >= 3 THEN n ELSE 0 END::BIGINT AS primer_length FROM n")
