"""Queries on cluster tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinstrand.functions.sequences import size_class
from kinstrand.functions.storage import stored
from kinstrand.operators import clusters as C
from kinstrand.operators import evaluation as E
from kinstrand.plans.fixtures import CLUSTERS, GRANDPARENTS, PARENTS, clusters, grandparents, parents, table

QUERIES, SQL = {}, {}
_WITH = f"WITH c AS ({CLUSTERS})"
_ROW = "cluster_id, member_no, id, len, is_rep"
_COLUMNS = ["cluster_id", "member_no", "id", "len", "is_rep"]


def _add(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def _case(column: str, classes: str) -> str:
    out = []
    for part in classes.split(","):
        low, _, high = part.partition("-")
        out.append(f"WHEN {column} >= {low}" + ("" if high == "up" else f" AND {column} <= {high or low}") + f" THEN '{part}'")
    return f"CASE {' '.join(out)} END"


SIZES, LENGTHS = "1,2-3,4-5,6-up", "1-10,11-25,26-up"

_add("clstr_rep", lambda s, d: C.representative(clusters(s, d)), f"{_WITH} SELECT cluster_id, max(id) FILTER (is_rep) AS rep, count(*)::BIGINT AS n FROM c GROUP BY 1")
_add("clstr_size_stat", lambda s, d: C.size_statistics(clusters(s, d)),
     f"{_WITH} SELECT size, count(*)::BIGINT AS n_clusters, sum(size)::BIGINT AS n_sequences FROM (SELECT count(*)::BIGINT AS size FROM c GROUP BY cluster_id) GROUP BY 1")
_add("clstr_size_hist", lambda s, d: C.size_histogram(clusters(s, d), 2), f"""{_WITH}, s AS (SELECT count(*) AS n FROM c GROUP BY cluster_id), b AS (SELECT unnest(range((SELECT max((n - 1) // 2) + 1 FROM s))) AS bin)
  SELECT (bin * 2 + 1)::BIGINT AS low, (bin * 2 + 2)::BIGINT AS high, count(n)::BIGINT AS n_clusters, coalesce(sum(n), 0)::BIGINT AS n_sequences FROM b LEFT JOIN s ON (n - 1) // 2 = bin GROUP BY bin""")  # fmt: skip
_add("clstr_len_cross", lambda s, d: C.size_length_table(clusters(s, d), size_class("size", SIZES), size_class("len", LENGTHS)), f"""{_WITH}, x AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM c),
  y AS (SELECT *, {_case('size', SIZES)} AS sc, {_case('len', LENGTHS)} AS lc FROM x)
  SELECT CASE WHEN grouping(sc) = 1 THEN 'total' ELSE sc END AS size_class, CASE WHEN grouping(lc) = 1 THEN 'total' ELSE lc END AS length_class,
    count(*)::BIGINT AS n_sequences, count(DISTINCT cluster_id)::BIGINT AS n_clusters, sum(is_rep::INT)::BIGINT AS n_reps FROM y GROUP BY ROLLUP (sc, lc)""")  # fmt: skip
_add("clstr_size_range", lambda s, d: C.representative(clusters(s, d)).groupBy(size_class("n", SIZES).alias("size_class")).agg(F.count("*").alias("n_clusters")),
     f"{_WITH} SELECT {_case('n', SIZES)} AS size_class, count(*)::BIGINT AS n_clusters FROM (SELECT count(*) AS n FROM c GROUP BY cluster_id) GROUP BY 1")
_add("clstr_txt", lambda s, d: C.flat_table(clusters(s, d)), f"""{_WITH} SELECT id, cluster_id, (count(*) OVER w)::BIGINT AS cluster_size, len, is_rep, CASE WHEN is_rep THEN 100.0 ELSE identity END::DOUBLE AS identity,
  floor(100.0 * len / nullif(max(len) FILTER (is_rep) OVER w, 0))::BIGINT AS coverage, (row_number() OVER (PARTITION BY cluster_id ORDER BY is_rep DESC, len DESC, member_no) - 1)::BIGINT AS place FROM c WINDOW w AS (PARTITION BY cluster_id)""")  # fmt: skip


def with_places(c):
    return c.withColumns({"q_beg": F.lit(1).cast("long"), "q_end": F.col("len"), "r_beg": F.col("member_no") + 1, "r_end": F.col("member_no") + F.col("len")})


_add("clstr_blm8", lambda s, d: C.as_hits(with_places(clusters(s, d))), f"""{_WITH}, m AS (SELECT *, floor((abs(len - 1) + 1) * (100 - identity) / 100)::BIGINT AS mis FROM c)
  SELECT m.id AS qid, r.id AS sid, m.identity AS iden, (abs(m.len - 1) + 1)::BIGINT AS aln_len, mis AS mismatches, 1::BIGINT AS qfrom, m.len AS qend, m.member_no + 1 AS sfrom, m.member_no + m.len AS send,
    (3 * (abs(m.len - 1) + 1) - 6 * mis)::BIGINT AS bits FROM m JOIN c r ON m.cluster_id = r.cluster_id AND r.is_rep WHERE NOT m.is_rep""")  # fmt: skip


def _renumbered(key: str) -> str:
    return f"""{_WITH}, h AS (SELECT cluster_id, row_number() OVER (ORDER BY {key}, cluster_id) - 1 AS new FROM c GROUP BY cluster_id)
  SELECT new::BIGINT AS cluster_id, (row_number() OVER (PARTITION BY new ORDER BY member_no) - 1)::BIGINT AS member_no, id, len, is_rep FROM c JOIN h USING (cluster_id)"""


_add("clstr_sort_size", lambda s, d: C.sort_by_size(clusters(s, d)).select(_COLUMNS), _renumbered("count(*) DESC"))
_add("clstr_sort_len", lambda s, d: C.sort_by_length(clusters(s, d)).select(_COLUMNS), _renumbered("max(len) DESC"))
_add("clstr_renumber", lambda s, d: C.renumber(clusters(s, d)).select(_COLUMNS), f"""{_WITH} SELECT dense_rank() OVER (ORDER BY cluster_id) - 1 AS cluster_id, member_no, id, len, is_rep FROM c""")
_add("clstr_sort_members", lambda s, d: C.sort_members(clusters(s, d)).select(_COLUMNS),
     f"{_WITH} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY is_rep DESC, len DESC, member_no) - 1 AS member_no, id, len, is_rep FROM c")
_add("clstr_sort_members_by_id", lambda s, d: C.sort_members(clusters(s, d), "id").select(_COLUMNS),
     f"{_WITH} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY is_rep DESC, id, member_no) - 1 AS member_no, id, len, is_rep FROM c")
_add("clstr_cut_top", lambda s, d: C.cut_top(clusters(s, d), 3).select(_COLUMNS), f"{_WITH} SELECT {_ROW} FROM c WHERE member_no < 3")
_add("clstr_select", lambda s, d: C.select_by_size(clusters(s, d), 2, 4).select(_COLUMNS), f"{_WITH} SELECT {_ROW} FROM c QUALIFY count(*) OVER (PARTITION BY cluster_id) BETWEEN 2 AND 4")
_add("clstr_select_rep", lambda s, d: C.select_ids(clusters(s, d), 3), f"{_WITH} SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM c) WHERE n >= 3 AND is_rep")
_add("clstr_select_seq", lambda s, d: C.select_ids(clusters(s, d), 1, 2, reps_only=False), f"{_WITH} SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM c) WHERE n <= 2")
_add("clstr_reduce", lambda s, d: C.reduce_classes(clusters(s, d), size_class("size", SIZES), 10).select(_COLUMNS), f"""{_WITH}, z AS (SELECT cluster_id, {_case('count(*)', SIZES)} AS sc FROM c GROUP BY cluster_id),
  k AS (SELECT cluster_id FROM z QUALIFY (row_number() OVER (PARTITION BY sc ORDER BY cluster_id) - 1) % 10 = 0) SELECT {_ROW} FROM c WHERE cluster_id IN (SELECT cluster_id FROM k)""")  # fmt: skip
_P = f"WITH c AS ({CLUSTERS}), p AS ({PARENTS})"
_add("clstr_rev_expand", lambda s, d: C.expand(parents(s, d), clusters(s, d)), f"""{_P} SELECT p.cluster_id, (row_number() OVER (PARTITION BY p.cluster_id ORDER BY p.member_no, c.member_no) - 1)::BIGINT AS member_no, c.id, c.len,
  p.is_rep AND c.is_rep AS is_rep, concat_ws(',', CASE WHEN p.is_rep THEN '*' ELSE printf('%.2f', p.identity) END, CASE WHEN c.is_rep THEN '*' ELSE printf('%.2f', c.identity) END) AS path
  FROM p JOIN c h ON h.id = p.id AND h.is_rep JOIN c ON c.cluster_id = h.cluster_id""")  # fmt: skip
_add("clstr_levels", lambda s, d: C.levels(clusters(s, d), parents(s, d)), f"""{_P}, h AS (SELECT cluster_id, id AS up FROM c WHERE is_rep)
  SELECT c.id, c.len, c.cluster_id AS cid_1, c.is_rep::BIGINT AS rep_1, coalesce(p.cluster_id, -1)::BIGINT AS cid_2, coalesce((p.is_rep AND c.id = p.id)::BIGINT, 0)::BIGINT AS rep_2
  FROM c JOIN h USING (cluster_id) LEFT JOIN p ON p.id = h.up""")  # fmt: skip
_add("clstr_sort_levels", lambda s, d: C.sort_levels(C.levels(clusters(s, d), parents(s, d)), 2, 1), f"SELECT *, row_number() OVER (ORDER BY cid_2, rep_2 DESC, cid_1, rep_1 DESC, id) AS place FROM ({SQL['clstr_levels']})")
_add("clstr_tree", lambda s, d: C.tree(parents(s, d), clusters(s, d)).select("cluster_id", "rep", "n_leaves", F.to_json(F.transform("nodes", lambda x: F.struct(x.id, x.leaves))).alias("nodes")), f"""{_P}, t AS (SELECT h.id, list(m.id ORDER BY m.member_no) AS leaves FROM c h JOIN c m USING (cluster_id) WHERE h.is_rep GROUP BY 1)
  SELECT cluster_id, max(p.id) FILTER (is_rep) AS rep, sum(len(leaves))::BIGINT AS n_leaves,
    '[' || string_agg('{{"id":"' || p.id || '","leaves":["' || array_to_string(leaves, '","') || '"]}}', ',' ORDER BY member_no) || ']' AS nodes FROM p JOIN t USING (id) GROUP BY 1""")  # fmt: skip
# trees of three levels: nations, customers, orders
_FOREST = f"""WITH c AS MATERIALIZED ({CLUSTERS}), p AS MATERIALIZED ({PARENTS}), g AS MATERIALIZED ({GRANDPARENTS}),
  ch AS (SELECT id, cluster_id AS k FROM c WHERE is_rep), ph AS (SELECT id, cluster_id AS k FROM p WHERE is_rep),
  two AS (SELECT g.cluster_id, [g.member_no, p.member_no] AS path, p.id FROM g JOIN ph ON ph.id = g.id JOIN p ON p.cluster_id = ph.k),
  three AS (SELECT two.cluster_id, list_append(path, c.member_no) AS path, c.id FROM two JOIN ch ON ch.id = two.id JOIN c ON c.cluster_id = ch.k),
  nodes AS (SELECT cluster_id, [member_no] AS path, id FROM g UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
  n AS (SELECT cluster_id, path[1:k] AS path, count(*) AS n_leaves FROM three, range(1, 4) AS t(k) GROUP BY ALL)
  SELECT cluster_id, array_to_string(path, '.') AS path, id, len(path)::BIGINT AS depth, n_leaves::BIGINT AS n_leaves FROM nodes JOIN n USING (cluster_id, path)"""
def _nodes(s, d):
    """The forest; its levels are made one from another, so each is made once and stored."""
    first = stored(clusters(s, d).select(*_COLUMNS, "identity"))
    second = stored(parents(s, d, first))
    return C.forest(grandparents(s, d, second), second, first)


_add("clstr_forest", lambda s, d: _nodes(s, d).select("cluster_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "id", F.size("path").cast("long").alias("depth"), "n_leaves"), _FOREST)
_add("forest_sort", lambda s, d: C.sort_forest(_nodes(s, d)).select("cluster_id", "rep", "n_leaves", "place"),
     f"""WITH f AS ({_FOREST}) SELECT f.cluster_id, max(f.id) FILTER (f.path = '0') AS rep, sum(n_leaves)::BIGINT AS n_leaves, row_number() OVER (ORDER BY sum(n_leaves) DESC, f.cluster_id) AS place FROM f WHERE depth = 1 GROUP BY 1""")
_add("clstr_newick", lambda s, d: C.newick(clusters(s, d)), f"""{_WITH} SELECT cluster_id, CASE WHEN count(*) = 1 THEN max(id) || ':1.0' ELSE '(' || string_agg(id || ':' || printf('%.4f', 1 - coalesce(identity, 100) / 100), ',' ORDER BY member_no) || '):' || printf('%.4f', coalesce(min(identity), 100) / 100) END AS tree FROM c GROUP BY 1""")


def _as_other(c):
    """A table whose clusters have the same representatives and other members."""
    return c.withColumn("id", F.when(F.col("is_rep"), F.col("id")).otherwise(F.concat(F.lit("x"), F.col("id"))))


_add("clstr_merge", lambda s, d: C.merge(clusters(s, d), _as_other(clusters(s, d))).select(_COLUMNS), f"""{_WITH}, u AS (SELECT {_ROW}, 0 AS t FROM c UNION ALL SELECT cluster_id, member_no, 'x' || id, len, is_rep, 1 FROM c WHERE NOT is_rep)
  SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY t, member_no, id) - 1)::BIGINT AS member_no, id, len, is_rep FROM u""")  # fmt: skip
_add("reps_per_cluster", lambda s, d: C.keep_per_cluster(clusters(s, d).select("id", "len"), clusters(s, d), 2), f"{_WITH} SELECT id, len FROM c WHERE id NOT IN (SELECT id FROM c WHERE member_no >= 2)")
_add("small_filter", lambda s, d: C.drop_small(clusters(s, d), 2).select(_COLUMNS), f"{_WITH} SELECT {_ROW} FROM c QUALIFY count(*) OVER (PARTITION BY cluster_id) > 2")
_add("refonly_filter", lambda s, d: C.drop_reference_only(clusters(s, d), F.col("l_returnflag") == "A").select(_COLUMNS), f"{_WITH} SELECT {_ROW} FROM c WHERE cluster_id IN (SELECT cluster_id FROM c WHERE l_returnflag = 'A')")
_add("nontop_ref", lambda s, d: C.best_reference(clusters(s, d), F.col("l_returnflag") == "A").select(_COLUMNS), f"""{_WITH} SELECT {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, l_returnflag = 'A' ORDER BY CASE WHEN is_rep THEN 100.0 ELSE identity END DESC, member_no) AS n FROM c) WHERE l_returnflag = 'A' OR n = 1""")

# labels against clusters
def _labelled(s, d):
    v = table(s, d, "embeddings")
    return v.select((F.col("vec_id") % 17).alias("cluster_id"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("term"))


_L = "WITH m AS (SELECT vec_id % 17 AS cluster_id, vec_id AS id, CAST(label AS VARCHAR) AS term FROM embeddings), k AS (SELECT cluster_id, term, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT sum(n) AS n FROM k GROUP BY cluster_id), b AS (SELECT sum(n) AS n FROM k GROUP BY term)"
for _name, _fn, _f in (("quality_pairs", E.pair_quality, "n * (n - 1) / 2"), ("quality_links", E.link_quality, "n - 1")):
    _u = _name.split("_")[1]
    _add(_name, lambda s, d, f=_fn: f(_labelled(s, d)), f"""{_L}, x AS (SELECT (SELECT sum({_f}) FROM a)::BIGINT AS cluster_{_u}, (SELECT sum({_f}) FROM b)::BIGINT AS term_{_u}, (SELECT sum({_f}) FROM k)::BIGINT AS both_{_u})
  SELECT *, both_{_u}::DOUBLE / nullif(term_{_u}, 0) AS sensitivity, both_{_u}::DOUBLE / nullif(cluster_{_u}, 0) AS specificity FROM x""")  # fmt: skip
_add("quality_pair_lists", lambda s, d: E.pair_list(_labelled(s, d)), """WITH m AS (SELECT vec_id % 17 AS cluster_id, vec_id AS id, label AS term FROM embeddings)
  SELECT x.id AS a, y.id AS b, CASE WHEN x.cluster_id = y.cluster_id AND x.term = y.term THEN 'T' WHEN x.cluster_id = y.cluster_id THEN 'C' ELSE 'B' END AS status
  FROM m x JOIN m y ON x.id < y.id AND (x.cluster_id = y.cluster_id OR x.term = y.term)""")  # fmt: skip


def _annotated(s, d):
    lines = table(s, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    parts = table(s, d, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.concat("l_returnflag", "l_linestatus").alias("cluster_id"), F.col("l_partkey").alias("id"), F.col("p_brand").alias("term")).distinct()


_add("enrichment_fisher", lambda s, d: E.enrichment(_annotated(s, d)).withColumn("p_value", F.round("p_value", 5)), """WITH m AS (SELECT DISTINCT l_returnflag || l_linestatus AS cluster_id, l_partkey AS id, p_brand AS term FROM lineitem JOIN part ON l_partkey = p_partkey),
  t AS (SELECT count(DISTINCT id) AS total FROM m), r AS (SELECT cluster_id, count(DISTINCT id) AS n1p FROM m GROUP BY 1), c AS (SELECT term, count(DISTINCT id) AS np1 FROM m GROUP BY 1),
  x AS (SELECT cluster_id, term, count(*) AS n11 FROM m GROUP BY 1, 2), y AS (SELECT * FROM x JOIN r USING (cluster_id) JOIN c USING (term), t),
  k AS (SELECT *, unnest(range(n11, least(n1p, np1) + 1)) AS i FROM y),
  p AS (SELECT cluster_id, term, sum(CASE WHEN total - np1 - n1p + i >= 0 THEN exp(lgamma(np1 + 1) - lgamma(i + 1) - lgamma(np1 - i + 1) + lgamma(total - np1 + 1) - lgamma(n1p - i + 1) - lgamma(total - np1 - n1p + i + 1) - lgamma(total + 1) + lgamma(n1p + 1) + lgamma(total - n1p + 1)) ELSE 0 END) AS p FROM k GROUP BY 1, 2)
  SELECT cluster_id, term, n11::BIGINT AS n11, n1p::BIGINT AS n1p, np1::BIGINT AS np1, total::BIGINT AS total, n11::DOUBLE * total / (n1p * np1) AS ratio, round(least(1.0, p), 5) AS p_value FROM y JOIN p USING (cluster_id, term)""")  # fmt: skip

def _samples(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("otu"), F.col("event_type").alias("sample"))


def _sample_table(s, d):
    rows = _samples(s, d)
    names = sorted(r.sample for r in rows.select("sample").distinct().collect())  # a handful of samples
    return E.sample_table(rows, names)


_add("otu_table", lambda s, d: _sample_table(s, d).selectExpr("otu", f"stack({5}, " + ", ".join(f"'{i}', `{c}`" for i, c in enumerate(sorted(c for c in _sample_table(s, d).columns if c != 'otu'))) + ") as (sample, n)"), """WITH n AS (SELECT DISTINCT event_type AS t FROM events), r AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS VARCHAR) AS sample FROM n),
  u AS (SELECT DISTINCT user_id AS otu FROM events) SELECT otu, sample, count(event_type)::BIGINT AS n FROM u CROSS JOIN r LEFT JOIN events ON user_id = otu AND event_type = t GROUP BY 1, 2""")  # fmt: skip
_add("mirna_table", lambda s, d: E.annotated_table(_samples(s, d).withColumn("annotation", F.lit(None).cast("string")).unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("otu"), F.lit(None).cast("string").alias("sample"), F.col("c_mktsegment").alias("annotation"))), ["click", "purchase"]).select("otu", "annotation"),
     "WITH u AS (SELECT DISTINCT user_id AS otu FROM events) SELECT otu, c_mktsegment AS annotation FROM u LEFT JOIN customer ON otu = c_custkey")


def _taxa(s, d):
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows
    return E.taxon_rollup(joined.select("r_name", "n_name", "c_mktsegment", F.lit(1).alias("n")), ["r_name", "n_name", "c_mktsegment"])


_add("taxon_rollup", _taxa, """WITH j AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  u AS (SELECT 1::BIGINT AS level, r_name AS taxon, count(*)::BIGINT AS n FROM j GROUP BY 2 UNION ALL SELECT 2, r_name || ';' || n_name, count(*) FROM j GROUP BY 2 UNION ALL SELECT 3, r_name || ';' || n_name || ';' || c_mktsegment, count(*) FROM j GROUP BY 2)
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, taxon) AS place FROM u""")  # fmt: skip


def _mates(s, d):
    o = table(s, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return n.select(F.col("o_custkey").alias("cluster_id"), "n", (F.col("lo") % 7).alias("r1_rep"), (F.col("hi") % 7).alias("r2_rep"), (F.col("lo") % 50).alias("r1_n"), (F.col("hi") % 50).alias("r2_n"), (F.col("lo") % 3).alias("r1_otu"), (F.col("hi") % 3).alias("r2_otu"))


_M = "WITH p AS (SELECT o_custkey AS cluster_id, count(*)::BIGINT AS n, min(o_orderkey) % 7 AS r1_rep, max(o_orderkey) % 7 AS r2_rep, min(o_orderkey) % 50 AS r1_n, max(o_orderkey) % 50 AS r2_n, min(o_orderkey) % 3 AS r1_otu, max(o_orderkey) % 3 AS r2_otu FROM orders GROUP BY 1)"
_ODD = "r1_rep <> r2_rep AND r1_n >= 2 * n AND r2_n >= 2 * n"
_add("chimera_pe_filter", lambda s, d: E.drop_chimeric_and_small(_mates(s, d), 0.0004).select("cluster_id", "n", "reason"),
     f"{_M} SELECT cluster_id, n, CASE WHEN {_ODD} AND r1_otu <> r2_otu THEN 'chimeric' WHEN n <= greatest(1, floor((SELECT sum(n) FROM p) * 0.0004)) THEN 'small' END AS reason FROM p")
_add("chimera_ref_filter", lambda s, d: E.drop_reference_chimeras(_mates(s, d), 5).select("cluster_id", "n"), f"{_M} SELECT cluster_id, n FROM p WHERE NOT (n <= 5 AND {_ODD} AND r1_rep <> cluster_id AND r2_rep <> cluster_id)")
