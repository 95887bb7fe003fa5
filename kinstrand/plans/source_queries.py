"""Queries through readers and writers: tables are written as files of a format in the shared folder and read back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinstrand.functions import kmers as K
from kinstrand.functions import sequences as S
from kinstrand.functions.storage import shared_folder
from kinstrand.operators import clusters as C
from kinstrand.operators import evaluation as E
from kinstrand.operators import fragments
from kinstrand.plans import pipelines
from kinstrand.plans.fixtures import AA, CLUSTERS, PARENTS, aa, aa_sql, clusters, parents, ranked, ranked_sql, table
from kinstrand.plans.read_queries import HITS, _hits
from kinstrand.plans.sequence_queries import _SHARED, _TWO, _passing, _two
from kinstrand.sources import formats
from kinstrand.streaming import abundances, incremental

QUERIES, SQL = {}, {}


def _add(name, sql):
    def keep(query):
        QUERIES[name], SQL[name] = query, sql
        return query

    return keep


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/kinstrand/files-{uuid.uuid4().hex}"


_DESCR = "doc_id || ' ' || coalesce(lang, '') || ' of ' || coalesce(source, '')"
_C = f"WITH c AS ({CLUSTERS})"


def _records(s, d):
    """Documents as records, in order: a description, and letters folded to lines of sixty."""
    descr = F.concat("doc_id", F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" of "), F.coalesce("source", F.lit("")))
    rows = formats.in_order(table(s, d, "documents").select("doc_id", "lang", "source", "text"), "doc_id").select("doc_id", descr.alias("descr"), S.letters_only(F.coalesce("text", F.lit(""))).alias("seq"))
    return rows.withColumn("seq_raw", F.regexp_replace("seq", "(.{60})", "$1\n"))


@_add("fasta_scan", f"SELECT CAST(doc_id AS VARCHAR) AS id, {_DESCR} AS descr, {AA} AS seq_raw FROM documents")
def fasta_scan(s, d):
    path = _folder(s)
    formats.write_fasta(_records(s, d), path, order=None)
    return formats.read_fasta(s, path).select("id", "descr", "seq_raw")


@_add("fasta_scan_gz", SQL["fasta_scan"])
def fasta_scan_gz(s, d):
    path = _folder(s)
    _records(s, d).select(formats.fasta_text().alias("value")).write.option("compression", "gzip").text(path)
    return formats.read_fasta(s, path).select("id", "descr", "seq_raw")


@_add("fasta_batches", f"SELECT CAST(doc_id AS VARCHAR) AS id, {_DESCR} AS descr, {AA} AS seq_raw FROM documents")
def fasta_batches(s, d):
    """The same records as a stream, two files at a time."""
    path, out = _folder(s), _folder(s)
    formats.write_fasta(_records(s, d), path, order=None)
    stream = formats.batches(s, path, files_per_batch=2)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


_BODY = r"regexp_replace(regexp_replace(t, '\s+$', ''), '\*$', '')"


@_add("fasta_sequences", rf"""WITH r AS (SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE regexp_replace(coalesce(text, ''), '[^A-Za-z\s]', '', 'g') END, chr(10), ' ') || CASE WHEN doc_id % 2 = 0 THEN '*' ELSE '' END AS t FROM documents),
  v AS (SELECT doc_id, upper(regexp_replace({_BODY}, '\s+', '', 'g')) AS seq FROM r WHERE NOT regexp_matches({_BODY}, '[^A-Za-z\s]'))
  SELECT CAST(doc_id AS VARCHAR) AS id, seq, row_number() OVER (ORDER BY doc_id) - 1 AS seq_idx FROM v WHERE length(seq) > 10""")  # fmt: skip
def fasta_sequences(s, d):
    """What a scan keeps: valid records longer than ten letters, numbered in file order. Two of three texts have no other characters."""
    path = _folder(s)
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.regexp_replace(text, r"[^A-Za-z\s]", ""))
    text = F.concat(F.replace(text, F.lit("\n"), F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, "*").otherwise(""))
    rows = formats.in_order(table(s, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("descr"), text.alias("seq_raw"))
    formats.write_fasta(rows, path, order=None)
    return formats.sequences(formats.read_fasta(s, path))[0].select("id", "seq", "seq_idx")


_QUALITY = "CASE WHEN doc_id % 3 = 0 THEN '@' ELSE 'I' END || repeat('I', length(seq) - 1)"


@_add("fastq_scan", f"SELECT CAST(doc_id AS VARCHAR) AS id, {_DESCR} AS descr, seq AS seq_raw, {_QUALITY} AS qual FROM (SELECT *, {AA} AS seq FROM documents) WHERE length(seq) > 0")
def fastq_scan(s, d):
    """Qualities may begin as headers do; sequences of every second record are folded, and so are their qualities."""
    path = _folder(s)
    fold = lambda c, n: F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(c, f"(.{{{n}}})(?=.)", "$1\n")).otherwise(F.col(c))
    rows = _records(s, d).where("seq <> ''").withColumn("seq_raw", fold("seq", 60))
    rows = rows.withColumn("qual", F.concat(F.when(F.col("doc_id") % 3 == 0, "@").otherwise("I"), F.repeat(F.lit("I"), F.length("seq") - 1))).withColumn("qual", fold("qual", 45))
    formats.write_fastq(rows, path, order=None)
    return formats.read_fastq(s, path).select("id", "descr", "seq_raw", "qual")


@_add("mates_scan", f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_idx, CAST(doc_id AS VARCHAR) AS id, left(seq, length(seq) // 2) AS r1, substring(seq, length(seq) // 2 + 1) AS r2 FROM (SELECT doc_id, {AA} AS seq FROM documents)")
def mates_scan(s, d):
    paths = _folder(s), _folder(s)
    for path, part in zip(paths, (F.expr("substring(seq, 1, length(seq) div 2)"), F.expr("substring(seq, length(seq) div 2 + 1)")), strict=True):
        formats.write_fasta(_records(s, d).withColumn("seq_raw", part), path, order=None)
    return formats.read_mates(s, *paths).select("seq_idx", "id", "r1", "r2")


@_add("clusters_scan", f"{_C} SELECT cluster_id, member_no, len, 'aa' AS unit, id, is_rep, round(identity, 2) AS identity FROM c")
def clusters_scan(s, d):
    path = _folder(s)
    formats.write_clusters(clusters(s, d).withColumn("unit", F.lit("aa")), path)
    return formats.read_clusters(s, path).select("cluster_id", "member_no", "len", "unit", "id", "is_rep", "identity")


@_add("hits_scan", f"WITH h AS ({HITS}) SELECT qid || '.500' AS qid, sid || '.400' AS sid, iden, aln_len, qfrom, qend, sfrom, send, evalue, score, 500::BIGINT AS q_len, 400::BIGINT AS s_len, frame, hsp_no FROM h")
def hits_scan(s, d):
    """Tabular hits in the order of the search; lengths come from the ids, frames from the places."""
    path = _folder(s)
    rows = _hits(s, d).withColumns({"qid": F.concat("qid", F.lit(".500")), "sid": F.concat("sid", F.lit(".400"))})
    formats.write_hits(rows.repartitionByRange("qid", "sid").sortWithinPartitions("qid", "sid", "hsp_no"), path)
    return formats.read_hits(s, path).drop("mismatches", "gaps")


@_add("taxonomy_scan", "SELECT 'P' || p_partkey AS id, replace(p_name || ' ' || p_type, ' ', '.') AS text FROM part")
def taxonomy_scan(s, d):
    path = _folder(s)
    table(s, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, ">").otherwise(""), F.lit("P"), "p_partkey", F.lit("\t"), "p_name", F.lit(" "), "p_type", F.lit("  ")).alias("value")).write.text(path)
    return formats.read_pairs(s, path)


@_add("ids_scan", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders")
def ids_scan(s, d):
    path = _folder(s)
    table(s, d, "orders").select(F.concat(F.lit(">"), "o_custkey", F.lit(" order "), "o_orderkey").alias("value")).write.text(path)
    return formats.read_ids(s, path)


@_add("sample_sheet_scan", "SELECT replace(n_name, ' ', '_') AS sample, n_regionkey || ',r' || n_nationkey || '.fq' AS data FROM nation")
def sample_sheet_scan(s, d):
    path = _folder(s)
    lines = table(s, d, "nation").select(F.explode(F.array(F.concat(F.lit("# "), "n_name"), F.lit("  "), F.concat(F.translate("n_name", " ", "_"), F.lit("\t"), "n_regionkey", F.lit("  r"), "n_nationkey", F.lit(".fq")))).alias("value"))
    lines.write.text(path)
    return formats.read_sample_sheet(s, path).select("sample", F.array_join("data", ",").alias("data"))


_REP = "SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM c"


@_add("rep_sink", f"{_C} SELECT id, row_number() OVER (ORDER BY size DESC, cluster_id) AS place FROM ({_REP}) WHERE is_rep")
def rep_sink(s, d):
    """Representatives as a file, largest cluster first, read back in its order."""
    path = _folder(s)
    c = clusters(s, d).withColumn("seq_idx", F.col("id"))
    rows = formats.representatives(c, c.select("seq_idx", F.col("id").alias("descr"), F.lit("ACGTACGTACGT").alias("seq_raw")).distinct(), by_size=True)
    formats.write_fasta(rows, path, order="place")
    return formats.number(formats.read_fasta(s, path)).select("id", (F.col("seq_idx") + 1).alias("place"))


@_add("two_set_text", f"""{_TWO}, m AS (SELECT r AS cluster_id, -1 AS o, 'i' || r AS id, len, true AS is_rep, 0.0 AS identity FROM (SELECT seq_idx AS r, length(seq) AS len FROM y) UNION ALL
  SELECT r, q, 'd' || q, length(seq), false, 100.0 * shared / length(seq) FROM hit JOIN x ON seq_idx = q), n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY o) - 1 AS k FROM m)
  SELECT cluster_id, '>Cluster ' || cluster_id || chr(10) || string_agg(k || chr(9) || len || 'aa, >' || id || '... ' || CASE WHEN is_rep THEN '*' ELSE 'at ' || printf('%.2f', identity) || '%' END, chr(10) ORDER BY k) AS value FROM n GROUP BY 1""")  # fmt: skip
def two_set_text(s, d):
    """Clusters of the second set around the first, as text."""
    first = aa(s, d, name="benchmark", key="item_id").select("seq_idx", F.concat(F.lit("i"), "seq_idx").alias("id"), F.length("seq").alias("len"))
    second = aa(s, d).select("seq_idx", F.concat(F.lit("d"), "seq_idx").alias("id"), F.length("seq").alias("len"))
    hits = _two(s, d).join(second.select(F.col("seq_idx").alias("q"), F.col("len").alias("n")), "q").select("q", "r", (100.0 * F.col("shared") / F.col("n")).alias("percent"))
    return formats.cluster_text(formats.two_set_clusters(first, hits, second))


_NOTE = "CASE WHEN o_custkey % 3 = 0 THEN ' chimeric_parent1=' || (o_custkey % 11) || ',chimeric_parent2=' || (o_custkey % 7) ELSE '' END"


@_add("chimeric_text", f"""{_C}, t AS (SELECT cluster_id, string_agg(member_no || chr(9) || len || 'nt, >' || id || '... ' || CASE WHEN is_rep THEN '*' ELSE 'at ' || printf('%.2f', identity) || '%' END, chr(10) ORDER BY member_no) AS v FROM c GROUP BY 1)
  SELECT cluster_id, '>Cluster ' || cluster_id || {_NOTE} || chr(10) || v AS value FROM t JOIN orders ON o_orderkey = cluster_id""")  # fmt: skip
def chimeric_text(s, d):
    """Clusters of duplicates; the headers of chimeric ones name the clusters of both parents."""
    o = table(s, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("cluster_id"), (F.col("o_custkey") % 11).alias("parent_head"), (F.col("o_custkey") % 7).alias("parent_tail"))
    return formats.cluster_text(formats.chimeric(clusters(s, d).withColumn("unit", F.lit("nt")), o))


@_add("xml_sink", f"WITH c AS ({CLUSTERS}), p AS ({PARENTS}), t AS (SELECT h.id, count(*) AS n FROM c h JOIN c m USING (cluster_id) WHERE h.is_rep GROUP BY 1) SELECT cluster_id, max(p.id) FILTER (is_rep) AS rep, sum(n)::BIGINT AS n_leaves, count(*)::BIGINT AS n_nodes FROM p JOIN t USING (id) GROUP BY 1")
def xml_sink(s, d):
    path = _folder(s)
    formats.write_xml(C.tree(parents(s, d), clusters(s, d)).select("cluster_id", "rep", "n_leaves", F.transform("nodes", lambda x: x.id).alias("node")), path)
    back = s.read.format("xml").option("rowTag", "cluster").schema("cluster_id long, rep string, n_leaves long, node array<string>").load(path)
    return back.select("cluster_id", "rep", "n_leaves", F.size("node").cast("long").alias("n_nodes"))


@_add("fasta_per_cluster", "SELECT vec_id % 17 AS cluster_id, 'v' || vec_id AS id, repeat('ACGT', (label + 1)::INT) AS seq_raw FROM embeddings WHERE vec_id % 17 > 2")
def fasta_per_cluster(s, d):
    """A folder of records for each cluster; small clusters have none."""
    path = _folder(s)
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("seq_idx"), F.when(F.col("vec_id") % 17 > 2, F.col("vec_id") % 17).otherwise(F.col("vec_id") + 1000).alias("cluster_id"), F.col("vec_id").alias("member_no"), F.col("label"))
    records = v.select("seq_idx", F.concat(F.lit("v"), "seq_idx").alias("descr"), F.repeat(F.lit("ACGT"), F.col("label") + 1).alias("seq_raw"))
    formats.write_per_cluster(v.drop("label"), records, path, least=2)
    folder = r"cluster_id=(\d+)"
    return formats.read_fasta(s, f"{path}/*").select(F.regexp_extract("file", folder, 1).cast("long").alias("cluster_id"), "id", "seq_raw")


@_add("biom_sink", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS n_otus, (SELECT count(DISTINCT event_type) FROM events)::BIGINT AS n_samples, count(*)::BIGINT AS n_cells, sum(n)::BIGINT AS total, max(n)::BIGINT AS most FROM n")
def biom_sink(s, d):
    """The sparse JSON table, parsed again."""
    events = table(s, d, "events").select(F.col("user_id").alias("otu"), F.col("event_type").alias("sample"))
    samples = sorted(r.sample for r in events.select("sample").distinct().collect())  # a handful of samples
    text = formats.sample_biom(E.sample_table(events, samples), samples)
    parsed = text.select(F.from_json("value", "shape array<long>, `rows` array<struct<id:string>>, columns array<struct<id:string>>, data array<array<long>>").alias("b"))
    counts = F.transform("b.data", lambda x: F.get(x, F.lit(2)))
    return parsed.select(
        F.get("b.shape", F.lit(0)).alias("n_otus"), F.size("b.columns").cast("long").alias("n_samples"), F.size("b.data").cast("long").alias("n_cells"),
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(counts).alias("most"),
    )


@_add("paired_reps", f"{_C}, m AS (SELECT id || '/' || (1 + l_suppkey % 2) AS id, len FROM (SELECT *, l_suppkey FROM c)) SELECT id, len FROM m WHERE left(id, -2) IN (SELECT id FROM c WHERE is_rep)")
def paired_reps(s, d):
    c = clusters(s, d)
    mates = c.select(F.concat("id", F.lit("/"), 1 + F.col("l_suppkey") % 2).alias("id"), "len")
    return fragments.paired_representatives(c, mates)


# smaller operators
@_add("drop_empty", f"SELECT * FROM (SELECT doc_id, {AA} AS seq FROM documents) WHERE length(seq) > 0")
def drop_empty(s, d):
    return fragments.drop_empty(table(s, d, "documents").select("doc_id", S.letters_only(F.coalesce("text", F.lit(""))).alias("seq")))


_NT = f"SELECT seq_idx AS rank, translate(seq, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{('ACGT' * 7)[:26]}') AS seq FROM ({aa_sql(name='benchmark', key='item_id')})"


def _items(s, d):
    return aa(s, d, name="benchmark", key="item_id").select(F.col("seq_idx").alias("rank"), S.as_nucleotides("seq").alias("seq"))


@_add("complement_words", f"SELECT rank, reverse(translate(word, 'ACGT', 'TGCA')) AS word, count(*)::INT AS cnt FROM (SELECT rank, substring(seq, i::INT, 8) AS word FROM (SELECT rank, seq, unnest(range(1, length(seq) - 6)) AS i FROM ({_NT}))) GROUP BY ALL")
def complement_words(s, d):
    return fragments.complement_words(K.postings(_items(s, d), 8))


_FRAG = f"SELECT rank, (i - 1) // 30 AS frag, substring(seq, i::INT, 6) AS word, count(*)::INT AS cnt FROM (SELECT rank, seq, unnest(range(1, length(seq) - 4)) AS i FROM ({_NT})) GROUP BY ALL"


@_add("fragment_words", _FRAG)
def fragment_words(s, d):
    return fragments.fragment_postings(_items(s, d), 6, 30)


@_add("fragment_shared", f"""WITH f AS ({_FRAG}), p AS (SELECT rank, word, sum(cnt) AS n FROM f GROUP BY ALL), e AS (SELECT p.rank AS q, f.rank AS r, frag, sum(least(n, cnt)) AS s FROM p JOIN f USING (word) GROUP BY 1, 2, 3),
  w AS (SELECT q, r, sum(s) OVER (PARTITION BY q, r ORDER BY frag RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s FROM e) SELECT q, r, max(s)::BIGINT AS shared FROM w GROUP BY 1, 2""")  # fmt: skip
def fragment_shared(s, d):
    items = _items(s, d)
    return fragments.fragment_shared(K.postings(items, 6), fragments.fragment_postings(items, 6, 30), 2)


@_add("weighted_sizes", f"WITH c AS ({CLUSTERS}), p AS ({PARENTS}), n AS (SELECT max(id) FILTER (is_rep) AS id, count(*) AS n FROM c GROUP BY cluster_id) SELECT cluster_id, sum(coalesce(n, 1))::BIGINT AS n FROM p LEFT JOIN n USING (id) GROUP BY 1")
def weighted_sizes(s, d):
    return fragments.weighted_sizes(parents(s, d), C.representative(clusters(s, d)).select(F.col("rep").alias("id"), "n"))


@_add("tree_sort", f"SELECT cluster_id, row_number() OVER (ORDER BY n_leaves DESC, cluster_id) AS place FROM ({SQL['xml_sink']})")
def tree_sort(s, d):
    return fragments.sort_tree(C.tree(parents(s, d), clusters(s, d)), "no").select("cluster_id", "place")


@_add("candidates_in_band", f"{_SHARED} SELECT q, r, shared FROM sh JOIN rk a ON a.rank = q JOIN rk b ON b.rank = r WHERE 10 * shared >= 4 * a.len AND b.len <= least(floor(a.len::FLOAT / 0.9), a.len + 40)")
def candidates_in_band(s, d):
    rk = ranked(s, d)
    pairs = _passing(s, d, reach=S.upper_length("len", s=0.9, S=40)).join(rk.select(F.col("rank").alias("q"), F.col("len").alias("q_len")), "q").join(rk.select(F.col("rank").alias("r"), F.col("len").alias("r_len")), "r")
    return pairs.where(F.col("r_len") <= S.upper_length("q_len", s=0.9, S=40)).select("q", "r", "shared")


@_add("distance_matrix", f"""{_SHARED}, p AS (SELECT q, r, 1 - shared / len AS distance FROM sh JOIN rk ON rk.rank = q WHERE 10 * shared >= 4 * len), b AS (SELECT q AS a, r AS b, distance FROM p UNION ALL SELECT r, q, distance FROM p)
  SELECT a, b, min(distance) AS distance FROM b GROUP BY 1, 2 UNION ALL SELECT DISTINCT a, a, 0.0 FROM b""")  # fmt: skip
def distance_matrix(s, d):
    pairs = _passing(s, d).join(ranked(s, d).select(F.col("rank").alias("q"), "len"), "q")
    return fragments.distance_matrix(pairs.select("q", "r", (1 - F.col("shared") / F.col("len")).alias("distance")))


# streams
def _stream(s, d, name):
    rows = table(s, d, name)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/{name}.parquet*")


@_add("stream_duplicates", f"SELECT DISTINCT {AA} AS seq FROM documents")
def stream_duplicates(s, d):
    """The first row of each sequence as rows arrive."""
    out = _folder(s)
    stream = _stream(s, d, "documents").select(S.letters_only(F.coalesce("text", F.lit(""))).alias("seq"))
    incremental.exact_duplicates(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("seq string").parquet(out)


@_add("stream_abundances", f"SELECT md5(seq) AS seq, min(doc_id) AS seq_idx, count(*)::BIGINT AS abundance FROM (SELECT doc_id, {AA} AS seq FROM documents) GROUP BY seq")
def stream_abundances(s, d):
    """Counts of equal sequences as documents arrive in two batches, each a run that is restarted from the state of the one before."""
    rows, source, out = table(s, d, "documents").select(F.col("doc_id").alias("seq_idx"), S.letters_only(F.coalesce("text", F.lit(""))).alias("seq")), _folder(s), _folder(s)
    middle = rows.agg(F.avg("seq_idx").alias("m")).first()["m"] or 0
    for part in (F.col("seq_idx") <= middle, F.col("seq_idx") > middle):
        rows.where(part).write.mode("append").parquet(source)
        abundances.count_stream(s.readStream.schema(rows.schema).parquet(source), out).awaitTermination()
    found = abundances.current(s, out).join(rows, "seq_idx")
    return found.select(F.md5("seq").alias("seq"), "seq_idx", "abundance")


@_add("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    """Counts by hour and kind, whole after the last batch."""
    out = _folder(s)
    events = _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.windowed_counts(events, "ts", "1 hour", "1 hour", "event_type")
    whole = counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/counts")
    whole.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(whole.schema).parquet(f"{out}/counts")


# pooled samples against references
_POOL = """WITH e AS (SELECT user_id % 40 AS otu, event_type, event_id FROM events), r AS (SELECT c_custkey % 50 AS otu, 'R' || c_custkey || '|' || c_mktsegment AS id, 95.0 + c_custkey % 5 AS identity, row_number() OVER (PARTITION BY c_custkey % 50 ORDER BY c_custkey) AS k FROM customer),
  b AS (SELECT otu, regexp_extract(id, '\\|(.*)$', 1) AS annotation FROM r QUALIFY row_number() OVER (PARTITION BY otu ORDER BY identity DESC, k) = 1)
  SELECT e.otu, max(annotation) AS annotation, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'purchase')::BIGINT AS purchase FROM e LEFT JOIN b USING (otu) GROUP BY 1"""


@_add("pooled_otus", _POOL)
def pooled_otus(s, d):
    """Clusters of pooled samples with the best reference that joins each: counts of two samples."""
    e = table(s, d, "events")
    n = F.row_number().over(C.Window.partitionBy("cluster_id").orderBy("event_id"))
    own = e.select((F.col("user_id") % 40).alias("cluster_id"), "event_id", F.concat(F.lit("Sample|"), "event_type", F.lit("|"), "event_id").alias("id")).withColumn("n", n)
    own = own.select("cluster_id", (F.col("n") - 1).cast("long").alias("member_no"), "id", F.lit(100).cast("long").alias("len"), (F.col("n") == 1).alias("is_rep"), F.when(F.col("n") > 1, 98.0).alias("identity"))
    k = F.row_number().over(C.Window.partitionBy("cluster_id").orderBy("c_custkey"))
    refs = table(s, d, "customer").select((F.col("c_custkey") % 50).alias("cluster_id"), "c_custkey", "c_mktsegment").withColumn("member_no", k.cast("long"))
    refs = refs.select("cluster_id", "member_no", F.concat(F.lit("R"), "c_custkey", F.lit("|"), "c_mktsegment").alias("id"), F.lit(100).cast("long").alias("len"), F.lit(False).alias("is_rep"), (95.0 + F.col("c_custkey") % 5).alias("identity"))
    hits = own.where("is_rep").unionByName(refs)
    samples = sorted(r.event_type for r in e.select("event_type").distinct().collect())  # a handful of samples
    return pipelines.pooled_otus(own, hits, samples, F.startswith("id", F.lit("Sample|"))).select("otu", "annotation", "click", "purchase")
