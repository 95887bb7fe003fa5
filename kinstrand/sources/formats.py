"""Readers and writers: FASTA and FASTQ (plain or gz), mates, cluster text, hit tables, id lists, sample sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.functions.storage import stored
from kinstrand.operators.ranking import numbered
from kinstrand.sources import fastq


def _numbered(text: DataFrame) -> DataFrame:
    """``n``: the place of a row within its file, for formats whose files are read whole and in order."""
    return text.withColumn("file", F.input_file_name()).withColumn("n", F.monotonically_increasing_id())


def _record(value: str) -> tuple[Column, Column]:
    """(definition line, letters without line ends) of a FASTA record as the reader splits it."""
    v = F.col(value)
    record = F.when(F.startswith(v, F.lit(">")), F.expr(f"substring({value}, 2)")).otherwise(v)
    head = F.substring_index(F.substring_index(record, "\n", 1), "\r", 1)
    end = F.instr(v, "\n")
    body = F.when(end > 0, F.substr(v, end + 1, F.length(v))).otherwise("")
    return head, F.replace(F.replace(body, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, descr, seq_raw of each record; ``.gz`` by name. Records are split by the reader itself, so plain files are read in parallel; ``block`` is where a record's split starts."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    head, seq = _record("value")
    out = _numbered(raw.where(F.length(F.trim("value")) > 0))
    return out.select("file", "block", "n", S.short_id(head).alias("id"), head.alias("descr"), seq.alias("seq_raw"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, n, id, descr, seq_raw, qual of each record, folded or not; ``.gz`` by name. Plain files are read in parallel."""
    descr = F.expr("substring(head, 2)")
    return fastq.records(spark, path).select("file", "n", S.short_id("head").alias("id"), descr.alias("descr"), F.col("seq").alias("seq_raw"), "qual")


def sequences(records: DataFrame, least: int = 10, upper: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows with seq_idx and seq, rejected rows): normalised, longer than ``least``; seq_idx is dense in file order."""
    good = records.where(S.is_valid("seq_raw") & S.has_letters("seq_raw", least + 1)).withColumn("seq", S.normalise("seq_raw", checked=True))
    return number(good), records.where(~S.is_valid("seq_raw"))


def number(records: DataFrame) -> DataFrame:
    """``seq_idx``: dense from 0 in file order. Where records carry their split's start (``block``) they lie in order within it, so they are stored once and only counts by split are sorted."""
    if "block" not in records.columns:
        return numbered(records, "file", "n", name="seq_idx")
    held = stored(records.withColumn("__at", F.monotonically_increasing_id()))  # a split is read by one task, in one piece
    splits = held.groupBy("file", "block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__offset"))
    placed = held.join(F.broadcast(offsets), ["file", "block"])  # a row for each split of the files
    return placed.withColumn("seq_idx", F.col("__offset") + F.col("__at")).drop("__offset", "__at", "block")


def read_mates(spark: SparkSession, first: str, second: str, fastq: bool = False) -> DataFrame:
    """id, r1, r2 (and descriptions): the i-th records of both files; unequal counts are an error."""
    read = read_fastq if fastq else read_fasta
    a, b = number(read(spark, first)), number(read(spark, second))
    counts = a.count(), b.count()
    if counts[0] != counts[1]:
        raise ValueError(f"mates differ in number: {counts[0]} and {counts[1]}")
    b = b.select("seq_idx", F.col("seq_raw").alias("r2"), F.col("descr").alias("descr2"))
    return a.select("seq_idx", "id", F.col("seq_raw").alias("r1"), F.col("descr").alias("descr1")).join(b, "seq_idx")


def batches(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of FASTA records, some files at a time."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(path)
    head, seq = _record("value")
    return raw.select(S.short_id(head).alias("id"), head.alias("descr"), seq.alias("seq_raw"))


#: A member line: number, length and unit, id, then * or the alignment; what a line end of another kind leaves after it is dropped.
_MEMBER = r"^(\d+)\s+(\d+)(aa|nt), >(.+?)\.\.\. (\*|at .*)$[\s\S]*"


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """A cluster table from cluster text: integer and two-decimal identities, extents and strands.

    Text is split before each header, so a row is a cluster and no order over lines is needed. A member line is matched once, into its parts; none of these can hold a line end.
    """
    raw = spark.read.option("lineSep", "\n>Cluster ").text(path)
    block = F.regexp_replace("value", r"^>Cluster ", "")
    end = F.instr(block, "\n")
    lines = F.split(F.when(end > 0, F.substr(block, end + 1, F.length(block))).otherwise(""), r"\r?\n")
    parts = F.transform(lines, lambda x: F.split(F.regexp_replace(x, _MEMBER, "$1\n$2\n$3\n$4\n$5"), "\n"))
    rows = raw.select(
        F.regexp_extract(block, r"^(\d+)", 1).cast("long").alias("cluster_id"), F.nullif(F.trim(F.regexp_extract(block, r"^\d+([^\n\r]*)", 1)), F.lit("")).alias("note"),
        F.explode_outer(parts).alias("p"),
    ).where(F.size("p") == 5)
    part = lambda i: F.col("p")[i - 1]
    tail = F.when(F.startswith(part(5), F.lit("at ")), F.substr(part(5), F.lit(4))).otherwise(part(5))
    place = r"^(\d+):(\d+):(\d+):(\d+)/"
    number_ = lambda c, i: F.when(F.rlike(c, F.lit(place)), F.regexp_extract(c, place, i).try_cast("int"))
    percent = lambda pattern: F.regexp_extract(tail, pattern, 1)
    return rows.select(
        "cluster_id", part(1).cast("long").alias("member_no"), part(2).cast("long").alias("len"), part(3).alias("unit"), part(4).alias("id"), (part(5) == "*").alias("is_rep"),
        percent(r"(?:^|/)(\d+(?:\.\d+)?)%").try_cast("double").alias("identity"), percent(r"%/(\d+(?:\.\d+)?)%").try_cast("double").alias("distance"),
        F.nullif(F.regexp_extract(tail, r"(?:^|/)([+-])/", 1), F.lit("")).alias("strand"),
        number_(tail, 1).alias("q_beg"), number_(tail, 2).alias("q_end"), number_(tail, 3).alias("r_beg"), number_(tail, 4).alias("r_end"), "note",
    )


def two_places(x: Column | str) -> Column:
    """A number as text with two decimals, rounded as C's printf does: by the number's exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form, half up, so 53.125 and 1.005 come out otherwise. The number is cut in two parts whose multiples are exact.
    """
    a = F.abs(F.col(x) if isinstance(x, str) else x).cast("double")
    high = F.floor(a * (1 << 20)).cast("double") / (1 << 20)
    whole = F.floor(high * 100)
    over = (high * 100 - whole.cast("double") - 0.5) + (a - high) * 100  # only its sign counts, and that is exact
    n = whole + F.when(over > 0, 1).when(over == 0, whole % 2).otherwise(0)
    sign = F.when((F.col(x) if isinstance(x, str) else x) < 0, "-").otherwise("")
    return F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def member_lines(clusters: DataFrame, places: bool = False, width: int = 0) -> Column:
    """The text of a member: ``k<tab>LENunit, >id... *`` or ``at [q:q:r:r/][strand/]xx.xx%[/dd.dd%]``; identity and distance in percent."""
    columns = set(clusters.columns)
    parts = []
    if places:
        parts.append(F.format_string("%d:%d:%d:%d", "q_beg", "q_end", "r_beg", "r_end"))
    if "strand" in columns:
        parts.append(F.when(F.col("unit") == "nt", F.col("strand")))
    parts.append(F.concat(F.coalesce(two_places("identity"), F.lit("null")), F.lit("%")))
    if "distance" in columns:
        parts.append(F.when(F.col("distance").isNotNull(), F.concat(two_places("distance"), F.lit("%"))))
    shown = F.substring("id", 1, width - 1) if width else F.col("id")
    return F.concat(
        F.col("member_no").cast("string"), F.lit("\t"), F.col("len").cast("string"), F.col("unit"), F.lit(", >"), shown, F.lit("... "),
        F.when(F.col("is_rep"), "*").otherwise(F.concat(F.lit("at "), F.concat_ws("/", *parts))),
    )


def cluster_text(clusters: DataFrame, places: bool = False, width: int = 0) -> DataFrame:
    """cluster_id, value: a cluster's text. Members of one cluster are one row, as in the format."""
    rows = clusters.withColumn("__t", member_lines(clusters, places, width))
    lines = F.sort_array(F.collect_list(F.struct("member_no", F.col("__t").alias("t"))))["t"]
    note = F.max("note") if "note" in clusters.columns else F.lit(None).cast("string")
    out = rows.groupBy("cluster_id").agg(lines.alias("l"), note.alias("note"))
    head = F.concat(F.lit(">Cluster "), F.col("cluster_id").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("note")), F.lit("")))
    return out.select("cluster_id", F.concat(head, F.lit("\n"), F.array_join("l", "\n")).alias("value"))


def chimeric(clusters: DataFrame, chimeras: DataFrame) -> DataFrame:
    """``clusters`` with ``note``, which their header carries: the clusters of both parents, from (cluster_id, parent_head, parent_tail)."""
    note = F.format_string("chimeric_parent1=%s,chimeric_parent2=%s", F.col("parent_head").cast("string"), F.col("parent_tail").cast("string"))
    return clusters.drop("note").join(chimeras.select("cluster_id", note.alias("note")), "cluster_id", "left")


def write_clusters(clusters: DataFrame, path: str, places: bool = False, width: int = 0) -> None:
    """Members are dealt by ranges of clusters, and become text where they lie."""
    cluster_text(clusters.repartitionByRange("cluster_id"), places, width).sortWithinPartitions("cluster_id").select("value").write.text(path)


def two_set_clusters(first: DataFrame, hits: DataFrame, second: DataFrame, unit: str = "aa") -> DataFrame:
    """One cluster for each row of ``first`` (seq_idx, id, len), which is member 0, with the rows of ``second`` that join it.

    ``hits`` (q, r) have ``identity``, a share, or ``percent``, which is taken as it is.
    """
    percent = F.col("percent") if "percent" in hits.columns else 100 * F.col("identity").cast("double")
    reps = first.select(F.col("seq_idx").alias("cluster_id"), "id", "len").withColumns({"is_rep": F.lit(True), "identity": F.lit(None).cast("double"), "o": F.lit(-1).cast("long")})
    members = hits.join(second.select(F.col("seq_idx").alias("q"), "id", "len"), "q").select(F.col("r").alias("cluster_id"), "id", "len", F.lit(False).alias("is_rep"), percent.alias("identity"), F.col("q").alias("o"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("o")) - 1
    return reps.unionByName(members).withColumn("member_no", place.cast("long")).withColumn("unit", F.lit(unit)).drop("o")


def backup_lines(clusters: DataFrame, places: bool = False) -> DataFrame:
    """seq_idx, value: ``cluster<tab>member`` in input order."""
    return clusters.select("seq_idx", F.concat(F.col("cluster_id").cast("string"), F.lit("\t"), member_lines(clusters, places)).alias("value"))


def fasta_text(descr: str = "descr", seq: str = "seq_raw") -> Column:
    return F.concat(F.lit(">"), F.col(descr), F.lit("\n"), F.col(seq))


def fastq_text(descr: str = "descr", seq: str = "seq_raw", qual: str = "qual") -> Column:
    return F.concat(F.lit("@"), F.col(descr), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))


def representatives(clusters: DataFrame, records: DataFrame, by_size: bool = False) -> DataFrame:
    """``records`` of representatives with ``place``: input order, or the largest cluster first."""
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    reps = clusters.withColumn("size", size).where("is_rep").select("seq_idx", "size", "cluster_id")
    rows = records.join(reps, "seq_idx")
    return rows.withColumn("place", F.struct(F.when(F.lit(by_size), -F.col("size")).otherwise(0), F.when(F.lit(by_size), F.col("cluster_id")).otherwise(F.col("seq_idx"))))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by ranges of the order and sorted. That reads them twice, so what costs is better computed after it."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_fasta(rows: DataFrame, path: str, order: str | None = "seq_idx", descr: str = "descr", seq: str = "seq_raw") -> None:
    """``order`` None: the rows lie :func:`in_order`."""
    (in_order(rows, order) if order else rows).select(fasta_text(descr, seq).alias("value")).write.text(path)


def write_fastq(rows: DataFrame, path: str, order: str | None = "seq_idx") -> None:
    (in_order(rows, order) if order else rows).select(fastq_text().alias("value")).write.text(path)


def write_per_cluster(clusters: DataFrame, records: DataFrame, path: str, least: int = 1) -> None:
    """A folder of FASTA for each cluster of ``least`` members or more."""
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    rows = clusters.withColumn("n", size).where(F.col("n") >= least).select("seq_idx", "cluster_id", "member_no").join(records, "seq_idx")
    rows.repartition("cluster_id").sortWithinPartitions("cluster_id", "member_no").select("cluster_id", fasta_text().alias("value")).write.partitionBy("cluster_id").text(path)


def write_xml(tree: DataFrame, path: str) -> None:
    tree.write.format("xml").option("rowTag", "cluster").option("rootTag", "clusters").save(path)


def forest_xml(nodes: DataFrame) -> DataFrame:
    """cluster_id, at and value: the lines of nested XML, in order by cluster_id and at, of the nodes of a forest.

    What opens a node comes at its path and what closes it after all paths that begin with it, so lines need no other node's place.
    """
    escaped = F.col("id")
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(c), F.lit(name))
    identity = F.when(F.col("identity").isNotNull(), F.format_string(' identity="%.2f"', F.col("identity").cast("double"))).otherwise("")
    node = F.concat(F.repeat(F.lit(" "), F.size("path")), F.lit('<node id="'), escaped, F.lit('" len="'), F.col("len").cast("string"), F.lit('"'), identity, F.lit(' leaves="'), F.col("n_leaves").cast("string"), F.lit('"'))
    last = F.lit((1 << 63) - 1)
    lines = nodes.select("cluster_id", F.col("path").alias("at"), F.concat(node, F.when(F.col("leaf"), "/>").otherwise(">")).alias("value"))
    closed = nodes.where("not leaf").select("cluster_id", F.concat("path", F.array(last)).alias("at"), F.concat(F.repeat(F.lit(" "), F.size("path")), F.lit("</node>")).alias("value"))
    tops = nodes.where(F.size("path") == 1).groupBy("cluster_id").agg(F.sum("n_leaves").alias("n"))
    begin = tops.select("cluster_id", F.array().cast("array<bigint>").alias("at"), F.format_string('<cluster id="%s" leaves="%d">', F.col("cluster_id").cast("string"), "n").alias("value"))
    end = tops.select("cluster_id", F.array(last).alias("at"), F.lit("</cluster>").alias("value"))
    return lines.unionByName(closed).unionByName(begin).unionByName(end)


def write_forest_xml(nodes: DataFrame, path: str) -> None:
    """Nested XML of any depth as text: files in order, each with whole clusters. A cluster's lines are sorted, not gathered."""
    forest_xml(nodes).repartitionByRange("cluster_id").sortWithinPartitions("cluster_id", "at").select("value").write.text(path)


HIT_SCHEMA = "qid string, sid string, iden double, aln_len long, mismatches long, gaps long, qfrom long, qend long, sfrom long, send long, evalue double, score double"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits with frame and hsp_no; ids ``index.length`` give q_len and s_len. Files are in the search's order."""
    from kinstrand.operators.hsp import frame

    raw = _numbered(spark.read.option("comment", "#").csv(path, sep="\t", schema=HIT_SCHEMA))
    length = lambda c: F.regexp_extract(c, r"\.(\d+)$", 1).try_cast("long")
    order = F.row_number().over(Window.partitionBy("qid", "sid").orderBy("file", "n"))
    return raw.withColumn("q_len", length("qid")).withColumn("s_len", length("sid")).withColumn("frame", frame()).withColumn("hsp_no", order.cast("long")).drop("file", "n")


def write_hits(hits: DataFrame, path: str) -> None:
    hits.select(*(c.split()[0] for c in HIT_SCHEMA.split(", "))).write.csv(path, sep="\t")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id, text of ``id<white space>text`` lines; ids lose ``>`` and blanks in texts become dots."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return raw.select(F.regexp_extract("value", r"^>?(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_extract("value", r"^\S+\s+(.*?)\s*$", 1), " ", ".").alias("text"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.regexp_extract("value", r"^>?(\S+)", 1).alias("id")).distinct()


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """sample, data (array) of white-space separated lines; ``#`` comments and blank lines are skipped."""
    raw = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#|$)")))
    fields = F.split(F.trim("value"), r"\s+")
    return raw.select(F.get(fields, F.lit(0)).alias("sample"), F.slice(fields, 2, 1000).alias("data"))


def annotate_references(records: DataFrame, annotations: DataFrame, uracil: bool = True) -> DataFrame:
    """``records`` (id, seq_raw) renamed ``id|annotation``, U written as T; order them by length, longest first."""
    named = records.join(annotations, "id", "left")
    seq = F.translate("seq_raw", "Uu", "Tt") if uracil else F.col("seq_raw")
    return named.select("id", F.when(F.col("text").isNull(), F.col("id")).otherwise(F.concat("id", F.lit("|"), "text")).alias("descr"), seq.alias("seq_raw"), F.length("seq_raw").alias("len"))


def sample_biom(table: DataFrame, samples: list[str]) -> DataFrame:
    """One row ``value``: an OTU table (otu and a column for each sample) as BIOM JSON, sparse. For tables that fit a file, as the format does."""
    cells = table.select("otu", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(s).alias("n")) for i, s in enumerate(samples)))).alias("x")).where("x.n > 0")
    rows = table.select("otu").withColumn("r", F.row_number().over(Window.orderBy("otu")) - 1)
    packed = cells.join(rows, "otu").agg(F.array_sort(F.collect_list(F.array("r", "x.c", F.col("x.n").cast("int")))).alias("data"))
    names = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "otu"))), lambda x: F.struct(x.otu.cast("string").alias("id"), F.lit(None).cast("string").alias("metadata"))).alias("rows"))
    columns = F.array(*(F.struct(F.lit(s).alias("id"), F.lit(None).cast("string").alias("metadata")) for s in samples))
    return packed.crossJoin(names).select(F.to_json(F.struct(F.lit("Biological Observation Matrix 1.0.0").alias("format"), F.lit("OTU table").alias("type"), F.lit("sparse").alias("matrix_type"), F.lit("int").alias("matrix_element_type"), F.array(F.size("rows"), F.lit(len(samples))).alias("shape"), "rows", columns.alias("columns"), "data"), {"ignoreNullFields": "false"}).alias("value"))
