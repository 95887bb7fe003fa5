"""Compositions of operators: OTU tables, small RNA tables, spliced references, hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.functions import sequences as S
from kinstrand.operators import clusters as C
from kinstrand.operators import chimeras, duplicates, evaluation, greedy, hsp, ranking, similarity
from kinstrand.operators.similarity import Options


def named(clusters: DataFrame, names: DataFrame) -> DataFrame:
    """``clusters`` with the ids of ``names`` (seq_idx, id)."""
    return clusters.join(names.select("seq_idx", "id"), "seq_idx")


def otus_of_sample(mates: DataFrame, share: float = 0.00001, identity: float = 0.99, cover: int = 50) -> DataFrame:
    """Clusters of one sample's read pairs (seq_idx, id, r1, r2) without chimeric and small ones.

    Pairs at 100 %, their representatives at ``identity``, each mate alone at ``identity`` of a local alignment of ``cover`` letters or more; a pair
    whose mates belong to different more abundant parents is a chimera. What stays is expanded again.
    """
    merged = mates.select("seq_idx", "id", S.merge_mates("r1", "r2").alias("seq"))
    nr = greedy.stored(duplicates.exact(ranking.rank_by_length(merged.select("seq_idx", "seq"))))
    size = nr.where("is_rep").select("seq_idx", "rank", F.col("abundance").alias("n"))
    reps = merged.join(size.select("seq_idx"), "seq_idx", "left_semi")
    options = Options.nucleotide(identity=identity, both_strands=False, word=10)
    otu = named(similarity.cluster(reps.select("seq_idx", "seq"), options), reps)
    single = Options.nucleotide(identity=identity, both_strands=False, word=10, global_identity=False, cover_least=cover)

    def parent(mate: str) -> DataFrame:
        rows = mates.join(size, "seq_idx").select("seq_idx", F.col(mate).alias("seq"))
        c = similarity.cluster(rows, single)
        heads = c.where("is_rep").select("cluster_id", F.col("seq_idx").alias("rep"))
        return c.join(heads, "cluster_id").select("seq_idx", "rep")

    sizes = size.select(F.col("seq_idx").alias("rep"), F.col("n").alias("rep_n"))
    groups = otu.select(F.col("seq_idx").alias("rep"), F.col("cluster_id").alias("otu"))
    table = size.select(F.col("seq_idx").alias("cluster_id"), "n")
    for i, mate in ((1, "r1"), (2, "r2")):
        p = parent(mate).join(sizes, "rep").join(groups, "rep").select(F.col("seq_idx").alias("cluster_id"), F.col("rep").alias(f"r{i}_rep"), F.col("rep_n").alias(f"r{i}_n"), F.col("otu").alias(f"r{i}_otu"))
        table = table.join(p, "cluster_id")
    kept = evaluation.drop_chimeric_and_small(table, share).where("reason is null").select(F.col("cluster_id").alias("seq_idx"))
    child = nr.join(merged.select("seq_idx", "id"), "seq_idx")
    child = child.join(child.where("is_rep").select(F.col("rank").alias("rr"), F.col("seq_idx").alias("cid")), F.col("rep_rank") == F.col("rr"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("rank")) - 1
    child = child.select(F.col("cid").alias("cluster_id"), place.cast("long").alias("member_no"), "id", F.col("len").cast("long").alias("len"), "is_rep", F.when(~F.col("is_rep"), 100.0).alias("identity"))
    parents = otu.join(kept, "seq_idx", "left_semi").select("cluster_id", "member_no", "id", F.col("len").cast("long").alias("len"), "is_rep", (100 * F.col("identity").cast("double")).alias("identity"))
    return C.expand(parents, child)


def pooled_otus(clusters: DataFrame, hits: DataFrame, samples: Sequence[str], is_sample: Column) -> DataFrame:
    """OTU x sample counts: reference members (``hits``, a cluster table with the same representatives) merged in, the best reference for each cluster."""
    merged = C.drop_reference_only(C.best_reference(C.merge(clusters, hits), is_sample), is_sample)
    sample = F.regexp_extract("id", r"^Sample\|([^|]+)\|", 1)
    rows = merged.select(F.col("cluster_id").alias("otu"), F.when(is_sample, sample).alias("sample"), F.when(~is_sample, F.regexp_extract("id", r"\|(.*)$", 1)).alias("annotation"))
    return evaluation.annotated_table(rows, samples)


def three_stage_otus(reads_: DataFrame, cutoffs: Sequence[float] = (0.9925, 0.985, 0.97), least: int = 2) -> DataFrame:
    """Duplicates and chimeras out, then clusters at rising distance; small clusters go before the last stage."""
    nr = greedy.stored(duplicates.exact(ranking.rank_by_length(reads_)))
    unique = nr.where("is_rep").select(F.col("seq_idx").alias("id"), "seq", "abundance")
    bad = chimeras.chimeras(unique)
    rows = unique.where(F.col("abundance") >= least).join(bad.select("id"), "id", "left_anti").select(F.col("id").alias("seq_idx"), "seq")
    for c in cutoffs[:-1]:
        step = similarity.cluster(rows, Options.nucleotide(identity=c, both_strands=False))
        rows = greedy.stored(rows.join(step.where("is_rep").select("seq_idx"), "seq_idx", "left_semi"))
    return similarity.cluster(rows, Options.nucleotide(identity=cutoffs[-1], both_strands=False))


def small_rna_table(reads_: DataFrame, references: DataFrame, samples: Sequence[str], identity: float = 0.95, drop: int = 1, spike_ins: DataFrame | None = None) -> DataFrame:
    """otu, annotation and sample counts of short reads (seq_idx, id ``Sample|s|n``, seq) against annotated references (seq_idx, id, seq).

    ``spike_ins``, a second set of such references, adds a column ``spike``: the best of them for each otu.
    """
    nr = greedy.stored(duplicates.exact(ranking.rank_by_length(reads_.select("seq_idx", "seq"))))
    reps = nr.where(F.col("is_rep") & (F.col("abundance") > drop))
    options = Options.nucleotide(identity=identity, both_strands=False, word=8)
    otu = greedy.stored(similarity.cluster(reps.select("seq_idx", "seq"), options))
    heads = otu.where("is_rep").select("cluster_id", F.col("seq_idx").alias("rep"))
    member = otu.select("seq_idx", F.col("cluster_id").alias("otu"))
    back = nr.select(F.col("rank").alias("rr"), F.col("seq_idx").alias("ri")).join(member, F.col("ri") == F.col("seq_idx")).select("rr", "otu")
    all_reads = nr.join(back, F.col("rep_rank") == F.col("rr")).join(reads_.select("seq_idx", "id"), "seq_idx").select("otu", F.regexp_extract("id", r"^Sample\|([^|]+)\|", 1).alias("sample"), F.lit(None).cast("string").alias("annotation"))
    first = reps.join(heads, F.col("seq_idx") == F.col("rep")).select("seq_idx", "seq", "cluster_id")
    options = Options.nucleotide(identity=identity, both_strands=False, word=8, length_share2=0.8, mode="accurate")

    def best(known: DataFrame) -> DataFrame:
        """(otu, annotation): the most identical reference that joins the otu, the first of equals."""
        hits = similarity.compare(first.select("seq_idx", "seq"), known.select("seq_idx", "seq"), options)
        names = hits.join(known.select(F.col("seq_idx").alias("q"), "id"), "q").join(first.select(F.col("seq_idx").alias("r"), F.col("cluster_id").alias("otu")), "r")
        return names.groupBy("otu").agg(F.min_by("id", F.struct(-F.col("identity"), "q")).alias("annotation"))

    found = best(references).select("otu", F.lit(None).cast("string").alias("sample"), "annotation")
    table = evaluation.annotated_table(all_reads.unionByName(found), samples)
    return table if spike_ins is None else table.join(best(spike_ins).withColumnRenamed("annotation", "spike"), "otu", "left")


def splice(references: DataFrame, hits1: DataFrame, hits2: DataFrame, keep1: int, keep2: int) -> DataFrame:
    """seq_idx, r1, r2: the stretches of references that two primers' hits bracket.

    ``hits1`` and ``hits2`` (seq_idx, start) tell where the consensus of each mate begins (forward) and ends (backward);
    stretches that the reference doesn't reach are filled with N.
    """
    both = references.join(hits1.select("seq_idx", F.col("start").alias("a")), "seq_idx").join(hits2.select("seq_idx", F.col("start").alias("b")), "seq_idx").where("a < b")
    head = F.substr("seq", F.greatest(F.lit(1), F.col("a")), F.least(F.lit(keep1), F.lit(keep1) + F.col("a") - 1).cast("int"))
    r1 = F.rpad(F.lpad(head, F.least(F.lit(keep1), F.greatest(F.length(head), F.length(head) - F.col("a") + 1)).cast("int"), F.lit("N")), F.lit(keep1), F.lit("N"))
    end = F.least(F.col("b"), F.length("seq"))
    begin = F.greatest(F.lit(1), F.col("b") - keep2 + 1)
    tail = F.substr("seq", begin.cast("int"), F.greatest(F.lit(0), end - begin + 1).cast("int"))
    r2 = S.reverse_complement(F.lpad(F.rpad(tail, F.greatest(F.length(tail), F.length(tail) + F.col("b") - F.length("seq")).cast("int"), F.lit("N")), F.lit(keep2), F.lit("N")))
    return both.select("seq_idx", r1.alias("r1"), r2.alias("r2"))


def spliced_references(references: DataFrame, reads1: DataFrame, reads2: DataFrame, keep1: int, keep2: int, columns: int = 45) -> DataFrame:
    """References (seq_idx, seq) cut where the consensus of both mates' first columns aligns: forward for the first, backward for the second.

    The consensus is laid over each reference at 80 % local identity over 30 letters; letters of it before the alignment count on to where the mate begins.
    """
    rows = greedy.stored(references.select("seq_idx", S.normalise("seq").alias("seq")))
    options = Options.nucleotide(identity=0.8, word=5, band=5, global_identity=False, cover_least=30, length_share2=0.01, length_gap2=similarity.UNSET)

    def starts(mates: DataFrame, strand: str) -> DataFrame:
        cols = greedy.stored(evaluation.consensus(mates, columns))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x.letter), "")
        primer = cols.crossJoin(F.broadcast(evaluation.consensus_length(cols))).where("place <= keep").agg(F.lit(0).cast("long").alias("seq_idx"), text.alias("seq"))  # one row
        before = F.col("r_beg") - 1
        hits = similarity.compare(primer, rows, options).where(F.col("strand") == strand)
        return hits.select(F.col("q").alias("seq_idx"), (F.col("q_beg") - before if strand == "+" else F.col("q_beg") + before).alias("start"))

    return splice(rows, starts(reads1, "+"), starts(reads2, "-"), keep1, keep2)


def down_to(sequences: DataFrame, names: DataFrame, *identities: float, hits: float | None = None) -> DataFrame:
    """Hierarchical clusters of residues expanded to one table: 90 % -> 60 % -> ..., and by local hits below that: ``hits`` is their identity, as 0.3."""
    word = lambda c: 5 if c >= 0.7 else 4 if c >= 0.6 else 3 if c >= 0.5 else 2
    levels = similarity.hierarchical(sequences, *(Options(identity=c, word=word(c)) for c in identities))
    tables = [named(x, names).select("cluster_id", "member_no", "id", F.col("len").cast("long").alias("len"), "is_rep", (100 * F.col("identity").cast("double")).alias("identity")) for x in levels]
    if hits is not None:
        rows = sequences.withColumn("seq", S.normalise("seq"))
        rows = rows.join(levels[-1].where("is_rep").select("seq_idx"), "seq_idx", "left_semi") if levels else rows
        far = named(hsp.cluster_by_hits(rows, hits), names)
        tables.append(greedy.stored(far.select("cluster_id", "member_no", "id", F.col("len").cast("long").alias("len"), "is_rep", F.col("identity").cast("double").alias("identity"))))
    out = tables[-1]
    for table in reversed(tables[:-1]):
        out = C.expand(out, table).withColumn("identity", F.try_element_at(F.split("path", ","), F.lit(1)).try_cast("double")).drop("path")
    return out
