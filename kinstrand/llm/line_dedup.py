"""Line dedup: lines that several documents share stay in one of them.

Lines are exploded with their document and position, and the 96-bit hash of each normalised line is
stored, once. A small aggregate for each hash (smallest and largest doc_id, combined before the
shuffle, so a line in every document costs a row for each task) tells which hashes are in two
documents or more. Only those meet the stored lines again, as positions that go, and the text is
reassembled by position from the lines that stay.

A hash that holds a ``HOT``-th of all lines or more is hot; there are at most ``HOT`` of them, so they meet the lines
where these are stored. The others are joined by hash, where none is more than that share of the rows.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least ``least``
code points that are in at least ``threshold`` documents lose all their lines except in the smallest doc_id
that has them, where all stay. Null and empty texts are one empty line. A null doc_id orders before all
others; rows with the same doc_id are one document for the counts, and each is
returned. Other columns are kept, whatever their names, but for those of the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import SPACES, cut, id_key

#: A hash with this part of all lines is joined without a shuffle; so many hashes can have it at most.
HOT = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts of such letters alone: their lower case changes A-Z and nothing else.
_SURE = "^[\\x00-\\x7Fß-ÿ]*$"


def line_key(line: Column) -> Column:
    """The line as it is compared."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """d, t (a hash of the text), p (place from 0), a and b (96 bits of the key) of each line whose key is long enough.

    Each step is a projection of its own, so the JVM code makes every value once.
    """
    texts = docs.select(id_key().alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("d", F.xxhash64("text").alias("t"), "text")
    lines = texts.select("d", "t", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where(F.octet_length("line") >= least)
    cores = lines.select("d", "t", "p", F.btrim("line", F.lit(SPACES)).alias("core"))
    cores = cores.select("d", "t", "p", "core", F.length("core").alias("n")).where(F.col("n") >= least)
    fast = (F.octet_length("core") == F.col("n")) | F.rlike("core", F.lit(_SURE))
    keys = cores.select("d", "t", "p", F.when(fast, F.lower("core")).otherwise(F.translate("core", _UPPER, _LOWER)).alias("key"))
    return keys.select("d", "t", "p", F.xxhash64("key").alias("a"), F.hash("key").alias("b"))


def shared_lines(lines: DataFrame, threshold: int) -> DataFrame:
    """a, b, first (the document that keeps the line) and n (how many lines) of keys in enough documents."""
    if threshold <= 2:
        found = lines.groupBy("a", "b").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"))
        return found.where("first < last").drop("last")
    each = lines.groupBy("a", "b", "d").agg(F.count("*").alias("n"))
    return each.groupBy("a", "b").agg(F.min("d").alias("first"), F.count("*").alias("holders"), F.sum("n").alias("n")).where(F.col("holders") >= threshold).drop("holders")


def dedup_lines(docs: DataFrame, least: int = 10, threshold: int = 2) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, the lines that stay joined by \\n."""
    lines = cut(hashed_lines(docs, least), "lines")
    shared = cut(shared_lines(lines, threshold), "shared-lines")
    hot = F.col("n") >= max(lines.count() // HOT, 1)
    # at most HOT rows
    near = lines.join(F.broadcast(shared.where(hot).select("a", "b", "first")), ["a", "b"])
    far = lines.join(shared.where(~hot).select("a", "b", "first"), ["a", "b"])
    goes = near.unionByName(far).where("d > first").groupBy("d", "t").agg(F.collect_set("p").alias("goes"))
    goes = goes.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("goes").alias("__goes"))

    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(goes, (id_key(docs["doc_id"]) == F.col("__d")) & (F.xxhash64(text) == F.col("__t")), "left")
    # documents that lose nothing are not taken apart; in others a hash set finds the places that stay
    loses = F.col("__goes").isNotNull()
    joined = joined.withColumn("__lines", F.when(loses, F.split(text, "\n", -1)))
    joined = joined.withColumn("__stay", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__goes")))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *(docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")),
        n_lines.cast("long").alias("n_lines"),
        F.when(loses, F.size("__goes")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(loses, F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n")).otherwise(text).alias("kept_text"),
    )
