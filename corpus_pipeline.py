"""A training-data pipeline over ``documents``: five stages, each on all that its predecessor kept.

    toxicity -> line dedup -> near-dedup -> mixing -> best-fit packing

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``; n_chars
follows the text. What a stage decides takes effect: toxic documents go, shared lines go, one
document of each near-duplicate group stays, documents are left out or repeated as the mix says, and the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinstrand.llm import line_dedup, mixing, packing, shingle_join, toxicity
from kinstrand.llm.common import cut, id_key, table
from kinstrand.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).where(F.col("predicted") == 0).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller doc_id has."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return found.select("doc_id", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", "n_dropped", "n_chars").withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates.

    Five-word shingles, Jaccard similarity 0.8 or more, exactly: links of SimHash fingerprints at five bits are checked with whole
    sets, and an exact join finds the pairs whose fingerprints lie farther apart, most of those below 0.9.
    """
    found = shingle_join.near_duplicates(docs, shingle=5, similarity="0.8")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_key().alias("__kept")).distinct()
    return docs.select(*COLUMNS).join(kept, id_key() == F.col("__kept"), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs.select(*COLUMNS)).where(F.col("times") > 0)
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no boosted trees, XXH64 or tokenizer; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, f"stage-{name}")
    return docs
