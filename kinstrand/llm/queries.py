"""The thin queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinstrand.llm import ann, conversation_repair, html_render, licenses, line_dedup, merkle_manifest, mixing, packing, quality, sanitise, simhash, substring_dedup, toxicity
from kinstrand.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), quality.POLICIES["prose", 2])
    base = quality.POLICIES["base", 1].mask
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "failed",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), rows)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in sanitise.KINDS]
    return found.select("doc_id", *counts, F.sha2(sanitise.shown("base"), 256).alias("base_sha256"), sanitise.shown("spans").alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_simhash_near_dedup, op3_best_fit_packing, op4_quality_rules, op5_toxicity,
        op6_nearest_neighbours, op7_html_extraction, op8_line_dedup, op9_mixing, op10_license_scan, op11_conversation_repair,
        op12_merkle_manifest, op13_personal_data,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return OPERATORS | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from kinstrand.llm.oracles import SQL

    return dict(SQL)
