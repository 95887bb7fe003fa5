"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps its measurements and one
failure bit for each rule. Policies are named, versioned sets of rules, so which
documents stay is a mask test on the ledger, and what each rule costs a policy (ablation) is
a count over distinct bit patterns. Texts are not read again.

All of it is column expressions: no explode and no shuffle in the ledger. Repeated
three-word windows are found by sorting a text's own window hashes, and only
in texts where two are equal.

Null text is empty: no words, lines without words. Null doc_ids and repeated rows keep a row
each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import words

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _fails() -> dict[str, Column]:
    """Rules in the order of their bits; new ones go to the end, so stored ledgers stay readable."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "dup_lines": (F.col("n_lines") >= 4) & (10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        "short_words": F.col("word_chars") < 2 * n,
        "long_words": F.col("word_chars") > 20 * n,
    }


RULES = ("few_words", "repeats", "symbols", "dup_lines", "short_words", "long_words")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(x) for x in self.rules)


POLICIES: Mapping[tuple[str, int], Policy] = {
    (p.name, p.version): p
    for p in (
        Policy("base", 1, ("few_words", "repeats")),
        Policy("prose", 1, ("few_words", "repeats", "symbols", "dup_lines")),
        Policy("prose", 2, RULES),
    )
}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, a bit for each of ``RULES``, of every row of ``docs`` (doc_id, text).

    n_words; word_chars (code points in words); n_symbols; n_lines and n_dup_lines (lines with a word, and of
    those the ones equal to an earlier line); n_repeat_words (words in three-word
    windows that occur twice or more in the text, first occurrences included).
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    gram = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW)))
    base = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[" + SYMBOLS + "]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), gram)).otherwise(F.array().cast("array<long>")).alias("grams"),
    )
    base = base.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "grams",
    )
    # only texts with equal windows are sorted; the rest have nothing to sort
    base = base.withColumn("grams", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")).otherwise(F.array().cast("array<long>")))
    base = base.withColumn("placed", F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("n", F.size("placed"))
    base = base.withColumn(
        "places",
        F.sort_array(
            F.transform(
                F.filter(
                    F.arrays_zip(
                        F.col("placed").alias("x"),
                        F.concat(F.array(F.lit(None).cast("long")), F.slice("placed.h", 1, F.greatest(F.col("n") - 1, F.lit(0)))).alias("before"),
                        F.concat(F.slice("placed.h", 2, F.greatest(F.col("n") - 1, F.lit(0))), F.array(F.lit(None).cast("long"))).alias("after"),
                    ),
                    lambda z: (z.before == z.x.h) | (z.after == z.x.h),
                ),
                lambda z: z.x.i,
            )
        ),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s.n + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s.n,
    )
    base = base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    bits = sum((F.when(fails, F.lit(1 << RULES.index(rule))).otherwise(F.lit(0)) for rule, fails in _fails().items()), F.lit(0))
    return base.withColumn("failed", bits.cast("long"))


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, documents that only it fails, and what is kept without it."""
    masked = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << RULES.index(x)).cast("long").alias("bit")) for x in policy.rules))
    each = masked.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("failed_only_this"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    )
