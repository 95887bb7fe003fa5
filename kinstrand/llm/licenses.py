"""License scans: phrase places, and an exact set-similarity join of text blocks with templates.

A block is any run of consecutive words, across line ends, half as long again as the template it is held against; its tokens
are the set of its words. A block matches a template if it has at least ``containment`` of the
template's tokens. The join is exact. Tokens are ordered by how many documents of the scanned table have them, rarest first. Of what a block
shares with a template, one token comes first in that order; if the block matches, it is one of the template's first ``size - need + 1``, so
places of words are joined with an index of these tokens only (prefix filter), by equality. From the template's tokens within a
block's reach of such a place the join goes on only if there are ``need`` (length filter), and only if those that come after the place's own token in the order are
``need - 1`` (positional filter: what comes before belongs to other places). What is left is verified by counting distinct tokens from each start.

Templates are rows of a table, so a list of any length makes the same plan; the index is broadcast after its size is checked.
Places of a document are rows of the join, each with the words in reach only, so a text with many of them is no single unit, whatever words are frequent;
its matches are combined by task before they meet.

Texts are read once: what is kept of one, in a stored table, is its number of words and the places of the words that
phrases and templates are made of. Frequencies come from that table.

Words are maximal runs of characters other than ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Null
text is empty: no words, labels are empty strings, score 0. A null doc_id and repeated rows keep a row
each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import cut

#: Phrases whose places are counted, with their labels.
PHRASES: Mapping[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License statements and the labels that a block near to them gets.
TEMPLATES: Mapping[str, str] = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl-3.0",
    "licensed under the mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "creative-commons",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
}
CONTAINMENT = 0.8
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The only letter beyond A-Z whose lower case is one of a-z.
_KELVIN = "\u212a"


def block_words(template: str) -> int:
    """How many words a block has that is held against ``template``."""
    n = len(template.split())
    return n + (n + 1) // 2


def placed_words(docs: DataFrame, vocabulary: set[str]) -> DataFrame:
    """doc_id, n_words and hits, the places (p from 0, in order) of the words w of ``vocabulary``, for each row of ``docs``."""
    # lower case beyond A-Z changes no word of a-z, once the one letter that becomes one is out of the way
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit(_KELVIN), F.lit("\u0138")))
    rows = docs.select("doc_id", F.split(text, _SEPARATORS + "+", -1).alias("w"))
    lead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    trail = F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    at = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(sorted(vocabulary)), i)))
    rows = rows.select("doc_id", (F.size("w") - lead - trail).cast("long").alias("n_words"), lead.alias("lead"), at.alias("at"), "w")
    return rows.select("doc_id", "n_words", F.transform("at", lambda i: F.struct((i - F.col("lead")).alias("p"), F.get("w", i).alias("w"))).alias("hits"))


def document_frequencies(placed: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How many documents have each word of ``vocabulary``, a bounded set."""
    seen = placed.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x.w))).alias("w"))
    return dict.fromkeys(vocabulary, 0) | {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}


#: Rows that the index of prefix tokens may have to be broadcast: a template has as many as it may lack tokens, and one.
MOST_INDEX_ROWS = 100_000
_INDEX = "template int, w string, at int, size int, need int, length int, tokens array<string>"


def index_rows(frequencies: Mapping[str, int], templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> list[tuple]:
    """A row for each prefix token of each template: template, token, its place in the template's order (from 1), size, need, words of a block, all tokens in order."""
    rows = []
    for template, text in enumerate(templates):
        tokens = sorted(set(text.split()), key=lambda w: (frequencies[w], w))
        need = math.ceil(containment * len(tokens) - 1e-9)
        rows += [(template, w, at, len(tokens), need, block_words(text), tokens) for at, w in enumerate(tokens[: len(tokens) - need + 1], 1)]
    return rows


def candidates(placed: DataFrame, rows: list[tuple], filters: tuple[str, ...] = ("length", "position")) -> DataFrame:
    """id, template, p, size, need, length and near of the places that prefix tokens, and the filters, leave.

    ``near``: places (p, w) within a block's reach of p of the template's tokens, from the own one on in the template's order.
    """
    spark = placed.sparkSession
    reach = max((r[5] for r in rows), default=1)
    prefixes = spark.createDataFrame(rows, _INDEX)
    if len(rows) <= MOST_INDEX_ROWS:
        prefixes = F.broadcast(prefixes)
    words = sorted({r[1] for r in rows})
    at = F.array_compact(F.transform("hits", lambda x, k: F.when(x.w.isin(words), k)))
    anchors = placed.select("id", "hits", F.explode(at).alias("k"))
    anchors = anchors.select("id", F.get("hits", F.col("k")).alias("own"), F.slice("hits", F.greatest(F.col("k") - (reach - 1), F.lit(0)) + 1, 2 * reach - 1).alias("around"))
    met = anchors.select("id", F.col("own.p").alias("p"), F.col("own.w").alias("w"), "around").join(prefixes, "w")
    met = met.withColumn("mine", F.filter("around", lambda x: (F.abs(x.p - F.col("p")) < F.col("length")) & F.array_contains("tokens", x.w)))
    if "length" in filters:
        met = met.where(F.size("mine") >= F.col("need"))
    met = met.withColumn("near", F.filter("mine", lambda x: F.array_position("tokens", x.w) >= F.col("at")))
    if "position" in filters:
        met = met.where(F.size(F.array_distinct(F.transform("near", lambda x: x.w))) >= F.col("need"))
    return met.select("id", "template", "p", "size", "need", "length", "near")


def verified(found: DataFrame) -> DataFrame:
    """id, template, n and first_word: the block with most distinct tokens of the template, the earliest of equals, where it has ``need``."""

    def counted(start: Column) -> Column:
        inside = F.filter("near", lambda x: (x.p >= start.p) & (x.p < start.p + F.col("length")))
        return F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x.w))).alias("n"), (-start.p).alias("o"))

    best = found.select("id", "template", "size", "need", F.array_max(F.transform(F.filter("near", lambda x: x.p <= F.col("p")), counted)).alias("b"))
    best = best.where(F.col("b.n") >= F.col("need")).groupBy("id", "template", "size").agg(F.max("b").alias("b"))
    return best.select("id", "template", (F.col("b.n") / F.col("size")).alias("score"), (-F.col("b.o")).cast("long").alias("first_word"))


def _phrase_places(hits: Column, phrase: str) -> Column:
    """The first words of all places where the phrase's words stand one after the other."""
    first, *rest = phrase.split()

    def stands(x: Column, k: Column) -> Column:
        ok = x["w"] == first
        for i, word in enumerate(rest, 1):
            other = F.get(hits, k + i)
            ok = ok & F.coalesce((other["w"] == word) & (other["p"] == x["p"] + i), F.lit(False))
        return ok

    return F.transform(F.filter(hits, stands), lambda x: x["p"])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches of every row of ``docs`` (doc_id, text).

    matches are the best blocks: (label, score, first_word). score is the best containment; 1 where a phrase stands.
    """
    vocabulary = {w for t in [*templates, *PHRASES] for w in t.split()}
    placed = cut(placed_words(docs, vocabulary).withColumn("id", F.monotonically_increasing_id()), "license-words")
    rows = index_rows(document_frequencies(placed, vocabulary), templates, containment)
    names = F.array(*map(F.lit, templates.values()))
    found = verified(candidates(placed, rows)).select("id", F.struct(F.get(names, F.col("template")).alias("label"), "score", "first_word").alias("m"))
    matches = found.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("matches"))  # as many as there are templates at most
    rows = placed.select("id", "doc_id", "n_words", *(_phrase_places(F.col("hits"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    rows = rows.select("id", "doc_id", "n_words", every.alias("places"), base.alias("base")).join(matches, "id", "left")
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label: string, score: double, first_word: bigint>>")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("matches", lambda x: x.label))), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda x: x.score)), F.lit(0.0))).alias("score"),
        "matches",
    )
