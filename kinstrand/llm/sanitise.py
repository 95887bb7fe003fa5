"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Values of four kinds are found by pattern in every text: e-mail addresses, IP addresses, card numbers that pass Luhn's
check, phone numbers. Each value is an entity to protect. A term, a word near an entity, discloses it as far as the corpus
tells: with N documents, n(e) and n(t) that hold the entity and the term and n(e, t) that hold the term near the entity,

    PMI(e; t) = log(n(e, t) N / (n(e) n(t)))    of    IC(e) = log(N / n(e))

is what the term tells of what there is to know. Where n(e, t) is at least ``SUPPORT`` documents and the share is at least
``DISCLOSURE``, the term's places near that entity are protected too. It is generalised to its first ``STEM`` letters if these
tell less than that even if n of the stem is no more than that of its most frequent word and all its words meet
the entity in different documents; else it is removed. Documents without an entity are left alone.

One pass finds values and the words around them; these are stored, with no more words than ``NEAR`` on each side of a value. All counts
cover all documents and are combined before each shuffle; words are counted only as sets of a document. No task and no
broadcast holds a list of entities or terms, so a value in a third of all documents is one row of each count.

Null text is empty. A text's time and memory follow its length. Copies of a document count as documents. Rows with one doc_id, a null one or
equal texts keep a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import ascii_lower, cut

#: Words on each side of a value that may give it away; the shortest that counts, in code points.
NEAR, SHORTEST = 8, 3
#: Documents in which a term must meet an entity, and the share of the entity's information that it may tell.
SUPPORT, DISCLOSURE = 3, 0.9
#: Letters that a generalised term keeps.
STEM = 4

KINDS = ("email", "ip", "card", "phone")
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match ends where its digits end, so none begins inside digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, ``@`` and domain: the part before each ``@`` goes back as far as its letters and the match before allow."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def values(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every value, by start, then by the order of ``KINDS``."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    small = lambda x: len(x := x.lstrip("0")) <= 3 and int(x or 0) <= 255
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def spelled(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def entity(kind: str, value: str) -> str:
    """Values that differ in case or separators only are one entity."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _digits(value)}"


def around(text: str, spans: list[tuple[int, str, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, word, start, end) of the words near each value, apart from those in a value."""
    if not spans:
        return []
    inside, last = [], 0  # values as disjoint stretches
    for s, _, e in spans:
        if inside and s < last:
            inside[-1] = (inside[-1][0], max(last, e))
        else:
            inside.append((s, e))
        last = inside[-1][1]
    words, k = [], 0
    for m in _WORD.finditer(text):
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if k == len(inside) or inside[k][0] >= m.end():
            words.append((m.start(), m.end()))
    out = {}
    for s, kind, e in spans:
        name = entity(kind, text[s:e])
        low, high = bisect_left(words, (s, 0)), bisect_left(words, (e, 0))
        for a, b in words[max(0, low - NEAR) : low] + words[high : high + NEAR]:
            if b - a >= SHORTEST:
                out[name, a] = (name, text[a:b].translate(_LOWER), a, b)
    return list(out.values())


_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = "array<struct<start: int, kind: string, end: int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    for batch in batches:
        spans, entities, near = [], [], []
        for text in batch["text"]:
            text = text.as_py() or ""
            found = values(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            entities.append(sorted({entity(k, text[s:e]) for s, k, e in found}))
            near.append([dict(zip(("entity", "word", "start", "end"), x, strict=True)) for x in around(text, found)])
        columns = [pa.array(spans, spans_type), pa.array(entities, pa.list_(pa.string())), pa.array(near, _NEAR)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "base", "entities", "near"])


def find(docs: DataFrame, with_text: bool) -> DataFrame:
    """id (of the row), doc_id, text if asked for, base (values), entities and near (words by values) of every row of ``docs``. Stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text")
    kinds = f"id long, {docs.select('doc_id').schema.simpleString()[7:-1].replace(':', ' ')}, text string, base {_FOUND}, entities array<string>, near array<struct<entity: string, word: string, start: int, end: int>>"
    found = rows.mapInArrow(_find, kinds)
    return cut(found if with_text else found.drop("text"), "values")


def _words(docs: DataFrame) -> DataFrame:
    """(word, n): documents that hold a word."""
    each = docs.select(F.explode(F.array_distinct(F.split(ascii_lower(F.coalesce("text", F.lit(""))), _NOT_WORD))).alias("word"))
    return each.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))


def share(together: Column, held: Column, by_term: Column, all_: Column) -> Column:
    """PMI of entity and term by the entity's information; an entity of all documents has none to tell."""
    return F.when(held < all_, F.ln(together * all_ / (held * by_term)) / F.ln(all_ / held)).otherwise(F.lit(0.0))


def risky(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, word, general): terms that disclose an entity, and whether their stem does for them. Stored."""
    total = found.agg(F.count("*").cast("double").alias("all"))
    pair = F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x.entity, x.word)))).alias("p")
    pairs = found.where(F.size("near") > 0).select(pair).groupBy("p.entity", "p.word").agg(F.count("*").alias("together"))
    pairs = cut(pairs.where(F.col("together") >= support), "pairs")
    held = found.where(F.size("entities") > 0).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("held"))
    stem = F.substring("word", 1, STEM)
    stems = pairs.select(stem.alias("stem")).distinct()
    # of the words with the stem of a term that is asked for, all; a stem is in as many documents as its most frequent word at least
    counts = cut(_words(docs).withColumn("stem", stem).join(stems, "stem", "left_semi"), "words")
    most = counts.groupBy("stem").agg(F.max("n").alias("most"))
    sums = pairs.groupBy("entity", stem.alias("stem")).agg(F.sum("together").alias("sum"))
    rows = pairs.withColumn("stem", stem).join(counts.select("word", "n"), "word").join(held, "entity").crossJoin(F.broadcast(total))
    rows = rows.where(share(F.col("together"), F.col("held"), F.col("n"), F.col("all")) >= disclosure)
    rows = rows.join(most, "stem").join(sums, ["entity", "stem"])
    bound = share(F.least("sum", "held"), F.col("held"), F.col("most"), F.col("all"))
    general = (bound < disclosure) & (F.length("word") > STEM)
    return cut(rows.select("entity", "word", general.alias("general")), "risky")


def _all_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``found`` with ``spans``: values and the places of terms, by start."""
    near = found.where(F.size("near") > 0).select("id", F.explode("near").alias("x")).select("id", "x.*")
    hits = near.join(terms, ["entity", "word"]).groupBy("id", "start", "end").agg(F.min("general").alias("general"))
    hits = hits.select("id", F.struct("start", F.when(F.col("general"), "generalised").otherwise("removed").alias("kind"), "end").alias("span"))
    hits = hits.groupBy("id").agg(F.collect_list("span").alias("more"))
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x.kind)
    joined = found.join(hits, "id", "left").withColumn("more", F.coalesce("more", F.array().cast(_FOUND)))
    order = F.sort_array(F.transform(F.concat("base", "more"), lambda x: F.struct(x.start.alias("start"), rank(x).alias("rank"), x.kind.alias("kind"), x.end.alias("end"))))
    return joined.withColumn("spans", F.transform(order, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))).drop("more")


def shown(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, base (start, kind, end of each value) and spans (these and the terms to generalise or remove) of every row of ``docs`` (doc_id, text)."""
    found = find(docs, with_text=False)
    return _all_spans(found, risky(docs, found, support, disclosure)).select("doc_id", "base", "spans")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            text, parts, at = text.as_py(), [], 0
            for x in spans.as_py():
                s, e = max(at, x["start"]), x["end"]
                if text is None or s >= e:
                    continue
                kind = x["kind"]
                parts += [text[at:s], f"{text[s : s + STEM]}*" if kind == "generalised" else "" if kind == "removed" else f"<{kind}>"]
                at = e
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.string()), batch["spans"]], names=["doc_id", "text", "spans"])


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, text and spans: values replaced by their kind in brackets, terms by their stem and a star, or by nothing."""
    found = find(docs, with_text=True)
    spans = _all_spans(found, risky(docs, found, support, disclosure)).select("doc_id", "text", "spans")
    return spans.mapInArrow(_redact, spans.schema)
