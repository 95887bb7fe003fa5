"""The pipeline's stages one after another on the smallest tables, each against a plain version on what its predecessor kept."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from kinstrand.llm import toxicity
from kinstrand.llm.common import cut, table

from test_shingle_join import plain as near_plain

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def _without_shared_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    holders = defaultdict(set)
    for d, text in rows.items():
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    drops = lambda d, line: len(key(line)) >= 10 and min(holders[key(line)]) != d
    return {d: "\n".join(x for x in (text or "").split("\n") if not drops(d, x)) for d, text in rows.items()}


def test_every_stage_works_on_what_is_left(spark):
    docs = cut(table(spark, SF, "documents"), "test")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert tuple(after.columns) == corpus_pipeline.COLUMNS
        seen.append((name, docs, after))
        docs = after
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    name, before, after = seen[0]
    scores = toxicity.score_toxicity(before, toxicity.fit(before, table(spark, SF, "labels")))
    wanted = {r.doc_id for r in scores.collect() if r.score < 0.5}
    assert name == "toxicity" and set(texts(after)) == wanted  # these few labels reject none; see the next test

    name, before, after = seen[1]
    left, found = _without_shared_lines(texts(before)), texts(after)
    assert name == "line_dedup" and {d: t or "" for d, t in found.items()} == left

    name, before, after = seen[2]
    rows = texts(before)
    kept = set(near_plain(sorted(rows.items())).values())
    assert name == "simhash_near_dedup" and texts(after) == {d: rows[d] for d in kept}

    name, before, after = seen[3]
    rows, taken = texts(before), Counter(r.doc_id for r in after.collect())
    assert name == "mixing" and max(taken.values()) <= 2 and texts(after) == {d: rows[d] for d in taken}

    name, before, after = seen[4]
    packed = defaultdict(list)
    for r in after.collect():
        packed[r.sequence_id].append((r.offset, r.length))
    assert name == "packing" and {r.doc_id for r in after.collect()} == set(taken)
    assert sum(r.piece == 0 for r in after.collect()) == sum(taken.values())
    for pieces in packed.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


def test_toxic_documents_go(spark):
    larger = SF.replace("0.001", "0.01")
    docs = cut(table(spark, larger, "documents"), "test")
    scores = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, larger, "labels"))).collect()
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, larger).collect()}
    assert kept == {r.doc_id for r in scores if r.score < 0.5} and 0 < len(kept) < len(scores)
