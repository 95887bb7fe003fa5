"""Conversation repair, Merkle manifests and sanitisation against plain versions."""

from __future__ import annotations

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from kinstrand.llm import conversation_repair as repair
from kinstrand.llm import html_render, licenses, merkle_manifest, queries, sanitise


def same(found, wanted):
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(map(tuple, wanted), key=order)


TURNS = "conv_id long, turn long, role string, text string, at int, audit string"


def conversations():
    rng = random.Random(9)
    rows = []
    for conv in range(300):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "u", "\u00e4"])
            text = rng.choice(["Yes.", "No", "", " \t", "What? ", "Well!\n", "so \u00e9t\u00e9", ". x"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, None, "Hm."), (None, 2, "assistant", None), (1000, None, "user", "x" * 70_000 + ".")]
    rows += [(1001, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(200)] + [(1002, 5, "user", "Same.")] * 4
    rows += [(1003, i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["A.", f"b{i}", f"c{i}.", ""])) for i in range(150)]
    return rows


def test_cheapest_edits():
    """Layers against a search over all edits, for every conversation of up to four turns and for longer ones across blocks."""
    kinds = [(r, f) for r in range(4) for f in range(4)]
    names = ("system", "user", "assistant", "tool")
    rng = random.Random(2)
    cases = [[]] + [[k] for k in kinds] + [[a, b] for a in kinds for b in kinds]
    cases += [[rng.choice(kinds) for _ in range(rng.randrange(3, 7))] for _ in range(1500)]
    cases += [[rng.choice(kinds) for _ in range(n)] for n in (31, 32, 33, 64, 65, 100, 200) for _ in range(6)]
    for case in cases:
        seen, turns = [("tool", "x.")], []
        for i, (r, f) in enumerate(case):
            text = ("t%d." % i, " ", None, "t%d" % i)[f]
            if text is None:  # a repeat of this role's own earlier turn, if it has one
                text = next((t for q, t in seen if q == names[r]), "u%d." % i)
            turns.append((names[r], text))
            seen.append(turns[-1])
        code = [names.index(r) + 4 * ("", "blank", "duplicate", "truncated").index(f) for (r, _), f in zip(turns, brute.faults(turns), strict=True)]
        cost, audit, kept = brute.cheapest_edits(turns)
        assert repair.solve(bytes(code)) == (cost, audit)
        step = repair.Repair(audit)
        done = [x for t in turns for x in step.turn(*t)] + list(step.rest())
        assert [x[1:] for x in done] == list(kept)


def test_conversation_repair(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(6)
    hurt = repair.damage(table)
    same(hurt.collect(), brute.damaged(rows))
    found = repair.repair(hurt, table)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    same(found.collect(), brute.repair(brute.damaged(rows), [r[0] for r in rows]))
    whole = repair.repaired_turns(table).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "role"))), lambda x: F.substring(x.role, 1, 1)).alias("r"))
    assert whole.where(~F.array_join("r", "").rlike("^(s?(ua)+)?$")).count() == 0
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0 and repair.repaired_turns(none).count() == 0
    lost = repair.repair(none, table).collect()
    assert {tuple(r)[1:] for r in lost} == {(0, 0, 0, 0, 0, 0, "", brute.sha(""))} and len(lost) == 305


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree int, node string, idx long"


@pytest.mark.parametrize("langs", [["en"], ["en", None], ["a", "b", "\u00e9", "", None, "z", "\U0001f600"]])
def test_merkle_manifest(spark, langs):
    rng = random.Random(len(langs))
    rows = [(rng.randrange(40), f"s{i % 3}", rng.choice(langs), i, f"t\u00e9 {i}") for i in range(137)]
    rows += [(None, None, langs[-1], None, None), (7, "", "lone", (1 << 63) - 1, "x" * 100_000), (14, None, langs[0], None, "")] + [(21, "s", langs[0], 4, "same")] * 3
    rows += [(i, "s", "all", i, "t") for i in range(300, 364)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS).repartition(5)
    found = merkle_manifest.verify(table)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    wanted = brute.merkle(rows)
    same(found.collect(), wanted)
    assert {True, False} == {r[-1] for r in wanted}


def test_merkle_manifest_small(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle_manifest.verify(none).count() == 0
    one = [(3, "s", None, 1, "t")]
    same(merkle_manifest.verify(spark.createDataFrame([(*r, 1, "x", 2) for r in one], DOCS)).collect(), brute.merkle(one))


TEXTS = "doc_id long, text string, id int, base int, spans string, near string"


def letters():
    """(doc_id, text) with values of all kinds, terms that go with some of them, and awkward texts."""
    rng = random.Random(4)
    common = [f"word{i}" for i in range(60)] + ["\u00c9t\u00e9", "\U0001f600", "the"]
    say = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, say(rng.randrange(0, 60))) for i in range(120)]
    for i in range(6):  # an entity with a term of its own, one that shares its stem with frequent words, and one that is everywhere
        rows.append((200 + i, f"{say(9)} zorblax the Wordsmith {'Mail' if i % 2 else 'mail'}@Example.com stands {say(9)} zorblax"))
    rows += [(220 + i, f"call +1 (988) 555-24{i % 2}5 qarnid {say(6)}") for i in range(8)] + [(240, "qarnid elsewhere"), (241, "stands alone")]
    rows += [(250, "a@b.c@d.e x@@y.z @p.q @x.y@z.w a.b@c..d _x@d-.e- %@a.b"), (251, "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3"), (252, "4111 1111 1111 1111, 4111-1111-1111-1112 4 2 79927398713"),
             (253, "+1 2 +49 (30) 1234-567 x+12345678901234567890 +4 9 3 0 1 2 3 4 5--"), (254, "x" * 60_000 + "@"), (255, "1" * 60_000 + ".2.3.4"), (256, "a" * 3000 + "@b.c " * 500), (257, None), (258, ""), (None, "me@here.org"), (200, "twice")]
    rows += [rows[-1]] * 2 + [(259, "+1" * 5000), (260, "0" * 6000 + ".1.1.1"), (261, "\U0001f600 me@here.org \u00e9")]
    return rows


def test_sanitise(spark):
    rows = letters()
    table = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], TEXTS).repartition(5)
    found = sanitise.personal_data(table).collect()
    shown = lambda spans: sanitise.spelled([tuple(x) for x in spans])
    wanted = brute.sanitise(rows)
    same([(r.doc_id, shown(r.base), shown(r.spans)) for r in found], [(d, shown(b), shown(s)) for d, b, s in wanted])
    kinds = {k for _, _, spans in wanted for _, k, _ in spans}
    assert kinds == {"email", "ip", "card", "phone", "generalised", "removed"}
    text = {r.doc_id: r.text for r in sanitise.sanitise(table).where("doc_id in (201, 221, 257, 251)").collect()}
    assert "<email>" in text[201] and "zorblax the Word* <email>" in text[201].replace("  ", " ") or "the Word* <email>" in text[201]
    assert text[257] is None and "<phone>" in text[221] and "<ip>" in text[251]
    assert sanitise.personal_data(spark.createDataFrame([], TEXTS)).count() == 0


def test_sanitise_share(spark):
    """Clean documents stay as they are, whatever terms they hold."""
    rows = [(i, "secret word here") for i in range(20)] + [(100 + i, f"secret word a{i}@b.org") for i in range(3)]
    found = {r.doc_id: r for r in sanitise.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not found[i].spans for i in range(20)) and all(len(found[100 + i].spans) == 1 for i in range(3))


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest", "op13_personal_data"])
def test_queries_on_whole_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    found = queries.queries()[name](spark, folder)
    if name == "op11_conversation_repair":
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        return same(found.collect(), brute.repair(brute.damaged(rows), [r[0] for r in rows]))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if name == "op12_merkle_manifest":
        return same(found.collect(), brute.merkle([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]))
    wanted = []
    for d, base, spans in brute.sanitise([tuple(r) for r in docs.select("doc_id", "text").collect()]):
        counts = [sum(k == kind for _, k, _ in base) for kind in sanitise.KINDS]
        wanted.append((d, *counts, brute.sha(sanitise.spelled(base)), sanitise.spelled(spans)))
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    same(found.collect(), wanted)


def test_tables_are_laid_out_one_way():
    """A table looks the same alone and after a great one; columns that begin beyond the limit are parted by two blanks."""
    small = "<table><tr><td>a</td><td>b</td></tr><tr><td>long one</td><td>c</td></tr></table>"
    great = "<table>" + "<tr>" + "".join(f"<td>{'w' * 30}{i}</td>" for i in range(40)) + "</tr>" + "<tr><td colspan=39>x<td>y" * 3000 + "</table>"
    alone = html_render.render(small).splitlines()
    assert alone == ["a         b", "long one  c"]
    both = html_render.render(great + small)
    assert both.splitlines()[-2:] == alone and html_render.render(small + great).splitlines()[:2] == alone
    assert both.splitlines()[1] == "x  y" and len(both) < 3000 * 300
    wide = html_render.render(f"<table><tr><td>{'v' * 300}<td>b<td>c<tr><td>x<td>yyy<td>z</table>").splitlines()
    assert wide == ["v" * 300 + "  b  c", "x  yyy  z"]


def test_license_filters(spark):
    """Hundreds of templates make the same plan; the length and the positional filter drop places that prefix tokens bring, and no match."""
    rng = random.Random(12)
    vocabulary = [f"l{i}" for i in range(70)]
    templates = {" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 12))): f"label{k}" for k in range(300)}
    listed = list(templates)
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary[:40] + ["other", "words", "between"]) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(words))
            words[k:k] = [w for w in rng.choice(listed).split() if rng.random() < 0.9]
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = 0
    for r in licenses.scan(docs, templates).collect():
        wanted = brute.license_labels(texts[r.doc_id][1], templates)
        got = {}
        for m in r.matches:
            got[m.label] = max(got.get(m.label, 0), m.score)
        assert got == wanted and r.score == max(wanted.values(), default=0)
        found += len(wanted)
    assert found > 60
    vocabulary = {w for t in [*templates, *licenses.PHRASES] for w in t.split()}
    placed = licenses.placed_words(docs, vocabulary).withColumn("id", F.monotonically_increasing_id()).cache()
    rows = licenses.index_rows(licenses.document_frequencies(placed, vocabulary), templates)
    counts = [licenses.candidates(placed, rows, f).count() for f in ((), ("length",), ("length", "position"))]
    assert counts[0] > counts[1] > counts[2] >= found
    size = lambda n: len(licenses.scan(docs, dict(list(templates.items())[:n]))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(300) == size(20)
    placed.unpersist()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    folder, connection = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found, wanted = queries.queries()[name](spark, folder), connection.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    same([tuple(r[c] for c in columns) for r in found.collect()], wanted.fetchall())
