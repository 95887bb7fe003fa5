"""Trees of any depth, and their XML."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

import pytest

from kinstrand.operators import clusters as C
from kinstrand.sources import formats

SCHEMA = "cluster_id long, member_no long, id string, len long, is_rep boolean, identity double"


def levels(rng, depth):
    """Cluster tables from fine to coarse over a few hundred ids: each level clusters the representatives of the one below."""
    ids, out = [f"s{i}<&>{i % 3}" for i in range(160)], []
    for _ in range(depth):
        rng.shuffle(ids)
        rows, reps, k = [], [], 0
        while ids:
            size = min(len(ids), rng.randrange(1, 5))
            members, ids = ids[:size], ids[size:]
            rows += [(k, i, x, 50 + len(x), i == 0, None if i == 0 else 90.0 - i) for i, x in enumerate(members)]
            reps.append(members[0])
            k += 1
        out.append(rows)
        ids = reps
    return out


def plain(tables):
    """(cluster_id, path, id, leaf, n_leaves) by recursion from the top."""
    below = []
    for rows in tables[1:]:
        members = {}
        for r in rows:
            members.setdefault(r[0], []).append(r)
        below.append({m[0][2]: m for m in members.values()})
    out = []

    def go(cluster, path, row, depth):
        children = below[depth].get(row[2], []) if depth < len(below) else []
        n = sum(go(cluster, [*path, r[1]], r, depth + 1) for r in children) if children else 1
        out.append((cluster, tuple(path), row[2], not children, n))
        return n

    for r in tables[0]:
        go(r[0], [r[1]], r, 0)
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_forest(spark, tmp_path, depth):
    fine = levels(random.Random(depth), depth)
    tables = fine[::-1]
    frames = [spark.createDataFrame(rows, SCHEMA).repartition(3) for rows in tables]
    nodes = C.forest(*frames)
    wanted = plain(tables)
    assert sorted((r.cluster_id, tuple(r.path), r.id, r.leaf, r.n_leaves) for r in nodes.collect()) == sorted(wanted)
    trees = C.sort_forest(nodes).orderBy("place").collect()
    assert [r.n_leaves for r in trees] == sorted((r.n_leaves for r in trees), reverse=True) and sum(r.n_leaves for r in trees) == 160

    formats.write_forest_xml(nodes, str(tmp_path / "xml"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "xml").glob("part-*")))
    read = []

    def go(cluster, path, element):
        for i, child in enumerate(element):
            read.append((cluster, (*path, i), child.get("id"), not len(child), int(child.get("leaves"))))
            go(cluster, (*path, i), child)

    for cluster in ET.fromstring(f"<clusters>{text}</clusters>"):
        go(int(cluster.get("id")), (), cluster)
    assert sorted(read) == sorted(wanted)


def test_forest_makes_each_level_once(spark, monkeypatch):
    """The lines' clusters are made once for all levels, and leaves, most of all nodes, aren't joined with their counts."""
    from kinstrand.plans import cluster_queries

    made = []
    monkeypatch.setattr(cluster_queries, "clusters", lambda s, d, of=cluster_queries.clusters: made.append(d) or of(s, d))
    monkeypatch.setattr("kinstrand.plans.fixtures.clusters", lambda *a: pytest.fail("clusters are made again"))
    found = cluster_queries._nodes(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")


def test_exact_duplicates_deal_no_letters(spark):
    """Equal sequences meet by digests, so plans that don't return letters don't deal them."""
    from kinstrand.operators import duplicates

    rows = spark.createDataFrame([(0, "ACCA"), (1, "ACCA"), (2, "ACC"), (3, ""), (4, None), (5, "")], "rank long, seq string")
    found = duplicates.exact(rows)
    assert sorted((r["rank"], r.rep_rank, r.abundance) for r in found.collect()) == [(0, 0, 2), (1, 0, 2), (2, 2, 1), (3, 3, 2), (5, 3, 2)]
    assert "hashpartitioning(seq" not in found.select("rank", "rep_rank")._jdf.queryExecution().executedPlan().toString()
