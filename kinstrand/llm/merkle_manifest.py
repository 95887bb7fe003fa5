"""Merkle manifest of a dataset: a tree of digests for each group of rows, a root over the groups, and proofs.

Rows become leaves, ordered within their group by id. Levels are DataFrames: a level's nodes have dense
indices, the index divided by the fan-out names the parent, and the parent is the digest of its sorted children; it keeps them
as an array. Levels are made and stored until one node a group is left, its subroot; subroots in the order of their groups
make a tree of the same kind, up to the root. Proofs go the other way: from the root down, a level's
table is joined with the paths of its nodes, and its children get these with their siblings in front. A level has half the rows
of the one below, so all these joins together move no more rows than there are leaves; the lowest level has its leaves' columns with it.

Places come from ranges of (group, id, leaf): sorted within a range, a range's offset from counts, so a group may hold any
share of the rows. Digests are 32 bytes in tables and hex in what is hashed and returned.

A null field is ``-``. Null ids come first in their group, equal ids go by their leaves, and equal rows are leaves of their
own. A null group is a group, before all others. Texts may have any length, other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinstrand.llm.common import cut

FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def shown(node: Column) -> Column:
    return F.lower(F.hex(node))


def _parent(nodes: Column) -> Column:
    """The digest of some nodes, as hex text in a row."""
    return digest(F.array_join(F.transform(nodes, shown), ""))


def leaf(**fields: Column) -> Column:
    """The digest of values: ``-`` for a null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in fields.values())]
    return digest(F.concat(*parts))


def tampered(column: str) -> Column:
    """One more than a whole number, also at the end of its range."""
    return F.col(column).cast("decimal(20,0)") + 1


def placed(leaves: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): ``leaves`` with ``tree`` and ``idx``, and tree, ``group`` and n of every group. Both stored."""
    keys = [group, *order]
    dealt = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumns({"__part": F.shiftright("__at", 33), "__in": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"), "leaves")
    parts = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # one row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(parts.select("__part", before.alias("__before")))
    at = dealt.join(offsets, "__part").withColumn("__at", F.col("__before") + F.col("__in"))
    groups = at.groupBy(F.col(group).alias("__group")).agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    groups = groups.repartitionByRange("first").sortWithinPartitions("first").withColumn("tree", F.monotonically_increasing_id())
    groups = cut(groups, "trees")
    same = F.col(group).eqNullSafe(F.col("__group"))
    rows = at.join(groups, same).select("tree", (F.col("__at") - F.col("first")).alias("idx"), *(F.col(c) for c in leaves.columns if c != group), "n")
    return cut(rows, "placed"), groups.select("tree", F.col("__group").alias(group), "first", "n")


PATH = "array<struct<left: array<binary>, right: array<binary>>>"


def _nothing() -> Column:
    return F.array().cast(PATH)


def levels_over(leaves: DataFrame) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, idx, node, n, others), up to one node a tree: tree, idx, kids, node and n; stored.

    The first one has a row for a lone leaf too, and in ``rows`` the columns of its leaves.
    """
    others = [c for c in leaves.columns if c not in ("tree", "idx", "node", "n")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    below = leaves
    while not levels or most > 1:
        first = not levels
        kept = F.struct("idx", "node", *others) if first else F.struct("idx", "node")
        up = below.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("up"), "n").agg(F.sort_array(F.collect_list(kept)).alias("rows"))
        kids = F.transform("rows", lambda x: x.node)
        node = F.when(F.col("n") == 1, F.element_at(kids, 1)).otherwise(_parent(kids))
        fields = [F.col("tree"), F.col("up").alias("idx"), kids.alias("kids"), node.alias("node"), F.expr(f"(n + {FANOUT} - 1) div {FANOUT}").alias("n")]
        levels.append(cut(up.select(*fields, *([F.col("rows"), (F.col("n") == 1).alias("alone")] if first else [])), "level"))
        below, most = levels[-1].where("n > 1").select("tree", "idx", "node", "n"), -(-most // FANOUT)
    return levels


def tops(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, top): the node that is left of each tree. Stored."""
    found = [x.where("n = 1").select("tree", F.col("node").alias("top")) for x in levels]
    return cut(reduce(DataFrame.unionByName, found), "tops")


def with_paths(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The columns of the leaves with tree and ``path``: for each level the siblings to the left and to the right, and then what ``above`` (tree, path) has for the tree."""
    path = None
    for i, level in reversed(list(enumerate(levels))):
        top = level.where("n = 1").join(above, "tree", "left")
        own = top if path is None else top.unionByName(level.where("n > 1").join(path, ["tree", "idx"]))
        whole = F.coalesce("path", _nothing())
        step = F.array(F.struct(F.slice("kids", 1, F.col("k")).alias("left"), F.slice("kids", F.col("k") + 2, FANOUT).alias("right")))
        if i:
            each = own.select("tree", "idx", "kids", "path", F.posexplode("kids").alias("k", "kid"))
            path = cut(each.select("tree", (F.col("idx") * FANOUT + F.col("k")).alias("idx"), F.concat(step, whole).alias("path")), "paths")
        else:
            each = own.select("tree", "kids", "path", "alone", F.posexplode("rows").alias("k", "row"))
            path = each.select("tree", "row.*", F.when(F.col("alone"), whole).otherwise(F.concat(step, whole)).alias("path"))
    return path


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, start, lambda node, step: _parent(F.concat(step.left, F.array(node), step.right)))


def siblings(path: Column) -> Column:
    """Siblings as hex text, level by level, left to right."""
    return F.array_join(F.transform(F.flatten(F.transform(path, lambda step: F.concat(step.left, step.right))), shown), "")


def manifest(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (``group``, the columns of ``order`` with node, the leaf's digest, at the end, others) with subroot, root and path instead of ``group``.

    Digests are 32 bytes; ``path`` has the siblings up to the subroot and on to the root.
    """
    leaves, groups = placed(rows, group, order)
    levels = levels_over(leaves)
    subroots = groups.join(tops(levels), "tree").select(F.lit(0).alias("all"), F.col("tree").alias("of"), F.col("top").alias("node"))
    # subroots in the order of their groups are the leaves of one more tree
    upper = levels_over(placed(subroots, "all", ["of"])[0])
    none = tops(upper).select("tree", F.col("top").alias("root"))
    above = with_paths(upper, none.select("tree", _nothing().alias("path")))
    above = cut(above.join(F.broadcast(none), "tree").select(F.col("of").alias("tree"), F.col("node").alias("subroot"), "root", "path"), "above")
    found = with_paths(levels, above.select("tree", "path"))
    return found.join(above.select("tree", "subroot", "root"), "tree").drop("tree", "idx")


def verify(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, lang, n_chars, text) in a manifest by lang, held against a tampered copy of the table.

    leaf, subroot, root and proof_sha256 (of the siblings as hex text) are those of the table; folded_root is what the row's leaf of
    the copy gives with these siblings, and verified tells whether that is the root. In the copy n_chars is one more where 7 divides crc32 of doc_id.
    """
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    fields = {c: F.col(c) for c in FIELDS}
    copy = fields | {"n_chars": F.when(changed, tampered("n_chars")).otherwise(F.col("n_chars"))}
    rows = docs.select("lang", "doc_id", leaf(**fields).alias("node"), leaf(**copy).alias("other"))
    found = manifest(rows, "lang", ["doc_id", "node"])
    found = found.withColumn("top", folded(F.col("other"), F.col("path")))
    return found.select(
        "doc_id", shown(F.col("node")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), shown(F.col("top")).alias("folded_root"), (F.col("top") == F.col("root")).alias("verified"),
    )
