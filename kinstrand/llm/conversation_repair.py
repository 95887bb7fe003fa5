"""Conversation structure repair by cost layers.

A conversation's role initials should read ``(s?(ua)+)?``. Edits get it there: Keep (0), Rerole to user or assistant (3), Delete (4;
blank and repeated turns must go), Insert an empty turn of user or assistant anywhere (3); a turn that
breaks off costs 3 more unless it is deleted. As in Wu and Manber's matching with errors, there is a layer for each cost: for each turn
the set, as bits, of the grammar's states from which the rest can be accepted at just that cost. Layers are filled at increasing cost
until the start is in one, which gives the cost; the bits then lead from the start through the cheapest edits, at each
step by the least letter (D, I, K, R), so the audit is the least of its cost. After each ``BLOCK`` turns layers begin anew
from the costs reached, which keeps a conversation's time in proportion to its turns.

A conversation of any length never meets in one place with its texts: rows are sorted by ranges of (conv_id, turn, role, text), and
what the layers need of a turn is one character, so a conversation is one string as long as its audit. Texts
then pass sorted through a task that holds the audit and a running hash.

Turns go by turn, nulls first, equal ones by role and text. Null roles and texts are one space; a null conv_id is a conversation.
Equal rows are each other's repeats. Roles count by their first character; one other than s, u, a can't be kept. A conversation without
rows has zeros, an empty audit and an empty text. Texts may have any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.common import SPACES, cut

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns after which layers begin anew.
BLOCK = 32

# States of the grammar: nothing yet, after s, after u, after a. A turn's letter is 4 * fault + class.
CLASSES, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"
_STEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1,) * 4)  # by class and state
_NEXT = (2, 2, 3, 2)  # by state: the one role of user and assistant that may follow
_ROLES = ("", "", "user", "assistant")  # by the state that they lead to
_END = (0, 2 * INSERT, INSERT, 0)  # what closes a conversation, by state


def _before(step: Sequence[int]) -> tuple[int, ...]:
    """For each set of states the set from which ``step`` leads into it."""
    return tuple(sum(1 << s for s, t in enumerate(step) if t >= 0 and to >> t & 1) for to in range(16))


_KEPT, _MADE = tuple(map(_before, _STEP)), _before(_NEXT)


def layers(turns: bytes, ends: Sequence[int]) -> tuple[list[bytearray], list[int]]:
    """The layers of some turns, the first at the least of ``ends`` (the cost of what follows, by state), and the cost at their start by state.

    Layer c has for each turn, and for the end, the bits of the states from which what is left costs c more than that least.
    """
    n, least = len(turns), min(ends)
    found: list[bytearray] = []
    starts, seen, c = [0] * 4, 0, 0
    while seen < 15:
        row = bytearray(n + 1)
        row[n] = sum(1 << s for s, cost in enumerate(ends) if cost - least == c)
        made = found[c - INSERT] if c >= INSERT else None
        gone = found[c - DELETE] if c >= DELETE else None
        late = found[c - RETYPE - TRUNCATED] if c >= RETYPE + TRUNCATED else None
        for i in range(n - 1, -1, -1):
            turn = turns[i]
            fault = turn >> 2
            bits = gone[i + 1] if gone else 0
            if made:
                bits |= _MADE[made[i]]
            if fault == 0:
                bits |= _KEPT[turn][row[i + 1]]
                if made:
                    bits |= _MADE[made[i + 1]]
            elif fault == 3:
                if made:  # kept, at the cost of a truncated turn
                    bits |= _KEPT[turn & 3][found[c - TRUNCATED][i + 1]]
                if late:
                    bits |= _MADE[late[i + 1]]
            row[i] = bits
        found.append(row)
        for s in range(4):
            if (row[0] & ~seen) >> s & 1:
                starts[s] = c + least
        seen |= row[0]
        c += 1
    return found, starts


def _trace(turns: bytes, found: list[bytearray], state: int, c: int) -> tuple[str, int]:
    """The least letters through the layers from ``state`` at cost ``c``, and the state after them."""
    out, i = [], 0
    while i < len(turns):
        kind, fault = turns[i] & 3, turns[i] >> 2
        extra = TRUNCATED if fault == 3 else 0
        nxt, kept = _NEXT[state], _STEP[kind][state] if fault in (0, 3) else -1
        if c >= DELETE and found[c - DELETE][i + 1] >> state & 1:
            out.append("D")
            c, i = c - DELETE, i + 1
        elif c >= INSERT and found[c - INSERT][i] >> nxt & 1:
            out.append("I")
            c, state = c - INSERT, nxt
        elif kept >= 0 and c >= extra and found[c - extra][i + 1] >> kept & 1:
            out.append("K")
            c, i, state = c - extra, i + 1, kept
        else:
            out.append("R")
            c, i, state = c - RETYPE - extra, i + 1, nxt
    return "".join(out), state


def solve(turns: bytes) -> tuple[int, str]:
    """The least cost of the edits and the least audit of that cost; ``turns`` has 4 * fault + class for each."""
    blocks = [turns[i : i + BLOCK] for i in range(0, len(turns), BLOCK)]
    ends = [list(_END)]
    for block in reversed(blocks[1:]):
        ends.append(layers(block, ends[-1])[1])
    state, audit, cost = 0, [], 0
    for k, block in enumerate(blocks):
        after = ends[len(blocks) - 1 - k]
        found, starts = layers(block, after)
        cost = cost if k else starts[0]
        letters, state = _trace(block, found, state, starts[state] - min(after))
        audit.append(letters)
    return cost, "".join(audit) + "I" * (_END[state] // INSERT)


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes its role user. Null conv_id and turn are one space there; null roles and texts become one."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("__fault")).where("__fault <> 0")
    fault = F.col("__fault")
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, ascending in the order of turns within a conversation, the class of their role, hashes of role and text, blank and truncated. Stored."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim("text", F.lit(SPACES))
    first, last = F.substring("role", 1, 1), F.substring(end, -1, 1)
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return cut(
        rows.select(
            "*", F.monotonically_increasing_id().alias("at"),
            F.coalesce(*(F.when(first == c, F.lit(i)) for i, c in enumerate(CLASSES)), F.lit(3)).alias("class"),
            F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"),
            (end == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
        ),
        "turns",
    )


def _letters(turns: DataFrame) -> DataFrame:
    """(conv_id, letters): a character for each turn, in order. A task sees the turns of one range, and of a conversation one string for each range."""
    small = turns.select("conv_id", "at", "class", "h1", "h2", "blank", "truncated")
    firsts = small.groupBy("conv_id", "h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    fault = F.when(F.col("blank"), 1).when(F.col("at") > F.col("first"), 2).when(F.col("truncated"), 3).otherwise(0)
    marked = small.join(firsts, same, "left").select("conv_id", "at", F.substring(F.lit(LETTERS), 1 + 4 * fault + F.col("class"), F.lit(1)).alias("letter"))
    joined = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value]), "")
    pieces = marked.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(joined("at", "letter").alias("piece"))
    return pieces.groupBy("conv_id").agg(joined("part", "piece").alias("letters"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`repair` returns of each conversation, but for the hash."""
    code = str.maketrans({c: chr(i) for i, c in enumerate(LETTERS)})
    for batch in batches:
        out = []
        for letters in batch["letters"].to_pylist():
            turns = (letters or "").translate(code).encode("latin-1")
            cost, audit = solve(turns)
            faults, kinds = bytes(x >> 2 for x in turns), [x & 3 for x in turns]
            illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:], strict=False))
            out.append((faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit))
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], batch["gaps"], *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
            names=["conv_id", "gaps", *_COUNTS, "audit"],
        )


class Repair:
    """Applies an audit to turns that come one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.place, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.place : self.place + 1] == "I":
            self.state, self.place = _NEXT[self.state], self.place + 1
            yield "I", _ROLES[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns inserted before this one, and of itself if it stays."""
        yield from self._inserted()
        edit, self.place = self.audit[self.place], self.place + 1
        if edit == "K":
            self.state = _STEP[CLASSES.index(role[0])][self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, _ROLES[self.state], text

    rest = _inserted


def plans(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation of ``ids`` and of ``turns`` (of :func:`_ordered`)."""
    span = turns.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = span.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")).select("conv_id", F.lit(None).cast("string").alias("letters"), "gaps")
    no = ids.select("conv_id", F.lit(None).cast("string").alias("letters"), F.lit(0).cast("long").alias("gaps"))
    every = _letters(turns).withColumn("gaps", F.lit(0).cast("long")).unionByName(gaps).unionByName(no)
    every = every.groupBy("conv_id").agg(F.max("letters").alias("letters"), F.max("gaps").alias("gaps"))
    return every.mapInArrow(_plans, "conv_id long, gaps long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


_HEAD = ("gaps", *_COUNTS, "audit")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, str | None]]:
    """(row of the plan, role, text) in order, without role and text for the plan itself, which comes first in its conversation."""
    head: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["at"] < 0:
                head = row
                yield head, None, None
            else:
                yield head, row["role"], row["text"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, head, repair, digest, first = [], None, Repair(""), hashlib.sha256(), True

    def add(turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal first
        for _, role, text in turns:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

    def close() -> None:
        if head is not None:
            add(repair.rest())
            done.append((head["conv_id"], *(head[c] for c in _HEAD), digest.hexdigest()))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *_HEAD, "repaired_sha256"])

    for plan, role, text in _conversations(batches):
        if role is None:
            close()
            head, repair, digest, first = plan, Repair(plan["audit"]), hashlib.sha256(), True
            if len(done) >= 4096:
                yield batch()
        else:
            add(repair.turn(role, text))
    close()
    if done:
        yield batch()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repair, head, place, done = Repair(""), None, 0, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])

    def add(turns: Iterator[tuple[str, str, str]]) -> None:
        nonlocal place
        for turn in turns:
            done.append((head["conv_id"], place, *turn))
            place += 1

    for plan, role, text in _conversations(batches):
        if role is None:
            add(repair.rest())
            head, repair, place = plan, Repair(plan["audit"]), 0
        else:
            add(repair.turn(role, text))
        if len(done) >= 1024:
            yield batch()
    add(repair.rest())
    if done:
        yield batch()


def _repaired(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Each conversation's plan (``at`` -1) and then its turns, sorted within a task."""
    turns = _ordered(rows)
    plan = plans(turns, rows if ids is None else ids)
    told = plan.select("conv_id", F.lit(-1).cast("long").alias("at"), *_HEAD, F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rest = turns.select("conv_id", "at", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _HEAD), "role", "text")
    return told.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conv_id of ``ids`` (of ``rows``, if not given) and of ``rows`` (conv_id long, turn long, role, text):

    gaps (turn numbers that are missing between the least and the greatest), blank, duplicate and truncated turns, illegal (neighbours
    other than su, ua, au), cost, audit and repaired_sha256 (the repaired ``role:text``, joined by newlines).
    """
    kinds = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _HEAD)
    return _repaired(rows, ids).mapInArrow(_digests, f"conv_id long, {kinds}, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role and text of every turn of the repaired conversations."""
    return _repaired(rows, None).mapInArrow(_turns, "conv_id long, place long, edit string, role string, text string")
