"""FASTQ records, folded or not, from files that Spark splits.

Spark's text reader gives lines with their file and the start of their split, in order within a split, from any store and
from ``.gz`` files (one split). A record ends where its quality is as long as its sequence, so qualities may begin as headers do. In a split
that begins inside a record the first header is the first ``@`` line from which ``CHAIN`` records, or all up to the end, read well. What is before it, and a record
that the split doesn't finish, are kept as fragments; fragments that follow each other make a record, and if they don't, the file is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinstrand.functions.storage import stored

#: Records that must follow each other for a header to be believed.
CHAIN = 4
_KINDS = {"file": pa.string(), "block": pa.int64(), "n": pa.int64(), "kind": pa.string(), "head": pa.string(), "seq": pa.string(), "qual": pa.string(), "lines": pa.list_(pa.string())}
_SCHEMA = "file string, block long, n long, kind string, head string, seq string, qual string, lines array<string>"


class BrokenRecord(ValueError):
    """Lines that are no FASTQ record."""


class Record:
    """Takes lines until a record is whole."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.letters, self.quality, self.parts = 0, -1, 0

    def add(self, line: str) -> tuple[str, str, str] | None:
        """(header, sequence, quality) with the record's last line."""
        if not self.lines and not line.startswith("@"):
            raise BrokenRecord(f"a record begins with @, not with {line[:60]!r}")
        self.lines.append(line)
        if len(self.lines) == 1:
            return None
        if self.quality < 0:
            if line.startswith("@"):
                raise BrokenRecord(f"no quality after {self.lines[0][:60]!r}")
            if line.startswith("+"):
                self.quality, self.parts = 0, len(self.lines)
            else:
                self.letters += len(line)
        else:
            self.quality += len(line)
        if self.quality > self.letters:
            raise BrokenRecord(f"quality and sequence differ in length in {self.lines[0][:60]!r}")
        if self.quality < self.letters:
            return None
        whole = self.lines[0], "".join(self.lines[1 : self.parts - 1]), "".join(self.lines[self.parts :])
        self.__init__()
        return whole


def _follows(lines: list[str]) -> bool | None:
    """Whether records begin at the first line; None: so far, but there are too few lines to tell."""
    record, n = Record(), 0
    try:
        for line in lines:
            n += record.add(line) is not None
            if n == CHAIN:
                return True
    except BrokenRecord:
        return False
    return None


class _Split:
    """The lines of a split, one after another; ``rows`` are the finished rows."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block, self.n = file, block, 0
        self.record, self.waiting, self.begun, self.rows = Record(), [], block == 0, []
        self.enough = 64  # lines with which to look for a header; twice as many when they don't tell

    def _row(self, kind: str, head: str | None, seq: str | None, qual: str | None, lines: list[str] | None) -> None:
        self.rows.append((self.file, self.block, self.block + self.n, kind, head, seq, qual, lines))

    def _take(self, line: str) -> None:
        if whole := self.record.add(line):
            self._row("record", *whole, None)
            self.n += 1

    def add(self, lines: list[str]) -> None:
        if self.begun:
            for line in lines:
                self._take(line)
        else:
            self.waiting += lines
            if len(self.waiting) >= self.enough:
                self._begin(last=False)

    def _begin(self, last: bool) -> None:
        for i, line in enumerate(self.waiting):
            if line.startswith("@") and (told := _follows(self.waiting[i:])) is not False:
                if told is None and not last:
                    self.enough = 2 * len(self.waiting)
                    return
                rest, self.waiting, self.begun = self.waiting[i:], self.waiting[:i], True
                for x in rest:
                    self._take(x)
                return

    def close(self) -> None:
        if not self.begun:
            self._begin(last=True)
        if self.block:
            self._row("before", None, None, None, self.waiting)
        if self.begun:
            self._row("after", None, None, None, self.record.lines)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split: _Split | None = None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))

    for batch in batches:
        lines = batch["value"].to_pylist()
        files, blocks = batch["file"].to_pylist(), batch["block"].to_pylist()
        begin = 0
        while begin < len(lines):
            end = begin + 1
            while end < len(lines) and blocks[end] == blocks[begin] and files[end] == files[begin]:
                end += 1
            if split is None or (split.file, split.block) != (files[begin], blocks[begin]):
                if split:
                    split.close()
                    if split.rows:
                        yield told(split.rows)
                split = _Split(files[begin], blocks[begin])
            split.add([x for line in lines[begin:end] if (x := line.rstrip())])
            begin = end
        if split and split.rows:
            rows, split.rows = split.rows, []
            yield told(rows)
    if split:
        split.close()
        if split.rows:
            yield told(split.rows)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the fragments between two splits."""
    for batch in batches:
        out = []
        for file, n, lines in zip(*(batch[c].to_pylist() for c in ("file", "n", "lines")), strict=True):
            record, found = Record(), []
            for line in lines:
                if whole := record.add(line):
                    found.append(whole)
            if record.lines or len(found) > 1:
                raise BrokenRecord(f"{file}: the file ends inside a record, or a header was taken for another after {lines[0][:60]!r}")
            out += [(file, n, *x) for x in found]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [_KINDS[c] for c in ("file", "n", "head", "seq", "qual")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "n", "head", "seq", "qual"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, n (ascending in the file's order), head (with ``@``), seq and qual of every record. Lines are read once; what they give is stored."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = stored(lines.mapInArrow(_parse, _SCHEMA))
    # a fragment before the first header of a split goes with what the last split that had one left open; rows by split
    parts = found.where("kind <> 'record'").select("file", "block", "n", "kind", "lines")
    group = F.sum(F.when(F.col("kind") == "after", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", F.desc("kind")))
    runs = parts.withColumn("group", group).groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("block", "n", "lines"))).alias("x"))
    runs = runs.select("file", F.element_at("x", 1)["n"].alias("n"), F.flatten(F.transform("x", lambda p: p["lines"])).alias("lines")).where(F.size("lines") > 0)
    between = runs.mapInArrow(_join, "file string, n long, head string, seq string, qual string")
    return found.where("kind = 'record'").select("file", "n", "head", "seq", "qual").unionByName(between)
