"""Large CloudWatch documents, cut at their events by the tasks that read them.

A document is read as pieces that start at each ``{``, over as many splits as
Spark makes of the file; a stretch is what one split holds.  What a stretch
starts in (a string or not, how deep, in the array of events or not) depends on
all before it, so it is worked out in two steps: each stretch says what it does
to either beginning, and the driver goes through these summaries in order, one
small row a stretch of a file of several.  With the beginnings known, each task
hands on its own events, one by one; only an event that reaches over the end of
a stretch is put together from its parts by a shuffle.

What stands outside the events has to be valid JSON with a comma between any two
events, and each event has to be an object, as in a document read whole; else
the document is malformed.  It is held in one row a document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Bytes up to which a document is one row.
WHOLE = 32 << 20
#: Bytes of text in a batch handed on.
BATCH = 4 << 20
ROW = "file string, owner bigint, at bigint, kind string, text string"
NAME = b'"events"'
#: No valid text: makes what it is put into malformed.
BAD = b"\x00"

_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+("?)|[{}\[\]]', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]++|\\.)*+("?)', re.S)
_COMMA = re.compile(rb"\s*,\s*")


class Scan:
    """Depth and strings of text that comes in pieces.

    ``low`` is the least depth so far.  ``events``: whether what was opened last at that
    depth is an array named events; None if nothing was opened there yet.
    """

    def __init__(self, inside: bool = False, depth: int = 0, low: int = 0, events: bool | None = None) -> None:
        self.inside, self.depth, self.low, self.events, self.named = inside, depth, low, events, False

    def feed(self, data: bytes) -> Iterator[tuple[int, bool]]:
        """Place of each bracket outside strings, and whether it opens; the state is that behind the bracket."""
        start = 0
        if self.inside:
            end = _STRING_END.match(data)
            if not end[1]:
                return
            self.inside, start = False, end.end()
        for found in _TOKEN.finditer(data, start):
            sign = found[0][:1]
            if sign == b'"':
                if not found[1]:
                    self.inside = True
                    return
                if self.depth == self.low:
                    self.named = found[0] == NAME
            elif sign in b"{[":
                if self.depth == self.low:
                    self.events = sign == b"[" and self.named
                self.depth += 1
                yield found.start(), True
            else:
                self.depth -= 1
                if self.depth < self.low:
                    self.low, self.events, self.named = self.depth, None, False
                yield found.start(), False


class Cutter:
    """Cuts the text of one stretch, whose beginning is known, into events, parts of events, and the rest."""

    def __init__(self, file: str, start: int, inside: bool, depth: int, events: bool, owner: int | None) -> None:
        # keys and arrays of events are followed at depth 1, wherever the stretch starts
        self.scan = Scan(inside, depth, 1, events)
        self.file, self.start, self.owner, self.at = file, start, owner, start
        self.event: list[bytes] | None = [] if events and depth > 2 else None
        self.gap: list[bytes] | None = None
        self.rest: list[bytes] = []
        self.before = True

    def checked(self, comma: bool) -> None:
        """The text before an event: a comma if one stands before it, and nothing but white space besides."""
        if self.gap is not None:
            text = b"".join(self.gap)
            if not (_COMMA.fullmatch(text) if comma else not text.strip()):
                self.rest.append(BAD)
        self.gap = None

    def put(self, text: bytes) -> None:
        if self.event is not None:
            self.event.append(text)
        elif self.gap is not None:
            self.gap.append(text)
        elif not (self.scan.events and self.scan.depth == 2):
            self.rest.append(text)

    def taken(self, kind: str, owner: int | None) -> tuple:
        row = (self.file, owner, self.at, kind, b"".join(self.event))
        self.event, self.at = None, self.at + 1
        return row

    def feed(self, data: bytes) -> Iterator[tuple]:
        scan, mark = self.scan, 0
        for place, opens in scan.feed(data):
            if opens and scan.depth == 2 and scan.events:
                self.put_rest(data[mark : place + 1])
                mark, self.gap, self.before = place + 1, [], False
            elif opens and scan.depth == 3 and scan.events:
                self.put(data[mark:place])
                self.checked(self.before)
                mark, self.event, self.owner, self.before = place, [], self.start, True
            elif not opens and scan.depth == 2 and self.event is not None:
                self.event.append(data[mark : place + 1])
                mark = place + 1
                yield self.taken("event" if self.owner == self.start else "part", self.owner)
                self.gap = []
            elif not opens and scan.depth == 1 and scan.events:
                self.put(data[mark:place])
                if b"".join(self.gap or []).strip():
                    self.rest.append(BAD)
                mark, self.gap, scan.events = place, None, False
        self.put(data[mark:])

    def put_rest(self, text: bytes) -> None:
        self.rest.append(text)

    def end(self) -> Iterator[tuple]:
        if self.event is not None:
            yield self.taken("part", self.owner)
        self.checked(self.before)
        yield self.file, self.start, self.start, "rest", b"".join(self.rest)


def pieces(spark: SparkSession, path: str | list[str], large: Column) -> DataFrame:
    """file, start, size, value: the texts between braces of files for which ``large`` holds."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "{").text(path).where(large)
    return raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), meta["file_block_length"].alias("length"), "value")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool]]:
    """(file, start, size), piece with its brace, and whether it is the first of its stretch."""
    before = None
    for batch in batches:
        file, start, size = (batch.column(i).to_pylist() for i in range(3))
        for *key, value in zip(file, start, size, batch.column(4).cast(pa.large_binary()).to_pylist(), strict=True):
            first = key != before
            before = key
            yield tuple(key), value if first and key[1] == 0 else b"{" + value, first


def batched(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        columns = list(zip(*held, strict=True))
        texts = [t.decode("utf-8", "replace") for t in columns.pop()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(texts, pa.string())], names)

    for row in rows:
        held.append(row)
        size += len(row[-1]) + 100
        if size > BATCH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def beginnings(read: DataFrame) -> tuple[dict[tuple[str, int], tuple], set[str]]:
    """By file and start of each stretch of files of several: inside, depth, events, owner; and files whose size is not that of their pieces."""

    def run(batches):
        def summary():
            first, other = scans
            columns = [pa.array([x]) for x in (key[0], key[1], key[2], n)]
            found = [[s.inside, s.depth, s.low, s.events] for s in (first, other)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([json.dumps(found)])], ["file", "start", "size", "n", "found"])

        key, scans, n = None, (), 0
        for own, piece, first in stretches(batches):
            if first:
                if key is not None:
                    yield summary()
                key, n = own, 0
                scans = (Scan(False, low=1), Scan(True, low=1)) if own[1] == 0 else (Scan(False), Scan(True))
            n += len(piece)
            for scan in scans:
                for _ in scan.feed(piece):
                    pass
        if key is not None:
            yield summary()

    several = read.where("length < size")
    rows = several.mapInArrow(run, "file string, start bigint, size bigint, n bigint, found string").collect()  # a row a split of a large file
    by: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r.file, r.start)):
        by.setdefault(row.file, []).append(row)
    known, wrong = {}, set()
    for file, own in by.items():
        inside, depth, events, owner = False, 0, False, None
        for row in own:
            known[file, row.start] = (inside, depth, events, owner)
            inside, change, low, opened = json.loads(row.found)[inside]
            if depth + low <= 2:
                owner = row.start
            events = bool(opened) if depth + low <= 1 else events
            depth += change
        if sum(r.n for r in own) != own[0].size:
            wrong.add(file)
    return known, wrong


def cut(read: DataFrame, known, whole: bool) -> DataFrame:
    """The events that lie in one stretch (``whole``), or all else."""

    def run(batches):
        def rows():
            cutter = None
            for (file, start, _), piece, first in stretches(batches):
                if first:
                    if cutter is not None:
                        yield from cutter.end()
                    cutter = Cutter(file, start, *known.value.get((file, start), (False, 0, False, None)))
                yield from cutter.feed(piece)
            if cutter is not None:
                yield from cutter.end()

        yield from batched((r for r in rows() if (r[3] == "event") == whole), ["file", "owner", "at", "kind", "text"])

    return read.mapInArrow(run, ROW)


def valid(text: str) -> bool:
    def none(name: str):
        raise ValueError(name)

    try:
        return isinstance(json.loads(text, parse_constant=none), dict)
    except ValueError:
        return False


def malformed(rests: DataFrame) -> list[str]:
    """Files (three at most) whose text outside the events is no object."""

    def run(batches):
        for batch in batches:
            bad = [f for f, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) if not valid(t)]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["file"])

    return [r.file for r in joined(rests, "file").select("file", "text").mapInArrow(run, "file string").limit(3).collect()]


def joined(parts: DataFrame, *keys: str) -> DataFrame:
    """Texts of one key, put together in the order of ``at``."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "text")))
    return parts.groupBy(*keys).agg(F.min("at").alias("at"), F.concat_ws("", ordered["text"]).alias("text"))


def is_large(most: int) -> Column:
    """Of a file: more bytes than ``most``, and in no compressed form, which is read as one."""
    return (F.col("_metadata.file_size") > most) & ~F.col("_metadata.file_name").rlike(r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)$")


def large_events(spark: SparkSession, path: str | list[str], most: int) -> DataFrame | None:
    """file, line_no, value: the events of documents of more than ``most`` bytes, as JSON; None if there is no such file.

    ``line_no`` grows with the place in the document and has gaps.  The files are
    read three times: for the beginnings of stretches, for what lies across them
    and outside events, and for the events.  A malformed document is an error.
    """
    if not spark.read.format("binaryFile").load(path).where(is_large(most)).select("length").head(1):
        return None
    read = pieces(spark, path, is_large(most))
    known, wrong = beginnings(read)
    shared = spark.sparkContext.broadcast(known)  # a row a split
    other = written(cut(read, shared, whole=False))
    wrong |= set(malformed(other.where("kind = 'rest'")))
    if wrong:
        raise ValueError(f"malformed CloudWatch document: {', '.join(sorted(wrong))}")
    across = joined(other.where("kind = 'part'"), "file", "owner")
    found = cut(read, shared, whole=True).select("file", "at", "text").unionByName(across.select("file", "at", "text"))
    return found.select("file", F.col("at").alias("line_no"), F.col("text").alias("value"))
