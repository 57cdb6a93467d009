"""Benchmark decontamination: a broadcast hash set of test n-grams against document windows.

Words are maximal runs of digits, lower-cased Latin letters and non-ASCII
characters.  Every ``n`` consecutive words of a test item are a window; an item
of fewer words, but not none, is one window.  A document word inside any
occurrence of a window is hit.

The set is broadcast in blocks of at most ``max_windows`` windows.  A benchmark
within the bound is one block and one pass; a larger one is matched block after
block, each pass adding to the hits found so far, with the rows written to the
shared folder between passes.  The driver, and each worker, hold one block at a
time, and one more is read ahead on the driver.

Defined cases: a null or wordless text has no words and no hits; a null or
wordless item has no window; several items may share a window and all count;
repeated item ids count once; repeated documents are judged row by row; empty
tables give no rows (documents) or no hits (benchmark); further columns of
the documents are ignored, or kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import checkpointed, fresh, joined_hash, slices, small_batches, texts

WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_B = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """A block of test windows: word ids, a sorted hash set for each window length, exact windows to item ids."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.exact: dict[bytes, list[str]] = {}
        self.lengths: set[int] = set()

    def add(self, item: str, text: bytes, n: int) -> None:
        own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)], np.uint32)
        m = min(n, len(own))
        if m:
            self.lengths.add(m)
            for i in range(len(own) - m + 1):
                items = self.exact.setdefault(own[i : i + m].tobytes(), [])
                if item not in items[-1:]:
                    items.append(item)

    def seal(self) -> Windows:
        by: dict[int, list[np.ndarray]] = {m: [] for m in self.lengths}
        for key in self.exact:
            by[len(key) // 4].append(np.frombuffer(key, np.uint32))
        self.hashes = {m: np.unique(rolled(np.concatenate(rows), np.arange(0, m * len(rows), m), m)) for m, rows in by.items()}
        return self


def rolled(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """A hash of the ``m`` ids from each position."""
    out = np.zeros(len(at), np.uint64)
    for j in range(m):
        out = (out ^ (out >> np.uint64(31))) * _B + ids[at + j]
    return out


def blocks(benchmark: DataFrame, n: int, max_windows: int, item: str = "item_id", text: str = "text") -> Iterator[Windows]:
    block = Windows()
    for row in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        block.add("null" if row.i is None else row.i, (row.t or "").encode(), n)
        if len(block.exact) >= max_windows:
            yield block.seal()
            block = Windows()
    if block.exact:
        yield block.seal()


def find_hits(docs: list[list[bytes]], block: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """Of all words of the documents (one free place after each), which are hit; each document's items."""
    get = block.ids.get
    ids = np.zeros(sum(map(len, docs)) + len(docs) + 1, np.uint32)
    starts, at = [], 0
    for own in docs:
        starts.append(at)
        if own:
            ids[at : at + len(own)] = [get(w, 0) for w in own]
        at += len(own) + 1
    found: list[set[str]] = [set() for _ in docs]
    cover = np.zeros(len(ids) + 1, np.int32)
    gaps = np.flatnonzero(ids == 0)
    run = gaps[np.searchsorted(gaps, np.arange(len(ids)))] - np.arange(len(ids))  # known words from here on
    for m, hashes in block.hashes.items():
        at_m = np.flatnonzero(run >= m)
        if not len(at_m):
            continue
        h = rolled(ids, at_m, m)
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in at_m[hashes[place] == h].tolist():
            if items := block.exact.get(ids[i : i + m].tobytes()):
                cover[i] += 1
                cover[i + m] -= 1
                found[int(np.searchsorted(starts, i, "right")) - 1].update(items)
    return np.cumsum(cover[:-1]) > 0, found


def _matched(documents: DataFrame, benchmark: DataFrame, n: int, share: int, max_windows: int, text: str, keep: bool) -> DataFrame:
    """Each row with its hits: only the clean rows as they are (``keep``), or all rows with their figures, without the text."""
    spark, columns = documents.sparkSession, documents.schema
    out = documents.withColumns({fresh(documents, "hits"): F.lit(b""), fresh(documents, "items"): F.array().cast("array<string>")})
    middle = out.schema
    figures = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>, contaminated boolean"
    rest = [f for f in columns if f.name != text]
    ends = columns if keep else StructType([*rest, *StructType.fromDDL(figures)])
    found_blocks = blocks(benchmark, n, max_windows)
    block = next(found_blocks, None) or Windows().seal()
    while block is not None:
        following = next(found_blocks, None)
        shared, last = spark.sparkContext.broadcast(block), following is None

        def run(batches, shared=shared, last=last):
            import pyarrow.compute  # noqa: F401

            for batch in slices(batches, text):
                docs = [words(t) for t in texts(batch, text)]
                cover, found = find_hits(docs, shared.value)
                hits, items, at = [], [], 0
                for own, before, had, more in zip(docs, batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), found, strict=True):
                    now = cover[at : at + len(own)]
                    if before:
                        now = now | np.unpackbits(np.frombuffer(before, np.uint8), count=len(own)).astype(bool)
                    hits.append(now)
                    items.append(sorted(more.union(had)))
                    at += len(own) + 1
                arrays = batch.columns[: len(columns)]
                if not last:
                    more = [pa.array([np.packbits(h).tobytes() if h.any() else b"" for h in hits], pa.binary()), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*arrays, *more], batch.schema.names)
                    continue
                n_words, n_hit = [len(h) for h in hits], [int(h.sum()) for h in hits]
                bad = [h > 0 and share * h >= w for w, h in zip(n_words, n_hit, strict=True)]
                if keep:
                    yield batch.filter(pa.array([not b for b in bad], pa.bool_())).select(range(len(columns)))
                    continue
                made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([joined_hash(x) for x in items], pa.string()), pa.array(items, pa.list_(pa.string())), pa.array(bad, pa.bool_())]
                own = [a for a, f in zip(arrays, columns, strict=True) if f.name != text]
                yield pa.RecordBatch.from_arrays([*own, *made], [f.name for f in ends])

        small_batches(spark)
        out = out.mapInArrow(run, ends if last else middle)
        if not last:  # a pass of its own, so that no task holds two blocks
            out = checkpointed(out)
            shared.unpersist()
        block = following
    return out


def contamination(
    documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, max_windows: int = 2_000_000, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, items, contaminated (a hit, and n_hit * share >= n_words)."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return _matched(rows, benchmark, n, share, max_windows, "text", keep=False)


def clean(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, max_windows: int = 2_000_000, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return _matched(documents, benchmark, n, share, max_windows, text, keep=True)
