"""Vector compression by product codes, entries found by annular norm pruning.

Every vector becomes whole numbers, floor(256 * x), and is cut into equal parts;
each part position has a codebook, and a part's code is the index of its nearest
entry.  Codebooks start as the parts of the vectors with the least ids.  A round
assigns every part and moves each entry to the floor of its parts' mean.

The nearest entry is found with the entries sorted by norm.  As

    | |x| - |c| | <= |x - c|,

an entry at most as far as the best one found so far has a norm within that
distance of |x|: a binary search gives this annulus, both ends included so that
ties are seen, and only its entries are evaluated, in whole numbers.  The search
starts at the norm nearest to |x| and goes outwards in growing steps; each better
distance narrows the annulus.

A round is one pass over the vectors without a shuffle of theirs; each task adds
up its parts, and Spark adds these sums by entry and place, so the driver gets as
many numbers as the codebooks have.  Codes and errors are written once.  Errors
are added up by label before they are handed back; few labels are broadcast, many
are joined with the rows of a label dealt over ``SALTS`` keys.

Defined cases: a vector that is null or holds a null or non-finite component (or
one beyond the range of 64-bit floats once it is multiplied) is dropped; shorter
vectors are filled up with zeros, to a length that divides into parts; components
beyond 2^62 count as that; errors beyond 64 bits are clipped after exact
arithmetic; fewer vectors than entries give fewer entries; ties go to the lower
index; a null id is coded like others, and starts an entry only after all ids;
repeated rows are coded, and counted, one by one, those of one id in the order of
their bytes; nulls are one label; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, type_of
from .vectors import filled, whole

MOST = 2.0**62
#: Labels, and bytes of them, that are broadcast; and keys over which the rows of each of more labels are dealt.
FEW, FEW_BYTES, SALTS = 100_000, 4 << 20, 32
_isqrt = np.frompyfunc(lambda x: math.isqrt(int(x)), 1, 1)


def nearest(x: np.ndarray, book: np.ndarray, step: int = 2) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the nearest entry of ``book`` for each row of ``x``, and how many entries were evaluated."""
    n, k = len(x), len(book)
    reach = max(int(abs(x).max(initial=0)), int(abs(book).max(initial=0)))
    if 4 * k * max(1, x.shape[1]) * reach**2 < 2**62:
        roots, slack = np.sqrt, 1e-5
    else:  # whole numbers of any size; a root is less than one too small
        x, book, roots, slack = x.astype(object), book.astype(object), _isqrt, 2
    own, norms = roots((x * x).sum(axis=1)), roots((book * book).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, ranked = norms[order], book[order]
    low = np.searchsorted(norms, own)
    high = low.copy()
    best = np.zeros(n, x.dtype)  # distance * k + index
    first, last = np.zeros(n, np.int64), np.full(n, k)
    live, seen = np.arange(n), 0
    while len(live):
        a, b, c, d = np.maximum(first[live], low[live] - step), low[live], high[live], np.minimum(last[live], high[live] + step)
        a, d = np.minimum(a, b), np.maximum(c, d)
        sizes = (b - a) + (d - c)
        some = sizes > 0
        live, a, b, c, d, sizes = live[some], a[some], b[some], c[some], d[some], sizes[some]
        if not len(live):
            break
        begin = np.cumsum(sizes) - sizes
        place = np.repeat(a - begin, sizes) + np.arange(sizes.sum())
        place += np.where(place >= np.repeat(b, sizes), np.repeat(c - b, sizes), 0)
        apart = ranked[place] - np.repeat(x[live], sizes, axis=0)
        found = np.minimum.reduceat((apart * apart).sum(axis=1) * k + order[place], begin)
        fresh = high[live] == low[live]
        best[live] = np.where(fresh, found, np.minimum(found, best[live]))
        low[live], high[live] = a, d
        allowed = roots(best[live] // k) + slack
        first[live], last[live] = np.searchsorted(norms, own[live] - allowed), np.searchsorted(norms, own[live] + allowed, "right")
        seen, step = seen + len(place), 2 * step
    return (best % k).astype(np.int64), best // k, seen


def parts(column: pa.Array, n_parts: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and their whole numbers by vector, part and place."""
    good, sizes, values = whole(column)
    x = filled(sizes, np.clip(values, -MOST, MOST), dims).astype(np.int64)
    return good, x.reshape(len(x), n_parts, dims // n_parts)


def seeds(rows: DataFrame, n_entries: int, n_parts: int) -> tuple[list, int]:
    """The vectors of the least ids, and the length of the longest, filled up to divide into parts."""

    def run(batches):
        held, width, any_row = [], 0, False
        for batch in batches:
            good, sizes, values = whole(batch.column(1))
            if good.any():
                any_row, width = True, max(width, int(sizes.max()))
                ids = batch.column(0).filter(pa.array(good)).to_pylist()
                cuts = np.split(values, np.cumsum(sizes)[:-1])
                # among equal ids, and only there, bytes decide
                held = sorted([*held, *zip([(i is None, i or 0) for i in ids], [c.tobytes() for c in cuts], strict=True)])[:n_entries]
        if any_row:
            yield pa.RecordBatch.from_pydict({"none": [i[0] for i, _ in held], "id": pa.array([i[1] for i, _ in held], pa.int64()), "v": pa.array([v for _, v in held], pa.binary()), "width": [width] * len(held)})

    few = checkpointed(rows.select("vec_id", "e").mapInArrow(run, "none boolean, id bigint, v binary, width bigint"))  # at most n_entries rows a task
    width = few.agg(F.max("width")).head()[0] or 0
    return [np.frombuffer(bytes(r.v)) for r in few.orderBy("none", "id", "v").limit(n_entries).collect()], math.ceil(width / n_parts) * n_parts


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: ``books`` (part, entry, place) with each entry that has parts at the floor of their mean."""
    n_parts, k, d = books.shape

    def run(batches):
        sums, counts = np.zeros((n_parts, k, d), object), np.zeros((n_parts, k), np.int64)
        for batch in batches:
            _, x = parts(batch.column(1), n_parts, n_parts * d)
            wide = int(abs(x).max(initial=0)) * max(1, len(x)) >= 2**62
            for p in range(n_parts):
                near, _, _ = nearest(x[:, p], books[p])
                own = np.zeros((k, d), object if wide else np.int64)
                np.add.at(own, near, x[:, p].astype(own.dtype))
                sums[p] += own
                counts[p] += np.bincount(near, minlength=k)
        if counts.any():
            p, entry = np.nonzero(counts)
            place = np.arange(max(1, d))
            total = np.concatenate([sums, np.zeros((n_parts, k, max(1, d) - d), object)], axis=2)[p, entry].ravel()
            columns = {"part": np.repeat(p, len(place)), "entry": np.repeat(entry, len(place)), "place": np.tile(place, len(p))}
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int32()) for n, c in columns.items()} | {"total": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)), "n": pa.array(np.repeat(counts[p, entry], len(place)), pa.int64())})

    by_task = rows.select("vec_id", "e").mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n bigint")
    out = books.copy()
    for r in by_task.groupBy("part", "entry", "place").agg(F.sum(F.col("total")).cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():  # as many as the codebooks have numbers
        if d:
            out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each vector."""
    n_parts, _, d = books.shape

    def run(batches):
        for batch in batches:
            good, x = parts(batch.column(1), n_parts, n_parts * d)
            found = [nearest(x[:, p], books[p])[:2] for p in range(n_parts)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = sum(e.astype(object) if len(e) and int(e.max()) >= 2**62 // n_parts else e for _, e in found)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array([min(int(e), 2**63 - 1) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id bigint, label {type_of(rows, 'label')}, code string, error bigint")


def coded(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2, vec: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each vector that takes part.  At most 256 entries."""
    if not 0 < n_entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    kind = "array<float>" if type_of(vectors, embedding) == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec).cast("bigint").alias("vec_id"), F.col(embedding).cast(kind).alias("e"), F.col(label).alias("label"))
    small_batches(spark)
    few, dims = seeds(rows, n_entries, n_parts)
    if not few:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    start = filled(np.array([len(v) for v in few]), np.concatenate(few), dims)
    books = np.clip(start, -MOST, MOST).astype(np.int64).reshape(len(few), n_parts, dims // n_parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = moved(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    done = checkpointed(assigned(rows, books))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    totals = checkpointed(done.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("bigint").alias("label_error")))
    n, size = totals.agg(F.count("*"), F.sum(F.octet_length(F.col("label").cast("string")))).head()
    if n <= FEW and (size or 0) <= FEW_BYTES:
        out = done.join(F.broadcast(totals.withColumnRenamed("label", "of")), F.col("label").eqNullSafe(F.col("of")))
    else:
        dealt = done.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        every = totals.withColumnRenamed("label", "of").withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        out = dealt.join(every, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
