"""Exact top-k search by inner product, with a pivot table.

Every vector component x becomes the integer floor(256 * x).  A bounded sample
gives the pivots (farthest-first); every row keeps its distances to all of them.
By the triangle inequality the distance of query q and row x is at least
max over p of |d(q, p) - d(x, p)|, and as

    <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2,

each lower bound on the distance is an upper bound on the score.  Rows of a
block are evaluated in the order of their bounds until the next bound is below
the k-th score found, which is then exact.

Rows are laid out by nearest pivot, and for each pivot in ``rings`` by their
distance to it, cut where the sample says.  A ring's rows are dealt to blocks of
about ``block_rows`` rows, whatever the size of the table; repeated rows are
dealt apart, so one hot vector fills no block of its own.  Each query is first
run against one block of its own ring, which gives a floor under its k-th score;
the least and greatest pivot distances of each ring then rule out whole rings
before anything is sent to their blocks.  The driver gathers a count and the
distance ranges of at most ``n_pivots * rings`` rings.  Queries travel in packs,
a pack for each block that may still hold a result.

Defined cases: a vector that is null or holds a null or non-finite component (or
one beyond the range of 64-bit floats once it is multiplied), or has no id,
takes no part; a shorter vector is filled up with zeros; ties go to
the smaller vec_id, then count as often as the row is repeated; a repeated query
row is answered once for each; scores beyond 64 bits are clipped, after exact
arithmetic; fewer rows than k give fewer ranks; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, parallel, small_batches

#: Squares beyond the range of floats are infinite: their bounds rule out nothing.
np.seterr(over="ignore", invalid="ignore")

EXACT = 2.0**53
PACK = 256


def integral(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the integers of each vector (vec_id, e) that takes part, as 64-bit floats."""

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.floor(256 * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null is not a number
            ends, wrong = np.cumsum(sizes), np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            good = wrong[ends] == wrong[ends - sizes]
            starts = np.concatenate([[0], 8 * np.cumsum(sizes[good])]).astype(np.int32)
            values = whole[np.repeat(good, sizes)].tobytes()
            v = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), v], ["vec_id", "v"])

    small_batches(vectors.sparkSession)
    return vectors.mapInArrow(run, "vec_id bigint, v binary")


def matrix(rows: list[bytes], dims: int) -> np.ndarray:
    """Rows of floats, filled up with zeros to ``dims``."""
    if all(len(r) == 8 * dims for r in rows):
        return np.frombuffer(b"".join(rows)).reshape(len(rows), dims)
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r)
    return out


def shortened(x: np.ndarray) -> bytes:
    """As 32-bit floats, if these hold the same numbers."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if (short == x).all() else x).tobytes()


def lengthened(data: bytes, rows: int, dims: int) -> np.ndarray:
    """The matrix that ``shortened`` wrote."""
    kind = np.float32 if len(data) == 4 * rows * dims else np.float64
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.float64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    reach = max(np.abs(x).max(initial=0), np.abs(pivots).max(initial=0))
    if 4 * reach * reach * x.shape[1] < EXACT:  # whole numbers: no step of this rounds before the root
        return np.sqrt((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots.T))
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def farthest_first(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each as far as may be from those before it."""
    chosen = [0]
    far = distances(sample, sample[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


def bounds(q_norm: np.ndarray, q_dist: np.ndarray, x_norm: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """Upper bounds on the scores of one query and rows whose pivot distances are ``low``, or lie from ``low`` to ``high``; a line of these for each pivot."""
    with np.errstate(over="ignore", invalid="ignore"):
        q_dist = q_dist[:, None]
        gaps = np.abs(low - q_dist) if high is None else np.maximum(low - q_dist, q_dist - high)
        apart = np.maximum(gaps.max(axis=0), 0.0)
        top = (q_norm + x_norm - apart**2) / 2 + 1.0 + 1e-9 * (q_norm + x_norm)
    return np.where(np.isfinite(top), top, np.inf)


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    out = [sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for r in x]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in out], np.int64)


def top(q: np.ndarray, q_id: int, q_dist: np.ndarray, floor: int, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, norms: np.ndarray, reach: float, k: int, step: int = 256) -> list[tuple[int, int]]:
    """The k best (score, id) of a block whose score is at least ``floor``, evaluated in bound order.  ``reach``: the block's greatest component."""
    ceiling = bounds(float(q @ q), q_dist, norms, dist)
    may = np.flatnonzero(ceiling >= floor)
    if not len(may):
        return []
    exact = float(np.abs(q).max(initial=0)) * reach * len(q) < EXACT
    order = may[np.argsort(-ceiling[may], kind="stable")]
    found: list[tuple[int, int]] = []
    for at in range(0, len(order), step):
        if ceiling[order[at]] < floor:
            break
        rows = order[at : at + step]
        rows = rows[ids[rows] != q_id]
        scores = products(q, x[rows], exact)
        good = scores >= floor
        found = sorted([*found, *zip([-s for s in scores[good].tolist()], ids[rows][good].tolist(), strict=True)])[:k]
        if len(found) == k:
            floor = max(floor, -found[-1][0])
    return [(-s, i) for s, i in found]


def search(vectors: DataFrame, query, k: int = 5, n_pivots: int = 32, sample: int = 2048, rings: int = 8, block_rows: int = 2048, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that meets the condition ``query`` (on vec_id)."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(vec).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    raw = integral(every)
    n, width = raw.agg(F.count("*"), F.max(F.octet_length("v"))).head()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n:
        return spark.createDataFrame([], result)
    dims = (width or 0) // 8
    few = raw.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    few = matrix([bytes(r.v) for r in few], dims)
    pivots = farthest_first(few, n_pivots)
    p = len(pivots)
    far = np.nan_to_num(distances(few, pivots), nan=np.inf, posinf=np.inf)
    own = far.argmin(axis=1)
    steps = np.arange(1, rings) / rings
    cuts = [np.quantile(far[own == c].min(axis=1), steps, method="lower") if (own == c).any() else np.zeros(rings - 1) for c in range(p)]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1).to_pylist(), dims)
                d = distances(x, pivots)
                near = np.nan_to_num(d, nan=np.inf, posinf=np.inf)
                cell = near.argmin(axis=1)
                ring = (np.stack(cuts)[cell] < near.min(axis=1)[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "v": [r.tobytes() for r in x], "d": [r.tobytes() for r in d], "ring": pa.array(cell * rings + ring, pa.int32())})

    def placed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(place, "vec_id bigint, v binary, d binary, ring int")

    rows = placed(raw)
    sizes = dict(rows.groupBy("ring").count().collect())  # at most n_pivots * rings
    split = [math.ceil(sizes.get(c, 0) / block_rows) for c in range(p * rings)]
    first, parts = F.array(*(F.lit(int(f)) for f in np.cumsum([0, *split[:-1]]))), F.array(*(F.lit(max(1, s)) for s in split))

    def block(*dealt):
        """A block of the row's ring."""
        return (F.get(first, "ring") + F.pmod(F.xxhash64(*dealt), F.get(parts, "ring"))).cast("bigint")

    def pack(group: pa.Table) -> pa.Table:
        x, d = matrix(group["v"].to_pylist(), dims), matrix(group["d"].to_pylist(), p)
        norms = (x**2).sum(axis=1)
        return pa.table({"block": group["block"][:1], "ring": group["ring"][:1], "ids": [group["vec_id"].to_numpy().tobytes()], "x": [shortened(x)], "dist": [np.ascontiguousarray(d.T).tobytes()], "low": [d.min(axis=0).tobytes()], "high": [d.max(axis=0).tobytes()], "norm": [float(norms.max())]})

    dealt = rows.withColumn("block", block(F.monotonically_increasing_id()))
    index = checkpointed(dealt.groupBy("block").applyInArrow(pack, "block bigint, ring int, ids binary, x binary, dist binary, low binary, high binary, norm double"))

    def widest(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                low, high, norm = np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["norm"]
                if r["ring"] in held:
                    a, b, c = held[r["ring"]]
                    low, high, norm = np.minimum(a, low), np.maximum(b, high), max(c, norm)
                held[r["ring"]] = low, high, norm
        yield pa.RecordBatch.from_pydict({"ring": pa.array(held.keys(), pa.int32()), "low": pa.array([v[0].tobytes() for v in held.values()], pa.binary()), "high": pa.array([v[1].tobytes() for v in held.values()], pa.binary()), "norm": pa.array([v[2] for v in held.values()], pa.float64())})

    shape = "ring int, low binary, high binary, norm double"
    by_task = index.select("ring", "low", "high", "norm").mapInArrow(widest, shape)
    ranges = by_task.repartition(min(p * rings, parallel(spark)), "ring").mapInArrow(widest, shape).collect()  # at most n_pivots * rings
    low, high = (matrix([bytes(r[f]) for r in ranges], p).T.copy() for f in ("low", "high"))
    shared = spark.sparkContext.broadcast(([r.ring for r in ranges], low, high, np.array([r.norm for r in ranges])))
    queries = placed(integral(every.where(query)))
    asked = checkpointed(queries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "d", "ring", block("vec_id", "v").alias("block")))

    def packs(batches, home: bool):
        """Queries for each ring that may hold a result; or for the home block alone."""
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                q, d = matrix(part.column("v").to_pylist(), dims), matrix(part.column("d").to_pylist(), p)
                rows, q_ids, floors, places = (part.column(c).to_numpy() for c in ("row", "vec_id", "floor", "block"))
                if home:
                    there = np.unique(places).tolist()
                    near = places[:, None] == np.array(there)[None, :]
                else:
                    there, low, high, norm = shared.value
                    near = np.stack([bounds(float(a @ a), b, norm, low, high) >= f for a, b, f in zip(q, d, floors, strict=True)])
                out = []
                for j in np.flatnonzero(near.any(axis=0)).tolist():
                    i = np.flatnonzero(near[:, j])
                    out.append((there[j], rows[i].tobytes(), q_ids[i].tobytes(), shortened(q[i]), floors[i].tobytes()))
                if out:
                    place, *columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["place", "rows", "q_ids", "q", "floors"])

    def evaluate(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                x, dist, q = lengthened(r["x"], len(ids), dims), np.frombuffer(r["dist"]).reshape(p, -1), lengthened(r["q"], len(rows), dims)
                norms, reach, d = (x**2).sum(axis=1), float(np.abs(x).max(initial=0)), distances(q, pivots)
                out = []
                for row, q_id, a, b, floor in zip(rows.tolist(), np.frombuffer(r["q_ids"], np.int64).tolist(), q, d, np.frombuffer(r["floors"], np.int64).tolist(), strict=True):
                    out += [(row, q_id, i, s) for s, i in top(a, q_id, b, floor, ids, x, dist, norms, reach, k)]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "query_id", "vec_id", "score"])

    def run(questions: DataFrame, home: bool) -> DataFrame:
        sent = questions.mapInArrow(lambda b: packs(b, home), "place bigint, rows binary, q_ids binary, q binary, floors binary")
        if home:
            sent = sent.withColumnRenamed("place", "block")
        else:
            begin, n = F.get(first, F.col("place").cast("int")), F.get(parts, F.col("place").cast("int"))
            sent = sent.withColumn("block", F.explode(F.sequence(begin.cast("bigint"), (begin + n - 1).cast("bigint")))).drop("place")
        return sent.join(index.select("block", "ids", "x", "dist"), "block").mapInArrow(evaluate, "row bigint, query_id bigint, vec_id bigint, score bigint")

    none = F.lit(-(2**63)).cast("bigint")
    began = run(asked.withColumn("floor", none), home=True).groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = began.where(F.col("n") >= k).select("row", "least")
    questions = checkpointed(asked.join(floors, "row", "left").select("row", "vec_id", "v", "d", "block", F.coalesce("least", none).alias("floor")))
    place_of = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return run(questions, home=False).withColumn("rank", place_of).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
