"""Product codes against brute force in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from timberline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code int"


def brute(rows, n_parts, n_entries, rounds=2):
    good = [(i, [math.floor(256 * x) for x in v], g) for i, v, g, _ in rows if v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    width = math.ceil(max((len(v) for _, v, _ in good), default=0) / n_parts)
    cut = [[tuple(max(-(2**62), min(2**62, x)) for x in (v + [0] * (width * n_parts))[p * width : (p + 1) * width]) for p in range(n_parts)] for _, v, _ in good]
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, np.array(good[i][1], float).tobytes()))[:n_entries]
    books = [[cut[i][p] for i in first] for p in range(n_parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for x in cut:
                held.setdefault(near(x[p], book)[1], []).append(x[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by = [], {}
    for (i, _, g), x in zip(good, cut, strict=True):
        found = [near(y, book) for y, book in zip(x, books, strict=True)]
        error = min(2**63 - 1, sum(d for d, _ in found))
        by[g] = by.get(g, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, g))
    return sorted([(i, c, e, min(2**63 - 1, by[g]), digest) for i, c, e, g in out], key=repr)


def rows_of(seed, n, dims, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(dims)], rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(n + i, list(rows[3][1]), "a") for i in range(n // 3)]  # a hot vector
    rows += [(5, list(rows[5][1]), "b"), (7, [1.0] * dims, "c"), (None, [0.5] * dims, "c"), (9_000, [0.25] * (dims - 3), None)]
    rows += [(9_001, None, "a"), (9_002, [1.0, None], "a"), (9_003, [math.nan] * dims, "a"), (9_004, [math.inf] * dims, "a"), (9_005, [1e308] * dims, "a"), (9_006, [], "a")]
    rng.shuffle(rows)
    return [(*r, 1) for r in rows]


@pytest.mark.parametrize(("n", "dims", "n_parts", "n_entries", "scale"), [(120, 16, 4, 16, 1.0), (90, 10, 4, 64, 0.02), (40, 8, 2, 256, 1e12)])
def test_coded(spark, monkeypatch, n, dims, n_parts, n_entries, scale):
    rows = rows_of(n, n, dims, scale)
    want = brute(rows, n_parts, n_entries)
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_codes.coded(df.repartition(3), n_parts, n_entries)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(vector_codes, "FEW", 0)  # as with many labels
    assert sorted(map(tuple, vector_codes.coded(df, n_parts, n_entries).collect()), key=repr) == want


def test_coded_edges(spark):
    assert vector_codes.coded(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.coded(spark.createDataFrame([(1, None, "a", 0)], SCHEMA)).collect() == []
    for rows in ([(1, [], "a", 0)], [(1, [0.5], None, 0), (1, [0.5], None, 0)], [(1, [1e300, -1e300], "a", 0), (2, [0.0], "a", 0), (3, [3e305], "a", 0)]):
        for entries in (1, 2, 64):
            got = vector_codes.coded(spark.createDataFrame(rows, SCHEMA), n_entries=entries).collect()
            assert sorted(map(tuple, got), key=repr) == brute(rows, 16, entries)
    with pytest.raises(ValueError, match="256"):
        vector_codes.coded(spark.createDataFrame([], SCHEMA), n_entries=257)


@pytest.mark.parametrize("scale", [3, 300, 10**12])
def test_nearest_is_exact_and_prunes(scale):
    rng = np.random.default_rng(scale)
    x, book = (np.floor(rng.normal(0, scale, (m, 4))).astype(np.int64) for m in (400, 64))
    book[10] = book[20]  # a tie
    index, apart, seen = vector_codes.nearest(x, book)
    full = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all()
    assert (apart == full.min(axis=1)).all()
    assert seen < 0.9 * full.size
