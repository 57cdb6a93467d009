"""Classes against all pairs, over families of near copies, common passages and odd texts."""

import random

import pytest

from timberline.llm import jaccard_join
from timberline.llm.components import components


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def families(seed, copies, length, edits, common=0.5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(12)] for _ in range(3)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < common:
                own += rng.choice(passages) * rng.randint(1, 2)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [*((i, t) for i, t in enumerate(rows, 5)), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (5, rows[0]), (None, rows[1]), (906, "a b c " * 500)]


@pytest.mark.parametrize(("seed", "size", "num", "copies", "length", "edits", "common"), [(1, 3, 90, 12, 120, 4, 40), (2, 5, 80, 12, 80, 3, 40), (3, 3, 90, 25, 200, 9, 3), (4, 5, 80, 25, 60, 3, 1), (5, 2, 50, 10, 30, 8, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, size, num, copies, length, edits, common):
    monkeypatch.setattr(jaccard_join, "WHOLE", common)  # most sets show a share of their tokens only
    monkeypatch.setattr(jaccard_join, "HELD", 500)
    if seed % 2:  # all groups in blocks of a few sets
        monkeypatch.setattr(jaccard_join, "ROWS", 3)
        monkeypatch.setattr(jaccard_join, "BYTES", 4000)
    rows = families(seed, copies, length, edits)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = jaccard_join.joined(df, size, num, 100).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, size, num, 100), key=key)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST", -1)
    monkeypatch.setattr(jaccard_join, "WHOLE", 2)
    rows = families(6, 20, 100, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, jaccard_join.joined(df, 3, 90, 100).collect()), key=key) == sorted(brute(rows, 3, 90, 100), key=key)


def test_representatives(spark):
    rows = families(7, 10, 60, 2)
    df = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id long, text string, label double")
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    classes = brute(rows, 5, 80, 100)
    blank = sum(n == 0 for _, n, _ in classes)
    named = {c for _, n, c in classes if n}
    assert len(left) == blank + len(named)
    assert {d for d, t in left if t and t.split()} == named


def test_empty(spark):
    assert jaccard_join.joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.joined(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert got == {x: c for x, c in parent.items() if any(x in e for e in edges if e[0] != e[1])}


@pytest.mark.parametrize("repeats", [1, 40])
def test_whole_sets_of_repeated_rows(spark, repeats):
    """A node has one set, however often its first row is repeated."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    near = [*base[:-1], "other"]
    rows = [(1, " ".join(base))] * repeats + [(2, " ".join(near)), (None, "a b c d")] + [(None, "a b c d")] * repeats
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    join = jaccard_join.Join(df, 3, 90, 100, "doc_id", "text")
    key = lambda r: tuple(str(x) for x in r)
    got = join.classes().select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 3, 90, 100), key=key)
    first = [(7, (1, " ".join(base))), (8, (2, " ".join(near))), (9, (None, "a b c d"))]
    wanted = spark.createDataFrame([(n, d, x) for n, (d, x) in first], "node long, doc_id long, text string")
    from pyspark.sql import functions as F

    nodes = wanted.select("node", F.struct("doc_id", F.xxhash64("text").alias("th")).alias("first"), F.lit(2).alias("copies"))
    assert sorted(r.node for r in join.whole_sets(nodes).collect()) == [7, 8, 9]


def test_repeated_rows_with_common_passages(spark, monkeypatch):
    """Prefixes of common tokens are made of different tokens, however often a row is repeated."""
    monkeypatch.setattr(jaccard_join, "WHOLE", 3)
    rng = random.Random(9)
    passages = [[f"p{rng.randrange(200)}" for _ in range(60)] for _ in range(2)]
    rows = []
    for i in range(60):
        own = passages[0] + passages[1] + [f"r{rng.randrange(10**6)}" for _ in range(rng.choice([2, 3, 4, 30]))]
        rows += [(i, " ".join(own))] * rng.choice([1, 25, 40])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, jaccard_join.joined(df, 3, 90, 100).collect()), key=key) == sorted(brute(rows, 3, 90, 100), key=key)
