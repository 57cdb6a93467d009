"""The tree against a plain reading of its definition, and the base score against counts."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.llm import suffix_tree


def rows_of(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "cat", "sat", "on", "a", "mat", "Dog", "ran", "é", "zz"]
    docs = [(i, " ".join(rng.choices(words, [9, 5, 4, 4, 6, 3, 2, 2, 1, 1], k=rng.randint(0, 30))) + rng.choice(["", " \t\n the cat sat", f" rare{i}"])) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (7, docs[7][1]), (None, "the cat")]


def split(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def is_train(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 != 2


def brute(rows, depth, least, test, prior):
    train = [split(t) for d, t in rows if is_train(d)]
    c = Counter(w for doc in train for w in doc)
    total, distinct = sum(c.values()), len(c)
    floor = max(1, math.ceil(least * total))
    grams = Counter(tuple(doc[i : i + n]) for doc in train for n in range(1, depth + 2) for i in range(len(doc) - n + 1))
    often = {g for g, k in grams.items() if k >= (floor if len(g) == 1 else max(2, floor))}
    often = {g for g in often if all(g[i:j] in often for i in range(len(g)) for j in range(i + 1, len(g) + 1))}
    root = lambda w: (c[w] + 1) / (total + distinct + 1)
    kept = lambda s: {g[-1]: grams[g] for g in often if g[:-1] == s}
    states = {}

    def p(s, w):
        while s and s not in states:
            s = s[1:]
        if not s:
            return root(w)
        own, n = states[s], grams[s]
        return own.get(w, 0) / (n + prior) + (n - sum(own.values()) + prior) / (n + prior) * p(s[1:], w)

    for length in range(1, depth + 1):
        new = {}
        for s in [g for g in often if len(g) == length]:
            own, n = kept(s), grams[s]
            parent = {w: p(s[1:], w) for w in own}
            gain = sum(k * math.log(k / n / parent[w]) for w, k in own.items())
            rest = 1 - sum(own.values()) / n
            if rest > 1e-9:
                gain += n * rest * math.log(rest / max(1 - sum(parent.values()), 1e-12))
            if gain >= test:
                new[s] = own
        states |= new
    out = []
    for d, t in rows:
        doc = split(t)
        base = sum(math.log10(root(w)) for w in doc)
        score = sum(math.log10(p(tuple(doc[max(0, i - depth) : i]), w)) for i, w in enumerate(doc))
        out.append((d, not is_train(d), len(doc), sum(c[w] > 0 for w in doc), total, base, score))
    return out, states


@pytest.mark.parametrize(("depth", "least", "test"), [(1, 0.01, 2.0), (2, 0.004, 1.0), (3, 0.003, 0.5), (2, 0.2, 1.0)])
def test_against_definition(spark, depth, least, test):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(3)
    got = suffix_tree.scored(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, depth, least, test, 4.0).collect()
    want, states = brute(rows, depth, least, test, 4.0)
    assert states or least == 0.2
    key = lambda r: (str(r[0]), r[1:5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-9)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.scored(none, F.lit(True)).collect() == []
    held = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = suffix_tree.scored(held, F.lit(False)).head()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_probabilities_sum_to_one():
    rows = [split(t) for _, t in rows_of()]
    c = Counter(w for doc in rows for w in doc)
    words = [w for w, _ in c.most_common(8)]
    model = suffix_tree.Model(words, [c[w] for w in words])
    import numpy as np

    for _ in range(2):
        ids = model.word_ids(rows)
        codes = model.codes_after(model.places(ids)[-1], ids)[1]
        unique, n = np.unique(codes, return_counts=True)
        model.add(unique[n > 2], n[n > 2])
    model.grow(sum(c.values()), len(c), 0.5, 3.0)
    assert any(level.state.any() for level in model.levels[:-1])
    context = rows[0][:2]
    ids = model.word_ids([[*context, w] for w in words])
    at = np.arange(len(words)) * 4 + 2
    root, p = (10**x for x in model.score(ids))
    outside = sum((k + 1) for w, k in c.items() if w not in words) + 1
    factor = 10 ** model.score(model.word_ids([[*context, b"never"]]))[1][2]
    assert p[at].sum() + factor * outside / (sum(c.values()) + len(c) + 1) == pytest.approx(1.0)


@pytest.mark.parametrize(("depth", "least", "test", "cached"), [(1, 0.0, 2.0, 0.01), (2, 0.0, 1.0, 0.01), (3, 0.0, 0.5, 1.0), (2, 0.004, 1.0, 0.0)])
def test_tables_against_definition(spark, monkeypatch, depth, least, test, cached):
    monkeypatch.setattr(suffix_tree, "WHOLE", 0)
    monkeypatch.setattr(suffix_tree, "CACHED", cached)
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(3)
    got = suffix_tree.scored(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, depth, least, test, 4.0).collect()
    want, states = brute(rows, depth, least, test, 4.0)
    assert states
    key = lambda r: (str(r[0]), r[1:5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-9)


def test_rare_sequences_count_in_a_large_corpus(spark):
    """A pair seen three times among 1.6 million tokens is a context and its continuation."""
    filler = spark.range(1600).select(F.col("id").alias("doc_id"), F.expr("repeat('the cat sat on a mat and ran away ', 111)").alias("text"))
    rare = spark.createDataFrame([(10000 + i, f"w{i} qx qy") for i in range(3)] + [(-1, "qx qy")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.scored(filler.unionByName(rare), F.col("doc_id") >= 0).where("doc_id < 0 OR doc_id >= 10000").collect()}
    total = got[-1].train_tokens
    distinct = 9 + 1 + 2 + 3  # nine filler words, the end, qx, qy, w0 to w2
    root = lambda c: (c + 1) / (total + distinct + 1)
    assert total > 1_000_000 and got[-1].base_score == pytest.approx(2 * math.log10(root(3)) + math.log10(root(1603)))
    after_qx = 3 / 11 + 8 / 11 * root(3)
    after_qy = 3 / 11 + 8 / 11 * root(1603)
    assert got[-1].score == pytest.approx(math.log10(root(3)) + math.log10(after_qx) + math.log10(after_qy), abs=1e-9)


@pytest.mark.parametrize(("depth", "known", "bucket"), [(1, 4, 40), (2, 4, 16), (2, 100, 40), (3, 6, 16), (3, 0, 16)])
def test_buckets_against_definition(spark, monkeypatch, depth, known, bucket):
    """Words that not every task knows, hot words whose followers are spread, and several pieces of a partition."""
    for name, value in (("WHOLE", 0), ("KNOWN", known), ("BUCKET", bucket), ("CACHED", 0.0), ("HELD_TOKENS", 120)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string").repartition(3)
    got = suffix_tree.scored(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, depth, 0.0, 0.5, 4.0).collect()
    want, states = brute(rows, depth, 0.0, 0.5, 4.0)
    assert states
    key = lambda r: (str(r[0]), r[1:5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=1e-9)


def test_rows_are_packed_small():
    """What is shuffled of a token: a few bytes, where a row of its sequences took tens of bytes."""
    import numpy as np

    rng = np.random.default_rng(1)
    word = np.minimum(rng.zipf(1.3, 50_000), 40_000).astype(np.int64)
    before = [np.roll(word, 1), np.roll(word, 2)]
    order = suffix_tree.ordered([*before, word])
    columns = [c[order] for c in (*before, word)]
    assert np.array_equal(columns, [c[np.lexsort((word, before[1], before[0]))] for c in (*before, word)])
    begin, count = suffix_tree.runs(columns)
    doc = (np.arange(50_000) // 500)[order]
    data = suffix_tree.packed(*(c[begin] for c in columns), count, doc)
    assert len(data) < 8 * len(word)
    back = suffix_tree.unpacked(data)
    assert all(np.array_equal(x, y) for x, y in zip(back, [*(c[begin] for c in columns), count, doc], strict=True))
    odd = [np.array([-5, 2**62, 0]), np.zeros(0, np.int64), np.array([255, 256])]
    assert all(np.array_equal(x, y) for x, y in zip(suffix_tree.unpacked(suffix_tree.packed(*odd)), odd, strict=True))
    x = np.array([-3.25, 0.0, 7.5])
    assert np.array_equal(suffix_tree.unfixed(suffix_tree.fixed(x)) / 2.0**36, x)
