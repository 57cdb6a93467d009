"""Line deduplication, packing, secrets, toxicity, quality."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import learn, line_dedup, packing, quality, secrets, toxicity


def brute_lines(rows, least):
    """Lines covered by a run of at least ``least`` words that occurs at an earlier (id, line)."""
    texts = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        texts[(d, t)] = (lines, [(i, x) for i, x in enumerate(lines) if x.split()])
    runs = {}
    spans = []
    for (d, t), (_, own) in texts.items():
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b][1].split())
                if n >= least:
                    content = tuple(x for _, x in own[a : b + 1])
                    spans.append(((d, t), a, b, content))
                    runs[content] = min(runs.get(content, (d, own[a][0])), (d, own[a][0]))
    gone = {k: set() for k in texts}
    for k, a, b, content in spans:
        own = texts[k][1]
        if runs[content] < (k[0], own[a][0]):
            gone[k] |= set(range(own[a][0], own[b][0] + 1))
    return sorted((d, t if t is None else "\n".join(x for i, x in enumerate(texts[(d, t)][0]) if i not in gone[(d, t)]), len(gone[(d, t)])) for d, t in rows)


@pytest.mark.parametrize(("seed", "least"), [(1, 4), (2, 6)])
def test_lines(spark, seed, least):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5))) for _ in range(9)] + ["", " ", "one two three four five six seven"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(100, ""), (101, "\n\n"), (102, rows[0][1]), (5, rows[5][1]), (103, "a b\n" * 300)]
    df = spark.createDataFrame([(d, t, 0, "r") for d, t in rows], "doc_id long, text string, start int, runs string")
    got = line_dedup.deduplicated(df, least)
    assert got.columns == [*df.columns, "__n_lines", "__n_removed"]
    solid = lambda d, t: (d, None if t is None else [x for x in t.split("\n") if x.split()])  # noqa: E731  blank lines take no part
    assert sorted(solid(r.doc_id, r.text) for r in got.collect()) == sorted(solid(d, t) for d, t, _ in brute_lines(rows, least))
    assert all(r["__n_lines"] - r["__n_removed"] == len((r.text or "").split("\n")) or not r.text for r in got.collect())


def test_lines_edges(spark):
    schema = "doc_id long, text string, n_chars int"
    rows = [(1, "w " * 60, 120), (2, "w " * 60 + "\nnew", 124), (3, "w " * 60, 120), (4, None, None), (None, "alone", 5)]
    out = line_dedup.cleaned(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id or 0), r.text, r.n_chars) for r in out if r.doc_id != 4) == [(0, "alone", 5), (1, "w " * 60, 120), (2, "new", 3)]
    assert any(r.doc_id == 4 and r.text is None for r in out)
    assert line_dedup.cleaned(spark.createDataFrame([], schema)).collect() == []


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_is_exact(spark):
    path = tokenizer_path()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Hello", "wörld.", "don't", "x<|endoftext|>y", "Ça", "日本語。", "42%", "...", "İs"]) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 9000), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(3)
    pieces = packing.packed(df, path, flush=6000).collect()
    encoder = packing.Encoder(path)
    sequences, docs = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault(p.doc_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for d, t in {(d, t) for d, t in rows}:
        ids = np.array([*encoder.ids(t or ""), 2], "<u4")
        want = sum(r == (d, t) for r in rows)
        got = sorted(docs[d], key=lambda p: p.start)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in got)
        assert sum(p.length for p in got) == want * len(ids)
    padding = sum(0 if (n := sum(x for _, x in s)) & (n - 1) == 0 else 4096 - n for s in sequences.values())
    assert padding < 0.05 * sum(p.length for p in pieces) + 3 * 4096
    assert packing.packed(df.limit(0), path).collect() == []


def test_best_cuts_against_all():
    rng = random.Random(5)
    for _ in range(40):
        position = [0]
        while len(position) < 12:
            position.append(position[-1] + rng.randint(1, 7))
        penalty = [0.0, *(rng.choice([0, 1.5, 4]) for _ in position[1:])]
        size = 16
        pad = lambda n: 0 if n & (n - 1) == 0 else size - n
        best = [0.0] + [float("inf")] * 11
        for j in range(1, 12):
            best[j] = penalty[j] + min(best[i] + pad(position[j] - position[i]) for i in range(j) if position[j] - position[i] <= size)
        cuts = packing.best_cuts(position, penalty, size)
        assert cuts[0] == 0 and cuts[-1] == 11
        assert sum(pad(position[b] - position[a]) + penalty[b] for a, b in zip(cuts, cuts[1:])) == pytest.approx(best[-1])


def test_secrets(spark):
    labelled = secrets.findings(spark, 3000)
    model = secrets.train(labelled.where(F.xxhash64("value") % 5 != 0))
    held = model.transform(secrets.featured(labelled.where(F.xxhash64("value") % 5 == 0)))
    assert held.where("label = prediction").count() >= 0.97 * held.count()
    rows = [(1, 'é token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" x'), (2, "card 4111111111111111 and 4111111111111111"), (3, None), (4, ""), (5, "a" * 5000), (6, "see commit 9c8b45435718dcc700c184a7e303cdc64c6a8f7f")]
    df = spark.createDataFrame([(d, t, "v") for d, t in rows], "doc_id long, text string, value string")
    got = secrets.scan(df, model).collect()
    assert {(r.doc_id, r.is_secret) for r in got} == {(1, True), (2, False), (6, False)}
    assert [(r.start, r.end) for r in got if r.doc_id == 1] == [(11, 51)]
    assert all((rows[r.doc_id - 1][1])[r.start : r.end] == r.value for r in got)
    assert secrets.scan(df.limit(0), model).collect() == []


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randint(0, 14))]

        def split(lo, hi):
            """The definition: the best segment, then what is left and right of it."""
            best = max(((sum(x[a:b]), a - b, -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            *_, a, b = best
            return [*split(lo, a), (a, b, best[0]), *split(b, hi)]

        got = toxicity.segments(x)
        assert sum(s for *_, s in got) == sum(s for *_, s in split(0, len(x)))
        assert max((s for *_, s in got), default=0) == max((s for *_, s in split(0, len(x))), default=0)
        assert all(sum(x[a:b]) == s for a, b, s in got)


def corpus(seed=6, n=400):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ta", "ro", "li", "po", "ve", "xi")]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad, low = rng.random() < 0.2, rng.random() < 0.3
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["idiot", "moron", "scum"])
        docs.append((i, " ".join(w + "###" if low else w for w in own) + ".", "en", f"s{i % 3}", len(own)))
        labels.append((i, int(not low), int(bad)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0)]
    labels += [(None, 1, 1), (n, None, None), (3, labels[3][1], labels[3][2]), (99_999, 1, 0)]
    return docs, labels


def test_toxicity_and_quality(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tox = {r.doc_id: r for r in toxicity.classified(df, lab, held).collect()}
    qual = {r.doc_id: r for r in quality.classified(df, lab, held).collect()}
    assert len(tox) == len(qual) == len(docs)
    out = [d for d in range(400) if tox[d].held_out]
    assert sum(tox[d].predicted == labels[d][2] for d in out) >= 0.95 * len(out)
    assert sum(qual[d].keep == bool(labels[d][1]) for d in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in (*tox.values(), *qual.values()))
    kept = quality.kept(df.withColumn("score", F.lit(1)), lab)
    assert kept.columns == [*df.columns, "score"]
    assert 200 < kept.count() < 330
    none = lab.limit(0)
    assert {r.predicted for r in toxicity.classified(df, none, held).collect()} == {0}
    assert {r.keep for r in quality.classified(df, none, held).collect()} == {True}
    assert toxicity.classified(df.limit(0), lab, held).collect() == quality.classified(df.limit(0), lab, held).collect() == []


def test_toxicity_scores(spark):
    """Every text's score from its words, one by one, by the model's own figures; long texts, ties and repeated rows."""
    docs, labels = corpus(seed=9)
    docs += [(1000, "kata " * 30_000 + "idiot moron scum " + "lota " * 30_000, "en", "s", 1), (1001, "kata " * 60_000, "en", "s", 1), *[(1002, docs[0][1], "en", "s", 1)] * 3]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(df.select("doc_id", "text"), lab, ~held)
    assert {"idiot", "moron", "scum"} <= {w.decode() for w in model.weights}
    got = [(r.doc_id, r.score) for r in toxicity.classified(df, lab, held).collect()]
    assert len(got) == len(docs)
    by_id = dict(got)

    def pieces(weights):
        """Maximal scoring segments by their definition: the best run, then those left and right of it."""
        best, start, total, begin = (0.0, 0, 0), 0, 0.0, 0
        for i, w in enumerate(weights):
            if total <= 0:
                total, begin = 0.0, i
            total += w
            best = max(best, (total, -begin, -i - 1))
        s, a, b = best[0], -best[1], -best[2]
        return [] if s <= 0 else pieces(weights[:a]) + [s] + pieces(weights[b:])

    for doc_id, text, *_ in docs:
        own = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        e = [model.rate * s - np.log(len(own)) - model.log_k for s in pieces([model.weights.get(w.encode(), model.loss) for w in own])]
        strong = [x for x in e if x > -np.log(model.level)]
        x = np.array([[min(30.0, max([0.0, *e])), np.log1p(sum(strong)), np.log1p(len(strong))]])
        assert abs(by_id[doc_id] - model.scores(x)[0]) < 1e-9
    assert by_id[1000] > by_id[1001]
    assert len({s for d, s in got if d == 1002}) == 1 and by_id[1002] == by_id[0]


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x @ [2.0, -1.0, 0.0] + 0.3 > 0).astype(float)
    fit = learn.Logistic(x, y)
    assert ((fit.logit(x) > 0) == (y > 0)).mean() > 0.97


def test_secret_candidates(spark):
    """Boundaries: an assignment's name is no part of the value, short and digit-free values need a cue, dotted tokens are one."""
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVPmB92K27uhbUJU1p1r"
    rows = [
        (1, "API_KEY=9c8b45435718dcc700c184a7e303cdc64c6a8f7f", ["9c8b45435718dcc700c184a7e303cdc64c6a8f7f"]),
        (2, "use password: hunt!er$ now", ["hunt!er$"]),
        (3, f"Bearer {jwt} end", [jwt]),
        (4, "the password is long and nothing follows it", []),
        (5, "tail c2VjcmV0LXZhbHVlLTEyMw== x", ["c2VjcmV0LXZhbHVlLTEyMw=="]),
        (6, "pwd=abcdefghij, token='short'", ["abcdefghij"]),
    ]
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    got = secrets.candidates(df).collect()
    for d, text, want in rows:
        own = sorted((r.start, r.value) for r in got if r.doc_id == d)
        assert [v for _, v in own] == want
        assert all(text[s : s + len(v)] == v for s, v in own)


def test_exchange_over_all_rows(spark):
    """Sums over a table of views are those of numpy over all its rows at once."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(300, 3)).astype(np.float32), rng.normal(size=(300, 2)).astype(np.float32)
    y = (x[:, 0] + 0.5 * z[:, 0] > 0).astype(float)
    text, page = learn.Logistic(x[:60].astype(float), y[:60]), learn.Logistic(z[:60].astype(float), y[:60])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, z)], "x array<float>, z array<float>").repartition(5)
    got, want = quality.lent_by_all(df, text, page, 0.8), quality.lend(text, page, x.astype(float), z.astype(float), 0.8)
    assert set(got) == set(want) and want["page", 1].n > 0
    for k, w in want.items():
        assert got[k].n == w.n
        np.testing.assert_allclose(got[k].gradient, w.gradient, rtol=1e-5, atol=1e-6)
        np.testing.assert_allclose(got[k].curve, w.curve, rtol=1e-5, atol=1e-6)
    assert quality.lent_by_all(df.limit(0), text, page, 0.8)["text", 0].n == 0


@pytest.mark.parametrize("names", [("__key", "__doc", "__text"), ("__n", "__hits", "__items"), ("__Runs", "__th", "row"), ("n", "hits", "items"), ("k", "left", "stays")])
def test_columns_of_any_name(spark, names):
    """What filtering operators add inside never meets a column of the table."""
    from timberline.llm import decontaminate, jaccard_join

    same = "one two three four five six seven eight nine ten " * 8
    rows = [(1, same, "en", "web", 10, "a", 1, None), (2, "other words in here", "en", "web", 11, "b", 2, None), (3, same, "de", "book", 12, "c", 3, None), (4, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names[0]} string, {names[1]} int, {names[2]} string")
    lab = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "none of these")], "item_id long, text string")
    by_id = {r[0]: tuple(r) for r in rows}
    for kept, stays in ((quality.kept(df, lab), {1, 2, 3, 4}), (line_dedup.cleaned(df), {1, 2, 4}), (jaccard_join.representatives(df), {1, 2, 4}), (decontaminate.clean(df, bench), {1, 2, 3, 4})):
        assert kept.columns == df.columns
        assert {r.doc_id: tuple(r) for r in kept.collect()} == {d: by_id[d] for d in stays}
