"""Pivot search, decontamination and personal data against brute force."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from timberline.llm import decontaminate, pii, pivots


def vectors(seed, n, dims):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(i + n, list(rows[0][1])) for i in range(n // 3)]  # a hot vector
    rows += [(10_000, None), (10_001, [1.0, None] + [0.0] * (dims - 2)), (10_002, [math.inf] * dims), (10_050, [math.nan] * dims), (10_100, [0.5]), (None, [1.0] * dims), (10_150, [])]
    return rows


@pytest.mark.parametrize(("n", "dims", "block"), [(150, 6, 2048), (220, 3, 16)])
def test_pivots(spark, n, dims, block):
    rows = vectors(n, n, dims)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, pivots.search(df, F.col("vec_id") % 50 == 0, n_pivots=8, sample=64, block_rows=block).collect()))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_pivots_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert pivots.search(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1.0, 3.0])], schema)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pivots.search(huge, F.col("vec_id") == 0).collect()}
    assert got == {(0, 1): (1, 2**63 - 1), (0, 2): (2, -(2**63))}
    over = spark.createDataFrame([(0, [1e307]), (50, [1.0]), (1, [2.0])], schema)
    assert [(r.query_id, r.vec_id) for r in pivots.search(over, F.lit(True)).orderBy("query_id").collect()] == [(1, 50), (50, 1)]
    hot = spark.createDataFrame([(0, [1.0, 1.0]), *[(1, [2.0, 1.0])] * 200, (2, [-3.0, 1.0])], schema)
    for size in (16, 2048):
        got = pivots.search(hot, F.col("vec_id").isin(0, 2), block_rows=size).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 1, 196608)] * 5 + [(2, 0, -131072)] + [(2, 1, -327680)] * 4
    twice = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], schema)
    assert [(r.rank, r.vec_id) for r in pivots.search(twice, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 1)]


def brute_contamination(text, items, n=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(own) - m + 1):
                if own[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    joined = ",".join(sorted(found))
    return len(own), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("blocks", [2_000_000, 3])
def test_contamination(spark, blocks):
    rng = random.Random(8)
    word = lambda: rng.choice("alpha beta Gamma déjà x1 the THE of to 42".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(20)]
    items += [(30, None), (31, ""), (32, "-- !!"), (3, items[3][1]), (33, items[5][1])]
    docs = []
    for i in range(40):
        t = [word() for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            t[rng.randint(0, len(t)) : 0] = rng.choice(items)[1].split() if rng.random() < 0.8 and items else []
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(t)))
    docs += [(100, None), (101, ""), (102, "!?"), (103, "the " * 2000 + items[4][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, "h") for d, t in docs], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(df, bench, max_windows=blocks).drop("items").collect()
    assert sorted(map(tuple, got)) == sorted((d, *brute_contamination(t, items)) for d, t in docs)
    clean = decontaminate.clean(df, bench, max_windows=blocks)
    assert clean.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((d, t or "") for d, t in docs if not brute_contamination(t, items)[4])


def test_contamination_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs, none).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_pii(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.com", "@", "x@y", "a@b.c@d.e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "001.002.003.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "++1 5551234567 ", "é", "😀", " ", "\n", "79927398713", "…@ex-ample.org.", "%+-@a.b", "0" * 16, "https://u:p@h.org/x", "IBAN DE89370400440532013000", "iban: DE00370400440532013000"]
    docs = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "a" * 3000 + "@b.co " + "9" * 5000 + " " + "1.1." * 900), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for d, t in docs:
        want = brute_pii(t or "")
        row = got[d]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[2] == k for s in want) for k in BASE), t
        written = [f"{k}:{a}:{b}" for a, b, k in want]
        assert row.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [s for s in row.spans.split(",") if s.split(":")[0] in BASE] == written
    spans = pii.spans("pay IBAN DE89 3704 0044 0532 0130 00 now or ftp://me:pw@host.net/x", pii.anchors())
    assert [s[2] for s in spans if s[2] in ("account", "url")] == ["account", "url"]
    assert pii.redacted("to a@b.co now", [(3, 9, "email")]) == "to [EMAIL] now"
    assert pii.find(df.limit(0)).collect() == []


def test_account_parsers():
    def kinds(text):
        return [(k, text[a:b]) for a, b, k in pii.spans(text, pii.anchors()) if k == "account"]

    assert kinds("routing number 021000021 account number 12345678") == [("account", "021000021"), ("account", "12345678")]
    assert kinds("Routing Number: 021000022") == []  # its check digit fails
    assert kinds("ACCOUNT NUMBER is 1234-5678-90") == [("account", "1234-5678-90")]
    assert kinds("Social Security Number: 536-22-8726 and SSN 000-12-3456") == [("account", "536-22-8726")]
    assert kinds("account number DE89 3704 0044 0532 0130 00") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("the cabaña 021000021 and classnumber") == []
