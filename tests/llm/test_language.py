"""Language identification against a plain second computation, and by held-out accuracy."""

import math
import random

import pytest
from pyspark.sql import functions as F

from timberline.llm import language
from timberline.llm.common import table

SCHEMA = "doc_id long, text string, lang string, score int, held_out string"
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def letters(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def brute(rows, held_out, longest=5):
    """By doc: prediction and score, learning from all rows that are not held out."""
    taught = [(lang, letters(t)) for i, t, lang in rows if i not in held_out and lang is not None]
    langs = sorted({lang for lang, w in taught if w})
    tables = [{lang: {} for lang in langs} for _ in range(longest + 1)]
    for lang, own in taught:
        for w in own:
            for size in range(longest + 1):
                p = f" {w} "
                for g in [w] if size == 0 else [p[k : k + size] for k in range(len(p) - size + 1)]:
                    if g.strip():
                        tables[size][lang][g] = tables[size][lang].get(g, 0) + 1

    def log(size, g):
        """By language, or none if no language has it."""
        if not any(g in tables[size][lang] for lang in langs):
            return None
        totals = {lang: sum(tables[size][lang].values()) for lang in langs}
        return [math.log(tables[size][lang][g] / totals[lang] if g in tables[size][lang] else 0.1 / max(totals.values())) for lang in langs]

    def word(w):
        known = log(0, w)
        for size in range(longest, 0, -1):
            if known:
                return known
            p = f" {w} "
            found = [v for k in range(len(p) - size + 1) if p[k : k + size].strip() and (v := log(size, p[k : k + size]))]
            if found:
                known = [sum(c) / len(found) for c in zip(*found, strict=True)]
        return known or [0.0] * len(langs)

    out = []
    n = [sum(lang == of for of, _ in taught) for lang in langs]
    for i, t, _ in rows:
        own = letters(t)
        if not own or not langs:
            out.append((i, "und", 0.0))
            continue
        total = [math.log(k / sum(n)) for k in n]
        for w in own:
            total = [a + b for a, b in zip(total, word(w), strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out.append((i, langs[best], 1 / sum(math.exp(v - total[best]) for v in total)))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    stems = {"aa": "ka to mi sen ROU".split(), "bb": "ka zhe lo ščo žit".split(), "cc": "μι κα Σος to x".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(list(stems))
        own = ["".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(own), lang if i % 9 else None))
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 -- ²½", "aa"), (103, "漢字", None), (104, "kato", "dd"), (105, None, "ee"), (106, "a²b ǅ İx", "aa"), (106, "a²b ǅ İx", "aa")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("longest", [5, 2])
def test_identified(spark, longest):
    rows = rows_of(longest)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    held = {r.doc_id for r in df.where(HELD_OUT).select("doc_id").collect()}
    for parts in (1, 5):
        got = language.identified(df.repartition(parts), F.expr(HELD_OUT), longest=longest).collect()
        want = sorted(brute(rows, held, longest))
        got = sorted((r.doc_id, r.lang_pred, r.score, r.held_out) for r in got)
        assert [(i, p, h) for i, p, _, h in got] == [(i, p, i in held) for i, p, _ in want]
        assert [s for *_, s, _ in got] == pytest.approx([s for *_, s in want], rel=1e-9)


def test_a_small_sample_takes_whole_rows_and_one_at_least(spark):
    df = spark.createDataFrame([(i, "word " * 50, "aa" if i % 3 else "bb") for i in range(200)] + [(1000, "x" * 100_000, "cc")], "doc_id long, text string, lang string")
    sample, rows = language.sampled(df, 12_000)
    sizes = {r.lang: (r.n, r.size) for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()}
    assert rows == {"aa": 133, "bb": 67, "cc": 1}
    assert sizes["cc"] == (1, 100_000)
    assert all(250 <= sizes[lang][1] <= 4_000 for lang in ("aa", "bb"))
    model = language.train(df, 12_000)
    assert set(model.words) == {"word", "x" * 100_000}


def test_edges(spark):
    for rows in ([], [(1, "abc", None)], [(1, None, "aa")], [(None, "abc abd", "aa"), (None, None, None)]):
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
        got = sorted(((r.lang_pred, r.score, r.held_out) for r in language.identified(df, F.expr(HELD_OUT)).collect()), key=repr)
        assert got == sorted([("aa", 1.0, False) if t and lang else ("und", 0.0, False) for _, t, lang in rows], key=repr)
    long = spark.createDataFrame([(2, "de la " * 400_000, "fr"), (3, "of the " * 10, "en"), (6, "de de", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identified(long, F.lit(False)).collect()}
    assert got == {2: "fr", 3: "en", 6: "fr"}


def test_memory_of_unknown_words_is_bounded(spark, monkeypatch):
    model = language.train(spark.createDataFrame([(1, "alpha beta", "aa"), (2, "gamma delta", "bb")], "doc_id long, text string, lang string"), 1 << 20)
    words = ["".join(random.Random(i).choices("abdelmt", k=9)) for i in range(3000)]
    fresh = language.Scorer(model)
    want = [fresh.score(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)]
    monkeypatch.setattr(language, "REMEMBERED", 10)
    small = language.Scorer(model)
    assert [small.score(f"{a} {b}") for a, b in zip(words, words[1:], strict=False)] == want
    assert len(small.more) <= 12


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = language.identified(table(spark, folder, "documents"), F.expr(HELD_OUT)).where("held_out").join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 150
    assert right >= 0.97 * len(got)
