"""The stages on nulls, nothing, extra columns, and against what brute force keeps."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in "ka lo mi re su ta vu".split() for b in "ban del fir gon hul".split()]


def folder_of(spark, path, documents, benchmark=(), labels=()):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars int, node int, score double, word string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def row(i, text, lang="en", source="web"):
    return (i, text, lang, source, None if text is None else len(text), 7, 0.5, "w")


def staged(spark, path):
    """doc_ids that each stage but the last leaves, in turn; and the pieces."""
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            kept.append(sorted(r.doc_id for r in docs.collect() if r.doc_id is not None))
    return kept, docs.collect()


def test_nothing_and_nulls(spark, tmp_path):
    kept, pieces = staged(spark, folder_of(spark, tmp_path / "empty", []))
    assert kept == [[], [], [], []] and pieces == []
    nulls = [(None,) * 8, (1, None, None, None, None, None, None, None), (2, "", None, None, None, None, None, None)]
    kept, pieces = staged(spark, folder_of(spark, tmp_path / "nulls", nulls, [(None, None), (1, None), (2, "")], [(None, None, None), (1, None, None)]))
    assert all(set(k) <= {1, 2} for k in kept)
    assert all(p.length >= 1 for p in pieces)


def test_planted(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    docs = {i: text(120) for i in range(60)}
    item = text(30)
    passage = "\n".join(text(12) for _ in range(6))  # 72 words
    docs[100] = docs[3]  # an exact copy
    near = docs[4].split()
    near[60] = "other"
    docs[101] = " ".join(near)
    docs[102] = f"{text(40)} {item} {text(30)}"  # a benchmark item
    docs[103], docs[104] = f"{passage}\n{text(80)}", f"{text(80)}\n{passage}"
    rows = [row(i, t) for i, t in docs.items()] + [row(200, docs[7]), row(200, docs[7])]  # a repeated row
    path = folder_of(spark, tmp_path / "planted", rows, [(1, item)], [])
    (quality, lines, near_left, clean), pieces = staged(spark, path)
    assert quality == sorted([*docs, 200, 200])  # without labels nothing is rejected

    # line dedup by brute force: later runs of 50 words or more that stand before, by id
    assert set(lines) == set(docs) - {100} or set(lines) == set(docs) - {100, 200}
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/line_dedup").collect()}
    assert passage in left[103] and passage not in left[104]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in left.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert linked == [(4, 101)]
    assert set(near_left) == set(left) - {101}
    assert set(clean) == set(near_left) - {102}
    assert {p.doc_id for p in pieces} == set(clean)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == by_doc.get(p.doc_id, 0)
        by_doc[p.doc_id] = p.start + p.length
        assert p.length <= 4096
    assert all(by_doc[p.doc_id] == p.doc_tokens for p in pieces)
