"""Line numbers without gaps, shapes by path, folding of case, and a stream that ends and goes on."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline import streaming
from timberline.functions import text
from timberline.operators import filters, shape
from timberline.sources import reader


@pytest.mark.parametrize("split", ["1k", "7k", "128m"])
def test_numbers_without_gaps(spark, tmp_path, split):
    want = []
    for name, n in (("a", 900), ("b", 1), ("c", 333), ("d", 0)):
        lines = [f"line {i} " + "x" * (i * 7 % 40) + ("\r" if i % 3 == 0 else "") + ("\n" if i % 4 == 0 else "") for i in range(n)]
        (tmp_path / f"{name}.log").write_text("\n".join(lines))
        want += [(name, i + 1, f"line {i}") for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = reader.numbered(reader.read_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file[-5], r.number, " ".join(r.value.split()[:2])) for r in got) == sorted(want)


def brute_paths(v, path=""):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")
    inner = {p for x in v for p in brute_paths(x, path + "[]")} if isinstance(v, list) else {p for k, x in v.items() for p in brute_paths(x, f"{path}.{k}")} if isinstance(v, dict) else set()
    return ({(path, kind)} if path else set()) | inner


def test_shape_by_path(spark):
    attributes = [{"a": [1, "x", {"b": None}], "n": 2}, {"a": [], "n": "two", "o": {"o": {"o": [[True]]}}}, {"a": {"b": 1}, "t": False}, {}, {"a": [1, 2, 3]}]
    lines = [json.dumps({"time": "2024-01-01T00:00:00Z", "level": "INFO", "msg": "m"} | a) for a in attributes]
    got = {(r.path, r.kind): r.records for r in shape.by_path(reader.load_lines(spark, lines * 3, "json").records.repartition(3)).collect()}
    want = Counter(p for line in lines * 3 for p in brute_paths(json.loads(line)))
    assert got == dict(want)
    assert shape.by_path(reader.load_lines(spark, ["none"], "json").records).count() == 0


def fold_equal(a, b):
    """Equal up to simple folding of each character, among characters of as many bytes."""
    key = lambda c: (next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c), len(c.encode()))
    return [*map(key, a)] == [*map(key, b)]


def test_fold_keeps_lengths_and_finds_what_brute_force_finds(spark):
    source, to = text.fold_table()
    assert all(len(a.encode()) == len(b.encode()) for a, b in zip(source, to, strict=True))
    own = ["οδος", "ΟΔΟΣ", "5 µs", "5 μS", "ſo So sO", "STRASSE", "Straße", "ǅ ǆ Ǆ", "K k K", "İi Iı", "ЖжЯ", "\U00010400\U00010428", "", "Ꭰꭰ ẞß"]
    words = ["ος", "Σ", "µ", "μs", "s", "ſ", "ss", "ß", "ẞ", "ǆ", "k", "K", "i", "İ", "ж", "\U00010428", "", "o s", "Ꭰ"]
    rows = [(t, w) for t in own for w in words]
    got = spark.createDataFrame(rows, "t string, w string").select("t", "w", text.contains_fold(F.col("t"), F.col("w")).alias("found")).collect()
    for r in got:
        assert r.found == any(fold_equal(r.t[i : i + len(r.w)], r.w) for i in range(len(r.t) - len(r.w) + 1)), (r.t, r.w)
    log = reader.load_lines(spark, [json.dumps({"msg": t, "k": "Ärger", "n": 5}) for t in own], "json").records
    assert {r.msg for r in log.where(filters.quick("οΔος äRGER")).collect()} == {"οδος", "ΟΔΟΣ"}
    assert {r.msg for r in log.where(filters.text_filter("msg", "startswith", "5 Μ")).collect()} == {"5 µs", "5 μS"}


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(name, *times):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(f'{{"time":"2024-01-01T{t}Z","level":"INFO","msg":"x"}}\n' for t in times))

    def follow():
        streaming.follow(streaming.level_counts(streaming.read_stream(spark, folder, "json"), "1 hour"), out, checkpoint)
        return {r.window.start.hour: r.records for r in spark.read.parquet(out).collect()}

    arrive("1", "00:10:00", "00:20:00", "01:30:00")
    assert follow() == {0: 2}
    assert follow() == {0: 2}  # nothing new
    arrive("2", "00:30:00", "01:40:00", "03:00:00")  # the first is late: its window is final
    assert follow() == {0: 2, 1: 2}
    arrive("3", "05:00:00")
    assert follow() == {0: 2, 1: 2, 3: 1}
