"""Large documents cut at their events, against the same documents read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from timberline.sources import documents, reader
from timberline.sources.formats import CloudWatchFormat


@pytest.fixture
def short_splits(spark):
    """Files read in splits of about 400 bytes."""
    own = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def document(rng, n):
    """A document as text and its messages; words hold braces, brackets, quotes and what looks like keys."""
    words = ["plain", "{", "}", "[", "]", '"', "\\", '\\"', '"events":[{', "é", "\n", "x=1", "}]}", ",", "µ" * 40, "{}" * 30]
    events = [{"logStreamName": "s", "timestamp": 1_700_000_000_000 + i, "message": " ".join(rng.choices(words, k=rng.randint(0, 12))), "eventId": f"e{i}"} for i in range(n)]
    for e in rng.sample(events, n // 4):
        e["more"] = {"list": [[], {}, [{"events": [{"message": "inner"}]}]]}
    other = {"searchedLogStreams": [{"logStreamName": "events", "searchedCompletely": True}], "nextToken": '{"events":['}
    parts = [("events", events), *other.items()]
    rng.shuffle(parts)
    text = json.dumps(dict(parts), indent=rng.choice([None, 1, 4]), ensure_ascii=False, separators=rng.choice([None, (",", ":"), (" , ", " : ")]))
    return text + rng.choice(["", "\n", "  \n"]), events


def read(spark, path, most):
    logs = reader.read_cloudwatch(spark, str(path), CloudWatchFormat(2024), most)
    return [(r.file.rsplit("/", 1)[-1], r.raw, r.msg, r.time, json.dumps([str(a) for a in r.attrs])) for r in logs.records.orderBy("file", "line_no").collect()]


def test_cut_as_whole(spark, short_splits, tmp_path):
    rng = random.Random(5)
    want = {}
    for i, n in enumerate([0, 1, 12, 20, 20, 20]):
        text, events = document(rng, n)
        (tmp_path / f"{i}.json").write_bytes(text.encode())
        want[f"{i}.json"] = [e["message"] for e in events]
    got = read(spark, tmp_path, 200)
    assert got == read(spark, tmp_path, 1 << 20)
    by = {name: [r[1] for r in got if r[0] == name] for name in want}
    assert by == want


def test_more_than_one_task(spark, short_splits, tmp_path):
    text, events = document(random.Random(2), 60)
    (tmp_path / "a.json").write_text(text)
    found = documents.large_events(spark, str(tmp_path), 200)
    tasks = found.select(F.spark_partition_id().alias("task"), "value").groupBy("task").count().collect()
    assert len(tasks) > 8 and sum(t["count"] for t in tasks) == len(events)
    lines = [r.line_no for r in found.collect()]
    assert len(set(lines)) == len(lines)
    assert documents.large_events(spark, str(tmp_path), 1 << 30) is None


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t[:-1],
        lambda t: t[: len(t) // 2],
        lambda t: t + "{",
        lambda t: t + "}",
        lambda t: t + " x",
        lambda t: t.replace("}, {", "} {", 1),
        lambda t: t.replace("}, {", "},, {", 1),
        lambda t: t.replace("[{", "[, {", 1),
        lambda t: t.replace("}]", "},]", 1),
        lambda t: t.replace("}, {", "}, 1, {", 1),
        lambda t: t.replace('"timestamp"', "timestamp", 1),
        lambda t: "[" + t + "]",
    ],
)
def test_malformed(spark, short_splits, tmp_path, change):
    text = json.dumps({"events": [{"logStreamName": "s", "timestamp": i, "message": f"m {{{i}"} for i in range(16)]})
    assert change(text) != text
    (tmp_path / "a.json").write_text(change(text))
    with pytest.raises(Exception, match="malformed"):
        read(spark, tmp_path, 200)


def test_kinds(spark, tmp_path):
    (tmp_path / "a b.json").write_text(" \n\n" + json.dumps({"events": [{"message": "one"}]}))
    (tmp_path / "tail.log").write_text("2023-06-07T18:45:12Z s1 words {here}")
    assert reader.is_document(spark, str(tmp_path / "a b.json")) and not reader.is_document(spark, str(tmp_path / "tail.log"))
    assert [r.msg for r in reader.read_logs(spark, str(tmp_path / "tail.log"), "cloudwatch").records.collect()] == ["words {here}"]
    (tmp_path / "none.json").write_text("")
    assert not reader.is_document(spark, str(tmp_path / "none.json"))
