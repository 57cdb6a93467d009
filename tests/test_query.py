"""Filters, queries, detail, shape, streaming and the registered queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.operators import detail, filters, shape
from timberline.plans.query import LogQuery, display
from timberline.sources import reader
from timberline.streaming import level_counts, read_stream

LINES = [
    '{"time":"2024-01-15T10:30:00.123Z","level":"ERROR","msg":"disk full","host":"db1","n":1048576}',
    '{"time":"2024-01-15T12:30:00+02:00","level":"INFO","msg":"Started","h":{"k":1}}',
    '{"level":"WARN","msg":"no time","host":null}',
    '{"time":"2024-01-16T00:00:00Z","level":"INFO","msg":"late"}',
]


@pytest.fixture(scope="module")
def records(spark):
    return reader.load_lines(spark, LINES, "json").records.cache()


def messages(df):
    return [r.msg for r in df.collect()]


def test_filters(records):
    found = lambda c: {r.msg for r in records.where(c).collect()}
    assert found(filters.quick("DISK db1")) == {"disk full"}
    assert found(filters.quick("12:30:00")) == {"Started"}
    assert found(filters.quick("e+06")) == {"disk full"}
    assert found(filters.quick("")) == {"disk full", "Started", "no time", "late"}
    assert found(filters.set_filter("level", ["INFO", "WARN"])) == {"Started", "no time", "late"}
    assert found(filters.text_filter("attrs", "contains", "HOST=")) == {"disk full", "no time"}
    assert found(filters.text_filter("attrs", "blank")) == {"late"}
    assert found(filters.time_filter(after=dt.datetime(2024, 1, 15, 10, 30, 0, 1))) == {"disk full", "late"}
    with pytest.raises(ValueError):
        filters.text_filter("zz", "contains", "a")


def test_query(records):
    assert messages(LogQuery(sort=(("time", False),)).run(records)) == ["no time", "Started", "disk full", "late"]
    assert messages(LogQuery(sort=(("level", True), ("time", True))).run(records)) == ["no time", "late", "Started", "disk full"]
    assert messages(LogQuery().page(1, 2).run(records)) == ["no time", "late"]
    assert messages(LogQuery(jq='.level == "INFO"', quick="start").run(records)) == ["Started"]
    assert [tuple(r) for r in LogQuery(group=("level", "msg")).run(records).collect()] == [("ERROR", 1), ("INFO", 2), ("WARN", 1)]
    assert messages(LogQuery(group=("level",), expanded=("INFO",)).run(records)) == ["Started", "late"]
    assert LogQuery(quick="late").total(records).head().total == 1
    with pytest.raises(ValueError):
        LogQuery(sort=(("attrs", False),)).run(records)


def test_display_and_detail(records):
    rows = {r.msg: r for r in display(records).collect()}
    assert rows["disk full"].time_text == "10:30:00.123" and rows["Started"].time_text == "12:30:00.000"
    assert rows["disk full"].attrs_text == "host=db1, n=1.048576e+06"
    assert rows["Started"].attrs_text == "h=map[k:1]"
    one = [(r.key, r.value) for r in detail.of_line(records, 0).orderBy("i").collect()]
    assert one == [("time", "2024-01-15 10:30:00.123 UTC"), ("level", "ERROR"), ("msg", "disk full"), ("host", "db1"), ("n", "1048576")]
    assert detail.raw_text('{"b":1,"a":2}') == '{\n  "a": 2,\n  "b": 1\n}'
    assert detail.raw_text("plain") == "plain"


def large_ids(spark, folder):
    """Events whose ids begin at 1,229,990."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 1_229_990)
    events.write.parquet(f"{folder}/events.parquet")
    return events.collect()


def test_whole_numbers_in_full(spark, tmp_path):
    import __spark_entry__

    want = {(e.event_id, f"event_id={e.event_id}, user={e.user_id}") for e in large_ids(spark, tmp_path)}
    got = __spark_entry__.queries()["display_columns"](spark, str(tmp_path)).select("event_id", "attrs_text").collect()
    assert set(map(tuple, got)) == want
    line = '{"a":9007199254740993,"b":-1000000,"c":2.50,"d":[1e6,{"e":1234567}],"f":1e25,"g":12e-6}'
    row = display(reader.load_lines(spark, [line], "json").records, full=True).head()
    assert row.attrs_text == 'a=9007199254740993, b=-1000000, c=2.5, d=[1000000 {"e":1234567}], f=1e+25, g=1.2e-05'


def test_raw_view(spark):
    lines = ['{"b":1,"a":{"y":[],"x":{}}}', '{"b":[1.50,{"c":"\\"},{"}],"a":true}', " {} ", "[1]", "null", "plain", '{"a":1', "", '{"k":"a<b & c","é":"\\n"}']
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(detail.raw_view(F.col("x")).alias("t")).collect()]
    want = [detail.raw_text(x).replace("<", "\\u003c").replace("&", "\\u0026") for x in lines]
    want[2] = "{}"
    assert got == want


def test_shape(records):
    found = shape.fields(shape.infer(records).head().shape)
    assert set(found) == {"time", "level", "msg", "host", "n", "h"} and set(found["h"]) == {"k"}
    kinds = {r.key: (r.kinds, r.records) for r in shape.by_field(records).collect()}
    assert kinds["host"] == (["null", "string"], 2)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LINES) + "\nnone\n")
    stream = level_counts(read_stream(spark, str(tmp_path / "in"), "json"), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.level, r.records) for r in spark.sql("SELECT level, records FROM counts WHERE window IS NOT NULL").collect()) == [("ERROR", 1), ("INFO", 1), ("INFO", 1)]


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() == 1000


def test_detail_of_all_events(spark):
    import json

    import __spark_entry__

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()
    levels = {"error": "ERROR", "purchase": "WARN", "signup": "DEBUG"}
    want = set()
    for e in events:
        number = str(int(e.value)) if e.value == int(e.value) else repr(e.value)
        time = f"{e.ts:%Y-%m-%d %H:%M:%S}.{e.ts.microsecond // 1000:03d} UTC"
        fields = {"time": time, "level": levels.get(e.event_type, "INFO"), "msg": f"event {e.event_type}", "event_id": str(e.event_id), "user": str(e.user_id), "value": number, "kind": e.event_type, "props": json.dumps(json.loads(e.props), separators=(",", ":"))}
        want |= {(e.event_id, k, v) for k, v in fields.items()}
    got = [tuple(r) for r in __spark_entry__.queries()["detail_all_fields"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == 8 * len(events) and set(got) == want


def test_whole_order(spark):
    import __spark_entry__

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()
    levels = {"error": "ERROR", "purchase": "WARN", "signup": "DEBUG"}
    by_time = sorted(sorted(events, key=lambda e: e.event_id), key=lambda e: e.ts, reverse=True)
    by_msg = sorted(sorted(events, key=lambda e: e.event_id), key=lambda e: e.event_type, reverse=True)
    by_level = sorted(by_msg, key=lambda e: levels.get(e.event_type, "INFO"))
    for name, want in (("sort_time_rank", by_time), ("sort_level_msg_rank", by_level)):
        got = {r.event_id: r["rank"] for r in __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()}
        assert got == {e.event_id: i for i, e in enumerate(want, 1)}


def test_ranks_of_a_window(records):
    assert sorted((r["rank"], r.msg) for r in LogQuery(start=1, end=3).ranked(records).select("rank", "msg").collect()) == [(2, "Started"), (3, "no time")]
    assert LogQuery(quick="none such").ranked(records).collect() == []


def test_command(spark, tmp_path, capsys):
    from timberline.__main__ import main

    path = tmp_path / "a.log"
    path.write_text('{"level":"info","msg":"b","n":1}\r\n\n{"level":"error","msg":"a","n":2}\nnothing\n{"level":"warn","msg":"c","n":3}\n')
    assert main([str(path), "--jq", ".n > 1", "--sort", "msg:desc", "--plugins", str(tmp_path)]) == 0
    shown = capsys.readouterr()
    assert [x.split('"msg":"')[1][0] for x in shown.out.splitlines()] == ["c", "a"]
    assert "records=3" in shown.err and "skipped=1" in shown.err
    assert main([str(path), "--format", "none"]) == 1


def test_files_of_several_formats(spark, tmp_path):
    for name, text in {"a": '{"a":1}\n{"a":2}\n', "b": "a=1 b=2\n", "c": '{"b":1}\n'}.items():
        (tmp_path / name).write_text(text)
    logs = reader.read_logs(spark, [str(tmp_path / n) for n in "abc"])
    assert logs.format == "json,logfmt"
    assert logs.records.groupBy("format").count().count() == 2
    assert logs.records.count() == 4
