"""Parsers, detection, plugins and the reader."""

import json

import pytest
from pyspark.sql import functions as F

from timberline.functions import times, values
from timberline.sources import reader
from timberline.sources.formats import GlogFormat, PluginFormat, RegexFormat, Registry
from timberline.sources.formats.plugin import sample_parse


def parse(spark, lines, format="auto", **registry):
    logs = reader.load_lines(spark, lines, format, Registry(**registry))
    shown = F.to_json(F.transform("attrs", lambda a: F.struct(a["key"].alias("k"), a["value"].alias("v"))))
    rows = logs.records.orderBy("line_no").select("line_no", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSS").alias("t"), "time_nanos", "time_offset_s", "level", "msg", shown.alias("a")).collect()
    return [(r.t, r.level, r.msg, {x["k"]: x.get("v") for x in json.loads(r.a)}, list(x["k"] for x in json.loads(r.a)), r) for r in rows], logs.summary().head()


def test_json(spark):
    rows, summary = parse(
        spark,
        [
            '{"time":"2023-06-07T18:45:12Z","level":"INFO","msg":"ready","shard":17}',
            '{"ts":1686163512.5,"level":"info","msg":"handed over","took":42}',
            '{"v":0,"level":50,"time":"2023-06-07T18:45:12.123456789+02:00","msg":"bad","pid":9}',
            "not json",
            '{"message":"a","msg":"b"}',
            '{"time":"x","ts":0}',
            '{"msg":5,"x":1}',
            '{"a":1,"b":2,"a":3}',
            "{}",
            '{"a":null,"h":{"b":[1,"x"]},"t":true}',
            '{"a":1',
            "",
        ],
        "json",
    )
    assert (summary.records, summary.skipped) == (9, 2)
    assert rows[0][:4] == ("2023-06-07 18:45:12.000", "INFO", "ready", {"shard": 17.0})
    assert rows[1][:3] == ("2023-06-07 18:45:12.500", "INFO", "handed over")
    assert rows[2][:3] == ("2023-06-07 16:45:12.123", "ERROR", "bad")
    assert (rows[2][5].time_nanos, rows[2][5].time_offset_s) == (123456789, 7200)
    assert rows[3][2:4] == ("a", {"msg": "b"})
    assert rows[4][0] == "1970-01-01 00:00:00.000" and rows[4][3] == {}
    assert rows[5][2:4] == ("", {"x": 1.0})
    assert rows[6][3:5] == ({"a": 3.0, "b": 2.0}, ["a", "b"])
    assert rows[7][0] is None and rows[7][1] == ""
    assert rows[8][3] == {"a": None, "h": {"b": [1, "x"]}, "t": True}


def test_glog(spark):
    rows, summary = parse(
        spark,
        [
            "I0607 18:45:12.345678 777 relay.go:9] Relay is up at node 3",
            "W0305 10:30:00.1   7 a.go:] x",
            'E20260607 18:45:12.000001 1 c.go:116] "Lease taken over" lease="zone/seven" turns=3 file=x',
            "F1332 99:30:00.1 7 a.go:3] bad time",
            "nope",
        ],
        "glog",
        default_year=2024,
    )
    assert (summary.records, summary.skipped) == (4, 1)
    assert rows[0][:4] == ("2024-06-07 18:45:12.345", "INFO", "Relay is up at node 3", {"thread_id": 777.0, "file": "relay.go", "line": 9.0})
    assert rows[1][1] == "WARNING" and "line" not in rows[1][3]
    assert rows[2][:5] == ("2026-06-07 18:45:12.000", "ERROR", "Lease taken over", {"thread_id": 1.0, "file": "x", "line": 116.0, "lease": "zone/seven", "turns": 3.0}, ["thread_id", "file", "line", "lease", "turns"])
    assert rows[3][:2] == (None, "FATAL")
    assert GlogFormat().default_year is None


def test_clf(spark):
    rows, _ = parse(
        spark,
        [
            '1.2.3.4 - frank [10/Oct/2000:13:55:36 -0700] "GET /find?w=old+map&part=2&w=x&bad=%zz HTTP/1.0" 404 2326 "http://r" "Mozilla/4.08"',
            '1.2.3.4 - - [bad] "GET" 500 -',
        ],
        "clf",
    )
    assert rows[0][:3] == ("2000-10-10 20:55:36.000", "WARN", "GET /find?w=old+map&part=2&w=x&bad=%zz HTTP/1.0")
    assert rows[0][3] == {"method": "GET", "protocol": "HTTP/1.0", "path": "/find", "query.w": "old map,x", "query.part": "2", "remote_addr": "1.2.3.4", "user": "frank", "status": 404.0, "bytes": 2326.0, "referer": "http://r", "user_agent": "Mozilla/4.08"}
    assert rows[1][:2] == (None, "ERROR") and rows[1][3] == {"remote_addr": "1.2.3.4", "status": 500.0}


def test_logfmt(spark):
    rows, summary = parse(spark, ['time=2023-06-07T18:45:12Z lvl=info msg="shard \\"x\\" moved" node=17 spare=true', "d=5d e=1e3 f=1e999 g=\"617\" =v word", "msg=a msg=b ts=never", "no pairs"], "logfmt")
    assert summary.skipped == 1
    assert rows[0][:4] == ("2023-06-07 18:45:12.000", "INFO", 'shard "x" moved', {"node": 17.0, "spare": True})
    assert rows[1][3] == {"d": "5d", "e": 1000.0, "f": "1e999", "g": 617.0, "": "v"}
    assert rows[2][:3] == (None, "", "b")


def test_cloudwatch(spark):
    rows, _ = parse(spark, ['2023-06-07T18:45:12Z s1 {"msg":"hi","level":"warn"}', "2023-06-07T18:45:12Z s1 plain words", "bad"], "cloudwatch")
    assert rows[0][1:4] == ("WARN", "hi", {"log_stream": "s1", "inner_format": "json"})
    assert rows[1][1:4] == ("", "plain words", {"log_stream": "s1"})
    rows, _ = parse(spark, ['{"events":[{"logStreamName":"s","timestamp":1686163512000,"message":"ready\\n","eventId":"e1"}]}'], "cloudwatch")
    assert rows[0][:4] == ("2023-06-07 18:45:12.000", "", "ready", {"log_stream": "s", "event_id": "e1"})
    with pytest.raises(Exception, match="malformed"):
        parse(spark, ["{broken"], "cloudwatch")


def test_detection(spark):
    for line, name in (('{"a":1}', "json"), ("a=1 b=2", "logfmt"), ("I0607 18:45:12.123456 1 s.go:4] x", "glog"), ('h - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 1', "clf")):
        assert reader.load_lines(spark, [line, "zz", line], "auto").format == name
    assert reader.load_lines(spark, [], "auto").format == "json"
    with pytest.raises(ValueError, match="json, glog, clf, logfmt"):
        reader.load_lines(spark, ["zz"], "auto")
    with pytest.raises(ValueError, match="unknown format"):
        reader.load_lines(spark, ["zz"], "nope")


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b'{"msg":"one"}\r\n\n{"msg":"two"}\nbad\n{"msg":"three"}')
    logs = reader.read_logs(spark, str(tmp_path / "a.log"))
    assert [r.msg for r in logs.records.orderBy("line_no").collect()] == ["one", "two", "three"]
    assert logs.summary().head().skipped == 1
    assert [r.value for r in logs.skipped.collect()] == ["bad"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        reader.read_logs(spark, str(tmp_path / "none.log"))


def test_plugins(spark, tmp_path):
    registry = Registry()
    (tmp_path / "a.toml").write_text('name = "bracket"\npattern = \'(?P<time>\\S+) \\[(?P<level>\\w+)\\] (?P<msg>.*)\'\nlevel_map = { X = "Extra" }\n')
    (tmp_path / "b.py").write_text('name = "bars"\ndef parse(line):\n    level, bar, msg = line.partition("|")\n    return {"ok": bool(bar), "level": level, "msg": msg, "attrs": {"n": 5, "a": "x"}}\n')
    (tmp_path / "c.toml").write_text('name = "bracket"\npattern = "x"\n')
    (tmp_path / "d.toml").write_text('name = "bad"\npattern = "("\n')
    (tmp_path / "e.txt").write_text("ignored")
    warnings = registry.load_plugins(tmp_path)
    assert len(warnings) == 2 and registry.names()[-2:] == ["bracket", "bars"]
    assert registry.load_plugins(tmp_path / "none") == []
    logs = reader.load_lines(spark, ["2024-01-15T10:30:00.000Z [X] started", "zz"], registry.need("bracket"))
    assert [(r.level, r.msg) for r in logs.records.collect()] == [("Extra", "started")]
    rows = reader.load_lines(spark, ["warn|hi", "none"], registry.need("bars")).records.collect()
    assert [(r.level, r.msg, [a.key for a in r.attrs]) for r in rows] == [("WARN", "hi", ["a", "n"])]
    optional = RegexFormat("o", r"(?P<level>\w+) (?P<id>\d+)?x(?P<rest>\w*)")
    rows, _ = parse(spark, ["INFO 5xab", "INFO x"], optional)
    assert [r[3] for r in rows] == [{"id": 5.0, "rest": "ab"}, {"rest": ""}]
    for bad in (("", "x"), ("n", ""), ("n", "(")):
        with pytest.raises(ValueError):
            RegexFormat(*bad)
    rows, _ = parse(spark, ["INFO: relay moved node=17", "x"], PluginFormat("s", sample_parse))
    assert rows[0][1:4] == ("INFO", "relay moved", {"node": "17"})


def test_texts(spark):
    cases = {8080.0: "8080", 1048576.0: "1.048576e+06", 1e21: "1e+21", 0.00001: "1e-05", 0.0001: "0.0001", 0.00025: "0.00025", 2.5: "2.5", -1234567.5: "-1.2345675e+06", 0.0: "0", 1e100: "1e+100", 999999.0: "999999"}
    rows = spark.createDataFrame([(k,) for k in cases], "x double").select("x", values.general_text(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == cases
    layouts = {"02/Jan/2006:15:04:05 -0700": "15/Jan/2024:10:30:00.5 +0200", "2006-01-02 15:04:05": "2024-01-15 08:30:00.5", "Jan _2 15:04:05 2006": "Jan 15 08:30:00.5 2024"}
    for layout, written in layouts.items():
        row = spark.createDataFrame([(written,)], "x string").select(times.layout_parser(layout)(F.col("x")).alias("t")).select(F.date_format("t.time", "yyyy-MM-dd HH:mm:ss.S").alias("t")).head()
        assert row.t == "2024-01-15 08:30:00.5", layout
