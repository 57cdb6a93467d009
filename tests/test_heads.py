"""Formats of many files at once."""

import gzip

import pytest

from timberline.sources import heads, reader
from timberline.sources.formats import Registry

LINES = {"json": '{"msg":"m%d"}', "logfmt": "a=%d b=2", "glog": "I0607 18:45:12.5 1 s.go:4] m%d", "clf": 'h - - [10/Oct/2023:13:55:36 -0700] "GET /%d HTTP/1.0" 200 1'}


def test_many_files_in_few_jobs(spark, tmp_path):
    paths, want = [], {}
    for i in range(120):
        name = [*LINES][i % 4]
        path = tmp_path / f"{i}.log"
        path.write_text("\r\n\n".join(LINES[name] % k for k in range(1 + i % 15)) + "\nno record of any kind\n" * (i % 3 // 2))
        paths.append(str(path))
        want[str(path)] = name if i % 15 or not i % 3 // 2 else None
    spark.sparkContext.setJobGroup("detect", "")
    found = heads.detected(spark, paths, [f for f in Registry().formats if not f.is_document], 10)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("detect"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == want
    assert jobs <= 3


def test_all_read_together(spark, tmp_path):
    paths = []
    for i, (name, line) in enumerate(LINES.items()):
        (tmp_path / name).write_text("\n".join(line % k for k in range(30)))
        paths.append(str(tmp_path / name))
        with gzip.open(tmp_path / f"{name}.gz", "wt") as out:
            out.write("\n".join(line % k for k in range(i + 1)))
        paths.append(str(tmp_path / f"{name}.gz"))
    (tmp_path / "empty").write_text("\n\n")
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "a").write_text('{"msg":"in a folder"}')
    logs = reader.read_logs(spark, [*paths, str(tmp_path / "empty"), str(tmp_path / "folder")])
    assert dict(logs.records.groupBy("format").count().collect()) == {n: 30 + i + 1 + (n == "json") for i, n in enumerate(LINES)}
    (tmp_path / "odd").write_text("what is this\n" * 3)
    with pytest.raises(ValueError, match="odd"):
        reader.read_logs(spark, [paths[0], str(tmp_path / "odd")])


def test_long_first_lines(spark, tmp_path):
    (tmp_path / "long").write_text('{"msg":"' + "x" * 200_000 + '"}\n{"msg":"b"}')
    assert [len(x) for x in heads.first_lines(spark, str(tmp_path / "long"), 10)] == [200_010, 11]
    assert len(heads.first_lines(spark, str(tmp_path / "long"), 1)) == 1
    assert heads.first_lines(spark, str(tmp_path), 10) is None
    assert heads.first_lines(spark, str(tmp_path / "none"), 10) is None
