"""Written results: pages, what is read for them, and what is left out by time and words."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from timberline.operators import filters
from timberline.plans import store
from timberline.plans.query import LogQuery
from timberline.sources import reader

BY_TIME = LogQuery(sort=(("time", False),))


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    rng = random.Random(3)
    lines = []
    for i in range(3000):
        at = dt.datetime(2024, 5, 1) + dt.timedelta(minutes=rng.randrange(30 * 24 * 60))
        lines.append(f'{{"time":"{at.isoformat()}Z","level":"{rng.choice(["info", "WARN"])}","msg":"unit {rng.choice("abcd") * 3} turned ΔΟΣ{i}","n":{i},"tag":"zone{at.day}"}}')
    lines += ['{"level":"warn","msg":"no time"}', '{"msg":"","n":null}']
    rng.shuffle(lines)
    folder = tmp_path_factory.mktemp("logs")
    (folder / "app.log").write_text("\n".join(lines))
    return str(folder / "app.log")


@pytest.fixture(scope="module")
def records(spark, path):
    return reader.read_logs(spark, path, "json").records


@pytest.fixture(scope="module")
def result(records, tmp_path_factory):
    return store.open_result(records, BY_TIME, str(tmp_path_factory.mktemp("results")), 100, words=True)


def read(df):
    return len(df.inputFiles())


def test_pages_are_the_order(records, result):
    want = [r.raw for r in BY_TIME.run(records).collect()]
    assert result.total == len(want) == 3002
    for number, size in ((0, 50), (3, 50), (59, 50), (60, 50), (7, 333), (99, 100)):
        got = result.page(number, size).collect()
        assert [r.raw for r in got] == want[number * size : (number + 1) * size]
        assert [r.rank for r in got] == list(range(number * size + 1, number * size + 1 + len(got)))
    assert result.page(0, 1).columns == [*records.columns, "rank"]


def test_a_late_page_costs_what_an_early_one_does(result):
    early, late = result.page(3, 50), result.page(55, 50)
    assert read(early) <= 2
    assert read(late) <= 2
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "").replace("ENSURE", "")
    assert "json" not in plan.lower()


def test_found_again_without_a_job(spark, path, result):
    folder = result.folder.rsplit("/", 1)[0]
    again = reader.read_logs(spark, path, "json").records
    tracker, group = spark.sparkContext.statusTracker(), "again"
    spark.sparkContext.setJobGroup(group, "")
    assert store.open_result(again, BY_TIME, folder, 100, words=True).folder == result.folder
    assert len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    test = filters.text_filter("msg", "contains", "aaa")
    named = [store.name_of(again, q) for q in (BY_TIME, LogQuery(), LogQuery(quick="aaa"), LogQuery(filters=(test,)), LogQuery(jq=".n > 5"), LogQuery(jq=".n > 6"))]
    assert len(set(named)) == len(named)
    assert store.name_of(again, LogQuery(filters=(filters.text_filter("msg", "contains", "aaa"),))) == named[3]


def test_a_changed_input_is_another_result(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text('{"msg":"one"}\n')
    first = store.open_result(reader.read_logs(spark, str(log), "json").records, LogQuery(), str(tmp_path / "r"))
    log.write_text('{"msg":"one"}\n{"msg":"two"}\n')
    second = store.open_result(reader.read_logs(spark, str(log), "json").records, LogQuery(), str(tmp_path / "r"))
    assert (first.total, second.total) == (1, 2)
    # a write without its manifest does not count
    shutil.rmtree(f"{second.folder}/manifest")
    again = store.open_result(reader.read_logs(spark, str(log), "json").records, LogQuery(), str(tmp_path / "r"))
    assert sorted(r.msg for r in again.page(0).collect()) == ["one", "two"]


def test_time_leaves_parts_out(records, result):
    after, before = dt.datetime(2024, 5, 10), dt.datetime(2024, 5, 11, 23)
    found = result.search(after=after, before=before)
    want = sorted(r.raw for r in records.where(filters.time_filter(after, before)).collect())
    assert sorted(r.raw for r in found.collect()) == want != []
    assert read(found) <= 5  # of 31 parts


def test_words_leave_parts_out_and_lose_nothing(records, result):
    for words, most in (("zone7", 31), ("ΔΟΣ1234", 31), ("δος1234 UNIT", 31), ("aaa", 31), ("12:", 31), ("zz", 31), ("no time", 31), ("nowhere", 0), ("zone31", 0)):
        found = result.search(words)
        want = sorted(r.raw for r in records.where(filters.quick(words)).collect())
        assert sorted(r.raw for r in found.collect()) == want, words
        assert read(found) <= most, words
    assert read(result.search("zone7")) < 20


def test_ids_of_a_million_are_found_by_their_digits(spark, tmp_path):
    import __spark_entry__

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_id", F.col("event_id") + 1_229_990)
    events.write.parquet(f"{tmp_path}/events.parquet")
    by_time = sorted(events.collect(), key=lambda e: (-e.ts.timestamp(), e.event_id))
    # the digits stand in an id or another number, or in the clock
    held = lambda e: any("123" in str(x) for x in (e.event_id, e.user_id, e.value, e.props, f"{e.ts:%H:%M:%S}.{e.ts.microsecond // 1000:03d}"))
    want = {(e.event_id, i) for i, e in enumerate(by_time, 1) if e.event_type == "view" and held(e)}
    got = __spark_entry__.queries()["result_by_words"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) > 100


def test_more_than_a_thousand_parts_of_a_task_keep_their_order(spark, tmp_path):
    lines = [f'{{"msg":"{i:04d}"}}' for i in range(1100)]
    result = store.open_result(reader.load_lines(spark, lines, "json").records.coalesce(1), LogQuery(sort=(("msg", False),)), str(tmp_path), 1)
    assert [r.msg for r in result.page(0, 1100).select("rank", "msg").orderBy("rank").collect()] == [f"{i:04d}" for i in range(1100)]


def test_edges(spark, records, tmp_path):
    empty = store.open_result(records, LogQuery(jq=".n == -1"), str(tmp_path), words=True)
    assert empty.total == 0
    assert empty.page(0).collect() == empty.search("word").collect() == []
    with pytest.raises(ValueError, match="groups"):
        store.open_result(records, LogQuery(group=("level",)), str(tmp_path))
    leaf = store.open_result(records, LogQuery(group=("level",), expanded=("WARN",)), str(tmp_path))
    assert leaf.total == records.where("level = 'WARN'").count()
    extra = records.withColumns({"part": F.lit(1), "start": F.lit(2), "n": F.lit(3)})
    got = store.open_result(extra, BY_TIME, str(tmp_path), 500).page(1, 5).collect()
    assert [(r.part, r.start, r.n) for r in got] == [(1, 2, 3)] * 5
