"""The jq language: parsing, evaluation, and compiled predicates against the interpreter."""

import pytest

from timberline.plans import jq
from timberline.plans.jq import interpreter
from timberline.sources import reader

RECORD = {"time": "2023-06-07T18:45:12Z", "level": "ERROR", "msg": "hello", "tags": {"run-id": "r/17"}, "a": [1, 2, {"b": 3}], "d": "54ms", "n": 5}
OUTPUTS = {
    ".level": ["ERROR"],
    'select(.level == "ERROR") | .msg': ["hello"],
    '.tags["run-id"] == "r/17"': [True],
    ".a[2].b": [3],
    "[.a[] | numbers] | add": [3],
    ".d > 200": [True],
    ".absent | .inner": [None],
    'false, "x"': [False, "x"],
    '.x // "z"': ["z"],
    "if .n > 3 then 1 elif .n > 2 then 2 else 3 end": [1],
    "reduce .a[:2][] as $x (0; . + $x)": [3],
    '"x\\(.n)\\("q" + "r")"': ["x5qr"],
    "def f(x): x * 2; f(.n)": [10],
    "def f($k): [., $k]; .n | f(1, 2)": [[5, 1], [5, 2]],
    ".a as [$x, $y] | $x + $y": [3],
    '.msg | sub("l+"; "L")': ["heLo"],
    '.msg | [match("l"; "g").offset]': [[2, 3]],
    '.msg | capture("(?<first>.)") | .first': ["h"],
    ".a |= map(1) | .a": [[1, 1, 1]],
    "del(.a, .tags) | keys": [["d", "level", "msg", "n", "time"]],
    "label $f | 1, break $f, 2": [1],
    "[foreach (1, 2, 3) as $x (0; . + $x)]": [[1, 3, 6]],
    "[limit(2; range(9))], first(range(5)), isempty(empty)": [[0, 1], 0, True],
    "[.a[] | type] | group_by(.) | map(length)": [[2, 1]],
    "with_entries(select(.key == \"n\"))": [{"n": 5}],
    "[paths(type == \"number\")]": [[["a", 0], ["a", 1], ["a", 2, "b"], ["n"]]],
    "@json \"v\\(.a)\", @uri \"\\(\"a b\")\"": ['v[1,2,{"b":3}]', "a%20b"],
    '"2015-03-05T23:51:47Z" | fromdate | todate': ["2015-03-05T23:51:47Z"],
    "try error(\"x\") catch .": ["x"],
    "[.[] | strings] | sort | first": ["2023-06-07T18:45:12Z"],
    "walk(if type == \"number\" then . + 1 else . end) | .n": [6],
    "[null, false, true, 0, \"a\", [], {}] | sort == .": [True],
}


@pytest.mark.parametrize("expression", OUTPUTS)
def test_outputs(expression):
    tree = jq.parse(expression)
    interpreter.check(tree)
    assert list(interpreter.Interpreter(tree)(RECORD)) == OUTPUTS[expression]


@pytest.mark.parametrize("expression", [".a | b!!", ".a |", "(", "foo", "$x", '"abc', ".a ==", "@foo", "if . then 1", "reduce . as $x (1)", "1 == 2 == 3"])
def test_no_jq(expression):
    with pytest.raises(jq.JqError):
        jq.plan(expression)


def test_first_output():
    first = lambda e: interpreter.first(jq.parse(e), RECORD)
    assert first("(false, true)") == (True, False)
    assert first("empty") == (False, None)
    assert first('error("x")') == (False, None)
    assert first('1, error("x")') == (True, 1)


LINES = [
    '{"time":"2024-01-17T08:09:10.5Z","level":"ERROR","msg":"hello","n":5,"s":"54ms","o":{"k":1,"a":[1,2]},"x":null,"t":true}',
    '{"time":"2024-02-15T10:30:00Z","level":"info","msg":"other view","n":-2.5,"s":"5","o":{"k":"z"},"msg":"again"}',
    '{"level":"warn","message":"m","n":"12","level_":1,"time":"bad","level":"late"}',
    "{}",
]
COMPILED = [
    '.level == "ERROR"', 'select(.level == "ERROR")', ".n > 3", ".n > 200", ".s > 200", ".missing", ".x", ".t", "null", "0", '""', ".o.k == 1", '.o.k == "z"', ".o.a[1] == 2", ".o.a[5]", ".s.k", ".s.k?", ".n.k // true",
    '.msg | test("^h.l")', '.msg | test("OTHER"; "i")', '.time | startswith("2024-01")', '.msg | endswith("view")', '.msg | contains("er v")', ".n | startswith(\"a\")", "(.missing | not)", '.level != "WARN"',
    ".n * 2 + 1 > 5", ".n / 0 > 1", ".n - 1 < 0", '.msg + "!" == "hello!"', "if .t then .n else .missing end", '.missing // "d"', "has(\"x\")", "has(\"zz\")", "(.o | has(\"k\"))", ".msg | length > 4", ".o | length == 2", "-.n > 0",
    '(.s | tonumber) == 5', '(.msg | ascii_upcase) == "HELLO"', '(.msg | ltrimstr("hel")) == "lo"', "(.n | type) == \"string\"", ".n and .t", ".n or .missing", "empty", "select(.n > 0) | .level", ". ", "(.n | floor) == -3", ".n == .n", ".x == null", ".o == .o", ".a.b.c", '.["level"]', ".msg",
]


def test_compiled_as_interpreted(spark):
    records = reader.load_lines(spark, LINES, "json").records
    for at in range(0, len(COMPILED), 13):
        part = COMPILED[at : at + 13]
        named = {f"c{i}": e for i, e in enumerate(part)}
        native = jq.with_matches(records, named, True).orderBy("line_no").collect()
        plain = jq.with_matches(records, named, False).orderBy("line_no").collect()
        for i, e in enumerate(part):
            assert [r[f"c{i}"] for r in native] == [r[f"c{i}"] for r in plain], e


def test_attributes_come_first(spark):
    records = reader.load_lines(spark, LINES, "json").records
    assert jq.where(records, '.msg == "again"').count() == 1
    assert jq.where(records, "").count() == 4
    assert sorted(r.o[0] for r in jq.with_outputs(records, ".level", "o").collect()) == ['""', '"ERROR"', '"INFO"', '"late"']


def test_completion():
    schema = {"headers": {"host": {}}, "latency_ms": {}}
    assert jq.complete(".lat", 4, schema) == (".latency_ms", ["latency_ms"])
    assert jq.complete(".l", 2, schema)[1] == ["latency_ms", "level"]
    assert jq.complete(".headers.h", 10, schema)[0] == ".headers.host"
    assert jq.complete(".msg | startsw", 14)[0] == ".msg | startswith"
    assert jq.complete(".zz", 3, schema) == (".zz", [])
