"""jq with several outputs, compiled to Columns, against the interpreter."""

import json

import pytest
from pyspark.sql import functions as F

from timberline.functions import nested
from timberline.plans import jq
from timberline.plans.jq import compiler, interpreter
from timberline.sources import reader

LINES = [
    '{"time":"2024-03-02T07:08:09.25Z","level":"ERROR","msg":"disk full","n":5,"s":"c,a,b","list":[3,1,2,null,"x",[2,1],{"k":1}],"o":{"b":2,"a":[1,{"z":null}],"c":"q"},"rows":[{"id":2,"g":"u"},{"id":1,"g":"v"},{"id":3,"g":"u"}],"t":true,"none":null,"key":"b"}',
    '{"time":"2024-03-03T00:00:00Z","level":"info","msg":"done","n":-2.5,"s":"","list":[],"o":{},"rows":[{"id":1},{"id":1,"x":[]}],"t":false,"deep":[[1,[2,[3,[4]]]],[[]]]}',
    '{"level":"warn","message":"text only","n":"7","s":"aXbXc","list":"no list","o":[1,[1],[1,0],[1,2],{"a":1},{"a":1,"b":0},{"b":0}],"rows":5}',
    '{"list":[0.1,1e-7,12345678.5,-4,100000,"é\\"\\\\",false,true],"o":{"k":{"k":{"k":[{"k":9}]}}},"rows":[[2,1],[2],[1,5],[]]}',
    "{}",
]
EXPRESSIONS = """
.list[] ; .list[]? ; .o[] ; .[] ; .. ; [..] | length ; .list | .[0], .[-1], .[99] ; .list[1:3] ; .list[-2:] ; .s[1:] ; .list[.n] ; .list[0.9]
.level, .msg ; (.n, 1), 2 ; empty ; empty, 1 ; 1, error("x"), 2 ; (.n | error), 3 ; .n, .n.x, 4 ; first(.list[]) ; first(empty) ; [limit(2; .list[]?)] ; limit(0; 1) ; isempty(.list[]?) ; first(1, error("x"))
[.list[]? | numbers] ; [.list[]? | arrays, objects] ; [.list[]? | scalars] ; [.[] | nulls] ; [.list[]? | values] ; .list | map(type) ; .rows | map(.id?)
any ; .list | any ; .list | any(. == 2) ; .list | all(. != 9) ; any(.list[]; . == "x") ; all(range(3); . < 3) ; [.list[]? | numbers] | add ; .list | add ; .s + "!" ; [.o, .rows] | add ; [.rows[]? | .id?] | add
keys ; .o | keys ; .list | keys ; .o | to_entries ; .o | to_entries | from_entries ; .o | with_entries(select(.key != "a")) ; .o | map_values(1) ; .o | map_values(empty) ; [["a", 1]] | map({(.[0]): .[1]}) | add ; [{"name": "q", "value": 1}, {"k": false, "v": 2}, {"key": null}] | from_entries
.list | sort ; .o | sort ; .rows | sort_by(.id) ; .rows | sort_by(.g, .id) ; .rows | group_by(.g) ; .rows | group_by(.g) | map(length) ; .list | unique ; .list | min, max ; .rows | min_by(.id), max_by(.id)
.list | reverse ; .s | reverse ; .deep | flatten ; .deep | flatten(1) ; .list | flatten ; .s | split(",") ; .s | split("X") ; .s | split(",") | join("-") ; .list | join("/")? ; [.list[]? | scalars] | join(",") ; .list | index(2) ; .s | index("X") ; .list | index([2, null])
.list | tostring ; .o | tojson ; [.[] | tostring] ; "n is \\(.n), o is \\(.o)" ; "\\(.list[]?) of \\(1, 2)" ; @json "v=\\(.list)" ; .o | tojson | fromjson ; "[1,{" | fromjson
{a: .n, b: .s} ; {a: (1, 2), b: (3, 4)} ; {(.level): 1} ; {"x": .list} ; {n, s} ; {a: 1, a: 2} ; {} ; {a: {b: [.n]}} ; [] ; [.n, .s, [.t]] ; {"a b": 1} | keys
reduce .list[]? as $x (0; . + 1) ; reduce range(5) as $i (0; . + $i) ; reduce (.list[]? | numbers) as $x (0; . + $x) ; reduce empty as $x (7; .) ; reduce range(3) as $i ([]; . + [$i]) ; [foreach range(4) as $i (0; . + $i)] ; [foreach range(4) as $i (0; . + $i; [., $i])] ; reduce (1, 2) as $x (0; ., 5)
.n as $x | [$x, $x] ; .list[0:2] as [$a, $b] | {a: $a, b: $b} ; (1, 2) as $x | $x + 2 ; . as $r | .list[]? | [., $r.n] ; .list as $l | range(2) | $l[.]
def f: .n; f ; def f(g): [g, g]; f(.n) ; def f($a; $b): $a + $b; f(1; 2) ; def f(g): .list[]? | g; [f(type)] ; def twice(f): f | f; 3 | twice(. * 2)
.list == .list ; .list < .rows ; .o == {} ; [.o[]? == {"a": 1}] ; .rows == [{"id": 1}, {"id": 1, "x": []}] ; [1, 2] < [1, 2, 0] ; {"a": 1} < {"b": 0} ; [.list[]? | . > 1] ; .list[]? < "y"
.list - [1, "x"] ; .list + [9] ; .o + {"z": 1} ; (1, 2) + (10, 20) ; .n % 3 ; -7 % 3 ; .n % 0 ; .list[]? % 2 ; 1 / 0 ; .n / 2 ; .s / "X" ; -(.n)
.missing // "d" ; (.list[]? | nulls) // 1 ; empty // 2 ; (false, null, 3, 4) // 5 ; (.n.x)? // "e" ; .n.x // "f" ; [.list[]? // "z"]
if .list[]? then 1 else 2 end ; [if (.n, .none) then "y" else "n" end] ; if .n > 0 then .list[]? else empty end ; (.n > 0, .t) and (true, false) ; [(.list[]? == 1) or false] ; .list[]? | not
.n? ; .n.x? ; [.[] | .x?] ; try .n.x ; (.list[]? | .k)? ; [.rows[]?.id?] ; .rows[]?["id"]? ; try error("x")
[range(3)] ; [range(1; 4)] ; [range(5; 0; -2)] ; [range(2; 5; 0.5)] ; [range(-2; 2)] | map(. > 0)
[.list[]? | has(0)?] ; .o | has("a")? ; .key as $k | .o | has($k)? ; "c" | inside("abc") ; [.list[]? | strings | startswith("x")] ; .s | contains("a")
[.list[]? | numbers | floor] ; [.list[]? | length?] ; .s | explode ; [.n | round?] ; .o.a[1].z ; .o | .a? | length ; [.n | sqrt?] | length
select(.level == "ERROR") | .list[0] ; select(.list[]? == 1) | .n ; .o | select(type == "object") | keys ; to_entries | map(.key) | sort
"""


def expressions():
    return [e.strip() for line in EXPRESSIONS.strip().split("\n") for e in line.split(" ; ")]


@pytest.fixture(scope="module")
def records(spark):
    return reader.load_lines(spark, LINES, "json").records.coalesce(1).cache()


@pytest.mark.parametrize("part", range(12))
def test_outputs_as_interpreted(records, part):
    assert len(expressions()) >= 150
    own = expressions()[part::12]
    plans = [(e, compiler._streamed("outputs", jq.parse(e))) for e in own]
    assert [e for e, c in plans if c is None] == []
    found = records.select(compiler.record_json().alias("record"), *(F.to_json(c).alias(f"c{i}") for i, (_, c) in enumerate(plans)), *(jq.predicate(e).alias(f"p{i}") for i, e in enumerate(own) if i % 4 == 0)).collect()
    wrong = []
    for r in found:
        record = json.loads(r.record)
        for i, e in enumerate(own):
            tree = jq.parse(e)
            interpreter.check(tree)
            want = [json.loads(t) for t in compiler._outputs(tree)(record)]
            if json.loads(r[f"c{i}"]) != want:
                wrong.append((e, r[f"c{i}"], want))
            if i % 4 == 0 and r[f"p{i}"] != compiler._matches(tree)(record):
                wrong.append((e, r[f"p{i}"], "matches"))
    assert wrong == []


@pytest.mark.parametrize("expression", ["path(.a)", ".a |= 1", "def f: f; f", '.s | sub("a"; "b")', "[paths]", "try error(1) catch .", "label $x | break $x", "range(.n)", '@csv "\\(.list)"'])
def test_left_to_the_interpreter(expression):
    with pytest.raises(jq.JqError):
        jq.predicate(expression)


def test_order_of_all_values(spark):
    given = ["null", "false", "true", "-1e300", "-1.5", "-1", "-1e-300", "0", "1e-300", "1", "1.5", "2", "10", "123456789.25", "1e300", '""', '"a"', '"ab"', '"b"', '"é"', '"\U0001f600"', "[]", "[null]", "[1]", "[1,2]", "[1,[]]", "[2]", "[[]]", "[{}]"]
    given += ["{}", '{"a":1}', '{"a":2}', '{"a":[1]}', '{"a":1,"b":0}', '{"a":2,"b":-1}', '{"b":0}']
    rows = spark.createDataFrame(list(enumerate(given)), "i int, j string").select("i", nested.order_key(F.parse_json("j")).alias("k")).collect()
    assert [r.i for r in sorted(rows, key=lambda r: r.k.encode())] == sorted(range(len(given)), key=lambda i: interpreter.order(json.loads(given[i])))
    assert len({r.k for r in rows}) == len(given)
    same = spark.createDataFrame([('{"b":1.0,"a":[2]}', '{"a":[2.0],"b":1}')], "x string, y string").select((nested.order_key(F.parse_json("x")) == nested.order_key(F.parse_json("y"))).alias("same"))
    assert same.head().same


def test_long_and_deep_values(spark):
    deep = "[" * 60 + "]" * 60
    wide = json.dumps([{"k": i, "t": 'a"[' * (i % 5)} for i in range(3000)], separators=(",", ":"))
    rows = spark.createDataFrame([(deep,), (wide,)], "j string").select("j", nested.json_text(F.parse_json("j")).alias("t"), nested.depth(F.parse_json("j")).alias("d")).collect()
    assert all(r.j == r.t for r in rows)
    assert sorted(r.d for r in rows) == [2, 60]
