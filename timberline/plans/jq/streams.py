"""jq trees with any number of outputs, as Columns.

An expression becomes a Column of its outputs.  There are four shapes:

    value   VARIANT                                   one output, no error
    maybe   struct<v: VARIANT, ok: boolean>           one output, or an error
    list    array<VARIANT>                            outputs, no error
    stream  struct<v: array<VARIANT>, ok: boolean>    outputs; not ok: then an error

A pipe is a ``transform`` over the outputs on its left, cut at the first error,
and flattened.  Functions of the language and the user's own are put in where
they are called, so one that calls itself is left to the interpreter, as are
paths, updates, formats and matches.  Each Column is used once, or bound by a
lambda first, so trees grow with the expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs as A
from ...functions import nested, values
from ...functions.nested import ARRAY, BOOLEAN, NULL, NUMBERS, OBJECT, STRING
from ...functions.values import bound
from . import compiler, interpreter

LIST, ENTRIES = nested.LIST, A.ATTRS
#: What the compiler of single values does not know, or whose missing output it cannot tell from an error; and the functions that it knows.
BEYOND = {"try", "variable", "as", "def", "reduce", "foreach", "each", "comma", "slice", "array", "object", "text", "format", "update", "label", "break"}
SINGLE = {
    "has", "ascii_downcase", "ascii_upcase", "floor", "ceil", "sqrt", "fabs", "abs", "type", "not", "tonumber", "length",
    "startswith", "endswith", "contains", "inside", "ltrimstr", "rtrimstr", "test",
}
#: Outputs of a range that are written out.
LONGEST_RANGE = 1_000_000


class Unsupported(compiler.Unsupported):
    """A tree that is left to the interpreter."""


@dataclass
class Stream:
    shape: str
    col: Column


def none() -> Column:
    return F.array().cast(LIST)


def value(col: Column) -> Stream:
    return Stream("value", col)


def number(col: Column) -> Stream:
    return value(col.cast("double").cast("variant"))


def boolean(col: Column) -> Stream:
    return value(F.coalesce(col, F.lit(False)).cast("variant"))


def string(col: Column) -> Stream:
    return value(col.cast("variant"))


def pair(v: Column, ok: Column) -> Column:
    return F.struct(v.alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))


def maybe(v: Column, ok: Column) -> Stream:
    """``v`` has to be of no harm where it is not ok."""
    return Stream("maybe", pair(v.cast("variant"), ok))


def stream(v: Column, ok: Column) -> Stream:
    return Stream("stream", pair(v, ok))


def promoted(s: Stream, shape: str) -> Column:
    if s.shape == shape:
        return s.col
    one, all_ = s.shape in ("value", "maybe"), F.lit(True)
    if s.shape == "maybe":
        return bound(s.col, lambda m: pair(F.when(m["ok"], F.array(m["v"])).otherwise(none()), m["ok"]))
    if shape == "maybe":
        return pair(s.col, all_)
    own = F.array(s.col) if one else s.col
    return own if shape == "list" else pair(own, all_)


def widest(*shapes: str) -> str:
    """The shape that holds all of these."""
    kinds = set(shapes)
    if len(kinds) == 1:
        return kinds.pop()
    if kinds == {"value", "maybe"}:
        return "maybe"
    return "list" if kinds == {"value", "list"} else "stream"


def choose(condition: Column, yes: Stream, no: Stream) -> Stream:
    shape = widest(yes.shape, no.shape)
    return Stream(shape, F.when(condition, promoted(yes, shape)).otherwise(promoted(no, shape)))


def gathered(results: Column, shape: str, ok: Column) -> Column:
    """The outputs of results one after another, up to the first error."""

    def cut(r: Column) -> Column:
        def kept(at: Column) -> Column:
            own = F.transform(F.slice(r, F.lit(1), F.when(at > 0, at if shape == "stream" else at - 1).otherwise(F.size(r))), lambda q: q["v"])
            return pair(F.flatten(own) if shape == "stream" else own, (at == 0) & ok)

        return bound(F.coalesce(F.array_position(F.transform(r, lambda q: q["ok"]), False), F.lit(0)).cast("int"), kept)

    return bound(results, cut)


def then(left: Stream, use: Callable[[Column], Stream]) -> Stream:
    """``use`` for every output of ``left``."""
    seen = []

    def each(v: Column) -> Column:
        seen.append(use(v))
        return seen[-1].col

    def over(items: Column, ok: Column) -> Column:
        results = F.transform(items, each)
        shape = seen[-1].shape
        if shape in ("maybe", "stream"):
            return gathered(results, shape, ok)
        return pair(F.flatten(results) if shape == "list" else results, ok)

    if left.shape == "value":
        col = bound(left.col, each)
        return Stream(seen[-1].shape, col)
    if left.shape == "maybe":

        def guarded(m: Column) -> Column:
            seen.append(use(m["v"]))
            shape = widest(seen[-1].shape, "maybe")
            failed = pair(none() if shape == "stream" else F.lit(None).cast("variant"), F.lit(False))
            return F.when(m["ok"], promoted(seen[-1], shape)).otherwise(failed)

        col = bound(left.col, guarded)
        return Stream(widest(seen[-1].shape, "maybe"), col)
    if left.shape == "list":
        results = F.transform(left.col, each)
        shape = seen[-1].shape
        if shape in ("maybe", "stream"):
            return Stream("stream", gathered(results, shape, F.lit(True)))
        return Stream("list", F.flatten(results) if shape == "list" else results)
    return Stream("stream", bound(left.col, lambda s: over(s["v"], s["ok"])))


def bind(s: Stream, use: Callable[[Column, Column], Stream]) -> Stream:
    """``use`` of all outputs together, and whether no error follows them."""
    seen = []

    def whole(x: Column) -> Column:
        seen.append(use(x["v"], x["ok"]))
        return seen[-1].col

    col = bound(promoted(s, "stream"), whole)
    return Stream(seen[-1].shape, col)


def truthy(v: Column) -> Column:
    tag = values.tag(v)
    return F.coalesce(F.when(tag == "BO", F.try_variant_get(v, "$", "boolean")).otherwise(tag != "VO"), F.lit(False))


def lifted(node: compiler.Node) -> Stream:
    """A plain node; here no output of it is an error."""
    plain = {"boolean": node.b, "number": node.n, "string": node.s}
    if node.known == "null":
        v = values.null_variant()
    elif node.known in plain:
        v = plain[node.known].cast("variant")
    else:
        v = F.when(node.kind == "null", values.null_variant())
        for kind, col in plain.items():
            v = v.when(node.kind == kind, col.cast("variant"))
        v = v.otherwise(node.v) if node.v is not None else v
    return maybe(v, node.ok)


def made_object(entries: Column) -> Column:
    """An object of entries (key, value); the last of one key stays."""
    return F.to_variant_object(F.map_from_entries(A.folded(entries.cast(ENTRIES))))


def at_key(v: Column, key: Column) -> Stream:
    """``v[key]`` for a text."""
    return maybe(F.when(nested.kind(v) == OBJECT, F.try_element_at(F.try_variant_get(v, "$", nested.MAP), key)), nested.kind(v).isin(OBJECT, NULL))


def at_place(v: Column, key: Column) -> Stream:
    """``v[key]`` for a number; from the end, if it is below zero."""
    place = F.floor(key).cast("int")
    found = bound(nested.elements(v), lambda own: F.get(own, F.when(place < 0, place + F.size(own)).otherwise(place)))
    return maybe(F.when(nested.kind(v) == ARRAY, found), nested.kind(v).isin(ARRAY, NULL))


def at(v: Column, key: Column) -> Stream:
    def use(x: Column) -> Column:
        by_key, by_place = at_key(v, values.as_string(key)).col, at_place(v, values.as_number(key)).col
        return F.when(x == STRING, by_key).when(x.isin(*NUMBERS), by_place).otherwise(pair(F.lit(None).cast("variant"), (nested.kind(v) == NULL) & (x == NULL)))

    return Stream("maybe", bound(nested.kind(key), use))


def cut(v: Column, start: Column | None, end: Column | None) -> Stream:
    """A slice of an array or text, from ``start`` (down) to ``end`` (up); negative ones count from the end."""

    def limits(size: Column) -> tuple[Column, Column]:
        def place(k: Column | None, otherwise: Column, round_) -> Column:
            if k is None:
                return otherwise
            n = round_(values.as_number(k)).cast("int")
            return F.when(nested.kind(k) == NULL, otherwise).otherwise(F.greatest(F.lit(0), F.least(size, F.when(n < 0, n + size).otherwise(n))))

        first = place(start, F.lit(0), F.floor)
        return first, F.greatest(F.lit(0), place(end, size, F.ceil) - first)

    def of_list(own: Column) -> Column:
        first, n = limits(F.size(own))
        return F.slice(own, first + 1, n).cast("variant")

    def of_text(own: Column) -> Column:
        first, n = limits(F.length(own))
        return F.substr(own, first + 1, n).cast("variant")

    kind = nested.kind(v)
    good = kind.isin(ARRAY, STRING)
    for k in (start, end):
        if k is not None:
            good &= nested.kind(k).isin(NULL, *NUMBERS)
    out = F.when(good & (kind == ARRAY), bound(nested.elements(v), of_list)).when(good & (kind == STRING), bound(values.as_string(v), of_text))
    return maybe(out, good | (kind == NULL))


def each(v: Column) -> Stream:
    kind = nested.kind(v)
    return stream(F.when(kind == ARRAY, nested.elements(v)).when(kind == OBJECT, F.map_values(F.try_variant_get(v, "$", nested.MAP))).otherwise(none()), kind.isin(ARRAY, OBJECT))


def _split(text: Column, sign: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(sign, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(text == "", F.array().cast("array<string>")).when(sign == "", F.filter(F.split(text, "", -1), lambda c: c != "")).otherwise(F.split(text, quoted, -1))


def math(op: str, a: Column, b: Column) -> Stream:
    def use(x: Column) -> Column:
        a, b, m, n, ka, kb = (x[k] for k in ("a", "b", "m", "n", "ka", "kb"))
        same = lambda kind: (ka == kind) & (kb == kind)
        numbers, out = ka.isin(*NUMBERS) & kb.isin(*NUMBERS), F.lit(None).cast("variant")
        ok = numbers
        if op == "+":
            texts, lists, objects = same(STRING), same(ARRAY), same(OBJECT)
            out = (
                F.when(ka == NULL, b).when(kb == NULL, a).when(numbers, (m + n).cast("variant"))
                .when(texts, F.concat(values.as_string(a), values.as_string(b)).cast("variant"))
                .when(lists, F.concat(nested.elements(a), nested.elements(b)).cast("variant"))
                .when(objects, made_object(F.concat(nested.members(a), nested.members(b))))
            )
            ok = numbers | texts | lists | objects | (ka == NULL) | (kb == NULL)
        elif op == "-":
            rest = bound(F.transform(nested.elements(b), nested.order_key), lambda gone: F.filter(nested.elements(a), lambda e: ~F.array_contains(gone, nested.order_key(e))))
            out = F.when(numbers, (m - n).cast("variant")).when(same(ARRAY), rest.cast("variant"))
            ok = numbers | same(ARRAY)
        elif op == "/":
            good = numbers & (n != 0)
            parts = F.transform(_split(values.as_string(a), values.as_string(b)), lambda t: t.cast("variant"))
            out = F.when(good, F.try_divide(m, n).cast("variant")).when(same(STRING), parts.cast("variant"))
            ok = good | same(STRING)
        elif op == "%":
            good = numbers & (compiler.whole(n) != 0)
            out = F.when(good, compiler.remainder(m, n).cast("variant"))
            ok = good
        else:
            raise Unsupported(op)
        return pair(out, ok)

    known = F.struct(a.alias("a"), b.alias("b"), values.as_number(a).alias("m"), values.as_number(b).alias("n"), nested.kind(a).alias("ka"), nested.kind(b).alias("kb"))
    return Stream("maybe", bound(known, use))


def sorted_by_key(pairs: Column) -> Column:
    """Pairs of v and k by k; equal ones stay in their order."""
    placed = F.transform(pairs, lambda p, i: F.struct(p["v"].alias("v"), p["k"].alias("k"), i.alias("i")))
    return F.array_sort(placed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"]))


def firsts(ranked: Column) -> Column:
    """Of sorted pairs those whose key is a new one."""
    return F.filter(ranked, lambda p, i: (i == 0) | (F.get(ranked, i - 1)["k"] != p["k"]))


def just(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["v"])


def chosen(pairs: Column, how: str) -> Column:
    """sort, unique, group, min or max of pairs of v and k."""
    if how == "sort":
        return just(sorted_by_key(pairs)).cast("variant")
    if how == "unique":
        return bound(sorted_by_key(pairs), lambda r: just(firsts(r))).cast("variant")
    if how == "group":
        return bound(sorted_by_key(pairs), lambda r: F.transform(firsts(r), lambda f: just(F.filter(r, lambda p: p["k"] == f["k"])))).cast("variant")
    return bound(sorted_by_key(pairs), lambda r: F.get(r, F.lit(0) if how == "min" else F.size(r) - 1)["v"])


def from_entries(v: Column) -> Stream:
    def entry(e: Column) -> Column:
        own = F.try_variant_get(e, "$", nested.MAP)
        get = lambda *names: F.coalesce(*(F.try_element_at(own, F.lit(n)) for n in names))
        good = F.coalesce(*(F.when(truthy(k), k) for k in (F.try_element_at(own, F.lit(n)) for n in ("key", "k", "name", "Name", "Key", "K"))), F.try_element_at(own, F.lit("key")))
        key = bound(good, lambda k: F.when(nested.kind(k).isin(STRING, BOOLEAN, NULL, *NUMBERS), nested.text_of(k)))
        return F.struct(key.alias("key"), F.coalesce(get("value", "v", "Value", "V"), values.null_variant()).alias("value"))

    def whole(own: Column) -> Column:
        good = F.forall(own, lambda e: nested.kind(e) == OBJECT)
        made = F.when(good, F.transform(own, entry))
        return bound(made, lambda m: bound(good & F.forall(m, lambda e: e["key"].isNotNull()), lambda ok: pair(F.when(ok, made_object(m)), ok)))

    return then(Stream("maybe", bound(each(v).col, lambda s: pair(s["v"].cast("variant"), s["ok"]))), lambda list_: Stream("maybe", bound(nested.elements(list_), whole)))


def index_of(v: Column, x: Column) -> Stream:
    kv, kx = nested.kind(v), nested.kind(x)
    text = bound(F.struct(values.as_string(v).alias("v"), values.as_string(x).alias("x")), lambda s: F.when((s["x"] != "") & F.contains(s["v"], s["x"]), F.octet_length(F.left(s["v"], F.position(s["x"], s["v"]) - 1))))
    own = F.array_position(F.transform(nested.elements(v), nested.order_key), nested.order_key(x))
    run = bound(F.struct(nested.elements(v).alias("v"), nested.elements(x).alias("x")), lambda s: _run(s["v"], s["x"]))
    place = F.when(kv == STRING, text).when(kx == ARRAY, run).otherwise(F.when(own > 0, own - 1))
    return maybe(F.when(kv.isin(STRING, ARRAY), place.cast("double").cast("variant")), (kv == NULL) | ((kv == STRING) & (kx == STRING)) | (kv == ARRAY))


def _run(own: Column, part: Column) -> Column:
    """Where the elements of ``part`` stand in a row for the first time."""
    size = F.size(part)

    def keyed(k: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(k["o"]) - size), lambda i: F.slice(k["o"], i + 1, size) == k["p"])
        return F.when((size > 0) & (F.size(k["o"]) >= size), F.get(places, F.lit(0)))

    keys = lambda c: F.transform(c, nested.order_key)
    return bound(F.struct(keys(own).alias("o"), keys(part).alias("p")), keyed)


def joined(v: Column, sep: Column) -> Stream:
    own = nested.elements(v)
    good = F.forall(own, lambda e: nested.kind(e).isin(STRING, BOOLEAN, NULL, *NUMBERS))
    parts = F.transform(own, lambda e: F.when(nested.kind(e) == NULL, "").otherwise(nested.text_of(e)))
    out = F.aggregate(parts, F.lit(None).cast("string"), lambda acc, t: F.coalesce(F.concat(acc, values.as_string(sep), t), t))
    return maybe(F.when(good, F.coalesce(out, F.lit("")).cast("variant")), (nested.kind(v) == ARRAY) & good & ((F.size(own) == 0) | (nested.kind(sep) == STRING)))


def contains(v: Column, x: Column) -> Stream:
    both = (nested.kind(v) == STRING) & (nested.kind(x) == STRING)
    numbers = nested.kind(v).isin(*NUMBERS) & nested.kind(x).isin(*NUMBERS)
    flat = numbers | ((nested.kind(v) == nested.kind(x)) & ~nested.kind(v).isin(ARRAY, OBJECT))
    return maybe(F.when(both, F.contains(values.as_string(v), values.as_string(x))).when(flat, nested.order_key(v) == nested.order_key(x)).cast("variant"), flat)


def has(v: Column, key: Column) -> Stream:
    of_object = (nested.kind(v) == OBJECT) & (nested.kind(key) == STRING)
    of_list = (nested.kind(v) == ARRAY) & nested.kind(key).isin(*NUMBERS)
    n = values.as_number(key)
    found = F.when(of_object, F.array_contains(F.map_keys(F.try_variant_get(v, "$", nested.MAP)), values.as_string(key))).when(of_list, (n >= 0) & (n < F.size(nested.elements(v))))
    return maybe(found.cast("variant"), of_object | of_list)


def _numbers(col: Column) -> Column:
    return F.transform(col, lambda i: i.cast("double").cast("variant"))


def keys(v: Column) -> Stream:
    own = F.transform(F.map_keys(F.try_variant_get(v, "$", nested.MAP)), lambda k: k.cast("variant"))
    places = F.transform(nested.elements(v), lambda _, i: i.cast("double").cast("variant"))
    return maybe(F.when(nested.kind(v) == OBJECT, own.cast("variant")).when(nested.kind(v) == ARRAY, places.cast("variant")), nested.kind(v).isin(ARRAY, OBJECT))


def to_entries(v: Column) -> Stream:
    own = F.transform(nested.members(v), lambda e: F.to_variant_object(F.struct(e["key"].cast("variant").alias("key"), e["value"].alias("value"))))
    return maybe(F.when(nested.kind(v) == OBJECT, own.cast("variant")), nested.kind(v) == OBJECT)


def reversed_(v: Column) -> Stream:
    kind = nested.kind(v)
    return maybe(F.when(kind == ARRAY, F.reverse(nested.elements(v)).cast("variant")).when(kind == STRING, F.reverse(values.as_string(v)).cast("variant")).when(kind == NULL, none().cast("variant")), kind.isin(ARRAY, STRING, NULL))


def from_json(v: Column) -> Stream:
    return maybe(bound(F.try_parse_json(values.as_string(v)), lambda p: p), F.try_parse_json(values.as_string(v)).isNotNull())


def on_list(v: Column, use: Callable[[Column], Column]) -> Stream:
    return maybe(F.when(nested.kind(v) == ARRAY, bound(nested.elements(v), use)), nested.kind(v) == ARRAY)


def keyed(own: Column) -> Column:
    return F.transform(own, lambda e: F.struct(e.alias("v"), nested.order_key(e).alias("k")))


def numeric(use: Callable[[Column], Column]) -> Callable[[Column], Stream]:
    return lambda v: maybe(bound(values.as_number(v), lambda n: use(n).cast("double").cast("variant")), nested.kind(v).isin(*NUMBERS))


def textual(use: Callable[[Column], Column]) -> Callable[[Column], Stream]:
    return lambda v: maybe(bound(values.as_string(v), lambda s: use(s).cast("variant")), nested.kind(v) == STRING)


#: Functions of the input alone, and of the input and one value.
PLAIN: dict[str, Callable[[Column], Stream]] = {
    "keys": keys, "keys_unsorted": keys, "to_entries": to_entries, "from_entries": from_entries, "reverse": reversed_, "fromjson": from_json,
    "tostring": lambda v: string(nested.text_of(v)), "tojson": lambda v: string(nested.json_text(v)), "not": lambda v: boolean(~truthy(v)), "type": lambda v: string(F.coalesce(values.type_of(v), F.lit("null"))),
    "sort": lambda v: on_list(v, lambda own: chosen(keyed(own), "sort")), "unique": lambda v: on_list(v, lambda own: chosen(keyed(own), "unique")),
    "min": lambda v: on_list(v, lambda own: chosen(keyed(own), "min")), "max": lambda v: on_list(v, lambda own: chosen(keyed(own), "max")),
    "floor": numeric(F.floor), "ceil": numeric(F.ceil), "fabs": numeric(F.abs), "abs": numeric(F.abs), "sqrt": numeric(lambda n: F.when(n >= 0, F.sqrt(n)).otherwise(float("nan"))),
    "round": numeric(lambda n: F.floor(F.abs(n) + 0.5) * F.when(n >= 0, 1).otherwise(-1)), "utf8bytelength": textual(F.octet_length),
    "explode": textual(lambda s: F.transform(F.filter(F.split(s, "", -1), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("double").cast("variant"))),
}
BINARY: dict[str, Callable[[Column, Column], Stream]] = {
    "has": has, "in": lambda v, x: has(x, v), "index": index_of, "join": joined, "contains": contains, "inside": lambda v, x: contains(x, v),
    "split": lambda v, x: maybe(F.transform(_split(values.as_string(v), values.as_string(x)), lambda t: t.cast("variant")).cast("variant"), (nested.kind(v) == STRING) & (nested.kind(x) == STRING)),
    "startswith": lambda v, x: maybe(F.startswith(values.as_string(v), values.as_string(x)).cast("variant"), (nested.kind(v) == STRING) & (nested.kind(x) == STRING)),
    "endswith": lambda v, x: maybe(F.endswith(values.as_string(v), values.as_string(x)).cast("variant"), (nested.kind(v) == STRING) & (nested.kind(x) == STRING)),
}
#: Functions of the library that are put in as they are defined.
INLINED = {"map", "values", "nulls", "booleans", "numbers", "strings", "arrays", "objects", "iterables", "scalars", "with_entries"}


@dataclass
class Input:
    """What an expression is applied to: a value, or the whole record, which is only put together if it is needed."""

    variant: Column | None = None
    made: compiler.Node | None = None

    @property
    def col(self) -> Column:
        return F.to_variant_object(F.map_from_entries(compiler.record_entries())) if self.variant is None else self.variant

    @property
    def node(self):
        if self.variant is None:
            return compiler.Root()
        if self.made is None:
            self.made = compiler.from_variant(self.variant)
        return self.made


@dataclass
class Scope:
    """What a call sees: compiles its arguments, for its own input or another."""

    streams: Streams
    input: Input
    env: dict
    fs: dict

    def __call__(self, tree, own: Input | None = None) -> Stream:
        return self.streams.compile(tree, self.input if own is None else own, self.env, self.fs)


class Streams:
    """Compiles trees; ``env`` holds variables, ``fs`` functions as (parameters, body, where they were defined)."""

    def plain(self, t, x: Input, fs) -> Stream | None:
        """By the compiler of single values, where it tells errors apart."""

        def silent(t) -> bool:
            if t[0] in BEYOND or (t[0] == "call" and (t[1] not in SINGLE or (t[1], len(t[2])) in fs)):
                return True
            inner = [p for p in t[1:] if isinstance(p, tuple)] + (t[2] if t[0] == "call" else [])
            return any(silent(p) for p in inner)

        if t[0] == "identity" or silent(t):
            return None
        try:
            node = compiler.Compiler().compile(t, x.node)
        except compiler.Unsupported:
            return None
        return None if isinstance(node, compiler.Root) or node.known == "record" else lifted(node)

    def compile(self, t, x: Input, env: dict, fs: dict) -> Stream:
        found = self.plain(t, x, fs)
        if found is not None:
            return found
        method = getattr(self, "c_" + {"//": "alternative", "and": "logic", "or": "logic", "if": "condition", "try": "attempt", "as": "binding", "def": "definition"}.get(t[0], t[0]), None)
        if method is None:
            raise Unsupported(t[0])
        return method(t, x, env, fs)

    def c_identity(self, t, x, env, fs):
        return value(x.col)

    def c_literal(self, t, x, env, fs):
        return lifted(compiler.Compiler().c_literal(t, None))

    def c_variable(self, t, x, env, fs):
        if t[1] not in env:
            raise Unsupported(t[1])
        return value(env[t[1]])

    def c_comma(self, t, x, env, fs):
        a, b = self.compile(t[1], x, env, fs), self.compile(t[2], x, env, fs)
        if widest(a.shape, b.shape) in ("value", "list"):
            return Stream("list", F.concat(promoted(a, "list"), promoted(b, "list")))
        return bind(a, lambda v, ok: bind(b, lambda w, good: stream(F.when(ok, F.concat(v, w)).otherwise(v), ok & good)))

    def c_pipe(self, t, x, env, fs):
        if t[1] == ("identity",):
            return self.compile(t[2], x, env, fs)
        return then(self.compile(t[1], x, env, fs), lambda v: self.compile(t[2], Input(v), env, fs))

    def c_index(self, t, x, env, fs):
        over, key = self.compile(t[1], x, env, fs), t[2]
        if key[0] in ("array", "object"):
            raise Unsupported("index")
        if key[0] == "literal" and isinstance(key[1], str):
            return then(over, lambda o: at_key(o, F.lit(key[1])))
        if key[0] == "literal" and isinstance(key[1], (int, float)) and not isinstance(key[1], bool):
            return then(over, lambda o: at_place(o, F.lit(float(key[1]))))
        if key[0] == "negative" and key[1][0] == "literal":
            return then(over, lambda o: at_place(o, F.lit(-float(key[1][1]))))
        return then(over, lambda o: then(self.compile(key, x, env, fs), lambda k: at(o, k)))

    def c_slice(self, t, x, env, fs):
        def with_end(o, start):
            return cut(o, start, None) if t[3] is None else then(self.compile(t[3], x, env, fs), lambda end: cut(o, start, end))

        return then(self.compile(t[1], x, env, fs), lambda o: with_end(o, None) if t[2] is None else then(self.compile(t[2], x, env, fs), lambda start: with_end(o, start)))

    def c_each(self, t, x, env, fs):
        return then(self.compile(t[1], x, env, fs), each)

    def c_attempt(self, t, x, env, fs):
        if t[2] is not None:
            raise Unsupported("catch")
        return self.silenced(self.compile(t[1], x, env, fs))

    @staticmethod
    def silenced(s: Stream) -> Stream:
        """Without the error at the end."""
        return s if s.shape in ("value", "list") else Stream("list", bound(promoted(s, "stream"), lambda p: p["v"]))

    def c_alternative(self, t, x, env, fs):
        left, right = self.silenced(self.compile(t[1], x, env, fs)), self.compile(t[2], x, env, fs)
        return bind(left, lambda v, _: bind(Stream("list", F.filter(v, truthy)), lambda good, _: choose(F.size(good) > 0, Stream("list", good), right)))

    def c_condition(self, t, x, env, fs):
        return then(self.compile(t[1], x, env, fs), lambda c: choose(truthy(c), self.compile(t[2], x, env, fs), self.compile(t[3], x, env, fs)))

    def c_logic(self, t, x, env, fs):
        stop = t[0] == "or"
        return then(self.compile(t[1], x, env, fs), lambda a: choose(truthy(a) == F.lit(stop), boolean(F.lit(stop)), then(self.compile(t[2], x, env, fs), lambda b: boolean(truthy(b)))))

    def both(self, first, second, x, env, fs, use) -> Stream:
        """``use`` of the outputs of both, those of the first running faster."""
        return then(self.compile(second, x, env, fs), lambda b: then(self.compile(first, x, env, fs), lambda a: use(a, b)))

    def c_compare(self, t, x, env, fs):
        def use(a, b):
            return bound(F.struct(nested.order_key(a).alias("a"), nested.order_key(b).alias("b")), lambda k: {"==": k["a"] == k["b"], "!=": k["a"] != k["b"], "<": k["a"] < k["b"], "<=": k["a"] <= k["b"], ">": k["a"] > k["b"], ">=": k["a"] >= k["b"]}[t[1]])

        return self.both(t[2], t[3], x, env, fs, lambda a, b: boolean(use(a, b)))

    def c_math(self, t, x, env, fs):
        return self.both(t[2], t[3], x, env, fs, lambda a, b: math(t[1], a, b))

    def c_negative(self, t, x, env, fs):
        return then(self.compile(t[1], x, env, fs), numeric(lambda n: -n))

    def c_array(self, t, x, env, fs):
        if t[1] is None:
            return value(none().cast("variant"))
        s = self.compile(t[1], x, env, fs)
        if s.shape in ("value", "list"):
            return value(promoted(s, "list").cast("variant"))
        return Stream("maybe", bound(promoted(s, "stream"), lambda p: pair(p["v"].cast("variant"), p["ok"])))

    def c_object(self, t, x, env, fs):
        def rest(pairs, made: list) -> Stream:
            if not pairs:
                return value(made_object(F.array(*made)) if made else F.to_variant_object(F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>"))))
            (name, own), *more = pairs

            def named(key: Column, text: Column) -> Stream:
                return then(self.compile(own, x, env, fs), lambda v: rest(more, [*made, F.struct(text.alias("key"), F.coalesce(v, values.null_variant()).alias("value"))]))

            if name[0] == "literal" and isinstance(name[1], str):
                return named(None, F.lit(name[1]))
            return then(self.compile(name, x, env, fs), lambda k: then(maybe(k, nested.kind(k) == STRING), lambda k: named(k, values.as_string(k))))

        return rest(t[1], [])

    def c_text(self, t, x, env, fs):
        def rest(parts, made: list) -> Stream:
            if not parts:
                return string(F.concat(*made) if made else F.lit(""))
            own, *more = parts
            if own[0] == "literal":
                return rest(more, [*made, F.lit(own[1])])
            if own[0] != "format" or own[1] not in ("@text", "@json"):
                raise Unsupported("format")
            as_text = nested.text_of if own[1] == "@text" else nested.json_text
            return then(then(self.compile(own[2], x, env, fs), lambda v: string(as_text(v))), lambda v: rest(more, [*made, values.as_string(v)]))

        return rest(t[1], [])

    def c_format(self, t, x, env, fs):
        if t[1] not in ("@text", "@json"):
            raise Unsupported("format")
        return then(self.compile(t[2], x, env, fs), PLAIN["tostring" if t[1] == "@text" else "tojson"])

    @staticmethod
    def bindings(pattern, v: Column, env: dict, use: Callable[[dict], Stream]) -> Stream:
        if pattern[0] == "$":
            return use(env | {pattern[1]: v})
        if pattern[0] != "[":
            raise Unsupported("pattern")

        def rest(items, env: dict) -> Stream:
            if not items:
                return use(env)
            (i, p), *more = items
            return then(at_place(v, F.lit(float(i))), lambda e: Streams.bindings(p, e, env, lambda env: rest(more, env)))

        return rest(list(enumerate(pattern[1])), env)

    def c_binding(self, t, x, env, fs):
        if len(t[2]) != 1:
            raise Unsupported("alternatives")
        return then(self.compile(t[1], x, env, fs), lambda v: self.bindings(t[2][0], v, env, lambda env: self.compile(t[3], x, env, fs)))

    def c_reduce(self, t, x, env, fs):
        def folded(items: Column, ok: Column, start: Column) -> Stream:
            def step(acc: Column, e: Column) -> Column:
                new = self.bindings(t[2], e, env, lambda env: self.compile(t[4], Input(acc["v"]), env, fs))
                last = promoted(new, "maybe") if new.shape in ("value", "maybe") else bound(promoted(new, "stream"), lambda s: pair(F.get(s["v"], F.size(s["v"]) - 1), s["ok"]))
                return F.when(acc["ok"], last).otherwise(acc)

            return Stream("maybe", F.aggregate(items, pair(start, F.lit(True)), step, lambda acc: pair(acc["v"], acc["ok"] & ok)))

        return then(self.compile(t[3], x, env, fs), lambda start: bind(self.compile(t[1], x, env, fs), lambda items, ok: folded(items, ok, start)))

    def c_foreach(self, t, x, env, fs):
        def folded(items: Column, ok: Column, start: Column) -> Stream:
            def step(acc: Column, e: Column) -> Column:
                new = self.bindings(t[2], e, env, lambda env: self.compile(t[4], Input(acc["v"]), env, fs))
                if new.shape not in ("value", "maybe"):
                    raise Unsupported("several states")

                def taken(m: Column) -> Column:
                    out = self.bindings(t[2], e, env, lambda env: self.compile(t[5], Input(m["v"]), env, fs)) if len(t) > 5 else value(m["v"])
                    return bound(promoted(out, "stream"), lambda o: F.when(m["ok"], F.struct(m["v"].alias("v"), o["ok"].alias("ok"), F.concat(acc["out"], o["v"]).alias("out"))).otherwise(F.struct(acc["v"].alias("v"), F.lit(False).alias("ok"), acc["out"].alias("out"))))

                return F.when(acc["ok"], bound(promoted(new, "maybe"), taken)).otherwise(acc)

            zero = F.struct(start.alias("v"), F.lit(True).alias("ok"), none().alias("out"))
            return Stream("stream", F.aggregate(items, zero, step, lambda acc: pair(acc["out"], acc["ok"] & ok)))

        return then(self.compile(t[3], x, env, fs), lambda start: bind(self.compile(t[1], x, env, fs), lambda items, ok: folded(items, ok, start)))

    def c_definition(self, t, x, env, fs):
        return self.compile(t[4], x, env, fs | {(t[1], len(t[2])): (t[2], t[3], fs, env)})

    def inlined(self, found, arguments, x, env, fs) -> Stream:
        params, body, scope, at = found

        def rest(pairs, inner: dict, own: dict) -> Stream:
            if not pairs:
                return self.compile(body, x, own, inner)
            (q, a), *more = pairs
            closure = lambda name: {(name, 0): ([], a, fs, env)}
            if q[0] != "$":
                return rest(more, inner | closure(q), own)
            return then(self.compile(a, x, env, fs), lambda v: rest(more, inner | closure(q[1:]), own | {q: v}))

        return rest(list(zip(params, arguments, strict=True)), dict(scope), dict(at))

    def c_call(self, t, x, env, fs):
        name, arguments = t[1], t[2]
        n = len(arguments)
        go = Scope(self, x, env, fs)
        if (name, n) in fs:
            return self.inlined(fs[name, n], arguments, x, env, fs)
        if name in INLINED:
            return self.inlined((*interpreter._library()[name, n][:2], {}, {}), arguments, x, env, fs)
        special = getattr(self, f"f_{name}_{n}", None)
        if special:
            return special(arguments, x, go)
        if n == 0 and name in PLAIN:
            return PLAIN[name](x.col)
        if n == 1 and name in BINARY:
            return then(go(arguments[0]), lambda a: BINARY[name](x.col, a))
        if n == 0:  # what the compiler of single values knows, for a record put together
            return then(value(x.col), lambda v: lifted(self.known(t, Input(v))))
        raise Unsupported(name)

    @staticmethod
    def known(t, x: Input) -> compiler.Node:
        return compiler.Compiler().value(t, x.node)

    def f_empty_0(self, a, x, go):
        return Stream("list", none())

    def f_error_0(self, a, x, go):
        return stream(none(), F.lit(False))

    def f_error_1(self, a, x, go):
        return then(go(a[0]), lambda _: stream(none(), F.lit(False)))

    def f_select_1(self, a, x, go):
        return then(go(a[0]), lambda c: Stream("list", F.when(truthy(c), F.array(x.col)).otherwise(none())))

    def f_recurse_0(self, a, x, go):
        return Stream("list", nested.within(x.col))

    def f_first_0(self, a, x, go):
        return at_place(x.col, F.lit(0.0))

    def f_last_0(self, a, x, go):
        return at_place(x.col, F.lit(-1.0))

    def f_first_1(self, a, x, go):
        return bind(go(a[0]), lambda v, ok: stream(F.slice(v, 1, 1), ok | (F.size(v) > 0)))

    def f_last_1(self, a, x, go):
        return bind(go(a[0]), lambda v, ok: maybe(F.get(v, F.size(v) - 1), ok))

    def f_isempty_1(self, a, x, go):
        return bind(go(a[0]), lambda v, ok: maybe((F.size(v) == 0).cast("variant"), ok | (F.size(v) > 0)))

    def f_limit_2(self, a, x, go):
        if a[0][0] != "literal" or not isinstance(a[0][1], (int, float)):
            raise Unsupported("limit")
        n = max(0, -int(-a[0][1] // 1))
        return bind(go(a[1]), lambda v, ok: stream(F.slice(v, 1, n), ok | (F.size(v) >= n))) if n else Stream("list", none())

    def tested(self, s: Stream, good: Callable[[Column], Column], result: bool) -> Stream:
        """``result`` if any output is good, the opposite if none is; an error counts if no good one comes before it."""
        return bind(s, lambda v, ok: bind(boolean(F.exists(v, good)), lambda f, _: then(Stream("list", f), lambda hit: maybe((truthy(hit) == F.lit(result)).cast("variant"), ok | truthy(hit)))))

    def f_any_2(self, a, x, go):
        return self.one(self.tested(then(go(a[0]), lambda v: go(a[1], Input(v))), truthy, True))

    def f_all_2(self, a, x, go):
        return self.one(self.tested(then(go(a[0]), lambda v: go(a[1], Input(v))), lambda v: ~truthy(v), False))

    @staticmethod
    def one(s: Stream) -> Stream:
        """A stream that is known to have one output, or an error."""
        return s if s.shape in ("value", "maybe") else Stream("maybe", bound(promoted(s, "stream"), lambda p: pair(F.get(p["v"], F.lit(0)), p["ok"])))

    def f_any_1(self, a, x, go):
        return self.one(self.tested(then(each(x.col), lambda v: go(a[0], Input(v))), truthy, True))

    def f_all_1(self, a, x, go):
        return self.one(self.tested(then(each(x.col), lambda v: go(a[0], Input(v))), lambda v: ~truthy(v), False))

    def f_any_0(self, a, x, go):
        return self.one(self.tested(each(x.col), truthy, True))

    def f_all_0(self, a, x, go):
        return self.one(self.tested(each(x.col), lambda v: ~truthy(v), False))

    def summed(self, s: Stream) -> Stream:
        zero = pair(values.null_variant(), F.lit(True))
        return bind(s, lambda v, ok: Stream("maybe", F.aggregate(v, zero, lambda acc, e: F.when(acc["ok"], math("+", acc["v"], e).col).otherwise(acc), lambda acc: pair(acc["v"], acc["ok"] & ok))))

    def f_add_0(self, a, x, go):
        return self.summed(each(x.col))

    def f_add_1(self, a, x, go):
        return self.summed(go(a[0]))

    def f_flatten_0(self, a, x, go):
        return self.flattened(x, lambda v: nested.depth(v))

    def f_flatten_1(self, a, x, go):
        if a[0][0] != "literal" or not isinstance(a[0][1], int) or a[0][1] < 0:
            raise Unsupported("flatten")
        return self.flattened(x, lambda v: F.lit(a[0][1]))

    @staticmethod
    def flattened(x: Input, times: Callable[[Column], Column]) -> Stream:
        return then(value(x.col), lambda v: bind(each(v), lambda own, ok: maybe(nested.flattened(own, times(v)).cast("variant"), ok)))

    def ranged(self, a, x, go) -> Stream:
        numbers = []
        for t in a:
            t, sign = (t[1], -1) if t[0] == "negative" else (t, 1)
            if t[0] != "literal" or not isinstance(t[1], (int, float)) or isinstance(t[1], bool):
                raise Unsupported("range")
            numbers.append(sign * t[1])
        start, end, step = (0, numbers[0], 1) if len(a) == 1 else (*numbers, 1)[:3]
        n = max(0, -int(-(end - start) // step)) if step else 0
        if n > LONGEST_RANGE:
            raise Unsupported("range")
        return Stream("list", _numbers(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double") * float(step) + float(start))) if n else none())

    f_range_1 = f_range_2 = f_range_3 = ranged

    def by(self, a, x, go, how: str) -> Stream:
        """Elements with the order key of what an expression gives for each."""
        keys_of = lambda v: self.c_array(("array", a[0]), Input(v), go.env, go.fs)

        def marked(v: Column) -> Stream:
            return then(keys_of(v), lambda k: value(F.to_variant_object(F.struct(F.coalesce(v, values.null_variant()).alias("v"), nested.order_key(k).alias("k")))))

        def pairs(own: Column) -> Column:
            return F.transform(own, lambda m: F.struct(F.try_variant_get(m, "$.v", "variant").alias("v"), F.try_variant_get(m, "$.k", "string").alias("k")))

        source = bound(F.struct(nested.kind(x.col).alias("k"), x.col.alias("v")), lambda s: pair(F.when(s["k"] == ARRAY, nested.elements(s["v"])).otherwise(none()), s["k"] == ARRAY))
        return self.one(bind(then(Stream("stream", source), marked), lambda own, ok: maybe(F.when(ok, chosen(pairs(own), how)), ok)))

    def f_sort_by_1(self, a, x, go):
        return self.by(a, x, go, "sort")

    def f_group_by_1(self, a, x, go):
        return self.by(a, x, go, "group")

    def f_unique_by_1(self, a, x, go):
        return self.by(a, x, go, "unique")

    def f_min_by_1(self, a, x, go):
        return self.by(a, x, go, "min")

    def f_max_by_1(self, a, x, go):
        return self.by(a, x, go, "max")

    def f_map_values_1(self, a, x, go):
        """Each value's first output; a value without one goes."""

        def first(v: Column) -> Stream:
            return bind(go(a[0], Input(v)), lambda w, ok: maybe(F.slice(w, 1, 1).cast("variant"), ok | (F.size(w) > 0)))

        def filled(v: Column, found: Column, ok: Column) -> Stream:
            lists = F.transform(found, nested.elements)
            names = F.map_keys(F.try_variant_get(v, "$", nested.MAP))
            entries = F.filter(F.zip_with(names, lists, lambda k, l: F.struct(k.alias("key"), F.get(l, F.lit(0)).alias("value"))), lambda e: e["value"].isNotNull())  # noqa: E741
            return maybe(F.when(ok & (nested.kind(v) == ARRAY), F.flatten(lists).cast("variant")).when(ok, made_object(entries)), ok)

        return self.one(then(value(x.col), lambda v: bind(then(each(v), first), lambda found, ok: filled(v, found, ok))))


def outputs(tree) -> Column:
    """All outputs of a record, as VARIANTs; an error ends them.  Raises Unsupported."""
    return bound(promoted(Streams().compile(tree, Input(), {}, {}), "stream"), lambda s: s["v"])


def matches(tree) -> Column:
    """Whether the first output is neither null nor false."""
    return F.coalesce(bound(outputs(tree), lambda v: (F.size(v) > 0) & truthy(F.get(v, F.lit(0)))), F.lit(False))
