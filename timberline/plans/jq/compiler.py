"""jq predicates as Columns.

A tree whose nodes have one output each becomes a plain Column that Catalyst can
fold, prune and generate code for.  Trees with several outputs, variables and
functions become Columns by ``streams``.  The rest (paths, updates, formats,
matches, recursion) runs in the interpreter over Arrow batches.

A compiled node knows, as Columns: ``ok`` (false: no output, by ``empty`` or an
error), its type and its value for each type.  Nothing is left to SQL's own
conversions or to its three-valued logic.  Arrays and objects compare by an order
key (``functions.nested``).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import attrs as A
from ...functions import nested, times, values
from . import interpreter
from .parser import JqError, parse

CORE = ("time", "level", "msg")
#: Column that holds a record as JSON for the interpreter.
JSON = "__record_json"
RANKS = ("null", "boolean", "number", "string", "array", "object")


class Unsupported(Exception):
    """A tree that is left to the interpreter."""


def core_values() -> dict[str, Column]:
    return {"time": times.rfc3339_text(F.col("time"), F.col("time_nanos"), F.col("time_offset_s")), "level": F.col("level"), "msg": F.col("msg")}


def record_entries() -> Column:
    """The record as entries: time, level and msg, then the attributes, which come before a core field of the same name."""
    core = F.filter(F.array(*(A.attr(k, v) for k, v in core_values().items())), lambda c: ~F.exists(F.col("attrs"), lambda a: a["key"] == c["key"]))
    return F.concat(core, F.col("attrs"))


def record_json() -> Column:
    return F.to_json(F.map_from_entries(record_entries()))


@dataclass
class Node:
    ok: Column
    kind: Column
    b: Column
    n: Column
    s: Column
    v: Column | None = None  # arrays and objects
    known: str | None = None  # the type, where it is known beforehand

    @property
    def truthy(self) -> Column:
        if self.known == "boolean":
            return self.b
        return ~((self.kind == "null") | ((self.kind == "boolean") & ~F.coalesce(self.b, F.lit(False))))

    @property
    def key(self) -> Column:
        """The place of arrays and objects in their order, else NULL."""
        return F.when(self.kind.isin("array", "object"), nested.order_key(self.v)) if self.v is not None else F.lit(None).cast("string")

    def rank(self) -> Column:
        """In jq's order of types and values."""
        place = F.array_position(F.array(*map(F.lit, RANKS)), self.kind)
        number = F.when(self.kind == "boolean", self.b.cast("double")).otherwise(self.n)
        return F.struct(place.alias("r"), F.coalesce(number, F.lit(0.0)).alias("n"), F.coalesce(self.s, F.lit("")).alias("s"), F.coalesce(self.key, F.lit("")).alias("k"))


_NO = {"b": "boolean", "n": "double", "s": "string"}


def made(kind: str, value: Column | None = None, ok: Column | None = None) -> Node:
    """A node of one known type."""
    empty = {k: F.lit(None).cast(t) for k, t in _NO.items()}
    field = {"boolean": "b", "number": "n", "string": "s"}.get(kind)
    return Node(F.lit(True) if ok is None else ok, F.lit(kind), **(empty | ({field: value} if field else {})), known=kind)


def from_variant(value: Column, ok: Column | None = None) -> Node:
    """A value; an absent one is null."""
    return Node(F.lit(True) if ok is None else ok, F.coalesce(values.type_of(value), F.lit("null")), values.as_boolean(value), values.as_number(value), values.as_string(value), value)


def when(condition: Column, yes: Node, no: Node) -> Node:
    pick = lambda a, b: F.when(condition, a).otherwise(b)
    if yes.known and yes.known == no.known:
        return Node(pick(yes.ok, no.ok), yes.kind, pick(yes.b, no.b), pick(yes.n, no.n), pick(yes.s, no.s), None, yes.known)
    none = F.lit(None).cast("variant")
    v = None if yes.v is None and no.v is None else pick(none if yes.v is None else yes.v, none if no.v is None else no.v)
    return Node(pick(yes.ok, no.ok), pick(yes.kind, no.kind), pick(yes.b, no.b), pick(yes.n, no.n), pick(yes.s, no.s), v)


def whole(n: Column) -> Column:
    """The integer part of a number, within 64 bits."""
    return F.when(n >= 2.0**63, 2**63 - 1).when(n <= -(2.0**63), -(2**63)).otherwise(n.try_cast("bigint"))


def remainder(a: Column, b: Column) -> Column:
    """Of integer parts, with the sign of the first; not a number if one of them is not."""
    return F.when(F.isnan(a) | F.isnan(b), float("nan")).otherwise(F.try_mod(whole(a), whole(b)).cast("double"))


class Root:
    """The whole record, before a field of it is taken."""


def java_pattern(pattern: str) -> str:
    """The pattern, if it means the same here and there; else the interpreter has to run it."""
    if re.search(r"\\[^\\wWdDsSbB.\[\]{}()*+?|^$/-]|\(\?|\[\[|&&|\[:", pattern):
        raise Unsupported("pattern")
    try:
        re.compile(pattern)
    except re.error as e:
        raise Unsupported("pattern") from e
    return pattern


class Compiler:
    def compile(self, t, x) -> Node | Root:
        method = getattr(self, "c_" + {"//": "alternative", "and": "logic", "or": "logic", "if": "condition", "try": "attempt"}.get(t[0], t[0]), None)
        if method is None:
            raise Unsupported(t[0])
        return method(t, x)

    def value(self, t, x) -> Node:
        node = self.compile(t, x)
        if isinstance(node, Root):
            raise Unsupported("whole record")
        return node

    def c_identity(self, t, x):
        return x

    def c_literal(self, t, x):
        v = t[1]
        if v is None:
            return made("null")
        if isinstance(v, bool):
            return made("boolean", F.lit(v))
        if isinstance(v, str):
            return made("string", F.lit(v))
        return made("number", F.lit(float(v)))

    def c_pipe(self, t, x):
        left = self.compile(t[1], x)
        if isinstance(left, Node) and left.known == "record":  # the record that a select has let through
            right = self.compile(t[2], Root())
            return left if isinstance(right, Root) else self.after(left, right)
        right = self.compile(t[2], left)
        return right if isinstance(left, Root) or isinstance(right, Root) else self.after(left, right)

    @staticmethod
    def after(first: Node, then: Node) -> Node:
        return Node(first.ok & then.ok, then.kind, then.b, then.n, then.s, then.v, then.known)

    def c_index(self, t, x):
        over, key = self.compile(t[1], x), t[2]
        if key[0] == "negative" and key[1][0] == "literal":
            raise Unsupported("index")
        if key[0] != "literal":
            raise Unsupported("index")
        if isinstance(over, Root):
            if not isinstance(key[1], str):
                raise Unsupported("index")
            own = A.get(F.col("attrs"), key[1])
            if key[1] not in CORE:
                return from_variant(own)
            return when(A.has(F.col("attrs"), key[1]), from_variant(own), made("string", core_values()[key[1]]))
        if isinstance(key[1], str):
            if "'" in key[1] or "\\" in key[1]:
                raise Unsupported("key")
            kind, path = "object", f"$['{key[1]}']"
        elif isinstance(key[1], int) and not isinstance(key[1], bool):
            kind, path = "array", f"$[{key[1]}]"
        else:
            raise Unsupported("index")
        inner = F.when(over.kind == kind, F.try_variant_get(over.v, path, "variant")) if over.v is not None else F.lit(None).cast("variant")
        return from_variant(inner, over.ok & over.kind.isin(kind, "null"))

    def c_compare(self, t, x):
        a, b = self.value(t[2], x), self.value(t[3], x)
        field = {"string": "s", "number": "n", "boolean": "b"}
        op = t[1]
        if a.known == b.known and a.known in field:
            left, right = getattr(a, field[a.known]), getattr(b, field[b.known])
        elif op in ("==", "!=") and (b.known or a.known) in field:  # one type is known: the other has to be it
            known, other = (b, a) if b.known in field else (a, b)
            same = (other.kind == known.known) & (getattr(other, field[known.known]) == getattr(known, field[known.known]))
            same = F.coalesce(same, F.lit(False))
            return made("boolean", same if op == "==" else ~same, a.ok & b.ok)
        else:
            left, right = a.rank(), b.rank()
        result = {"==": lambda: left == right, "!=": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right}[op]()
        return made("boolean", result, a.ok & b.ok)

    def c_logic(self, t, x):
        a, b = self.value(t[1], x), self.value(t[2], x)
        stop = a.truthy if t[0] == "or" else ~a.truthy
        return made("boolean", F.when(stop, F.lit(t[0] == "or")).otherwise(b.truthy), a.ok & (stop | b.ok))

    def c_math(self, t, x):
        op, a, b = t[1], self.value(t[2], x), self.value(t[3], x)
        numbers = (a.kind == "number") & (b.kind == "number")
        texts = (a.kind == "string") & (b.kind == "string")
        if op == "%":
            good = numbers & (whole(b.n) != 0)
            return made("number", F.when(good, remainder(a.n, b.n)), a.ok & b.ok & F.coalesce(good, F.lit(False)))
        if (op == "+" and (a.v is not None or b.v is not None) and not (a.known or b.known)):
            raise Unsupported("math")
        if op == "+":
            if "null" in (a.known, b.known):
                raise Unsupported("math")
            missing = (a.kind == "null") | (b.kind == "null")
            other = when(a.kind == "null", b, a)
            sum_ = when(numbers, made("number", a.n + b.n), made("string", F.concat(a.s, b.s)))
            out = when(missing, other, sum_)
            return Node(a.ok & b.ok & (missing | numbers | texts), out.kind, out.b, out.n, out.s, out.v)
        if op == "/" and (a.known == "string" or b.known == "string"):
            raise Unsupported("math")
        if op in ("*", "-", "/") and not (a.known == "number" or b.known == "number"):
            raise Unsupported("math")
        if op == "*" and not (a.known == b.known == "number"):
            # a string times a number repeats it
            if a.known != "number" and b.known != "number":
                raise Unsupported("math")
            repeated = (a.kind == "string") | (b.kind == "string")
            text = F.coalesce(a.s, b.s)
            times_ = F.coalesce(a.n, b.n)
            out = when(repeated, when(times_ > 0, made("string", F.repeat(text, F.greatest(F.lit(1), F.ceil(times_)).cast("int"))), made("null")), made("number", a.n * b.n))
            return Node(a.ok & b.ok & (repeated | numbers), out.kind, out.b, out.n, out.s)
        result = {"-": a.n - b.n, "*": a.n * b.n, "/": F.when(b.n != 0, a.n / b.n)}[op]
        return made("number", result, a.ok & b.ok & numbers & F.coalesce(result.isNotNull(), F.lit(False)))

    def c_negative(self, t, x):
        a = self.value(t[1], x)
        return made("number", -a.n, a.ok & (a.kind == "number"))

    def c_alternative(self, t, x):
        a, b = self.value(t[1], x), self.value(t[2], x)
        return when(F.coalesce(a.ok & a.truthy, F.lit(False)), Node(F.lit(True), a.kind, a.b, a.n, a.s, a.v, a.known), b)

    def c_condition(self, t, x):
        c, yes, no = self.value(t[1], x), self.value(t[2], x), self.value(t[3], x)
        return self.after(Node(c.ok, c.kind, c.b, c.n, c.s), when(c.truthy, yes, no))

    def c_attempt(self, t, x):
        if t[2] is not None:
            raise Unsupported("catch")
        return self.compile(t[1], x)  # an error is no output already

    def c_call(self, t, x):
        name, arguments = t[1], t[2]
        if name == "select" and len(arguments) == 1:
            c = self.value(arguments[0], x)
            if isinstance(x, Root):
                return Node(c.ok & c.truthy, F.lit("object"), F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("string"), None, "record")
            return Node(x.ok & c.ok & c.truthy, x.kind, x.b, x.n, x.s, x.v, x.known)
        if name == "empty" and not arguments:
            return made("null", ok=F.lit(False))
        if isinstance(x, Root):
            if name == "has" and len(arguments) == 1 and arguments[0][0] == "literal" and isinstance(arguments[0][1], str):
                key = arguments[0][1]
                return made("boolean", F.lit(True) if key in CORE else A.has(F.col("attrs"), key))
            raise Unsupported("whole record")
        if x.known == "record":
            raise Unsupported("whole record")
        string, number = x.ok & (x.kind == "string"), x.ok & (x.kind == "number")
        if not arguments:
            simple = {
                "ascii_downcase": lambda: made("string", F.translate(x.s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), string),
                "ascii_upcase": lambda: made("string", F.translate(x.s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), string),
                "floor": lambda: made("number", F.floor(x.n).cast("double"), number),
                "ceil": lambda: made("number", F.ceil(x.n).cast("double"), number),
                "sqrt": lambda: made("number", F.sqrt(x.n), number),
                "fabs": lambda: made("number", F.abs(x.n), number),
                "abs": lambda: made("number", F.abs(x.n), number),
                "type": lambda: made("string", x.kind, x.ok),
                "not": lambda: made("boolean", ~x.truthy, x.ok),
                "tonumber": lambda: made("number", F.coalesce(x.n, F.when(x.s.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(x.s).try_cast("double"))), x.ok & F.coalesce(x.n, F.when(x.s.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.lit(0.0))).isNotNull()),
                "length": lambda: made(
                    "number",
                    F.when(x.kind == "null", 0).when(x.kind == "string", F.length(x.s)).when(x.kind == "number", F.abs(x.n))
                    .when(x.kind == "array", F.size(F.try_variant_get(x.v, "$", "array<variant>"))).otherwise(F.size(F.try_variant_get(x.v, "$", "map<string,variant>"))).cast("double")
                    if x.v is not None
                    else F.when(x.kind == "null", 0).when(x.kind == "string", F.length(x.s)).otherwise(F.abs(x.n)).cast("double"),
                    x.ok & (x.kind != "boolean"),
                ),
            }
            if name in simple:
                return simple[name]()
        if len(arguments) == 1:
            a = self.value(arguments[0], x)
            both = a.ok & string & (a.kind == "string")
            if name in ("startswith", "endswith"):
                return made("boolean", getattr(F, name)(x.s, a.s), both)
            if name in ("contains", "inside") and a.known == "string":
                return made("boolean", F.contains(x.s, a.s) if name == "contains" else F.contains(a.s, x.s), both)
            if name in ("ltrimstr", "rtrimstr") and a.known == "string":
                cut = F.startswith(x.s, a.s) if name == "ltrimstr" else F.endswith(x.s, a.s) & (a.s != "")
                n = F.length(x.s) - F.length(a.s)
                rest = F.right(x.s, n) if name == "ltrimstr" else F.left(x.s, n)
                return when(F.coalesce((x.kind == "string") & cut, F.lit(False)), made("string", rest, x.ok), x)
            if name == "has" and a.known == "string" and arguments[0][0] == "literal" and "'" not in arguments[0][1] and x.v is not None:
                keys = F.map_keys(F.try_variant_get(x.v, "$", "map<string,variant>"))
                return made("boolean", F.array_contains(keys, arguments[0][1]), x.ok & (x.kind == "object"))
        if name == "test" and arguments and all(a[0] == "literal" and isinstance(a[1], str) for a in arguments):
            mods = arguments[1][1] if len(arguments) == 2 else ""
            if len(arguments) > 2 or set(mods) - set("is"):
                raise Unsupported("test")
            pattern = java_pattern(arguments[0][1])
            return made("boolean", x.s.rlike(f"(?{mods}){pattern}" if mods else pattern), string)
        raise Unsupported(name)


def plan(expression: str) -> tuple[object, Column | None]:
    """The tree, and its predicate if it can be compiled.  Raises JqError."""
    tree = parse(expression)
    interpreter.check(tree)
    try:
        node = Compiler().compile(tree, Root())
    except Unsupported:
        return tree, _streamed("matches", tree)
    if isinstance(node, Root):
        return tree, F.lit(True)
    return tree, F.coalesce(node.ok & (F.lit(True) if node.known == "record" else node.truthy), F.lit(False))


def _streamed(what: str, tree) -> Column | None:
    from . import streams

    try:
        return getattr(streams, what)(tree)
    except Unsupported:
        return None


def _function(kind: str, run):
    """An Arrow function over the record's JSON; not to be moved into a place where Python cannot run."""
    return F.arrow_udf(lambda records: pa.array([run(json.loads(r, parse_int=float)) for r in records.to_pylist()], pa.bool_() if kind == "boolean" else pa.list_(pa.string())), kind).asNondeterministic()


def _matches(tree):
    def run(record):
        found, v = interpreter.first(tree, record)
        return found and interpreter.truthy(v)

    return run


def _outputs(tree):
    def run(record):
        out = []
        try:
            out.extend(interpreter.dump(v) for v in interpreter.Interpreter(tree)(record))
        except (interpreter.Failure, interpreter.Break, RecursionError, TypeError, ValueError):
            pass
        return out

    return run


def predicate(expression: str) -> Column:
    """Whether a record matches, as a Column: its first output decides; null and false do not match, errors and no output neither.

    Raises JqError for an expression that needs the interpreter; ``where`` and ``with_matches`` run those as well.
    """
    _, column = plan(expression)
    if column is None:
        raise JqError(f"{expression!r} needs the interpreter")
    return column


def with_matches(records: DataFrame, expressions: dict[str, str], native: bool | None = None) -> DataFrame:
    """Adds a boolean for each named expression.

    ``native``: None takes the compiled form where there is one; True insists on it, False on the interpreter.
    """
    plans = {name: plan(e) for name, e in expressions.items()}
    if native and (left := [expressions[n] for n, (_, column) in plans.items() if column is None]):
        raise JqError(f"{left[0]!r} needs the interpreter")
    compiled = {n: c for n, (_, c) in plans.items() if c is not None and native is not False}
    out = records.select("*", *(c.alias(n) for n, c in compiled.items()))
    if len(compiled) < len(plans):
        out = _with_json(out)
        for n, (tree, _) in plans.items():
            if n not in compiled:
                out = out.withColumn(n, _function("boolean", _matches(tree))(F.col(JSON)))
    return out.select(*records.columns, *plans)


def where(records: DataFrame, expression: str, native: bool | None = None) -> DataFrame:
    """The records that match; all of them for an empty expression.  ``native`` as for ``with_matches``."""
    if not expression.strip():
        return records
    tree, column = plan(expression)
    if column is not None and native is not False:
        return records.where(column)
    if native:
        raise JqError(f"{expression!r} needs the interpreter")
    return _with_json(records).where(_function("boolean", _matches(tree))(F.col(JSON))).drop(JSON)


def _with_json(records: DataFrame) -> DataFrame:
    """Adds the record's JSON as a column made once, so that Python functions get a plain column."""
    return records.select("*", F.explode(F.array(record_json())).alias(JSON))


def with_outputs(records: DataFrame, expression: str, name: str = "outputs", native: bool | None = None) -> DataFrame:
    """Adds all outputs of an expression, as an array of JSON texts; an error ends them.  ``native`` as for ``with_matches``."""
    tree = parse(expression)
    interpreter.check(tree)
    column = None if native is False else _streamed("outputs", tree)
    if column is not None:
        return records.withColumn(name, F.transform(column, nested.json_text))
    if native:
        raise JqError(f"{expression!r} needs the interpreter")
    return _with_json(records).withColumn(name, _function("array<string>", _outputs(tree))(F.col(JSON))).drop(JSON)
