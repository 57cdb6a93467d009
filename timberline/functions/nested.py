"""Nested VARIANT values without recursion: an order of all values, JSON as the query language writes it, and walks.

Catalyst has no recursion, so a value is opened level by level: it becomes a list
of tokens, of which those still closed are replaced by what is in them, as many
times as the value is deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import bound

LIST, MAP, TOKENS = "array<variant>", "map<string,variant>", "array<struct<s:string,v:variant>>"
#: Types, as ``kind`` names them: the first two letters of a value's schema.
NULL, BOOLEAN, STRING, ARRAY, OBJECT, NUMBERS = "VO", "BO", "ST", "AR", "OB", ("BI", "DO", "FL", "DE")


def kind(v: Column) -> Column:
    """The type; an absent value is null."""
    return F.coalesce(F.substring(F.schema_of_variant(v), 1, 2), F.lit(NULL))


def text_in(v: Column) -> Column:
    """The text of a string, a number or a boolean."""
    return F.try_variant_get(v, "$", "string")


def number_in(v: Column) -> Column:
    """The number that a number is."""
    return F.try_variant_get(v, "$", "double")


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", LIST)


def members(v: Column) -> Column:
    """key and value of each member of an object, in the order of the keys."""
    return F.map_entries(F.try_variant_get(v, "$", MAP))


def depth(v: Column) -> Column:
    """How many levels of brackets a value has."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(v), r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, sign: Column) -> Column:
        now = at["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.split(bare, ""), zero, step, lambda at: at["most"]), F.lit(0))


def repeated(start: Column, times: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` applied so many times."""
    rounds = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, lambda acc, _: step(acc))


def token(text: Column | str, v: Column | None = None) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("s"), (F.lit(None).cast("variant") if v is None else v).alias("v"))


def unfolded(v: Column, leaf: Callable[[Column, Column], Column], as_list: Callable, as_object: Callable) -> Column:
    """A value as one text.  ``as_list`` and ``as_object`` give the tokens of an opened value, those in it closed; ``leaf`` the text of any other, given its kind."""

    def opened(t: Column) -> Column:
        def by_kind(x: Column) -> Column:
            return F.when(x["k"] == ARRAY, as_list(t["s"], elements(t["v"]))).when(x["k"] == OBJECT, as_object(t["s"], members(t["v"]))).otherwise(F.array(token(F.concat(t["s"], leaf(t["v"], x["k"])))))

        return F.when(t["v"].isNull(), F.array(t)).otherwise(bound(F.struct(kind(t["v"]).alias("k")), by_kind))

    def whole(v: Column) -> Column:
        deep = F.when(kind(v).isin(ARRAY, OBJECT), depth(v)).otherwise(0) + 1
        return F.array_join(F.transform(repeated(F.array(token("", v)).cast(TOKENS), deep, lambda tokens: F.flatten(F.transform(tokens, opened)).cast(TOKENS)), lambda t: t["s"]), "")

    from .values import null_variant

    return bound(F.coalesce(v, null_variant()), whole)


def number_key(n: Column) -> Column:
    """Digits in the order of the numbers: sign, exponent and significand, turned round below zero."""
    written = F.format_string("%a", F.abs(n))
    power = F.regexp_extract(written, r"p(-?[0-9]+)$", 1).try_cast("int") + 2000
    digits = F.concat(F.substring(written, 3, 1), F.rpad(F.regexp_extract(written, r"\.([0-9a-f]+)p", 1), 13, "0"))
    size = F.when(F.abs(n) == float("inf"), F.lit("9")).otherwise(F.concat(F.lpad(power.cast("string"), 4, "0"), digits))
    turned = F.translate(size, "0123456789abcdef", "fedcba9876543210")
    return F.when(F.isnan(n), "0").when(n == 0, "2").when(n > 0, F.concat(F.lit("3"), size)).otherwise(F.concat(F.lit("1"), turned))


#: Below every digit: what is over comes before what goes on.
END = "!"


def order_key(v: Column) -> Column:
    """A text whose byte order is the order of values: null, false, true, numbers, strings by code points, arrays by their elements, objects by their key sets and then their values.  Equal values have equal keys."""

    def leaf(v: Column, k: Column) -> Column:
        number = F.concat(F.lit("4"), bound(number_in(v), number_key))
        text = F.concat(F.lit("5"), F.hex(F.encode(text_in(v), "UTF-8")), F.lit(END))
        return F.when(k == NULL, "1").when(k == BOOLEAN, F.when(F.try_variant_get(v, "$", "boolean"), "3").otherwise("2")).when(k == STRING, text).otherwise(number)

    def as_list(prefix: Column, own: Column) -> Column:
        return F.concat(F.array(token(F.concat(prefix, F.lit("6")))), F.transform(own, lambda e: token("", e)), F.array(token(END))).cast(TOKENS)

    def as_object(prefix: Column, own: Column) -> Column:
        names = F.array_join(F.transform(own, lambda e: F.concat(F.lit("5"), F.hex(F.encode(e["key"], "UTF-8")), F.lit(END))), "")
        return F.concat(F.array(token(F.concat(prefix, F.lit("7"), names, F.lit(END)))), F.transform(own, lambda e: token("", e["value"])), F.array(token(END))).cast(TOKENS)

    return unfolded(v, leaf, as_list, as_object)


def number_json(n: Column) -> Column:
    """Integral numbers without a fraction, others shortest; with an exponent below 1e-4 and from 1e17 on."""
    written, size = n.cast("string"), F.abs(n)
    mantissa, power = F.regexp_replace(F.substring_index(written, "E", 1), r"\.0$", ""), F.substring_index(written, "E", -1)
    plain = F.regexp_replace(n.cast("string").try_cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    return (
        F.when(F.isnan(n), "null")
        .when(size == float("inf"), F.when(n > 0, "1.7976931348623157e+308").otherwise("-1.7976931348623157e+308"))
        .when((n == F.floor(n)) & (size < 1e17), F.when(size < 1e17, n.try_cast("bigint")).cast("string"))
        .when(size >= 1e17, F.concat(mantissa, F.lit("e+"), power))
        .when(size < 1e-4, F.concat(mantissa, F.lit("e"), power))
        .when((size >= 1e-3) & (size < 1e7), written)
        .otherwise(plain)
    )


def json_text(v: Column) -> Column:
    """A value as JSON without spaces, members in the order of their keys."""

    def leaf(v: Column, k: Column) -> Column:
        return F.when(k.isin(*NUMBERS), bound(number_in(v), number_json)).when(k == NULL, "null").otherwise(F.to_json(v))

    def comma(i: Column) -> Column:
        return F.when(i > 0, ",").otherwise("")

    def as_list(prefix: Column, own: Column) -> Column:
        return F.concat(F.array(token(F.concat(prefix, F.lit("[")))), F.transform(own, lambda e, i: token(comma(i), e)), F.array(token("]"))).cast(TOKENS)

    def as_object(prefix: Column, own: Column) -> Column:
        name = lambda e, i: F.concat(comma(i), F.to_json(e["key"].cast("variant")), F.lit(":"))
        return F.concat(F.array(token(F.concat(prefix, F.lit("{")))), F.transform(own, lambda e, i: token(name(e, i), e["value"])), F.array(token("}"))).cast(TOKENS)

    return unfolded(v, leaf, as_list, as_object)


def text_of(v: Column) -> Column:
    """Strings as they are, anything else as JSON."""
    return F.when(kind(v) == STRING, text_in(v)).otherwise(json_text(v))


def within(v: Column) -> Column:
    """The value and all values in it, each before those in it."""
    tokens = "array<struct<open:boolean,v:variant>>"

    def opened(t: Column) -> Column:
        inner = F.when(kind(t["v"]) == ARRAY, elements(t["v"])).when(kind(t["v"]) == OBJECT, F.transform(members(t["v"]), lambda e: e["value"])).otherwise(F.array().cast(LIST))
        own = F.struct(F.lit(False).alias("open"), t["v"].alias("v"))
        return F.when(t["open"], F.concat(F.array(own), F.transform(inner, lambda e: F.struct(F.lit(True).alias("open"), e.alias("v"))))).otherwise(F.array(t)).cast(tokens)

    start = F.array(F.struct(F.lit(True).alias("open"), v.alias("v"))).cast(tokens)
    found = repeated(start, depth(v) + 1, lambda all_: F.flatten(F.transform(all_, opened)).cast(tokens))
    return F.transform(found, lambda t: t["v"])


def flattened(items: Column, times: Column) -> Column:
    """Elements of arrays in the place of these, so many levels deep."""
    return repeated(items.cast(LIST), times, lambda own: F.flatten(F.transform(own, lambda e: F.when(kind(e) == ARRAY, elements(e)).otherwise(F.array(e).cast(LIST)))).cast(LIST))
