"""Dynamically typed values as VARIANT: their types, numbers, and the texts they are shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number as ParseFloat-like readers take it; Spark's own cast takes more ("5d", " 5 ").
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEX_NUMBER = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+$"
SIGNED_INFINITY = r"^[+-](?i:inf|infinity)$"

STRING, BOOLEAN, NUMERIC, ARRAY, OBJECT = "string", "boolean", "number", "array", "object"
#: The types by the first two letters of a value's schema.
_TAGS = {"VO": "null", "ST": STRING, "BO": BOOLEAN, "AR": ARRAY, "OB": OBJECT, "BI": NUMERIC, "DO": NUMERIC, "DE": NUMERIC, "FL": NUMERIC}


def bound(value: Column, use) -> Column:
    """``use(value)`` with value worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag(value: Column) -> Column:
    return F.substring(F.schema_of_variant(value), 1, 2)


def variant(column: Column) -> Column:
    return column.cast("variant")


def null_variant() -> Column:
    """A present null, which is not an absent value."""
    return F.parse_json(F.lit("null"))


def type_of(value: Column) -> Column:
    """null, boolean, number, string, array or object; SQL NULL for an absent value."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _TAGS.items() for x in pair)), tag(value))


def as_string(value: Column) -> Column:
    """The string in it, else NULL; nothing is converted."""
    return F.when(tag(value) == "ST", F.try_variant_get(value, "$", "string"))


def as_number(value: Column) -> Column:
    """The number in it as a double, else NULL; strings and booleans are no numbers."""
    return F.when(tag(value).isin("BI", "DO", "FL", "DE"), F.try_variant_get(value, "$", "double"))


def as_boolean(value: Column) -> Column:
    return F.when(tag(value) == "BO", F.try_variant_get(value, "$", "boolean"))


def doubled(value: Column) -> Column:
    """Numbers as doubles, anything else as it is: all numbers of a record are 64-bit floats."""
    return F.when(tag(value).isin("BI", "DO", "FL", "DE"), variant(F.try_variant_get(value, "$", "double"))).otherwise(value)


def inferred(text: Column) -> Column:
    """A typed value from text: true and false exactly, numbers, else the text.  A number beyond the range of doubles stays text."""
    finite = (text.rlike(NUMBER) | text.rlike(HEX_NUMBER)) & (F.abs(text.try_cast("double")) < float("inf"))
    number = F.when(F.substring(text, 1, 1).between("+", "9"), F.when(finite | text.rlike(SIGNED_INFINITY), text.try_cast("double")))
    return (
        F.when(text == "true", variant(F.lit(True)))
        .when(text == "false", variant(F.lit(False)))
        .otherwise(F.coalesce(variant(number), variant(text)))
    )


def parsed_float(text: Column) -> Column:
    """The number that a text holds in decimal or hexadecimal form, or as a name; NULL if it is none or beyond the range of doubles."""
    named = F.lower(text).rlike(r"^[+-]?(inf|infinity)$|^nan$")
    value = F.when(text.rlike(NUMBER) | text.rlike(HEX_NUMBER), text.try_cast("double"))
    return F.when(named, text.try_cast("double")).when(F.abs(value) < float("inf"), value)


def general_text(number: Column) -> Column:
    """A double in shortest ``%g`` form: with an exponent (of at least two digits) from 1e6 on and below 1e-4."""
    written, size = number.cast("string"), F.abs(number)
    sign = F.when(number < 0, "-").otherwise("")
    mantissa = F.regexp_extract(written, r"^-?([0-9.]+)", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "(?<=.)0+$", "")
    power = F.coalesce(F.regexp_extract(written, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(6))
    rest = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise("")
    exponent = F.concat(sign, F.substring(digits, 1, 1), rest, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.when(F.abs(power) >= 100, 3).otherwise(2), F.lit("0")))
    return (
        F.when(F.isnan(number), "NaN")
        .when(number == float("inf"), "+Inf")
        .when(number == float("-inf"), "-Inf")
        .when(number == 0, "0")
        .when((size >= 1e6) | (size < 1e-4), exponent)
        .when(size < 1e-3, F.concat(sign, F.lit("0.000"), digits))
        .otherwise(F.regexp_replace(written, r"\.0$", ""))
    )


def whole_text(number: Column) -> Column:
    """A double with all digits and no fraction if it is integral, else as ``general_text``."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 9.2e18), number.cast("bigint").cast("string")).otherwise(general_text(number))


def display_text(value: Column, full: bool = False) -> Column:
    """A value in a list of attributes: strings as they are, numbers in ``%g`` form, ``<nil>``, nested values as ``map[k:v]`` or ``[a b]`` one level deep and JSON below.

    ``full``: whole numbers with all their digits, so that an id of a million is not 1e+06.
    """

    def plain(x: Column) -> Column:
        text, number = F.try_variant_get(x["v"], "$", "string"), F.try_variant_get(x["v"], "$", "double")
        as_is = ("ST", "BI") if full else ("ST",)
        return F.when(x["t"].isin(*as_is), text).when(x["t"].isin("BI", "DO", "FL", "DE"), bound(number, whole_text if full else general_text)).when(x["t"] == "BO", text).when(x["t"] == "VO", "<nil>").otherwise(F.to_json(x["v"]))

    def typed(v: Column) -> Column:
        return F.struct(v.alias("v"), tag(v).alias("t"))

    def whole(x: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>"))  # in key order
        as_map = F.concat(F.lit("map["), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), bound(typed(e["value"]), plain))), " "), F.lit("]"))
        as_list = F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v: bound(typed(v), plain)), " "), F.lit("]"))
        return F.when(x["t"] == "OB", as_map).when(x["t"] == "AR", as_list).otherwise(plain(x))

    return bound(typed(value), whole)


def detail_text(value: Column) -> Column:
    """A value in the detail view: integral numbers without a fraction, ``null``, nested values as JSON."""

    def use(x: Column) -> Column:
        text = F.try_variant_get(x["v"], "$", "string")
        number = F.try_variant_get(x["v"], "$", "double")
        return F.when(x["t"].isin("ST", "BO"), text).when(x["t"].isin("BI", "DO", "FL", "DE"), bound(number, whole_text)).when(x["t"] == "VO", "null").otherwise(F.to_json(x["v"]))

    return bound(F.struct(value.alias("v"), tag(value).alias("t")), use)
