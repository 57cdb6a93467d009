"""The inferred shape of heterogeneous records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, values
from ..plans.jq.compiler import record_entries, record_json


def infer(records: DataFrame) -> DataFrame:
    """One row: the type that fits all records, with every field of any of them."""
    return records.agg(F.schema_of_variant_agg(F.try_parse_json(record_json())).alias("shape"))


def by_field(records: DataFrame) -> DataFrame:
    """key, kinds and how many records have it, for each attribute."""
    each = records.select(F.explode("attrs").alias("a"))
    return each.groupBy(F.col("a.key").alias("key")).agg(F.array_sort(F.collect_set(values.type_of(F.col("a.value")))).alias("kinds"), F.count("*").alias("records"))


def by_path(records: DataFrame) -> DataFrame:
    """path, kind, records: in how many records each path holds values of each kind; ``[]`` stands for any element of an array.

    A record counts once for a path and kind.  Records give their distinct pairs,
    which are added up; shapes of parts of a log add up to that of the whole.
    """
    tokens = "array<struct<open:boolean,path:string,v:variant>>"

    def closed(path: Column, v: Column) -> Column:
        return F.struct(F.lit(True).alias("open"), path.alias("path"), v.alias("v"))

    def opened(t: Column) -> Column:
        of_list = F.transform(nested.elements(t["v"]), lambda e: closed(F.concat(t["path"], F.lit("[]")), e))
        of_object = F.transform(nested.members(t["v"]), lambda e: closed(F.concat(t["path"], F.lit("."), e["key"]), e["value"]))
        inner = F.when(nested.kind(t["v"]) == nested.ARRAY, of_list).when(nested.kind(t["v"]) == nested.OBJECT, of_object).otherwise(F.array().cast(tokens))
        return F.when(t["open"], F.concat(F.array(t.withField("open", F.lit(False))).cast(tokens), inner.cast(tokens))).otherwise(F.array(t).cast(tokens))

    def whole(entries: Column) -> Column:
        start = F.transform(entries, lambda e: closed(F.concat(F.lit("."), e["key"]), e["value"])).cast(tokens)
        levels = F.coalesce(F.array_max(F.transform(entries, lambda e: nested.depth(e["value"]))), F.lit(0)) + 1
        found = nested.repeated(start, levels, lambda all_: F.flatten(F.transform(all_, opened)).cast(tokens))
        return F.array_distinct(F.transform(found, lambda t: F.struct(t["path"].alias("path"), F.coalesce(values.type_of(t["v"]), F.lit("null")).alias("kind"))))

    each = records.select(F.explode(values.bound(record_entries(), whole)).alias("p"))
    return each.groupBy("p.path", "p.kind").agg(F.count("*").alias("records"))


def fields(shape: str) -> dict:
    """Nested dicts of the field names in a shape's text, for completion."""
    at = 0

    def kind():
        nonlocal at
        start = at
        while at < len(shape) and shape[at] not in "<>,":
            at += 1
        name = shape[start:at].strip().upper()
        if at < len(shape) and shape[at] == "<":
            at += 1
            out = members() if name in ("OBJECT", "STRUCT") else kind()
            while at < len(shape) and shape[at] != ">":
                at += 1
            at += 1
            return out if isinstance(out, dict) else {}
        if name.startswith("DECIMAL("):
            while at < len(shape) and ")" not in shape[start:at]:
                at += 1
        return {}

    def members() -> dict:
        nonlocal at
        out: dict = {}
        while at < len(shape) and shape[at] != ">":
            start = at
            if shape[at] == "`":
                at = shape.index("`", at + 1) + 1
            while shape[at] != ":":
                at += 1
            name = shape[start:at].strip().strip("`")
            at += 1
            out[name] = kind()
            if at < len(shape) and shape[at] == ",":
                at += 1
                while at < len(shape) and shape[at] == " ":
                    at += 1
        return out

    found = kind()
    return found if isinstance(found, dict) else {}
