"""One record in detail: its fields as rows, or its line as written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attrs, nested, times, values

STAMP = "yyyy-MM-dd HH:mm:ss.SSS"


def fields(records: DataFrame) -> DataFrame:
    """file, line_no, i, key, value: the core fields and attributes of each record, in order."""
    minutes = F.abs("time_offset_s") / 60
    sign = F.when(F.col("time_offset_s") < 0, "-").otherwise("+")
    zone = F.when(F.col("time_offset_s") == 0, "UTC").otherwise(F.concat(sign, F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("int").cast("string"), 2, "0")))
    time = F.when(F.col("time").isNotNull(), F.concat_ws(" ", times.shown(F.col("time"), F.col("time_offset_s"), STAMP), zone))
    core = attrs.listed(("time", time), ("level", F.col("level")), ("msg", F.col("msg")))
    return records.select("file", "line_no", F.posexplode(F.concat(core, F.col("attrs"))).alias("i", "a")).select("file", "line_no", "i", F.col("a.key").alias("key"), values.detail_text(F.col("a.value")).alias("value"))


def of_line(records: DataFrame, line_no: int, file: str | None = None) -> DataFrame:
    """The fields of one record."""
    found = records.where(F.col("line_no") == line_no)
    return fields(found if file is None else found.where(F.col("file") == file))


def raw_text(line: str) -> str:
    """A JSON line with sorted keys and indents; any other line as it is."""
    try:
        parsed = json.loads(line)
    except ValueError:
        return line
    return json.dumps(parsed, indent=2, sort_keys=True, ensure_ascii=False) if isinstance(parsed, dict) else line


def raw_view(line: Column) -> Column:
    """``raw_text`` as a Column, for all records: numbers as 64-bit floats, and ``<``, ``>`` and ``&`` in texts by their codes."""
    tokens = F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|\[\]|\{\}|[\[{\]},:]|[^\[{\]},:"]+')

    def step(at: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth = at["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        fresh = F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))
        piece = F.when(opens | (token == ","), F.concat(token, fresh)).when(closes, F.concat(fresh, token)).when(token == ":", ": ").otherwise(token)
        return F.struct(F.concat(at["text"], piece).alias("text"), depth.alias("depth"))

    def pretty(text: Column) -> Column:
        for sign, code in (("&", "0026"), ("<", "003c"), (">", "003e")):
            text = F.replace(text, F.lit(sign), F.lit("\\u" + code))
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("depth"))
        return F.aggregate(F.regexp_extract_all(text, tokens, F.lit(0)), start, step, lambda at: at["text"])

    value = F.try_parse_json(line)
    is_object = line.rlike(r"^\s*\{") & value.isNotNull()
    return F.when(is_object, values.bound(nested.json_text(value), pretty)).otherwise(line)
