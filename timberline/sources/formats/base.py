"""What a format is: a name and a function from a line to a record, as Columns."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, times
from ...functions.values import bound

__all__ = ["RECORD", "DocumentFormat", "Format", "bound", "groups", "plain_record", "record", "staged"]

RECORD = f"struct<time:timestamp,time_nanos:int,time_offset_s:int,level:string,msg:string,attrs:{attrs.ATTRS},raw:string>"


class Format(Protocol):
    name: str

    def parse(self, line: Column) -> Column:
        """The record of a line; NULL if it is none."""


class DocumentFormat(Format, Protocol):
    """Reads whole documents, and is never detected from lines."""

    is_document: bool


def staged(made: Column, *steps) -> Column:
    """``made``, taken through steps, each of which reads what the one before worked out."""
    return bound(made, lambda x: staged(steps[0](x), *steps[1:])) if steps else made


def plain_record(time: Column, level: Column, msg: Column, attributes: Column, raw: Column) -> Column:
    """``record`` of a time that is a column already."""
    return F.struct(
        time["time"].alias("time"),
        time["nanos"].alias("time_nanos"),
        time["offset"].alias("time_offset_s"),
        F.coalesce(level, F.lit("")).alias("level"),
        F.coalesce(msg, F.lit("")).alias("msg"),
        attributes.alias("attrs"),
        raw.alias("raw"),
    )


def record(time: Column, level: Column, msg: Column, attributes: Column, raw: Column) -> Column:
    """``time``: a struct of functions.times, worked out once; missing level and message are empty."""

    return bound(time, lambda t: plain_record(t, level, msg, attributes, raw))


def groups(line: Column, pattern: str, names: tuple[str, ...], use) -> Column:
    """``use`` of a struct of a pattern's groups, NULL where it does not match; one search a line.

    The pattern takes the whole line, and the groups are written side by side
    with a sign between them that the line itself does not hold.
    """
    sign = "\x01"
    joined = F.split(F.regexp_replace(line, pattern, sign.join(f"${i}" for i in range(1, len(names) + 1))), sign, -1)
    slow = F.when(line.rlike(pattern), F.array(*(F.regexp_extract(line, pattern, i) for i in range(1, len(names) + 1))))
    found = F.when(line.contains(sign), slow).otherwise(joined)

    def named(x: Column) -> Column:
        return F.when(F.size(x) == len(names), bound(F.struct(*(F.get(x, F.lit(i)).alias(n) for i, n in enumerate(names))), use))

    return bound(found, named)
