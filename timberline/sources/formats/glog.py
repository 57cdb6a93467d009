"""glog and klog lines: ``I0115 10:30:00.123456   123 file.go:42] message``, with klog's quoted message and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, times
from .base import bound, groups, record
from .logfmt import pairs, typed

LINE = r"(?s)^([IWEF])(\d{4}|\d{8}) ([^ ]{8,}) +(\d+) ([^:]*):(\d*)\] ?(.*)$"
PARTS = ("level", "date", "clock", "thread", "file", "line", "msg")
LEVELS = (("I", "INFO"), ("W", "WARNING"), ("E", "ERROR"), ("F", "FATAL"))
QUOTED = r'(?s)^"((?:[^"\\]|\\.)*)"(.*)$'


class GlogFormat:
    name = "glog"
    is_document = False

    def __init__(self, default_year: int | None = None) -> None:
        """``default_year``: of lines with month and day alone; this year if it is None."""
        self.default_year = default_year

    def parse(self, line: Column) -> Column:
        return groups(line, LINE, PARTS, lambda p: self.whole(p, line))

    def time(self, p: Column) -> Column:
        year = F.year(F.current_date()) if self.default_year is None else F.lit(self.default_year)
        long = F.length(p["date"]) == 8
        year = F.when(long, F.substring(p["date"], 1, 4).try_cast("int")).otherwise(year)
        month, day = (F.substring(F.when(long, F.substring(p["date"], 5, 4)).otherwise(p["date"]), i, 2).try_cast("int") for i in (1, 3))
        hour, minute, second = (F.substring(p["clock"], i, 2).cast("int") for i in (1, 4, 7))
        micros = F.rpad(F.substring(p["clock"], 10, 6), 6, "0").cast("int")
        whole = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(16,6)"))
        made = bound(micros, lambda m: times.parts(F.timestamp_micros(F.unix_micros(whole) + m), m * 1000, F.lit(0)))
        return F.when(p["clock"].rlike(r"^\d\d:\d\d:\d\d(\.\d*)?$"), made)

    def whole(self, p: Column, line: Column) -> Column:
        level = F.lit(None).cast("string")
        for letter, name in LEVELS:
            level = F.when(p["level"] == letter, name).otherwise(level)
        own = attrs.listed(("thread_id", p["thread"].try_cast("double")), ("file", p["file"]), ("line", p["line"].try_cast("double")))
        plain = record(self.time(p), level, p["msg"], own, line)

        def tail(q: Column) -> Column:
            """Of a message in quotes: what it says, and the pairs behind it."""

            def use(x: Column) -> Column:
                split = (x["rest"] == "") | (F.size(x["more"]) > 0)
                more = F.when(F.size(x["more"]) > 0, attrs.folded(F.concat(own, typed(x["more"])))).otherwise(own)
                return F.when(split, record(self.time(p), level, x["said"], more, line)).otherwise(plain)

            return bound(F.struct(q["said"].alias("said"), q["rest"].alias("rest"), pairs(F.ltrim(q["rest"])).alias("more")), use)

        return F.when(p["msg"].startswith('"'), F.coalesce(groups(p["msg"], QUOTED, ("said", "rest"), tail), plain)).otherwise(plain)
