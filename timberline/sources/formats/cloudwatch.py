"""CloudWatch Logs output: lines of ``tail``, and documents of events; what they carry is parsed in turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, times
from .base import bound, record
from .clf import ClfFormat
from .glog import GlogFormat
from .json import JsonFormat
from .logfmt import LogfmtFormat

EVENT = "struct<logStreamName:string,timestamp:bigint,message:string,ingestionTime:bigint,eventId:string>"
DOCUMENT = f"struct<events:array<{EVENT}>>"


def inner(message: Column, formats) -> Column:
    """name and record r of the first format that takes a message; a plain text otherwise."""
    clean = F.regexp_replace(message, r"[\r\n]+$", "")
    plain = record(times.no_time(), F.lit(""), clean, attrs.none(), clean)
    tried = [F.struct(F.lit(f.name).alias("name"), f.parse(clean).alias("r")) for f in formats]
    return F.coalesce(*(F.when(t["r"].isNotNull(), t) for t in tried), F.struct(F.lit(None).cast("string").alias("name"), plain.alias("r")))


class CloudWatchFormat:
    name = "cloudwatch"
    is_document = True

    def __init__(self, default_year: int | None = None) -> None:
        self.formats = [JsonFormat(), GlogFormat(default_year), ClfFormat(), LogfmtFormat()]

    def parse(self, line: Column) -> Column:
        """A line of ``tail``: time, stream and message."""
        split = F.split(line, " ", 3)
        time = times.rfc3339(F.get(split, F.lit(0)))
        good = (F.size(split) == 3) & time.isNotNull()
        extra = lambda x: attrs.listed(("log_stream", F.get(split, F.lit(1))), ("inner_format", x["name"]))
        return F.when(good, bound(inner(F.get(split, F.lit(2)), self.formats), lambda x: self.outer(x["r"], time, extra(x), line)))

    def event(self, event: Column) -> Column:
        """One event of a document."""
        stamp = times.epoch_millis(F.when((event["timestamp"] != 0) & (F.abs(event["timestamp"]) < 9_000_000_000_000_000), event["timestamp"]))
        extra = attrs.listed(("log_stream", F.coalesce(event["logStreamName"], F.lit(""))), ("event_id", F.when(event["eventId"] != "", event["eventId"])))
        message = F.coalesce(event["message"], F.lit(""))
        return bound(inner(message, self.formats), lambda x: self.outer(x["r"], stamp, extra, message))

    @staticmethod
    def outer(r: Column, time: Column, extra: Column, raw: Column) -> Column:
        own = times.parts(r["time"], r["time_nanos"], r["time_offset_s"])
        return record(F.coalesce(own, time), r["level"], r["msg"], attrs.folded(F.concat(r["attrs"], extra)), raw)
