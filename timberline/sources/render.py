"""Log lines made from rows, one renderer for each format: the other way round of parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_line(time: Column, level: Column, msg: Column, **fields: Column) -> Column:
    return F.to_json(F.struct(stamp(time).alias("time"), level.alias("level"), msg.alias("msg"), *(c.alias(k) for k, c in fields.items())))


def logfmt_line(time: Column, level: Column, msg: Column, **fields: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.regexp_replace(msg, r'(["\\])', r"\\$1"), F.lit('"'))
    pairs = [F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in fields.items()]
    return F.concat_ws(" ", F.concat(F.lit("time="), stamp(time)), F.concat(F.lit("level="), F.lower(level)), F.concat(F.lit("msg="), quoted), *pairs)


def glog_line(time: Column, level: Column, msg: Column, thread: Column, file: str = "event.go", line: int = 42, **fields: Column) -> Column:
    pairs = [F.concat(F.lit(f" {k}="), c.cast("string")) for k, c in fields.items()]
    said = F.concat(F.lit('"'), msg, F.lit('"')) if fields else msg
    return F.concat(F.substring(level, 1, 1), F.date_format(time, "yyyyMMdd HH:mm:ss.SSSSSS"), F.lit(" "), F.lpad(thread.cast("string"), 7, " "), F.lit(f" {file}:{line}] "), said, *pairs)


def clf_line(time: Column, user: Column, method: Column, target: Column, status: Column, size: Column) -> Column:
    return F.concat(F.lit("10.0.0.1 - "), user, F.lit(" ["), F.date_format(time, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), method, F.lit(" "), target, F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "), size.cast("string"), F.lit(' "-" "agent/1.0"'))


def tail_line(time: Column, stream: Column, message: Column) -> Column:
    return F.concat_ws(" ", stamp(time), stream, message)
