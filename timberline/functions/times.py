"""Times with nanoseconds and the offset they were written in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import bound

#: What parsers return: an instant, the fraction of its second, and its zone offset.
TIME = "struct<time:timestamp,nanos:int,offset:int>"
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"


def no_time() -> Column:
    return F.lit(None).cast(TIME)


def parts(time: Column, nanos: Column, offset: Column) -> Column:
    return bound(time.cast("timestamp"), lambda t: F.when(t.isNotNull(), F.struct(t.alias("time"), nanos.cast("int").alias("nanos"), offset.cast("int").alias("offset"))))


def fraction_nanos(digits: Column) -> Column:
    """Nanoseconds from the digits behind the point, however many."""
    return F.coalesce(F.rpad(F.substring(digits, 1, 9), 9, "0").try_cast("int"), F.lit(0))


def offset_seconds(zone: Column) -> Column:
    """Seconds from Z, +hh:mm or +hhmm."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    size = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    return F.coalesce(F.when(zone.startswith("-"), -size).otherwise(size), F.lit(0))


def rfc3339(text: Column) -> Column:
    """Date, ``T``, time and zone are all needed; anything else is no time."""

    def use(x: Column) -> Column:
        text, time = x["text"], x["time"]
        utc, size = text.endswith("Z"), F.length(text)
        digits = F.substr(text, F.lit(21), size - F.when(utc, 21).otherwise(26))  # behind the point, before the zone
        nanos = F.when(size > F.when(utc, 27).otherwise(32), fraction_nanos(digits)).otherwise(F.pmod(F.unix_micros(time), F.lit(1_000_000)).cast("int") * 1000)
        return F.when(time.isNotNull(), F.struct(time.alias("time"), nanos.alias("nanos"), F.when(utc, 0).otherwise(offset_seconds(F.right(text, F.lit(6)))).alias("offset")))

    def read(text: Column) -> Column:
        return bound(F.struct(text.alias("text"), text.try_cast("timestamp").alias("time")), use)

    return bound(F.when(text.rlike(RFC3339), F.replace(text, F.lit(","), F.lit("."))), lambda t: F.when(t.isNotNull(), read(t)))


def epoch(seconds: Column, unit: int = 1) -> Column:
    """From a number of seconds (or of 1 / ``unit`` seconds), in UTC."""
    value = seconds / F.lit(float(unit))
    whole = F.when(F.abs(value) < 9e12, value.cast("bigint"))
    nanos = ((value - whole) * 1e9).cast("bigint")
    second = whole + F.when(nanos < 0, -1).otherwise(0)
    nanos = F.when(nanos < 0, nanos + 1_000_000_000).otherwise(nanos)
    return parts(F.timestamp_micros(second * 1_000_000 + F.floor(nanos / 1000)), nanos, F.lit(0))


def epoch_millis(millis: Column) -> Column:
    """From whole milliseconds, exactly."""
    return parts(F.timestamp_micros(millis * 1000), F.pmod(millis, F.lit(1000)) * 1_000_000, F.lit(0))


def shown(time: Column, offset: Column, pattern: str) -> Column:
    """In the offset it was written in; fractions are cut, not rounded."""
    return F.date_format(F.timestamp_micros(F.unix_micros(time) + F.coalesce(offset, F.lit(0)).cast("bigint") * 1_000_000), pattern)


def rfc3339_text(time: Column, nanos: Column, offset: Column) -> Column:
    """The time as RFC 3339 in its own offset, with as many fraction digits as it has; the zero time if there is none."""
    digits = F.regexp_replace(F.lpad(nanos.cast("string"), 9, "0"), "0+$", "")
    fraction = F.when(F.coalesce(nanos, F.lit(0)) == 0, "").otherwise(F.concat(F.lit("."), digits))
    minutes = F.abs(F.coalesce(offset, F.lit(0))) / 60
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    zone = F.when(F.coalesce(offset, F.lit(0)) == 0, "Z").otherwise(F.concat(F.when(offset < 0, "-").otherwise("+"), two(minutes / 60), F.lit(":"), two(minutes % 60)))
    return F.when(time.isNull(), "0001-01-01T00:00:00Z").otherwise(F.concat(shown(time, offset, "yyyy-MM-dd'T'HH:mm:ss"), fraction, zone))


#: The pieces of a reference-time layout, longest first, and the Java pattern and regular expression of each.
LAYOUT = (
    ("January", "MMMM", r"[A-Za-z]+"),
    ("Monday", "EEEE", r"[A-Za-z]+"),
    ("2006", "yyyy", r"\d{4}"),
    ("Z07:00", "XXX", r"(?:Z|[+-]\d\d:\d\d)"),
    ("-07:00", "xxx", r"[+-]\d\d:\d\d"),
    ("Z0700", "XX", r"(?:Z|[+-]\d{4})"),
    ("-0700", "xx", r"[+-]\d{4}"),
    ("MST", "zzz", r"[A-Z]{3,4}"),
    ("Jan", "MMM", r"[A-Za-z]{3}"),
    ("Mon", "EEE", r"[A-Za-z]{3}"),
    ("01", "MM", r"\d\d"),
    ("02", "dd", r"\d\d"),
    ("_2", "d", r" ?\d{1,2}"),
    ("03", "hh", r"\d\d"),
    ("04", "mm", r"\d\d"),
    ("05", "ss", r"\d\d"),
    ("06", "yy", r"\d\d"),
    ("15", "HH", r"\d\d"),
    ("PM", "a", r"(?:AM|PM)"),
    ("-07", "x", r"[+-]\d\d"),
    ("1", "M", r"\d{1,2}"),
    ("2", "d", r"\d{1,2}"),
    ("3", "h", r"\d{1,2}"),
    ("4", "m", r"\d{1,2}"),
    ("5", "s", r"\d{1,2}"),
)


def layout_parser(layout: str):
    """A function from Column to time for a layout written as the reference time 2006-01-02 15:04:05.

    A fraction may follow the seconds even if the layout has none.
    """
    pattern, regex, zone, at = "", "^", False, 0
    while at < len(layout):
        if m := re.match(r"[.,]([09]+)(?!\d)", layout[at:]):
            at += m.end()
            continue
        for piece, java, expression in LAYOUT:
            if layout.startswith(piece, at):
                pattern, regex, at = pattern + java, regex + expression, at + len(piece)
                zone = zone or java[0] in "xXz"
                if piece in ("05", "5"):
                    regex += r"(?:[.,]\d+)?"
                break
        else:
            char = layout[at]
            pattern += f"'{char}'" if char.isalpha() else "''" if char == "'" else char
            regex += re.escape(char)
            at += 1

    def parse(text: Column) -> Column:
        whole = F.when(text.rlike(regex + "$"), text)
        plain = F.regexp_replace(F.regexp_replace(whole, r"(:\d\d)[.,]\d+", "$1"), "  +", " ")
        time = F.try_to_timestamp(plain, F.lit(pattern.replace("  ", " ")))
        offset = offset_seconds(F.regexp_extract(plain, r"([+-]\d\d:?\d\d)$", 1)) if zone else F.lit(0)
        return parts(time, fraction_nanos(F.regexp_extract(whole, r":\d\d[.,](\d+)", 1)), offset).withField("time", F.timestamp_micros(F.unix_micros(time) + F.floor(fraction_nanos(F.regexp_extract(whole, r":\d\d[.,](\d+)", 1)) / 1000)))

    return parse


def any_of(text: Column, *parsers) -> Column:
    return F.coalesce(*(p(text) for p in parsers))


#: What regex and code plugins try in turn.
PLUGIN_LAYOUTS = ("2006-01-02T15:04:05.000Z", "2006-01-02 15:04:05")


def plugin_time(text: Column, layout: str = "") -> Column:
    own = [layout_parser(layout)] if layout else []
    return any_of(text, *own, rfc3339, *map(layout_parser, PLUGIN_LAYOUTS))
