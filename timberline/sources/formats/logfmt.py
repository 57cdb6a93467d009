"""key=value pairs separated by spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, text, times, values
from .base import bound, record

PAIR = r'(?s)([^= ]*)=("(?:[^"\\]|\\.|\\$)*"?|[^ ]*)'
TIME_KEYS = ("time", "ts", "timestamp")
LEVEL_KEYS = ("level", "lvl", "severity")
MESSAGE_KEYS = ("msg", "message")


def pairs(line: Column) -> Column:
    """key and value (a text) of each pair in order; bare words count for nothing."""
    def pair(p: Column) -> Column:
        value = F.substr(p, F.instr(p, "=") + 1)
        return F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(value.startswith('"'), text.unquoted(value)).otherwise(value).alias("value"))

    return F.transform(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)), pair)


def typed(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), values.inferred(p["value"]).alias("value")))


class LogfmtFormat:
    """The last alias of a field wins, and none becomes an attribute; times are RFC 3339 only."""

    name = "logfmt"
    is_document = False

    def parse(self, line: Column) -> Column:
        def last(found: Column, keys: tuple[str, ...]) -> Column:
            return F.try_element_at(F.filter(found, lambda p: p["key"].isin(*keys)), F.lit(-1))["value"]

        def use(found: Column) -> Column:
            time = F.try_element_at(F.filter(F.transform(F.filter(found, lambda p: p["key"].isin(*TIME_KEYS)), lambda p: times.rfc3339(p["value"])), lambda t: t.isNotNull()), F.lit(-1))
            rest = F.filter(found, lambda p: ~p["key"].isin(*TIME_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS))
            whole = record(time, text.normalize_level(last(found, LEVEL_KEYS)), last(found, MESSAGE_KEYS), attrs.folded(typed(rest)), line)
            return F.when(F.size(found) > 0, whole)

        return bound(pairs(line), use)
