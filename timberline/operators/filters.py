"""Filters over parsed records: quick, time, set and text."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import times, values
from ..functions.text import folded

CLOCK = "HH:mm:ss.SSS"
COLUMNS = ("time", "level", "msg", "attrs")


def time_text() -> Column:
    """The clock as it is shown: in the record's own offset, milliseconds cut; the zero time if there is none."""
    return F.when(F.col("time").isNull(), "00:00:00.000").otherwise(times.shown(F.col("time"), F.col("time_offset_s"), CLOCK))


def attrs_text(full: bool = False) -> Column:
    """``k=v, k=v`` in order.  ``full``: whole numbers with all their digits."""
    return F.array_join(F.transform("attrs", lambda a: F.concat(a["key"], F.lit("="), values.display_text(a["value"], full))), ", ")


def shown(column: str) -> Column:
    """A display column as text."""
    if column not in COLUMNS:
        raise ValueError(f"no display column {column!r}; there are {', '.join(COLUMNS)}")
    return {"time": time_text, "level": lambda: F.col("level"), "msg": lambda: F.col("msg"), "attrs": attrs_text}[column]()


def quick(words: str, full: bool = False) -> Column:
    """Every word occurs, in any case, in the time, level, message, or an attribute's key or value; ``full``: whole numbers with all their digits."""

    own = F.transform("attrs", lambda a: folded(a["key"])), F.transform("attrs", lambda a: values.bound(values.display_text(a["value"], full), folded))
    # every text once, for all words
    every = F.concat(F.array(folded(F.col("msg")), folded(F.col("level")), time_text()), *own)
    wanted = F.array(*(folded(F.lit(w)) for w in words.split())).cast("array<string>")
    return values.bound(every, lambda texts: F.forall(wanted, lambda w: F.exists(texts, lambda t: F.contains(t, w))))


def time_filter(after: dt.datetime | str | None = None, before: dt.datetime | str | None = None, equals: dt.datetime | str | None = None) -> Column:
    """From ``after`` to ``before``, both included; records without a time do not match a bound."""
    tests = [op(F.lit(v).cast("timestamp")) for v, op in ((after, F.col("time").__ge__), (before, F.col("time").__le__), (equals, F.col("time").__eq__)) if v is not None]
    return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))


def set_filter(column: str, allowed: list[str]) -> Column:
    return shown(column).isin(*allowed) if allowed else F.lit(False)


TEXT_TESTS = ("contains", "equals", "startswith", "endswith", "notcontains", "notequal", "blank", "notblank")


def text_filter(column: str, test: str, value: str = "") -> Column:
    """A test of a column's text, in any case."""
    if test not in TEXT_TESTS:
        raise ValueError(f"no text test {test!r}; there are {', '.join(TEXT_TESTS)}")
    own, other = folded(shown(column)), folded(F.lit(value))
    if test.startswith("not") and test != "notblank":
        return ~(F.contains(own, other) if test == "notcontains" else own == other)
    if test.endswith("blank"):
        return (own == "") if test == "blank" else (own != "")
    return own == other if test == "equals" else getattr(F, test)(own, other)
