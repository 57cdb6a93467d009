"""One JSON object a line, in the dialects of the common structured loggers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, text, times, values
from .base import bound, plain_record, record, staged

TIME_KEYS = ("time", "ts", "timestamp", "@timestamp")
LEVEL_KEYS = ("level", "severity", "lvl")
MESSAGE_KEYS = ("msg", "message", "log")
SPACE = " \t\n\r\x0b\x0c"


def time_of(value: Column, epoch_unit: int = 1) -> Column:
    return F.coalesce(times.rfc3339(values.as_string(value)), times.epoch(values.as_number(value), epoch_unit))


def level_of(value: Column) -> Column:
    return F.coalesce(bound(values.as_string(value), text.normalize_level), text.numeric_level(values.as_number(value)))


def filled(value: Column) -> Column:
    return bound(value, lambda x: F.when(x != "", x))


class JsonFormat:
    """The first alias in document order that fills its field wins; later ones are attributes, earlier ones are dropped."""

    name = "json"
    is_document = False

    def __init__(self, epoch_unit: int = 1) -> None:
        self.epoch_unit = epoch_unit

    def parse(self, line: Column) -> Column:
        members = F.when(F.substring(F.ltrim(line, F.lit(SPACE)), 1, 1) == "{", F.from_json(line, "map<string,variant>"))
        return staged(members, self.told_apart, self.opened, self.worked_out, lambda x: self.put_together(line, x))

    @staticmethod
    def told_apart(members: Column) -> Column:
        """The values of the three fields with their types, and all other members.  ``plain``: no field has two aliases, and no key stands twice."""
        time, level, msg = (F.coalesce(*(F.try_element_at(members, F.lit(k)) for k in keys)) for keys in (TIME_KEYS, LEVEL_KEYS, MESSAGE_KEYS))
        rest = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(*TIME_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS))
        once = F.size(F.array_distinct(F.map_keys(members))) == F.size(members)
        return F.struct(time.alias("t"), level.alias("l"), msg.alias("m"), members.alias("all"), rest.alias("rest"), once.alias("once"))

    @staticmethod
    def opened(x: Column) -> Column:
        """What each field holds, as a text."""
        filled_in = sum((x[n].isNotNull().cast("int") for n in "tlm"), F.lit(0))
        plain = x["once"] & (F.size(x["all"]) - F.size(x["rest"]) == filled_in)
        texts = (F.when(plain, F.try_variant_get(x[n], "$", "string")).alias(f"{n}_text") for n in "tlm")
        return F.struct(*(x[n].alias(n) for n in ("all", "rest", "t", "l", "m")), plain.alias("plain"), *texts)

    def worked_out(self, x: Column) -> Column:
        """Time, level and message.  A text that begins like a word was a string; only others have their type looked up."""

        def is_string(n: str) -> Column:
            own = x[f"{n}_text"]
            return (F.substring(own, 1, 1).between("A", "z") & ~own.isin("true", "false") & ~F.substring(own, 1, 1).isin("[", "\\", "]", "^", "_", "`")) | (values.tag(x[n]) == "ST")

        stamp = times.rfc3339(x["t_text"])  # no number looks like one
        time = bound(stamp, lambda t: F.coalesce(t, times.epoch(values.as_number(x["t"]), self.epoch_unit)))
        level = F.when(is_string("l"), text.normalize_level(x["l_text"])).otherwise(text.numeric_level(values.as_number(x["l"])))
        return F.struct(*(x[n].alias(n) for n in ("all", "rest", "plain")), time.alias("time"), level.alias("level"), F.when(is_string("m"), x["m_text"]).alias("msg"))

    def put_together(self, line: Column, x: Column) -> Column:
        return F.when(x["plain"], plain_record(x["time"], x["level"], x["msg"], x["rest"], line)).when(x["all"].isNotNull(), self.in_order(line, x["all"]))

    def in_order(self, line: Column, members: Column) -> Column:
        """The record of members with several aliases for a field, or with repeated keys."""
        # each entry once, with the field that its key stands for: t, l, m, or none
        field = F.create_map(*(F.lit(x) for keys, f in ((TIME_KEYS, "t"), (LEVEL_KEYS, "l"), (MESSAGE_KEYS, "m")) for k in keys for x in (k, f)))
        placed = F.transform(F.map_entries(members), lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.try_element_at(field, e["key"]).alias("f"), i.alias("i")))

        def pick(core: Column, name: str, value):
            """The first entry that fills a field: its place and its value."""
            tried = F.transform(F.filter(core, lambda e: e["f"] == name), lambda e: F.struct(e["i"].alias("i"), value(e["value"]).alias("v")))
            return F.get(F.filter(tried, lambda t: t["v"].isNotNull()), F.lit(0))

        def use(entries: Column) -> Column:
            return bound(F.struct(entries.alias("e"), F.filter(entries, lambda e: e["f"].isNotNull()).alias("core")), pick_all)

        def pick_all(x: Column) -> Column:
            chosen = F.struct(
                x["e"].alias("e"),
                pick(x["core"], "t", lambda v: time_of(v, self.epoch_unit)).alias("t"),
                pick(x["core"], "l", lambda v: filled(level_of(v))).alias("l"),
                pick(x["core"], "m", lambda v: filled(values.as_string(v))).alias("m"),
            )
            return bound(chosen, finish)

        def finish(c: Column) -> Column:
            def stays(e: Column) -> Column:
                core = F.when(e["f"] == "t", c["t"]["i"]).when(e["f"] == "l", c["l"]["i"]).otherwise(c["m"]["i"])
                return e["f"].isNull() | F.coalesce(e["i"] > core, F.lit(False))

            kept = F.transform(F.filter(c["e"], stays), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
            return record(c["t"]["v"], c["l"]["v"], c["m"]["v"], attrs.folded(kept), line)

        return bound(placed, use)
