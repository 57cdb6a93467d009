"""Attributes: an ordered array of key and VARIANT value, keys unique."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import bound

ATTR = "struct<key:string,value:variant>"
ATTRS = f"array<{ATTR}>"


def none() -> Column:
    return F.array().cast(ATTRS)


def attr(key: Column | str, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("variant").alias("value"))


def listed(*pairs: tuple[str, Column]) -> Column:
    """Those pairs whose value is not NULL, in order."""
    return F.filter(F.array(*(attr(key, value) for key, value in pairs)).cast(ATTRS), lambda a: a["value"].isNotNull())


def folded(attrs: Column) -> Column:
    """Each key once: at its first place, with its last value."""


    def use(attrs: Column) -> Column:
        keys = F.array_distinct(F.transform(attrs, lambda a: a["key"]))
        once = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(attrs, lambda a: a["key"] == k), -1)["value"].alias("value")))
        return F.when(F.size(keys) == F.size(attrs), attrs).otherwise(once)

    return bound(attrs, use)


def get(attrs: Column, key: str) -> Column:
    """The value of a key; SQL NULL if it is absent, a null VARIANT if it is present and null."""
    return F.get(F.filter(attrs, lambda a: a["key"] == F.lit(key)), F.lit(0))["value"]


def has(attrs: Column, key: str) -> Column:
    return F.exists(attrs, lambda a: a["key"] == F.lit(key))
