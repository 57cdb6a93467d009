"""A query over records: filters, order, a window of rows, and grouping by keys."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..session import written
from . import jq

SORTABLE = ("time", "level", "msg")
PLACE = ("file", "line_no")


@dataclass(frozen=True)
class LogQuery:
    """All parts are joined by "and".

    ``sort``: (column, descending) in order of weight; ties, and an empty sort, keep
    the order of the lines.  ``start`` and ``end`` cut a window of rows.  ``group``
    names display columns in nesting order; ``expanded`` the keys that are open, so
    that the query gives the groups one level below them, or at last the records.
    """

    jq: str = ""
    quick: str = ""
    filters: tuple[Column, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    start: int = 0
    end: int | None = None
    group: tuple[str, ...] = ()
    expanded: tuple[str, ...] = ()
    place: tuple[str, ...] = field(default=PLACE)

    def matching(self, records: DataFrame) -> DataFrame:
        """The records that pass all filters and lie under the expanded keys."""
        tests = list(self.filters)
        if self.quick.strip():
            tests.append(filters.quick(self.quick))
        tests += [filters.shown(c) == key for c, key in zip(self.group, self.expanded, strict=False)]
        return jq.where(records.where(reduce(Column.__and__, tests)) if tests else records, self.jq)

    def order(self) -> list[Column]:
        for column, _ in self.sort:
            if column not in SORTABLE:
                raise ValueError(f"cannot sort by {column!r}; by {', '.join(SORTABLE)}")
        # records without a time hold the earliest one
        return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in self.sort] + [F.asc(c) for c in self.place]

    def total(self, records: DataFrame) -> DataFrame:
        """How many rows there are without the window."""
        return self._unordered(records).agg(F.count("*").alias("total"))

    def _unordered(self, records: DataFrame) -> DataFrame:
        found = self.matching(records)
        if len(self.expanded) < len(self.group):
            return found.groupBy(filters.shown(self.group[len(self.expanded)]).alias("key")).agg(F.count("*").alias("records"))
        return found

    def run(self, records: DataFrame) -> DataFrame:
        rows = self._unordered(records)
        rows = rows.orderBy("key") if "records" in rows.columns and "key" in rows.columns and len(self.expanded) < len(self.group) else rows.orderBy(*self.order())
        if self.end is not None:
            rows = rows.limit(self.end)
        return rows.offset(self.start) if self.start else rows

    def ranked(self, records: DataFrame) -> DataFrame:
        """The rows and ``rank``, their number in the order from 1 on; counted by partition, so that no task holds all rows."""
        spark = records.sparkSession
        # kept, so that counts and ranks see the same partitions
        rows = written(self.run(records).withColumn("_at", F.monotonically_increasing_id()))
        part, before, offsets = F.shiftrightunsigned("_at", 33), self.start, []
        for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
            offsets.append((r.part, before))
            before += r.n
        placed = rows.join(F.broadcast(spark.createDataFrame(offsets, "_part bigint, _before bigint")), part == F.col("_part"))
        return placed.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")

    def page(self, number: int, size: int = 100) -> LogQuery:
        return replace(self, start=number * size, end=(number + 1) * size)


def display(records: DataFrame, full: bool = False) -> DataFrame:
    """The four columns of the grid, and the place of the line.  ``full``: whole numbers with all their digits."""
    return records.select("file", "line_no", filters.time_text().alias("time_text"), "level", "msg", filters.attrs_text(full).alias("attrs_text"))
