"""Formats defined by a regular expression with named groups, in a TOML file."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, text, times, values
from .base import bound, record

_GROUP = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>|\((?!\?)", re.S)


def numbered(pattern: str) -> tuple[str, list[str]]:
    """The pattern with plain groups, as Java's names take no underscore; and the name of each group ('' if it has none)."""
    names: list[str] = []

    def plain(m: re.Match) -> str:
        if m[0][0] in "\\[":
            return m[0]
        names.append(m[1] or "")
        return "("

    return _GROUP.sub(plain, pattern), names


def may_stay_out(pattern: str) -> bool:
    """Whether a group may take no part in a match: one that is optional, or in an alternative."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    return "|" in plain or re.search(r"\)(?:[?*]|\{0)", plain) is not None


class RegexFormat:
    """Groups time, level and msg fill the record; other named groups become attributes in order, with inferred types.

    A group that takes no part in a match is left out, an empty one is empty.
    Spark's regular expressions do not tell these apart, so patterns where it
    matters run in an Arrow function instead.
    """

    is_document = False

    def __init__(self, name: str, pattern: str, time_format: str = "", level_map: dict[str, str] | None = None) -> None:
        if not name:
            raise ValueError("a regex format needs a name")
        if not pattern:
            raise ValueError(f"regex format {name!r} needs a pattern")
        try:
            re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))
        except re.error as e:
            raise ValueError(f"regex format {name!r}: {e}") from e
        self.name, self.pattern, self.time_format, self.level_map = name, pattern, time_format, dict(level_map or {})
        self.java, self.groups = numbered(pattern)

    @classmethod
    def from_toml(cls, path: str | Path) -> RegexFormat:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        return cls(raw.get("name", ""), raw.get("pattern", ""), raw.get("time_format", ""), raw.get("level_map"))

    def parse(self, line: Column) -> Column:
        found = self.by_python(line) if may_stay_out(self.pattern) else self.by_java(line)
        return F.when(line.rlike(self.java), bound(found, lambda g: self.whole(g, line)))

    def by_java(self, line: Column) -> Column:
        return F.array(*(F.regexp_extract(line, self.java, i) for i in range(1, len(self.groups) + 1))).cast("array<string>")

    def by_python(self, line: Column) -> Column:
        pattern = re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", self.pattern)

        @F.arrow_udf("array<string>")
        def groups(lines: pa.Array) -> pa.Array:
            search = re.compile(pattern).search
            found = (None if x is None else search(x) for x in lines.to_pylist())
            return pa.array([m and list(m.groups()) for m in found], pa.list_(pa.string()))

        return groups(line)

    def whole(self, groups: Column, line: Column) -> Column:
        named = [(n, F.get(groups, F.lit(i))) for i, n in enumerate(self.groups) if n]
        core = {n: F.coalesce(*[v for k, v in named if k == n], F.lit(None).cast("string")) for n in ("time", "level", "msg")}
        level = core["level"]
        mapped = F.coalesce(*(F.when(level == k, v) for k, v in self.level_map.items()), text.normalize_level(level))
        more = [(n, F.when(v.isNotNull(), values.inferred(v))) for n, v in named if n not in core]
        return record(times.plugin_time(core["time"], self.time_format), mapped, core["msg"], attrs.folded(attrs.listed(*more)) if more else attrs.none(), line)
