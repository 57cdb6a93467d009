"""Formats written in Python: ``name`` and ``parse(line)``, run over Arrow batches."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, text, times, values
from .base import bound, record

PAYLOAD = "struct<ok:boolean,error:string,time:string,level:string,msg:string,attrs:map<string,variant>>"
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "PANIC")


class PluginFormat:
    """``function`` gives a dict (or its JSON) with ok, error, time, level, msg and attrs; a line is skipped unless ok is true.

    A line on which the function fails is skipped, too.  Attributes are sorted by key.
    """

    is_document = False

    def __init__(self, name: str, function: Callable[[str], dict | str]) -> None:
        if not name:
            raise ValueError("a code format needs a name")
        if not callable(function):
            raise ValueError(f"code format {name!r} has no function parse")
        self.name, self.function = name, function

    @classmethod
    def from_file(cls, path: str | Path) -> PluginFormat:
        spec = importlib.util.spec_from_file_location(f"timberline_plugin_{Path(path).stem}", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        missing = [n for n in ("name", "parse") if not hasattr(module, n)]
        if missing:
            raise ValueError(f"{path}: missing {', '.join(missing)}")
        source = Path(path).read_text(encoding="utf-8")

        def parse(line: str):  # executors get the source, not the file
            if "parse" not in parse.__dict__:
                scope: dict = {"__name__": "timberline_plugin"}
                exec(compile(source, str(path), "exec"), scope)  # noqa: S102
                parse.__dict__["parse"] = scope["parse"]
            return parse.__dict__["parse"](line)

        return cls(module.name if isinstance(module.name, str) else module.name(), parse)

    def parse(self, line: Column) -> Column:
        function = self.function

        def one(x: str | None) -> str | None:
            if x is None:
                return None
            try:
                out = function(x)
                return out if isinstance(out, str) else json.dumps(out)
            except Exception:  # noqa: BLE001  a plugin's own failure costs its line
                return None

        @F.arrow_udf("string")
        def called(lines: pa.Array) -> pa.Array:
            return pa.array([one(x) for x in lines.to_pylist()], pa.string())

        return bound(F.from_json(called(line), PAYLOAD), lambda p: F.when(p["ok"], self.whole(p, line)))

    @staticmethod
    def whole(p: Column, line: Column) -> Column:
        own = F.array_sort(F.map_keys(p["attrs"]))
        sorted_attrs = F.transform(own, lambda k: F.struct(k.alias("key"), values.doubled(F.get(F.filter(F.map_entries(p["attrs"]), lambda e: e["key"] == k), F.lit(0))["value"]).alias("value")))
        return record(times.plugin_time(p["time"]), text.normalize_level(p["level"]), p["msg"], F.coalesce(sorted_attrs, attrs.none()), line)


def sample_parse(line: str) -> dict:
    """``LEVEL: message key=value ...``: the pairs are the longest run of words with ``=`` at the end; values stay texts."""
    level, colon, rest = line.partition(":")
    if not colon or level not in LEVELS:
        return {"ok": False, "error": "no level"}
    words = rest.split()
    at = len(words)
    while at and "=" in words[at - 1]:
        at -= 1
    pairs = [w.partition("=") for w in words[at:]]
    return {"ok": True, "level": level, "msg": " ".join(words[:at]), "attrs": {k: v for k, _, v in pairs}}
