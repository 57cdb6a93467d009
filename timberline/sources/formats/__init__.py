"""The formats, in the order in which they are tried: strict ones first."""

from __future__ import annotations

import os
from pathlib import Path

from .base import RECORD, DocumentFormat, Format
from .clf import ClfFormat
from .cloudwatch import CloudWatchFormat
from .glog import GlogFormat
from .json import JsonFormat
from .logfmt import LogfmtFormat
from .plugin import PluginFormat
from .regex import RegexFormat

__all__ = ["EXAMPLES", "RECORD", "ClfFormat", "CloudWatchFormat", "DocumentFormat", "Format", "GlogFormat", "JsonFormat", "LogfmtFormat", "PluginFormat", "RegexFormat", "Registry", "default_plugin_dir"]


def default_plugin_dir() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "timberline" / "formats"


#: A folder of plugins to start from, one of each kind.
EXAMPLES = Path(__file__).parent.parent / "examples"


class Registry:
    """An ordered list of formats; each engine has its own."""

    def __init__(self, default_year: int | None = None, epoch_unit: int = 1) -> None:
        self.formats: list[Format] = [JsonFormat(epoch_unit), GlogFormat(default_year), ClfFormat(), LogfmtFormat(), CloudWatchFormat(default_year)]

    def names(self) -> list[str]:
        return [f.name for f in self.formats]

    def by_name(self, name: str) -> Format | None:
        return next((f for f in self.formats if f.name == name), None)

    def need(self, name: str) -> Format:
        found = self.by_name(name)
        if found is None:
            raise ValueError(f"unknown format {name!r}; there are {', '.join(self.names())}")
        return found

    def register(self, format: Format) -> None:
        self.formats.append(format)

    def load_plugins(self, folder: str | Path | None = None) -> list[str]:
        """Add the formats of a folder by file name: .toml by expression, .py by code.  Returns warnings; a bad file costs only itself."""
        folder = Path(folder) if folder is not None else default_plugin_dir()
        warnings = []
        kinds = {".toml": RegexFormat.from_toml, ".py": PluginFormat.from_file}
        for path in sorted(folder.iterdir(), key=lambda p: p.name) if folder.is_dir() else []:
            if path.suffix == ".wasm":
                warnings.append(f"{path.name}: no runtime for compiled plugins; write a .py one")
            if path.suffix not in kinds or not path.is_file():
                continue
            try:
                made = kinds[path.suffix](path)
            except Exception as e:  # noqa: BLE001  whatever a plugin file raises
                warnings.append(f"{path.name}: {e}")
                continue
            if self.by_name(made.name) is not None:
                warnings.append(f"{path.name}: there is a format {made.name!r} already; skipped")
            else:
                self.register(made)
        return warnings
