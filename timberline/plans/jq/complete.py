"""Suggestions at the cursor of an expression: fields of the records and builtins."""

from __future__ import annotations

import re
from os.path import commonprefix

from .interpreter import KNOWN, SIMPLE, _library

CORE = ("time", "level", "msg")


def builtins() -> list[str]:
    return sorted({n for n, _ in (*SIMPLE, *_library()) if not n.startswith("_")} | set(KNOWN))


def complete(expression: str, position: int, schema: dict | None = None) -> tuple[str, list[str]]:
    """The expression with the word at ``position`` completed as far as it is clear, and all suggestions for it.

    ``schema``: nested dicts of field names, from ``operators.shape.fields``.
    Prefixes match in any case.
    """
    before = expression[:position]
    path = re.search(r"((?:\.[A-Za-z_][A-Za-z0-9_]*)*)\.([A-Za-z_][A-Za-z0-9_]*)?$", before)
    word = re.search(r"[A-Za-z_][A-Za-z0-9_]*$", before)
    if path:
        fields: dict = {**dict.fromkeys(CORE), **(schema or {})}
        for step in filter(None, path[1].split(".")):
            fields = fields.get(step) or {}
        prefix, known = path[2] or "", list(fields)
    elif word:
        prefix, known = word[0], builtins()
    else:
        return expression, []
    found = sorted(k for k in known if k.lower().startswith(prefix.lower()))
    if not found:
        return expression, []
    common = found[0] if len(found) == 1 else commonprefix([f.lower() for f in found])
    filled = found[0][: len(common)] if len(common) > len(prefix) else prefix
    return before[: len(before) - len(prefix)] + filled + expression[position:], found
