"""Scalar functions of the parsers: levels, quoting, case-insensitive search."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric levels up to each bound.
BUNYAN = ((10, "TRACE"), (20, "DEBUG"), (30, "INFO"), (40, "WARN"), (50, "ERROR"))


def normalize_level(level: Column) -> Column:
    """Upper case, if anything is in lower case; WARN and WARNING stay two levels."""
    return F.when(level.rlike(r"\p{Ll}"), F.upper(level)).otherwise(level)


def numeric_level(number: Column) -> Column:
    out = F.when(number <= BUNYAN[0][0], BUNYAN[0][1])
    for bound, name in BUNYAN[1:]:
        out = out.when(number <= bound, name)
    return F.when(number.isNotNull(), out.otherwise("FATAL"))


def status_level(status: Column) -> Column:
    """By an HTTP status."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


def unquoted(token: Column) -> Column:
    """The text in double quotes: a backslash goes and the next character stays; without a closing quote, all of the rest."""
    inner = F.regexp_replace(token, r'(?s)^"((?:[^"\\]|\\.|\\$)*)"?$', "$1")
    return F.when(token.contains("\\"), F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(F.replace(token, F.lit('"'), F.lit("")))


@functools.cache
def fold_table() -> tuple[str, str]:
    """Characters, and what each is folded to: the least of those that differ from it by simple case alone and take as many bytes, a lower-case ASCII letter first."""
    groups: dict[tuple[str, int], list[str]] = {}
    for code in (*range(0xD800), *range(0xE000, 0x1E944)):
        c = chr(code)
        folded = next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c)
        groups.setdefault((folded, len(c.encode())), []).append(c)
    pairs = [(c, min(group, key=lambda g: (not ("a" <= g <= "z"), g))) for group in groups.values() if len(group) > 1 for c in group]
    changed = [(c, to) for c, to in pairs if c != to]
    return "".join(c for c, _ in changed), "".join(to for _, to in changed)


def folded(text: Column) -> Column:
    """The text without differences of case: equal for texts that differ by simple case folding, character by character, and never of another length in bytes."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, *fold_table()))


def contains_fold(text: Column, part: Column) -> Column:
    """Whether a text holds another one, in any case; every text holds the empty one."""
    return F.contains(folded(text), folded(part))
