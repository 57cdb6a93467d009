"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
schemes and identifier cues.  At each anchor a deterministic local parser
expands to the boundaries of the e-mail address, telephone number, URL or
account number around it and validates it.  IP addresses and cards have no anchor
but their digits; they are found by one pattern each over the whole text.

The four base kinds are those of fixed patterns, leftmost and non-overlapping
for each kind.  A parser looks at the maximal run of its own alphabet around the
anchor only, and as no match can reach out of that run, it finds what a search
of the whole text would find.  The method adds two kinds: ``account``, a cue such as "IBAN",
"routing number", "account number" or "SSN" followed by an identifier (whose check
digits hold, where it has any), and ``url``, a scheme whose authority holds
user information (``user:password@host``).

Defined cases: a null text is empty and has no spans; a candidate that fails its
check is dropped and the scan goes on behind it; offsets are code points, the
end exclusive; repeated documents are scanned row by row; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, joined_hash, type_of

KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = 4
#: What a cue leads to.
CUES = {
    "iban": "iban", "account number": "account", "account no": "account", "account #": "account", "acct": "account", "bank account": "account",
    "routing number": "routing", "routing no": "routing", "aba": "routing", "social security number": "ssn", "ssn": "ssn",
}
LOCAL = string.ascii_letters + string.digits + "._%+-"
SCHEMES = ("http://", "https://", "ftp://")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z]+://[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
_BEHIND = r"(?:[.:#=\-]|\s|number|no\b|is\b){0,6}"
_ROUTING = re.compile(rf"{_BEHIND}([0-9]{{9}})(?![0-9])", re.I)
_ACCOUNT = re.compile(rf"{_BEHIND}([0-9](?:[ -]?[0-9]){{5,16}})(?![0-9])", re.I)
_SSN = re.compile(rf"{_BEHIND}([0-9]{{3}}[ -]?[0-9]{{2}}[ -]?[0-9]{{4}})(?![0-9])", re.I)
_IBAN = re.compile(r"[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def routing(value: str) -> bool:
    """Nine digits of a bank's routing number: its check digit holds, and its first two name a district."""
    d = [int(c) for c in value]
    return (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0 and (1 <= 10 * d[0] + d[1] <= 12 or 21 <= 10 * d[0] + d[1] <= 32 or 61 <= 10 * d[0] + d[1] <= 72 or value[:2] == "80")


def social(value: str) -> bool:
    d = re.sub("[ -]", "", value)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


#: Of each kind of cue, the parser of what follows and its check.
_AFTER = {"iban": (lambda t, at: _IBAN.match(t, at), lambda v: iban(v)), "routing": (lambda t, at: _ROUTING.match(t, at), routing), "account": (lambda t, at: _IBAN.match(t, at) or _ACCOUNT.match(t, at), lambda v: iban(v) if v[:1].isalpha() else True), "ssn": (lambda t, at: _SSN.match(t, at), social)}


def anchors():
    """The automaton over at-signs, plus signs, schemes and cues in four ways of writing."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, anchor in [("email", "@"), ("phone", "+"), *(("url", s) for s in SCHEMES), *((f"cue {kind}", v) for c, kind in CUES.items() for v in {c, c.upper(), c.capitalize(), c.title()})]:
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def local_start(text: str, at: int, least: int) -> int:
    """Where the run of local-part characters that ends before ``at`` begins, at ``least`` or later."""
    step = 64
    while True:
        low = max(least, at - step)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start > low or low == least:
            return start
        step *= 8


def spans(text: str, automaton) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "email":
            start = local_start(text, at, free[kind])
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end(), kind))
                free[kind] = m.end()
        elif kind.startswith("cue "):
            parse, good = _AFTER[kind[4:]]
            if not text[at - 1 : at].isalnum() and (m := parse(text, last + 1)) and m.start(1) >= free["account"] and good(m[1]):
                free["account"] = m.end(1)
                out.append((m.start(1), m.end(1), "account"))
        elif at < free[kind]:
            continue
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                free[kind] = m.end()
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((at, m.end(), kind))
        elif m := _USERINFO.match(text, at):
            free[kind] = m.end()
            out.append((at, m.end(), kind))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(found: list[tuple[int, int, str]]) -> list[str]:
    return [f"{kind}:{start}:{end}" for start, end, kind in found]


def find(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, base_sha256, and all spans as ``kind:start:end``."""
    id_type = type_of(documents, doc)

    def make():
        automaton = anchors()

        def work(batch: pa.RecordBatch) -> dict:
            every = [spans(t, automaton) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in found if s[2] in KINDS[:BASE]] for found in every]
            counts = {f"n_{kind}": pa.array([sum(s[2] == kind for s in found) for found in base], pa.int64()) for kind in KINDS[:BASE]}
            return {"doc_id": batch.column(0), **counts, "base_sha256": [joined_hash(written(b)) for b in base], "spans": [",".join(written(s)) for s in every]}

        return work

    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, make, f"doc_id {id_type}, " + "".join(f"n_{kind} bigint, " for kind in KINDS[:BASE]) + "base_sha256 string, spans string")


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the earlier one."""

    def parts() -> Iterator[str]:
        at = 0
        for start, end, kind in found:
            if start >= at:
                yield text[at:start]
                yield f"[{kind.upper()}]"
                at = end
        yield text[at:]

    return "".join(parts())
