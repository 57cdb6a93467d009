"""Web server access lines, common and combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import attrs, text, times, values
from .base import bound, groups, record

LINE = r'(?s)^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?.*$'
PARTS = ("addr", "ident", "user", "time", "request", "status", "bytes", "referer", "agent")
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: User information, a host or a bracketed address, and a port of digits.
_AUTHORITY = r"^//([^/?@]*@)?([^/?@:\[\]]*|\[[^/?@\]]*\])(:\d*)?([/?]|$)"


def decoded(value: Column, plus: bool) -> Column:
    """Percent escapes resolved; a plus sign is a space in a query, and itself in a path."""
    return F.try_url_decode(value if plus else F.replace(value, F.lit("+"), F.lit("%2B")))


def query_attrs(query: Column) -> Column:
    """``query.<key>`` attributes in order of first appearance; repeated keys joined by commas, malformed pairs left out."""
    raw = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.contains(";"))
    pairs = F.transform(raw, lambda p: F.struct(decoded(F.substring_index(p, "=", 1), True).alias("k"), F.when(p.contains("="), decoded(F.substr(p, F.instr(p, "=") + 1), True)).otherwise("").alias("v")))
    good = F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull())

    def use(good: Column) -> Column:
        keys = F.array_distinct(F.transform(good, lambda p: p["k"]))
        return F.transform(keys, lambda k: attrs.attr(F.concat(F.lit("query."), k), F.array_join(F.transform(F.filter(good, lambda p: p["k"] == k), lambda p: p["v"]), ",")))

    return bound(good, use)


def request_attrs(request: Column) -> Column:
    """method, protocol, path and query.* of a request line."""
    split = F.split(request, " ", 3)

    def use(s: Column) -> Column:
        target = F.get(s, F.lit(1))
        # a path from the root, or a URL with a scheme, which may be opaque ("host:443") and then has no path; "#" means nothing here
        rooted = target.startswith("/")
        scheme = ~rooted & target.rlike(_SCHEME)
        rest = F.when(rooted, target).otherwise(F.regexp_replace(target, _SCHEME, ""))
        authority = scheme & rest.startswith("//")
        relative = F.when(authority, F.regexp_replace(rest, "^//[^/?]*", "")).otherwise(rest)
        before = F.substring_index(relative, "?", 1)
        opaque = scheme & ~rest.startswith("/")
        bad = ~(rooted | scheme) | target.rlike(r"[\x00-\x1f\x7f]") | (~opaque & before.rlike(_BAD_ESCAPE)) | (authority & ~rest.rlike(_AUTHORITY))
        path = F.when(bad, target).when(opaque, "").otherwise(decoded(before, False))
        query = F.when(~bad & relative.contains("?"), F.substr(relative, F.instr(relative, "?") + 1))
        fixed = attrs.listed(("method", F.get(s, F.lit(0))), ("protocol", F.get(s, F.lit(2))), ("path", path))
        return F.when(F.size(s) >= 2, F.concat(fixed, F.coalesce(query_attrs(query), attrs.none()))).otherwise(attrs.none())

    return bound(split, use)


class ClfFormat:
    name = "clf"
    is_document = False

    def parse(self, line: Column) -> Column:
        return groups(line, LINE, PARTS, lambda p: self.whole(p, line))

    @staticmethod
    def whole(p: Column, line: Column) -> Column:
        stamp = F.try_to_timestamp(p["time"], F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
        time = times.parts(stamp, F.lit(0), times.offset_seconds(F.regexp_extract(p["time"], r"([+-]\d{4})$", 1)))
        status = p["status"].try_cast("double")
        filled = lambda c, *none: F.when(~c.isin("", *none), c)
        own = attrs.listed(
            ("remote_addr", p["addr"]),
            ("user", F.when(p["user"] != "-", p["user"])),
            ("status", status),
            ("bytes", values.parsed_float(p["bytes"])),
            ("referer", filled(p["referer"], "-")),
            ("user_agent", filled(p["agent"])),
        )
        both = attrs.folded(F.concat(request_attrs(p["request"]), own))
        return record(time, text.status_level(status), p["request"], both, line)
