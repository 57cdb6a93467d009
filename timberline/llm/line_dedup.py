"""Removal of repeated runs of lines, by winnowing over line hashes; DataFrame functions only.

A window is a shortest run of lines with at least ``min_words`` words; one
begins, and one ends, at each line that leaves room for it.  Blank lines take no
part.  As in winnowing, each window selects its least line hash, so that two
runs which share a window share a fingerprint; only fingerprints that occur at
more than one place are followed up.  There the windows themselves are compared
by two hashes of all their lines, each repeat is matched with the first place of
its content, and windows that begin and windows that end at a line extend the
match both ways: together the repeated windows cover exactly the lines of all
repeated runs of at least ``min_words`` words.

A line goes if it lies in such a run whose content occurs at an earlier place,
earlier by (document id, line).  The first occurrence stays.

Scale: fingerprints and windows are grouped by hash with map-side sums, never
paired; a passage that a third of all documents share costs a row for each
occurrence.  Only positions are shuffled, and the texts once, to meet them.

Defined cases: a null text stays null and has no lines; rows with one id and
text are one place, so none of them is the later one; a null id sorts first;
blank lines inside a repeated window go with it; a text may become empty; other
columns are kept whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

_SPACE = r"[\\x20\\x09-\\x0D]"

_TRIMMED = "btrim(x, concat(' ', char(9), char(10), char(11), char(12), char(13)))"

#: pos: place among all lines; n: words.  Bound once for each text by the outer transform.
_LINES = rf"""
filter(transform(split(__text, '\n'), (x, i) -> struct(i AS pos, xxhash64(x) AS h, hash(x) AS g, if({_TRIMMED} = '', 0, size(split({_TRIMMED}, '{_SPACE}+'))) AS n)), s -> s.n > 0)
"""


def _windows(kind: int, run: str, least: int) -> str:
    """Windows that begin (kind 0) or end (kind 1) at each line; ``run``: the lines from it on, in the window's own order."""
    ends = "a.start, s.pos AS stop" if kind == 0 else "s.pos AS start, a.stop"
    return f"""
filter(transform(sequence(1, size(lines)), k -> aggregate({run},
  struct({kind} AS kind, 0 AS n, 0 AS m, {kind}L AS h, {kind} AS g, 9223372036854775807L AS low, lines[k - 1].pos AS start, lines[k - 1].pos AS stop),
  (a, s) -> if(a.n >= {least}, a, struct({kind} AS kind, a.n + s.n AS n, a.m + 1 AS m, xxhash64(a.h, s.h) AS h, hash(a.g, s.g) AS g, least(a.low, s.h) AS low, {ends})))),
  w -> w.n >= {least})
"""


def windows(rows: DataFrame, least: int) -> DataFrame:
    """__doc, __key and w (kind, n, m, h, g, low, start, stop) for each window of each row's __text."""
    forward, backward = f"slice(lines, k, {least})", f"reverse(slice(lines, greatest(1, k - {least - 1}), least(k, {least})))"
    both = f"concat({_windows(0, forward, least)}, {_windows(1, backward, least)})"
    every = f"transform(array({_LINES}), lines -> if(size(lines) = 0, null, {both}))[0]"
    return rows.select("__doc", "__key", F.explode(F.expr(every)).alias("w"))


def repeated(rows: DataFrame, least: int) -> DataFrame:
    """__doc, __key, runs: the disjoint line ranges (start, stop) of each document that repeat earlier ones, in order."""
    found = windows(rows, least).select("__doc", "__key", "w.*")
    places = found.groupBy("low").agg(F.min(F.struct("__doc", "__key", "start")).alias("a"), F.max(F.struct("__doc", "__key", "start")).alias("b"))
    followed = found.join(places.where("a <> b").select("low"), "low", "left_semi")
    content = ["kind", "low", "h", "g", "m"]
    # both sides of the join read the same columns, so that one shuffle of the windows serves both
    place = F.struct("__doc", "start", "stop", "__key")
    same = lambda a, b: F.col(f"{a}.__doc").eqNullSafe(F.col(f"{b}.__doc")) & (F.col(f"{a}.start") == F.col(f"{b}.start"))
    first = followed.groupBy(*content).agg(F.min(place).alias("first"), F.max(place).alias("final")).where(~same("first", "final")).drop("final")
    later = followed.join(first, content).where(F.struct("__doc", "start") > F.struct("first.__doc", "first.start")).select("__doc", "__key", "start", "stop").distinct()
    order = Window.partitionBy("__doc", "__key").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("__doc", "__key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("__doc", "__key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__runs"))


def _without_runs(documents: DataFrame, min_words: int, doc: str, text: str) -> DataFrame:
    """row (all columns of a document), left (its text without later repeated runs), n_lines, n_removed."""
    keyed = documents.select(F.struct(*documents.columns).alias("row"), F.col(doc).alias("__doc"), F.xxhash64(F.col(text)).alias("__key"), F.col(text).alias("__text"))
    runs = repeated(keyed.select("__doc", "__key", "__text"), min_words).withColumnsRenamed({"__doc": "__d", "__key": "__k"})
    joined = keyed.join(runs, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    kept = F.expr(
        r"""transform(array(split(__text, '\n')), lines -> flatten(transform(sequence(0, size(__runs)), i ->
          slice(lines, if(i = 0, 0, __runs[i - 1].stop + 1) + 1, if(i = size(__runs), size(lines), __runs[i].start) - if(i = 0, 0, __runs[i - 1].stop + 1)))))[0]"""
    )
    removed = F.expr("aggregate(__runs, 0L, (a, r) -> a + r.stop - r.start + 1)")
    return joined.select(
        "row",
        F.when(F.col("__runs").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("left"),
        F.coalesce(F.size(F.split("__text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
    )


def _columns(documents: DataFrame, changed: dict) -> list:
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns]


def deduplicated(documents: DataFrame, min_words: int = 50, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with later repeated runs removed from ``text``, and two more columns: __n_lines and __n_removed, with as many ``_`` behind them as it takes to be new names."""
    out = _without_runs(documents, min_words, doc, text)
    figures = (F.col(c).alias(fresh(documents, f"__{c}")) for c in ("n_lines", "n_removed"))
    return out.select(*_columns(documents, {text: F.col("left")}), *figures)


def cleaned(documents: DataFrame, min_words: int = 50, doc: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents without later repeated runs, and without those of which nothing is left; ``length`` follows the text."""
    out = _without_runs(documents, min_words, doc, text).where((F.col("n_removed") == 0) | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text: F.col("left")}
    if length in documents.columns:
        changed[length] = F.when(F.col("n_removed") > 0, F.length("left").cast(documents.schema[length].dataType)).otherwise(F.col("row").getField(length))
    return out.select(*_columns(documents, changed))
