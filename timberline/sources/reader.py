"""Reading logs: lines with their places, format detection, parsing with a count of what is no record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from . import documents
from .formats import RECORD, CloudWatchFormat, Format, Registry
from .formats.cloudwatch import DOCUMENT, EVENT
from .heads import detected, first_sign

SAMPLE = 10
MALFORMED = "malformed CloudWatch document"
COLUMNS = ("file", "line_no", "time", "time_nanos", "time_offset_s", "level", "msg", "attrs", "raw", "format")


def prepare(spark: SparkSession) -> None:
    """Session settings that parsing relies on."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def split_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """Drop one carriage return at the end of each line, then empty lines."""
    line = F.col(column)
    cut = F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return texts.withColumn(column, cut).where(F.length(column) > 0)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no, value: lines end at ``\\n`` only; ``line_no`` grows with the place in the file, and is not without gaps.

    The number is the offset of the file split and the running number within
    it, so large files are read in parallel and need no global count.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    in_split = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return split_lines(raw.withColumn("line_no", F.col("start") + in_split)).select("file", "line_no", "value")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of ``read_lines`` with ``number``: 1, 2, 3, ... in each file, without gaps; for these the lines are read twice.

    Lines are counted by stretch (the lines of a file that one task reads in a
    row), and each stretch is given the number of lines before it; no line is
    shuffled, and a task or the driver holds a row a stretch at most.
    """
    at = F.monotonically_increasing_id()
    placed = lines.withColumns({"_task": F.shiftrightunsigned(at, 33), "_at": at})
    stretches = written(placed.groupBy("file", "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.min("line_no").alias("_least")))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_least").rowsBetween(Window.unboundedPreceding, -1))
    starts = stretches.select(F.col("file").alias("_file"), F.col("_task").alias("_of"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    found = placed.join(starts, (F.col("file") == F.col("_file")) & (F.col("_task") == F.col("_of")))
    return found.select(*lines.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("number"))


def lines_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Lines that are in memory, such as standard input read to its end."""
    rows = [("", i, x) for i, x in enumerate(lines)]
    return split_lines(spark.createDataFrame(rows, "file string, line_no long, value string"))


@dataclass
class Logs:
    """A parsed log: ``every`` line with its record or none."""

    every: DataFrame
    format: str

    @property
    def records(self) -> DataFrame:
        own = F.col("format") if "format" in self.every.columns else F.lit(self.format)
        return self.every.where("r IS NOT NULL").select("file", "line_no", "r.*", own.alias("format"))

    @property
    def skipped(self) -> DataFrame:
        return self.every.where("r IS NULL").select("file", "line_no", "value")

    def summary(self) -> DataFrame:
        """format, records and skipped of the unfiltered log."""
        return self.every.agg(F.lit(self.format).alias("format"), F.count_if(F.col("r").isNotNull()).alias("records"), F.count_if(F.col("r").isNull()).alias("skipped"))


def once(record: Column) -> Column:
    """The record, made once a row: a generator is a place that the optimizer copies no expression through."""
    return F.explode(F.array(record))


def parse(lines: DataFrame, format: Format, column: str = "value") -> Logs:
    return Logs(lines.select("*", once(format.parse(F.col(column)).cast(RECORD)).alias("r")), format.name)


def votes(lines: DataFrame, formats: list[Format], column: str = "value") -> DataFrame:
    """One row: n, and how many of these lines each format takes."""
    return lines.agg(F.count("*").alias("n"), *(F.count_if(f.parse(F.col(column)).isNotNull()).alias(f.name) for f in formats))


def detect(lines: DataFrame, registry: Registry, column: str = "value") -> Format:
    """The first format that takes more than half of the first ten lines."""
    # a limit reads the first split, and more only if that has too few lines; an order would read them all
    sample = [r[0] for r in lines.select(column).limit(SAMPLE).collect()]
    if not sample:
        return registry.need("json")
    formats = [f for f in registry.formats if not f.is_document]
    shown = lines.sparkSession.createDataFrame([(x,) for x in sample], f"{column} string").coalesce(1)
    for f in formats:  # strict ones first; most logs need one or two small jobs
        if votes(shown, [f], column).head()[f.name] > len(sample) // 2:
            return f
    raise ValueError(f"no format takes most of the first lines; there are {', '.join(registry.names())}")


def read_cloudwatch(spark: SparkSession, path: str | list[str], format: CloudWatchFormat, most: int = documents.WHOLE) -> Logs:
    """The events of JSON documents, one document a file; a malformed one is an error.

    Documents of up to ``most`` bytes are a row each; larger ones are cut at their events.
    """
    large = documents.large_events(spark, path, most)
    small = spark.read.text(path, wholetext=True).where(~documents.is_large(most)).select(F.col("_metadata.file_path").alias("file"), "value")
    logs = cloudwatch_events(small, format)
    if large is None:
        return logs
    parsed = F.from_json("value", EVENT)
    whole = F.col("value").startswith("{") & F.try_parse_json("value").isNotNull()
    events = large.select("file", "line_no", F.when(whole, parsed).otherwise(F.raise_error(F.lit(MALFORMED))).alias("e"))
    return Logs(logs.every.unionByName(event_rows(events, format)), format.name)


def cloudwatch_events(texts: DataFrame, format: CloudWatchFormat) -> Logs:
    """``texts``: file, value, a document a row."""
    parsed = F.from_json("value", DOCUMENT)
    checked = F.when(parsed.isNull() | ~F.col("value").rlike(r"^\s*\{") | F.try_parse_json("value").isNull(), F.raise_error(F.lit(MALFORMED))).otherwise(parsed)
    return Logs(event_rows(texts.select("file", F.posexplode(checked["events"]).alias("line_no", "e")), format), format.name)


def event_rows(events: DataFrame, format: CloudWatchFormat) -> DataFrame:
    return events.select("file", F.col("line_no").cast("long").alias("line_no"), F.col("e.message").alias("value"), once(format.event(F.col("e")).cast(RECORD)).alias("r"))


def is_document(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether CloudWatch output is a document of events, and not lines of ``tail``: by the first sign that is not white space."""
    signs = (first_sign(spark, file) for file in spark.read.text(path).inputFiles())
    return next(filter(None, signs), "") == "{"


def read_logs(spark: SparkSession, path: str | list[str], format: str | Format = "auto", registry: Registry | None = None) -> Logs:
    """Read log files.  ``format``: a name, a Format, or "auto" to detect it (for each file, if there are several)."""
    prepare(spark)
    registry = registry or Registry()
    if isinstance(path, list) and len(path) > 1 and format == "auto":
        return read_each(spark, path, registry)
    chosen = registry.need(format) if isinstance(format, str) and format != "auto" else format
    if isinstance(chosen, CloudWatchFormat) and is_document(spark, path):
        return read_cloudwatch(spark, path, chosen)
    lines = read_lines(spark, path)
    return parse(lines, detect(lines, registry) if chosen == "auto" else chosen)


def read_each(spark: SparkSession, paths: list[str], registry: Registry) -> Logs:
    """Each file in the format that its own first lines show, all judged in one job; one scan for all files of a format."""
    by: dict[str, list[str]] = {}
    found = detected(spark, paths, [f for f in registry.formats if not f.is_document], SAMPLE)
    for path in paths:
        if path not in found:  # a folder or a pattern
            name = detect(read_lines(spark, path), registry).name
        else:
            name = registry.need("json").name if found[path] == "" else found[path]
        if name is None:
            raise ValueError(f"no format takes most of the first lines of {path}; there are {', '.join(registry.names())}")
        by.setdefault(name, []).append(path)
    return union([parse(read_lines(spark, own), registry.need(name)) for name, own in by.items()])


def load_lines(spark: SparkSession, lines: list[str], format: str | Format = "auto", registry: Registry | None = None) -> Logs:
    """As ``read_logs``, from lines in memory."""
    prepare(spark)
    registry = registry or Registry()
    chosen = registry.need(format) if isinstance(format, str) and format != "auto" else format
    if isinstance(chosen, CloudWatchFormat) and lines and lines[0].lstrip().startswith("{"):
        return cloudwatch_events(spark.createDataFrame([("", "\n".join(lines))], "file string, value string"), chosen)
    rows = lines_of(spark, lines)
    return parse(rows, detect(rows, registry) if chosen == "auto" else chosen)


def union(logs: list[Logs]) -> Logs:
    """Several logs as one; each record keeps the format of its own."""
    return Logs(reduce(DataFrame.unionByName, (x.every.withColumn("format", F.lit(x.format)) for x in logs)), ",".join(dict.fromkeys(x.format for x in logs)))
