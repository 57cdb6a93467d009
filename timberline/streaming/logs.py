"""Streaming reads: parsers are plain Columns, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import RECORD, Format, Registry
from ..sources.reader import once, prepare, split_lines


def read_stream(spark: SparkSession, path: str, format: str | Format, registry: Registry | None = None, **options) -> DataFrame:
    """Records of a folder's files as they arrive.  The format has to be named, as there is no sample to detect it from."""
    prepare(spark)
    chosen = (registry or Registry()).need(format) if isinstance(format, str) else format
    lines = split_lines(spark.readStream.options(lineSep="\n", **options).text(path))
    return lines.select(once(chosen.parse(F.col("value")).cast(RECORD)).alias("r")).where("r IS NOT NULL").select("r.*", F.lit(chosen.name).alias("format"))


def level_counts(records: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Records by window of time and level; later ones than ``late`` are dropped, so state stays bounded."""
    return records.withWatermark("time", late).groupBy(F.window("time", window), "level").agg(F.count("*").alias("records"))


def follow(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Take in what has arrived since the last call, from ``checkpoint``, and append to ``out`` what is final.

    ``counts``: a stream of windows with a watermark.  A window is appended once,
    when the watermark has passed its end; rows of such a window that come later
    are dropped.  Called again, after an end or a failure, it goes on where it was.
    """
    counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
