"""The first lines of many files, and the formats they show, without a job for each file."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .formats import Format

#: Bytes read at a time, and at most, for a file's first lines; files whose first lines are judged in one job.
STEP, MOST, FILES = 1 << 16, 1 << 24, 2_000


def opened(spark: SparkSession, place):
    """A stream of a file's bytes, by the file system's own client; None for what is no single file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    system = place.getFileSystem(conf)
    if not (system.exists(place) and system.getFileStatus(place).isFile()):
        return None
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    stream = system.open(place)
    return codec.createInputStream(stream) if codec is not None else stream


def first_sign(spark: SparkSession, uri: str) -> str:
    """The first character of a file that is not white space; none if there is none in its first ``MOST`` bytes."""
    stream = opened(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)))
    try:
        for _ in range(MOST // STEP):
            data = bytes(stream.readNBytes(STEP))
            if not data or data.strip():
                return data.strip()[:1].decode("latin-1")
        return ""
    finally:
        stream.close()


def first_lines(spark: SparkSession, path: str, n: int) -> list[str] | None:
    """The first ``n`` lines that are not empty; None for what is no single file."""
    stream = opened(spark, spark._jvm.org.apache.hadoop.fs.Path(path))
    if stream is None:
        return None
    try:
        data, lines = b"", []
        while len(data) < MOST:
            more = bytes(stream.readNBytes(STEP))
            data += more
            whole = data.split(b"\n") if not more else data.split(b"\n")[:-1]
            lines = [line for line in (x.removesuffix(b"\r") for x in whole) if line]
            if not more or len(lines) >= n:
                break
    finally:
        stream.close()
    return [line.decode("utf-8", "replace") for line in lines[:n]]


def detected(spark: SparkSession, paths: list[str], formats: list[Format], n: int) -> dict[str, str | None]:
    """By single file: the name of the first format that takes more than half of its first lines; "" if it has none, None if no format does.

    Heads of ``FILES`` files at a time are read by threads of the driver, at most
    ``n`` lines each, and judged by all formats in one job.
    """
    out: dict[str, str | None] = {}
    for at in range(0, len(paths), FILES):
        own = paths[at : at + FILES]
        with ThreadPoolExecutor(16) as pool:
            heads = dict(zip(own, pool.map(lambda p: first_lines(spark, p, n), own), strict=True))
        out |= {p: "" for p, lines in heads.items() if lines == []}
        rows = [(p, line) for p, lines in heads.items() for line in lines or []]
        if not rows:
            continue
        votes = [F.count_if(f.parse(F.col("line")).isNotNull()).alias(f"v{i}") for i, f in enumerate(formats)]
        for r in spark.createDataFrame(rows, "path string, line string").groupBy("path").agg(F.count("*").alias("n"), *votes).collect():  # a row a file
            out[r.path] = next((f.name for i, f in enumerate(formats) if 2 * r[f"v{i}"] > r.n), None)
    return out
