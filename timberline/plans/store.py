"""Sorted results written once, so that a page reads the parts it needs and nothing is parsed or sorted again.

``open_result`` writes what a query finds, in its order, as Parquet parts of a
bounded number of rows.  A manifest beside them has a row a part: where it starts
in the order, its rows, its least and greatest time, and, if asked for, a Bloom
filter of the three-letter pieces of its texts.  It is written last and alone
makes a result count, so a write that fails leaves nothing that is read.  A result
is found again by the query and the input's files with their sizes and times.

Page N takes the parts that overlap it from the manifest, whatever N is, and
orders only the page's rows.  ``search`` leaves out parts by time and by words;
it tests every row of the parts that are left, so it loses none.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import values
from ..functions.text import folded
from ..operators import filters
from ..session import shared_folder
from .query import LogQuery

ROWS_PER_PART = 20_000
#: Bits of a part's filter; as many as Spark's bitmaps have.
BITS = 32_768
PIECE = 3
#: Words of these signs alone may stand in the clock, which has no pieces in the filter.
CLOCK = re.compile(r"[0-9:.]*")


def listing(records: DataFrame) -> list[str]:
    """The input's files with their sizes and times of change."""
    spark, out = records.sparkSession, []
    for path in sorted(records.inputFiles()):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
        out.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return out


def name_of(records: DataFrame, query: LogQuery, *more) -> str:
    """A name that differs where the query, the input or its files do."""
    found = query.matching(records)
    # variables of lambdas are numbered anew each time they are made
    tests = [re.sub(r"\b([a-z])_\d+\b", r"\1", f._jc.toString()) for f in query.filters]
    parts = [found.semanticHash(), query.jq, query.quick, query.sort, query.group, query.expanded, query.place, tests, found.schema.json(), more, listing(records)]
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def pieces(text: Column) -> Column:
    """Places in the filter of a text's three-letter pieces, in any case."""

    def use(own: Column) -> Column:
        starts = F.when(F.length(own) >= PIECE, F.sequence(F.lit(1), F.length(own) - (PIECE - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(own, i, F.lit(PIECE))), F.lit(BITS)))

    return values.bound(folded(text), use)


def word_pieces(full: bool = False) -> Column:
    """Of all texts that ``quick`` looks at but the clock."""
    texts = F.concat(F.array("msg", "level"), F.transform("attrs", lambda a: a["key"]), F.transform("attrs", lambda a: values.display_text(a["value"], full)))
    return F.array_distinct(F.flatten(F.transform(texts, pieces)))


@dataclass(frozen=True)
class Result:
    """A written result.  ``rows`` gives any stretch of it, with ``rank`` from 1 on.  ``full``: words are sought in all digits of whole numbers."""

    spark: SparkSession
    folder: str
    schema: StructType
    full: bool = False

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    @property
    def total(self) -> int:
        return self.manifest.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]

    def parts(self, parts: DataFrame) -> DataFrame:
        """The rows of some parts, with their ranks."""
        own = [(r.part, r.start) for r in parts.select("part", "start").collect()]  # a name and a number for each part that is read
        if not own:
            return self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("rank", LongType())]))
        starts = F.broadcast(self.spark.createDataFrame(own, "_part string, _start bigint"))
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{part}" for part, _ in own))
        rows = rows.select(F.struct("*").alias("_r"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return rows.join(starts, F.col("_file") == F.col("_part")).select("_r.*", (F.col("_start") + F.col("_row") + 1).alias("rank"))

    def rows(self, start: int, end: int) -> DataFrame:
        """The rows from ``start`` (counted from 0) to before ``end``, in order: one task, which holds no more than these."""
        near = self.manifest.where((F.col("start") < end) & (F.col("start") + F.col("n") > start))
        return self.parts(near).where((F.col("rank") > start) & (F.col("rank") <= end)).coalesce(1).sortWithinPartitions("rank")

    def page(self, number: int, size: int = 100) -> DataFrame:
        return self.rows(number * size, (number + 1) * size)

    def near(self, quick: str = "", after=None, before=None) -> DataFrame:
        """The manifest of the parts that may hold rows of a time and with all words."""
        tests = [F.lit(True)]
        if after is not None:
            tests.append(F.col("latest") >= F.lit(after).cast("timestamp"))
        if before is not None:
            tests.append(F.col("earliest") <= F.lit(before).cast("timestamp"))
        manifest = self.manifest
        if "words" in manifest.columns:
            for word in quick.split():
                if not CLOCK.fullmatch(word):
                    tests.append(F.forall(pieces(F.lit(word)), lambda bit: F.getbit(F.conv(F.hex(F.substring(F.col("words"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint"), F.pmod(bit, F.lit(8)).cast("int")) == 1))
        return manifest.where(reduce(Column.__and__, tests))

    def search(self, quick: str = "", after=None, before=None) -> DataFrame:
        """The rows that hold all words, from ``after`` to ``before``, with their ranks."""
        rows = self.parts(self.near(quick, after, before))
        if quick.strip():
            rows = rows.where(filters.quick(quick, self.full))
        return rows if after is None and before is None else rows.where(filters.time_filter(after, before))


def open_result(records: DataFrame, query: LogQuery, folder: str | None = None, rows_per_part: int = ROWS_PER_PART, words: bool = False, full: bool = False) -> Result:
    """The result of a query of records, without its window: found under ``folder``, or written there.

    ``folder``: one that all machines share; that of ``spark.checkpoint.dir`` if not
    given.  ``words``: also write filters for ``search`` by words.  ``full``: words
    are sought in whole numbers with all their digits, not in their ``%g`` form.
    """
    spark = records.sparkSession
    if len(query.expanded) < len(query.group):
        raise ValueError("groups are counted, not paged")
    if "rank" in records.columns:
        raise ValueError("rank is the name of the place in the result")
    query = replace(query, start=0, end=None)
    own = f"{(folder or shared_folder(spark)).rstrip('/')}/result-{name_of(records, query, rows_per_part, words, *["full"] * full)}"
    found = query.matching(records)
    result = Result(spark, own, found.schema, full)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{own}/manifest/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return result
    query.run(records).write.mode("overwrite").option("maxRecordsPerFile", rows_per_part).parquet(f"{own}/data")
    written = spark.read.schema(found.schema).parquet(f"{own}/data").select("time", "level", "msg", "attrs", F.col("_metadata.file_name").alias("part"))
    by_part = written.groupBy("part").agg(F.count("*").alias("n"), F.min("time").alias("earliest"), F.max("time").alias("latest"))
    # parts are named by their task and their number in it, which may have more digits than others; this counts on over one row a part
    places = [F.regexp_extract("part", pattern, 1).cast("bigint") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")]
    before = F.sum("n").over(Window.orderBy(*places, "part").rowsBetween(Window.unboundedPreceding, -1))
    manifest = by_part.withColumn("start", F.coalesce(before, F.lit(0)))
    if words:
        bits = written.select("part", F.explode(word_pieces(full)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("words"))
        manifest = manifest.join(bits, "part", "left").withColumn("words", F.coalesce("words", F.lit(bytes(BITS // 8))))
    manifest.write.mode("overwrite").parquet(f"{own}/manifest")
    return result
