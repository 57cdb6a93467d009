"""Log files from the command line: ``python -m timberline FILE... [--format F] [--jq E] [--quick W] [--sort time:desc] [--limit N]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.jq.compiler import record_json
from .plans.query import LogQuery
from .sources.formats import Registry
from .sources.reader import load_lines, read_logs


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="timberline", description="Print the matching records of log files as JSON lines.")
    parser.add_argument("files", nargs="*", help="files or folders; standard input without any, or for -")
    parser.add_argument("--format", default="auto", help="a format's name; detected if not given")
    parser.add_argument("--plugins", help="folder of plugin formats")
    parser.add_argument("--jq", default="", help="jq expression whose first output decides")
    parser.add_argument("--quick", default="", help="words that all occur in a record")
    parser.add_argument("--sort", action="append", default=[], metavar="COLUMN[:desc]", help="time, level or msg")
    parser.add_argument("--limit", type=int, default=100, help="records to print")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    registry = Registry()
    for warning in registry.load_plugins(args.plugins):
        print(f"warning: {warning}", file=sys.stderr)
    if args.format != "auto" and registry.by_name(args.format) is None:
        print(f"unknown format {args.format!r}; there are {', '.join(registry.names())}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("timberline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.files in ([], ["-"]):
        logs = load_lines(spark, sys.stdin.read().split("\n"), args.format, registry)
    else:
        logs = read_logs(spark, args.files, args.format, registry)
    sort = tuple((c, way == "desc") for c, _, way in (s.partition(":") for s in args.sort))
    found = LogQuery(jq=args.jq, quick=args.quick, sort=sort, end=args.limit).run(logs.records).select(record_json().alias("j"), F.col("file"))
    for row in found.collect():  # at most --limit
        print(row.j)
    print(" ".join(f"{k}={v}" for k, v in logs.summary().head().asDict().items()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
