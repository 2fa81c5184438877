"""python -m ebbline inspect|transactions|changes|blackhole PATH: JSON lines of an archive, or its count."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import replay


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ebbline")
    parser.add_argument("command", choices=("inspect", "transactions", "changes", "blackhole"))
    parser.add_argument("path")
    parser.add_argument("--include", action="append", default=[])
    parser.add_argument("--ignore", action="append", default=[])
    parser.add_argument("--executed", default="")
    parser.add_argument("--stop-at", default="")
    parser.add_argument("--stop-after", type=int)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ebbline").getOrCreate()
    events = replay.read(spark, given.path)
    if given.command == "blackhole":
        print(events.count())
        return 0
    rows = events if given.command == "inspect" else replay.groups(events) if given.command == "transactions" else replay.changes(events, given.include, given.ignore, given.executed, given.stop_at, given.stop_after)
    for line in rows.toJSON().toLocalIterator():
        sys.stdout.write(line + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
