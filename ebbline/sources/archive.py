"""Archives of binary logs: inventory, adjacency and completeness, before anything is written."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gtid, running
from . import binlog

MAX_FILES = 10_000


class ArchiveError(ValueError):
    """An archive that cannot be replayed."""


@dataclass(frozen=True)
class Inventory:
    path: str
    files: tuple[str, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, f) for i, f in enumerate(self.files)], "number int, file string")


def inventory(path: str, first: str | None = None, most: int = MAX_FILES) -> Inventory:
    """The files of manifest.json (in its order), or the numbered files of a folder by number, from ``first`` on."""
    from pyarrow import fs

    filesystem, inner = binlog._open(path)
    manifest = f"{inner.rstrip('/')}/manifest.json"
    if filesystem.get_file_info(manifest).type == fs.FileType.File:
        with filesystem.open_input_stream(manifest) as stream:
            names = [f["name"] if isinstance(f, dict) else f for f in json.loads(stream.read())["files"]]
    else:
        names = [f.rsplit("/", 1)[-1] for f in binlog._files(path)]
        names.sort(key=lambda n: int(re.search(r"(\d+)$", n)[1]))
    if first is not None:
        if first not in names:
            raise ArchiveError(f"no file {first}")
        names = names[names.index(first) :]
    if not names or len(names) > most:
        raise ArchiveError(f"{len(names)} files")
    return Inventory(path, tuple(names))


def adjacency(events: DataFrame, files: DataFrame) -> DataFrame:
    """(file, code): files that the one before doesn't lead to (numbers, rotation) and files that end inside a group.

    events: file, offset, kind, sql (of a rotate: name:position).
    """
    ends = events.groupBy("file").agg(
        F.max_by("kind", "offset").alias("last"),
        F.max_by(F.when(F.col("kind") == "rotate", F.regexp_extract("sql", r"^(.*):\d+$", 1)), F.when(F.col("kind") == "rotate", F.col("offset"))).alias("target"),
        F.max(F.when(F.col("kind").isin("gtid", "anonymous"), F.col("offset"))).alias("opened"),
        F.max(F.when(F.col("kind").isin("xid", "commit", "rollback", "statement"), F.col("offset"))).alias("closed"),
    )
    number = F.regexp_extract("file", r"(\d+)$", 1).cast("long")
    listed = files.join(ends, "file", "left").withColumn("n", number)
    seen = running.previous(listed, [], "number", _target=F.col("target"), _n=F.col("n"), _last=F.col("last"))
    codes = F.array_compact(
        F.array(
            F.when(F.col("_n").isNotNull() & (F.col("n") != F.col("_n") + 1), "gap"),
            F.when(F.col("_target").isNotNull() & (F.col("_target") != F.col("file")), "rotation"),
            F.when(F.col("opened").isNotNull() & (F.col("closed").isNull() | (F.col("closed") < F.col("opened"))), "incomplete"),
            F.when(F.col("last").isNull(), "empty"),
        )
    )
    return seen.select("file", F.explode(codes).alias("code"))


def validate(spark: SparkSession, available: DataFrame, baseline: DataFrame, previous: DataFrame, stop: DataFrame | None = None) -> list[str]:
    """Reasons against a replay: the baseline must cover what was executed before the first file, and baseline and archive the stop set."""
    keys = ["sid", "tag"]
    reasons = []
    if not gtid.uncovered(previous, gtid.union(baseline, keys), keys).isEmpty():
        reasons.append("baseline does not cover the first file's previous set")
    if stop is not None and not gtid.uncovered(stop, gtid.union(available.unionByName(baseline), keys), keys).isEmpty():
        reasons.append("archive and baseline do not cover the stop set")
    return reasons


def relay_frame(metadata: dict[str, Any], raw: bytes) -> bytes:
    """One record of a relay log: two lengths (32 bits, little endian), metadata as JSON, the raw event."""
    head = json.dumps(metadata, sort_keys=True).encode()
    return len(head).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + head + raw


def read_relay(data: bytes) -> list[tuple[int, dict[str, Any], bytes]]:
    """(offset, metadata, raw event) of each record; a torn last record is an error."""
    out, at = [], 0
    while at < len(data):
        head, body = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        end = at + 8 + head + body
        if at + 8 > len(data) or end > len(data):
            raise ArchiveError(f"torn record at {at}")
        out.append((at, json.loads(data[at + 8 : at + 8 + head]), data[at + 8 + head : end]))
        at = end
    return out


def preamble(events: DataFrame, file: str) -> str | None:
    """The numbers executed before a file: its previous set, null where it has none. Only that file is read."""
    row = events.where((F.col("file") == file) & (F.col("kind") == "previous_gtids")).select("gtid").first()
    return row[0] if row else None
