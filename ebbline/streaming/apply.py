"""Change streams applied to snapshots: stateful assembly, exactly-once batches, and the noop sink.

``SnapshotSink`` is a foreachBatch writer. Each batch is folded to one change for
each key and written under its batch id, so a batch that is run again replaces
itself; the snapshot is the fold over all batches. Whole groups whose number an
earlier batch applied or skipped are dropped; every row of a new group stays.
``compact`` folds the batches so far into a base and their numbers into intervals, so
neither a batch nor a snapshot reads more than one base and the batches since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import scratch
from ..operators import filters, fold, gtid, transactions


class SinkError(ValueError):
    """A batch that may not be applied."""


class SnapshotSink:
    """Applies batches of changes (keys, seq, op, columns) below a shared folder.

    seq orders the row changes and is unique. number (sid, gno): the source and number of each row's
    group; a number that is covered is not applied again, and one that returns with other places than
    before (while its batch is not compacted) is refused. old_keys: the keys before each change, where they may move.
    code: the error for which a group is skipped (null: it is applied). A skipped group changes nothing; its
    audit row and its coverage are one row of one commit. Rows without a number are always applied.
    """

    def __init__(self, folder: str, keys: list[str], seq: str, op: str, columns: list[str], number: tuple[str, str] | None = None, old_keys: list[str] | None = None, code: str | None = None) -> None:
        if code and not number:
            raise SinkError("skips need numbers")
        self.folder, self.keys, self.seq, self.op, self.columns, self.number, self.old_keys, self.code = folder, keys, seq, op, columns, number, old_keys, code

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = self._base(spark)
        if batch_id <= base:
            return  # a base holds it already
        if self.number:
            batch = self._fresh(spark, batch, batch_id, base)
        if self.code:
            batch = batch.where(F.col(self.code).isNull())
        self._folded(batch).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")

    def _fresh(self, spark: SparkSession, batch: DataFrame, batch_id: int, base: int) -> DataFrame:
        """The rows of groups that no other batch has; writes the numbers of this batch."""
        sid, gno = self.number
        batch = scratch.written(batch, "batch")  # its source is read once
        groups = batch.where(F.col(gno).isNotNull()).groupBy(sid, gno).agg(F.min(self.seq).alias("first"), F.max(self.seq).alias("last"), F.max(self.code or F.lit(None).cast("string")).alias("code"))
        recent = self._read(spark, "numbers", base, batch_id)
        if recent is not None:
            there = recent.select(F.col(sid).alias("_s"), F.col(gno).alias("_g"), F.col("first").alias("_first"), F.col("last").alias("_last"))
            known = groups.join(there, F.col(sid).eqNullSafe(F.col("_s")) & (F.col(gno) == F.col("_g")))
            moved = known.where("first <> _first OR last <> _last").select(sid, gno).first()
            if moved is not None:
                raise SinkError(f"number {tuple(moved)} returns with another place")
            groups = groups.join(there, F.col(sid).eqNullSafe(F.col("_s")) & (F.col(gno) == F.col("_g")), "left_anti")
        if base >= 0:
            groups = filters.without_covered(groups, spark.read.parquet(f"{self.folder}/covered/base={base}"), [sid], gno)
        groups.write.mode("overwrite").parquet(f"{self.folder}/numbers/batch={batch_id}")
        new = spark.read.schema(groups.schema).parquet(f"{self.folder}/numbers/batch={batch_id}").select(F.col(sid).alias("_s"), F.col(gno).alias("_g"))
        numbered = batch.where(F.col(gno).isNotNull()).join(new, F.col(sid).eqNullSafe(F.col("_s")) & (F.col(gno) == F.col("_g")), "left_semi")
        return numbered.unionByName(batch.where(F.col(gno).isNull()))

    def _folded(self, batch: DataFrame) -> DataFrame:
        order = [self.seq]
        if self.old_keys:
            new = [f"_new_{k}" for k in self.keys]
            for k, n in zip(self.keys, new, strict=True):
                batch = batch.withColumnRenamed(k, n)
            batch = fold.split_key_moves(batch.withColumnRenamed(self.op, "_op"), self.old_keys, new, self.keys, "_op").withColumnRenamed("op", self.op)
            order = [self.seq, "sub"]
        newest = batch.groupBy(*self.keys).agg(F.max_by(F.struct(self.seq, self.op, *self.columns), F.struct(*order)).alias("_l"))
        return newest.select(*self.keys, "_l.*")

    def _path(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _numbers_of(self, spark: SparkSession, name: str, prefix: str) -> list[int]:
        """Ids of the whole tables ``prefix=id`` below a folder: those with the mark of a finished write."""
        files, path = self._path(spark, name)
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith(f"{prefix}=")]
        return sorted(int(p.getName().partition("=")[2]) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _base(self, spark: SparkSession) -> int:
        """The last batch of the newest base; -1 without one. Covered numbers are written before the base, so a base is whole."""
        return max(self._numbers_of(spark, "base", "base"), default=-1)

    def _read(self, spark: SparkSession, name: str, above: int, below: int | None = None) -> DataFrame | None:
        """The tables of the batches above one and below another."""
        ids = [i for i in self._numbers_of(spark, name, "batch") if i > above and (below is None or i < below)]
        return spark.read.parquet(*[f"{self.folder}/{name}/batch={i}" for i in ids]) if ids else None

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """The table after all batches so far."""
        base = self._base(spark)
        changes = self._read(spark, "changes", base)
        if base >= 0:
            held = spark.read.parquet(f"{self.folder}/base/base={base}")
            changes = held if changes is None else changes.unionByName(held)
        if changes is None:
            raise SinkError("no batch yet")
        return fold.keyed_snapshot(changes, self.keys, self.seq, self.op, self.columns)

    def skips(self, spark: SparkSession) -> DataFrame | None:
        """The audit of skipped groups: source, number, places and code; compaction keeps it."""
        parts = []
        base = self._base(spark)
        recent = self._read(spark, "numbers", base)
        if recent is not None:
            parts.append(recent.where("code IS NOT NULL"))
        if base >= 0:
            parts.append(spark.read.parquet(f"{self.folder}/skipped/base={base}"))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def compact(self, spark: SparkSession) -> None:
        """Folds everything so far into one base. Deleted keys leave it. An interrupted compaction is begun again or goes unseen."""
        base = self._base(spark)
        ids = [i for i in self._numbers_of(spark, "changes", "batch") if i > base]
        if not ids:
            return
        newest = ids[-1]
        if self.number:
            sid, gno = self.number
            recent = self._read(spark, "numbers", base)
            spans = gtid.islands(recent, [sid], gno)
            if base >= 0:
                spans = gtid.union(spans.unionByName(spark.read.parquet(f"{self.folder}/covered/base={base}")), [sid])
            spans.write.mode("overwrite").parquet(f"{self.folder}/covered/base={newest}")
            self.skips(spark).write.mode("overwrite").parquet(f"{self.folder}/skipped/base={newest}")
        self.snapshot(spark).withColumn(self.op, F.lit("insert")).write.mode("overwrite").parquet(f"{self.folder}/base/base={newest}")
        for name in ("changes", "numbers"):
            for i in self._numbers_of(spark, name, "batch"):
                if i <= newest:
                    files, path = self._path(spark, f"{name}/batch={i}")
                    files.delete(path, True)
        for name in ("base", "covered", "skipped"):
            for i in self._numbers_of(spark, name, "base"):
                if i < newest:
                    files, path = self._path(spark, f"{name}/base={i}")
                    files.delete(path, True)


STATE = "state string, first long, events long, bytes long, rows long, last long"
OUTPUT = "file string, first long, last long, events long, bytes long, row_events long, outcome string, error string"


def assemble_file(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The assembler's machine over one file's events in order; the open group lives in the state between batches.

    After an error the file gives nothing more (state poisoned).
    """
    name, first, events, size, rows, last = state.get if state.exists else ("idle", -1, 0, 0, 0, -1)
    out = []
    frame = pd.concat(list(batches)).sort_values("offset")
    for offset, kind, bytes_ in zip(frame["offset"].tolist(), frame["kind"].tolist(), frame["size"].tolist(), strict=True):
        if name == "poisoned":
            break
        if offset <= last:
            error = "sequence"
        else:
            following = transactions.MACHINE.get((name, kind)) or (transactions.MACHINE.get((name, "rows_end")) if kind == "rows_end" else None)
            error = None if following else "sequence"
        if error is None:
            if kind in transactions.STARTS:
                first, events, size, rows = offset, 0, 0, 0
            events, size, rows, last = events + 1, size + bytes_, rows + (kind in ("rows", "rows_end")), offset
            if kind == "rollback" and rows:
                error = "sequence"
            elif events > transactions.MAX_EVENTS or size > transactions.MAX_BYTES:
                error = "limit"
        if error:
            out.append((key[0], first, offset, events, size, rows, "incomplete", error))
            name = "poisoned"
            break
        if kind in transactions.ENDS and first >= 0:
            outcome = {"xid": "committed", "commit": "committed", "rollback": "rolledBack"}.get(kind, "statement")
            out.append((key[0], first, offset, events, size, rows, outcome, None))
            first = -1
        name = following
    state.update((name, first, events, size, rows, last))
    yield pd.DataFrame(out, columns=["file", "first", "last", "events", "bytes", "row_events", "outcome", "error"])


def assemble_stream(events: DataFrame) -> DataFrame:
    """A stream of events (file, offset, kind, size) -> transactions as they complete."""
    return events.groupBy("file").applyInPandasWithState(assemble_file, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def discard(changes: DataFrame, checkpoint: str) -> int:
    """Reads and counts a stream without keeping anything; returns the number of rows."""
    query = changes.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def run_available(stream: DataFrame, sink: SnapshotSink, checkpoint: str) -> None:
    """Applies everything that is there and stops at a batch boundary."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
