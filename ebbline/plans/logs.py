"""Queries over binary logs that are written from the standard tables and read back through the data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import replay, scratch
from ..catalog import query
from ..functions import ddl
from ..operators import gtid
from ..sources import archive, binlog, binlog_writer, tables

SID = "00112233-4455-6677-8899-aabbccddeeff"
COLUMNS = [("id", "bigint"), ("kind", "varchar"), ("value", "double"), ("flag", "tinyint"), ("n", "int")]
PER_GROUP, FILES = 5, 4


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a row change of its user: groups of five changes, four files, nulls and negative numbers."""
    log = tables.event_log(spark, sf_dir)
    row = F.struct(F.col("user_id").alias("id"), F.when(F.col("seq") % 9 != 0, F.concat("event_type", F.lit("é"))).alias("kind"), "value", (F.col("seq") % 200 - 100).cast("tinyint").alias("flag"), F.when(F.col("seq") % 4 != 1, -F.col("seq")).cast("int").alias("n"))
    old = F.struct(F.col("user_id").alias("id"), F.lit("old").alias("kind"), F.lit(0.5).alias("value"), F.lit(1).cast("tinyint").alias("flag"), F.lit(None).cast("int").alias("n"))
    group = F.expr(f"seq div {PER_GROUP}")
    return log.select("seq", "op", (group + 1).alias("gno"), F.when(F.col("op") != "insert", old).alias("before"), F.when(F.col("op") != "delete", row).alias("after"))


def written_log(spark: SparkSession, sf_dir: str) -> str:
    """Writes the log of the events and returns its folder."""
    folder = scratch.shared_dir(spark, "log")
    changes = _changes(spark, sf_dir)
    top = changes.agg(F.max("gno")).first()[0]
    binlog_writer.write_log(changes.withColumn("file_no", F.least(F.expr(f"(gno - 1) * {FILES} div {top} + 1"), F.lit(FILES))), folder, COLUMNS, "app", "users", SID, FILES)
    return folder


_ROW = "user_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_type || 'é' END AS kind, value, event_id % 200 - 100 AS flag, CASE WHEN event_id % 4 <> 1 THEN -event_id END AS n"
_TABLE = "CREATE TABLE users (id BIGINT PRIMARY KEY, kind VARCHAR(1000), value DOUBLE, flag TINYINT, n INT)"


@query(
    "src1_binlog_changes",
    f"""
    SELECT gtid, op, id, CASE WHEN op <> 'delete' THEN kind END AS kind, CASE WHEN op <> 'delete' THEN round(value, 6) END AS value, CASE WHEN op <> 'delete' THEN flag END::INTEGER AS flag, CASE WHEN op <> 'delete' THEN n END AS n, CASE WHEN op <> 'insert' THEN 'old' END AS before_kind
    FROM (SELECT '{SID}:' || (event_id // {PER_GROUP} + 1) AS gtid, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, {_ROW} FROM events)
    """,
)
def src1_binlog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row changes written as files and decoded again: frames, checksums, table maps, row images, transactions and typed columns."""
    table = ddl.parse(_TABLE).detail["table"]
    rows = replay.typed(replay.changes(replay.read(spark, written_log(spark, sf_dir)), include=["app.us%"]), table, "app", "users")
    return rows.select("gtid", "op", F.coalesce("after.id", "before.id").alias("id"), "after.kind", F.round("after.value", 6).alias("value"), "after.flag", "after.n", F.col("before.kind").alias("before_kind"))


@query(
    "src5_replay_snapshot",
    f"SELECT * REPLACE (round(value, 6) AS value) FROM (SELECT {_ROW} FROM events WHERE event_id // {PER_GROUP} < 50 AND NOT (event_id // {PER_GROUP} BETWEEN 9 AND 19) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error')",
)
def src5_replay_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after groups 1 to 50, without those that were executed before."""
    table = ddl.parse(_TABLE).detail["table"]
    changes = replay.changes(replay.read(spark, written_log(spark, sf_dir)), executed=f"{SID}:10-20", stop_at=f"{SID}:1-9:21-50")
    return replay.snapshot(changes, table, "app", "users").withColumn("value", F.round("value", 6))


@query("dec1_event_frames", f"SELECT kind, CAST(n AS BIGINT) AS n, true AS adjoin, true AS hashes FROM (SELECT 'rows' AS kind, count(*) AS n FROM events UNION ALL SELECT 'table_map', count(*) FROM events UNION ALL SELECT k, count(DISTINCT event_id // {PER_GROUP}) FROM events, (VALUES ('gtid'), ('begin'), ('xid')) v(k) GROUP BY k UNION ALL SELECT 'fde', {FILES} UNION ALL SELECT 'rotate', {FILES} - 1)")
def dec1_event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of decoded events by kind, that they adjoin within their files, and that fingerprints are those of the files' bytes."""
    folder = written_log(spark, sf_dir)
    events = replay.read(spark, folder).select("file", "offset", "next_pos", "kind", "sha256")
    seen = binlog.same_bytes(events, folder)
    # one row for each file and kind: its span, from which adjoining follows
    spans = seen.groupBy("file", "kind").agg(F.count("*").alias("n"), F.every("same").alias("same"), F.min("offset").alias("low"), F.sum(F.col("next_pos") - F.col("offset")).alias("bytes"), F.max("next_pos").alias("high"))
    whole = Window.partitionBy("file")
    adjoin = (F.min("low").over(whole) == 4) & (F.sum("bytes").over(whole) == F.max("high").over(whole) - 4)
    return spans.withColumn("adjoin", adjoin).groupBy("kind").agg(F.sum("n").alias("n"), F.every("adjoin").alias("adjoin"), F.every("same").alias("hashes"))


@query("src3_adjacency", "SELECT 'bin.000003' AS file, 'gap' AS code UNION ALL SELECT 'bin.000003', 'rotation'")
def src3_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive whose second file is left out."""
    events = replay.read(spark, written_log(spark, sf_dir)).where("file <> 'bin.000002'").select("file", "offset", "kind", "sql")
    files = spark.createDataFrame([(0, "bin.000001"), (1, "bin.000003"), (2, "bin.000004")], "number int, file string")
    return archive.adjacency(events, files)


@query("src4_validate", "SELECT 'baseline does not cover the first file''s previous set' AS reason UNION ALL SELECT 'archive and baseline do not cover the stop set'")
def src4_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that begins after number 7 on a baseline of 1 to 5, with a stop beyond its end."""
    groups = replay.groups(replay.read(spark, written_log(spark, sf_dir))).select(F.lit(SID).alias("sid"), F.lit("").alias("tag"), F.regexp_extract("gtid", r"(\d+)$", 1).cast("long").alias("gno"))
    frame = lambda text: gtid.frame(spark, f"{SID}:{text}")
    available = gtid.islands(groups.where("gno > 7"), ["sid", "tag"], "gno")
    reasons = archive.validate(spark, available, frame("1-5"), frame("1-7"), frame("1-1000000000"))
    return spark.createDataFrame([(r,) for r in reasons], "reason string")


@query("src6_stream_of_files", "SELECT count(*) AS row_events, count(DISTINCT event_id // 5) AS groups FROM events")
def src6_stream_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream."""
    binlog.register(spark)
    folder = written_log(spark, sf_dir)
    out = scratch.shared_dir(spark, "stream")
    stream = spark.readStream.format("binlog").option("tables", "app.users").load(folder).select("file", "offset", "kind")
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    return found.agg(F.count_if(F.col("kind") == "rows").alias("row_events"), F.count_if(F.col("kind") == "gtid").alias("groups"))
