"""Queries over keyed and keyless snapshots of change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import fold
from ..sources import tables

_OP = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"


@query(
    "mut6_snapshot_lww",
    """
    SELECT user_id, event_id AS last_seq, event_type AS last_op, round(value, 6) AS value
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'
    """,
)
def mut6_snapshot_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    return fold.keyed_snapshot(log, ["user_id"], "seq", "op", ["event_type", "value"]).selectExpr("user_id", "seq AS last_seq", "event_type AS last_op", "round(value, 6) AS value")


@query(
    "mut1_flatten_rows",
    """
    SELECT event_id // 7 AS txn_seq, CAST(row_number() OVER (PARTITION BY event_id // 7 ORDER BY event_id) - 1 AS INTEGER) AS row_ordinal, event_id AS seq, user_id
    FROM events
    """,
)
def mut1_flatten_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    # a group holds at most seven events here, as a transaction holds a bounded number of rows
    groups = log.groupBy(F.expr("seq div 7").alias("txn_seq")).agg(F.sort_array(F.collect_list(F.struct("seq", "user_id"))).alias("rows"))
    return fold.flatten(groups, "rows", ["txn_seq"])


@query(
    "mut2_duplicate_inserts",
    f"""
    SELECT event_id AS seq, user_id FROM (SELECT *, {_OP} AS op, lag({_OP}) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    WHERE op = 'insert' AND before IS NOT NULL AND before <> 'delete'
    """,
)
def mut2_duplicate_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.duplicate_inserts(tables.event_log(spark, sf_dir), ["user_id"], "seq", "op").select("seq", "user_id")


@query(
    "mut3_update_fold",
    """
    SELECT user_id, max(event_id) AS last_seq, count(*) AS updates, round(arg_max(value, event_id), 6) AS value
    FROM events WHERE event_type NOT IN ('signup', 'error') GROUP BY user_id
    """,
)
def mut3_update_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.update_fold(tables.event_log(spark, sf_dir), ["user_id"], "seq", "op", ["value"]).withColumn("value", F.round("value", 6))


_MOVES = f"""
    WITH log AS (SELECT event_id AS seq, {_OP} AS op, user_id AS old_key, CASE WHEN event_id % 7 = 0 THEN user_id + 1000 ELSE user_id END AS new_key, value FROM events),
    split AS (
      SELECT seq, 0 AS sub, 'delete' AS op, old_key AS k, value FROM log WHERE op = 'update' AND old_key <> new_key
      UNION ALL SELECT seq, 1, 'insert', new_key, value FROM log WHERE op = 'update' AND old_key <> new_key
      UNION ALL SELECT seq, 1, op, CASE WHEN op = 'delete' THEN old_key ELSE new_key END, value FROM log WHERE NOT (op = 'update' AND old_key <> new_key))
"""


def _moving_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    moved = log.select("seq", "op", F.col("user_id").alias("old_key"), F.when(F.col("seq") % 7 == 0, F.col("user_id") + 1000).otherwise(F.col("user_id")).alias("new_key"), "value")
    return fold.split_key_moves(moved, ["old_key"], ["new_key"], ["k"], "op")


@query("mut4_key_move", _MOVES + "SELECT k, seq * 2 + sub AS last_order, round(value, 6) AS value FROM split QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC, sub DESC) = 1 AND op <> 'delete'")
def mut4_key_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _moving_log(spark, sf_dir).withColumn("last_order", F.col("seq") * 2 + F.col("sub"))
    return fold.keyed_snapshot(split, ["k"], "last_order", "op", ["value"]).select("k", "last_order", F.round("value", 6).alias("value"))


@query("mut5_deleted_keys", f"SELECT user_id, max(event_id) AS deleted_at FROM events GROUP BY user_id HAVING arg_max({_OP}, event_id) = 'delete'")
def mut5_deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.deleted_keys(tables.event_log(spark, sf_dir), ["user_id"], "seq", "op")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]


def _bag_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a keyless log: each row inserted; of returned rows with an even part key, one deleted again."""
    lines = tables.table(spark, sf_dir, "lineitem").select(*_LINE)
    gone = lines.where("l_returnflag = 'R' AND l_partkey % 2 = 0")
    return lines.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))


@query(
    "mut7_bag_fold",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, CAST(sum(s) AS BIGINT) AS n, sum(s) < 0 AS broken FROM (
      SELECT *, 1 AS s FROM lineitem UNION ALL SELECT *, -1 FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0)
    GROUP BY 1, 2, 3, 4, 5, 6 HAVING sum(s) <> 0
    """,
)
def mut7_bag_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.bag_fold(_bag_log(spark, sf_dir), _LINE, "sign")


@query(
    "mut7_bag_legality",
    """
    SELECT event_id, user_id, event_type FROM (
      SELECT *, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS remaining FROM events)
    WHERE remaining < 0
    """,
)
def mut7_bag_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"))
    return fold.bag_legality(events, ["user_id", "event_type"], "event_id", "sign").select("event_id", "user_id", "event_type")


@query(
    "mut7_bag_rows",
    "SELECT l_returnflag, count(*) AS live_rows FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_partkey % 2 = 0) GROUP BY l_returnflag",
)
def mut7_bag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = fold.bag_fold(_bag_log(spark, sf_dir), _LINE, "sign").drop("broken")
    return fold.expand_bag(bag, "n").groupBy("l_returnflag").agg(F.count("*").alias("live_rows"))


@query(
    "mut9_generated_check",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS mismatches FROM lineitem
    WHERE CASE WHEN l_orderkey % 11 = 0 THEN l_quantity * 2 + 1 ELSE l_quantity * 2 END IS DISTINCT FROM l_quantity * 2 GROUP BY 1, 2, 3
    """,
)
def mut9_generated_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem")
    stored = lines.withColumn("g", F.when(F.col("l_orderkey") % 11 == 0, F.col("l_quantity") * 2 + 1).otherwise(F.col("l_quantity") * 2))
    return fold.generated_mismatch(stored, "g", F.col("l_quantity") * 2).groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("mismatches"))


@query(
    "mut10_affected",
    f"""
    SELECT seq, CASE WHEN op = 'update' AND bop <> 'delete' AND b IS NOT DISTINCT FROM img THEN 0 ELSE 1 END AS expected_affected FROM (
      SELECT event_id AS seq, {_OP} AS op, floor(value) AS img, lag({_OP}) OVER w AS bop, lag(floor(value)) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    """,
)
def mut10_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir).withColumn("image", F.floor("value"))
    return fold.affected_rows(log, ["user_id"], "seq", "op", ["image"]).select("seq", "expected_affected")


@query("mut11_enum_zero", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE NULL END AS label FROM events")
def mut11_enum_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", fold.enum_label(F.col("event_id") % 5, ["one", "two", "three"]).alias("label"))


@query(
    "mut11_set_labels",
    "SELECT event_id, concat_ws(',', CASE WHEN event_id & 1 = 1 THEN 'a' END, CASE WHEN event_id & 2 = 2 THEN 'b' END, CASE WHEN event_id & 4 = 4 THEN 'c' END) AS labels FROM events",
)
def mut11_set_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", fold.set_labels(F.col("event_id").bitwiseAND(F.lit(7)), ["a", "b", "c"]).alias("labels"))


@query(
    "agg7_recovery_fold",
    """
    SELECT user_id, round(arg_min(b, event_id), 6) AS initial, round(arg_max(value, event_id), 6) AS final, count(*) AS touches, bool_or(broken) AS ambiguous FROM (
      SELECT user_id, event_id, value, b, coalesce(p IS DISTINCT FROM b AND has, false) AS broken FROM (
        SELECT user_id, event_id, value, CASE WHEN event_id % 50 = 0 THEN -1.0 ELSE coalesce(lag(value) OVER w, 0.0) END AS b, lag(value) OVER w AS p, lag(event_id) OVER w IS NOT NULL AS has
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)))
    GROUP BY user_id
    """,
)
def agg7_recovery_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import running

    log = running.previous(tables.event_log(spark, sf_dir).select("user_id", "seq", "value"), ["user_id"], "seq", prior=F.col("value"))
    images = log.withColumn("before", F.when(F.col("seq") % 50 == 0, F.lit(-1.0)).otherwise(F.coalesce("prior", F.lit(0.0))))
    found = fold.recovery(images, ["user_id"], "seq", "before", "value")
    return found.select("user_id", F.round("initial", 6).alias("initial"), F.round("final", 6).alias("final"), "touches", "ambiguous")


@query(
    "ddl4_truncate",
    """
    SELECT event_type, count(*) AS rows_after, min(event_id) AS first_seq FROM events e
    WHERE event_id % 997 <> 0 AND event_id > coalesce((SELECT max(event_id) FROM events t WHERE t.event_type = e.event_type AND t.event_id % 997 = 0), -1)
    GROUP BY event_type
    """,
)
def ddl4_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir).withColumn("op", F.when(F.col("seq") % 997 == 0, "truncate").otherwise(F.col("op")))
    return fold.truncated(log, ["event_type"], "seq", "op").groupBy("event_type").agg(F.count("*").alias("rows_after"), F.min("seq").alias("first_seq"))


@query(
    "mut1_group_checks",
    """
    SELECT event_id // 4 AS txn, CASE WHEN event_id // 4 % 10 = 3 THEN 'outcome' WHEN event_id // 4 % 10 = 4 THEN 'identity' WHEN event_id // 4 % 10 = 5 THEN 'boundary' WHEN event_id // 4 % 10 = 6 THEN 'dml.multiple_statements'
      WHEN event_id // 4 % 10 = 7 THEN 'dml.multiple_tables' WHEN event_id // 4 % 10 = 8 THEN 'operation' END AS code
    FROM events GROUP BY event_id // 4 HAVING count(*) = 4 AND event_id // 4 % 10 BETWEEN 3 AND 8
    """,
)
def mut1_group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four events, of which two hold rows: of ten kinds of groups, six break one rule each and one has only filtered rows."""
    kind, place = F.expr("event_id div 4 % 10"), F.col("event_id") % 4
    events = tables.table(spark, sf_dir, "events").select(
        F.expr("event_id div 4").alias("txn"),
        F.when(kind == 3, "rolledBack").otherwise("committed").alias("outcome"),
        F.when((kind != 4) & (place == 0), "u:1").alias("gtid"),
        place.between(1, 2).alias("is_rows"),
        ((kind != 5) & ((place == 2) | ((kind == 6) & (place == 1)))).alias("ends_statement"),
        (kind == 9).alias("filtered"),
        F.when(place.between(1, 2), F.when((kind == 8) | (kind == 9), "merge").otherwise("insert")).alias("op"),
        F.lit("app").alias("db"),
        F.when((kind == 7) & (place == 1), "u").otherwise("t").alias("tbl"),
    )
    whole = events.groupBy("txn").count().where("count = 4").select("txn")
    return fold.group_problems(events.join(whole, "txn"), ["txn"])
