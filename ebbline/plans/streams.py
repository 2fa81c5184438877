"""Queries over filters, transaction-number sets and assembled transactions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars
from ..operators import filters, gtid, metrics, transactions
from ..sources import binlog, tables


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events")


INCLUDE, IGNORE = ["app.p%", r"app.v\iew", "db\\_1.%"], ["app.%", "%.error"]


@query(
    "flt1_include_ignore",
    r"""
    SELECT event_id, name FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'db_1.' WHEN event_id % 4 = 1 THEN 'dbx1.' ELSE 'app.' END || event_type AS name FROM events)
    WHERE name LIKE 'app.p%' OR name LIKE 'app.view' OR name LIKE 'db\_1.%' ESCAPE '\'
    """,
)
def flt1_include_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = F.when(F.col("event_id") % 4 == 0, "db_1").when(F.col("event_id") % 4 == 1, "dbx1").otherwise("app")
    events = _events(spark, sf_dir).withColumn("db", database)
    kept = events.where(~filters.ignored(F.col("db"), F.col("event_type"), INCLUDE, IGNORE))
    return kept.select("event_id", F.concat_ws(".", "db", "event_type").alias("name"))


@query(
    "flt1_ignore_only",
    "SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type LIKE '_i%' OR event_type = 'error') GROUP BY event_type",
)
def flt1_ignore_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _events(spark, sf_dir).where(~filters.ignored(F.lit("App"), F.col("event_type"), (), ["APP._i%", "app.error"], lower_names=True))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@query("flt4_database_scope", "SELECT n_name, n_name LIKE 'I%' AS dropped FROM nation")
def flt4_database_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.table(spark, sf_dir, "nation")
    return nation.select("n_name", filters.ignored(F.col("n_name"), F.lit(None).cast("string"), (), ["I%.%"]).alias("dropped"))


@query(
    "flt5_ddl_scope",
    """
    SELECT r_name AS statement, CASE WHEN min(d) <> max(d) THEN 'mixed' WHEN max(d) THEN 'ignored' ELSE 'included' END AS scope
    FROM (SELECT r_name, n_name LIKE '%A' AS d FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name
    """,
)
def flt5_ddl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = tables.table(spark, sf_dir, "nation").join(tables.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flagged = targets.select(F.col("r_name").alias("statement"), filters.ignored(F.lit("app"), F.col("n_name"), (), ["app.%A"]).alias("dropped"))
    return filters.ddl_scope(flagged, "statement", "dropped")


_COVERED = "(VALUES ('click', 0, 99), ('click', 200, 450), ('view', 50, 900), ('error', 0, 1000000))"


def _covered(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("click", 0, 99), ("click", 200, 450), ("view", 50, 900), ("error", 0, 1_000_000)], "event_type string, lo long, hi long")


@query(
    "flt7_excluded_gtids",
    f"SELECT event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM {_COVERED} c(s, lo, hi) WHERE c.s = e.event_type AND e.event_id BETWEEN c.lo AND c.hi)",
)
def flt7_excluded_gtids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_covered(_events(spark, sf_dir), _covered(spark), ["event_type"], "event_id").select("event_id", "event_type")


@query("flt8_boundary", "SELECT event_id FROM events WHERE event_id // 1000 + 9 > 10 OR (event_id // 1000 + 9 = 10 AND event_id % 1000 * 40 >= 4000)")
def flt8_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _events(spark, sf_dir).selectExpr("event_id", "concat('bin.', lpad(event_id div 1000 + 9, 6, '0')) AS file", "event_id % 1000 * 40 AS pos")
    return located.where(filters.after_boundary(F.col("file"), F.col("pos"), "bin.000010", 4000)).select("event_id")


@query(
    "flt9_full_row",
    """
    SELECT count(*) AS same_rows FROM lineitem
    WHERE l_returnflag = CASE WHEN l_partkey % 3 = 0 THEN lower(l_returnflag) ELSE l_returnflag END AND NOT (l_suppkey % 5 = 0)
    """,
)
def flt9_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem")
    other = F.when(F.col("l_partkey") % 3 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    zero, signed = F.lit(0.0), F.when(F.col("l_suppkey") % 5 == 0, -(F.col("l_suppkey") * 0.0)).otherwise(F.col("l_suppkey") * 0.0)
    same = filters.same_row([(F.col("l_returnflag"), other, "text"), (zero, signed, "double"), (F.lit(None).cast("int"), F.lit(None).cast("int"), "int")])
    return lines.where(same).agg(F.count("*").alias("same_rows"))


@query(
    "flt10_validate",
    """
    SELECT event_id,
      CASE WHEN event_id % 300 > 127 THEN 'range' END AS tiny,
      CASE WHEN length(event_type) > 5 THEN 'length' END AS text5,
      CASE WHEN event_id % 7 = 0 THEN 'null' WHEN event_id % 2200 <> 0 AND (event_id % 2200 < 1901 OR event_id % 2200 > 2155) THEN 'range' END AS year,
      CASE WHEN event_id >= 1000 THEN 'range' END AS dec5_2,
      CASE WHEN event_id % 9 > 5 THEN 'range' END AS enum5
    FROM events
    """,
)
def flt10_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = filters.violation
    year = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 2200)
    return _events(spark, sf_dir).select(
        "event_id",
        v(F.col("event_id") % 300, "tinyint").alias("tiny"),
        v(F.col("event_type"), "varchar", length=5).alias("text5"),
        v(year, "year", nullable=False).alias("year"),
        v(F.concat(F.col("event_id").cast("string"), F.lit(".25")), "decimal", precision=5, scale=2).alias("dec5_2"),
        v(F.col("event_id") % 9, "enum", labels=5).alias("enum5"),
    )


_STATEMENTS = [
    "CREATE TRIGGER t{} BEFORE INSERT ON a FOR EACH ROW SET @x = 1", "create definer=`r o`@`%` trigger `t{}` AFTER DELETE ON b FOR EACH ROW DELETE FROM c", "/* x */ DROP TRIGGER IF EXISTS app.t{}",
    "CREATE EVENT e{} ON SCHEDULE EVERY 1 DAY DO DELETE FROM a", "ALTER DEFINER = CURRENT_USER EVENT e{} DISABLE", "DROP TEMPORARY TABLE IF EXISTS `a`.`tmp{}`, tmp2", "DROP TEMPORARY TABLE tmp{}", "CREATE TABLE trigger_log{} (event INT)",
]


@query(
    "flt12_ddl_policy",
    """
    SELECT event_id, CASE WHEN event_id % 8 < 3 AND event_id % 5 = 0 THEN 'error' WHEN event_id % 8 < 3 THEN 'skip' WHEN event_id % 8 < 5 THEN 'reject' WHEN event_id % 8 = 5 AND event_id % 5 = 0 THEN 'error' WHEN event_id % 8 = 5 THEN 'skip' ELSE 'apply' END AS action,
      CASE WHEN event_id % 8 IN (0, 1, 2, 5) AND event_id % 5 = 0 THEN 'a failed statement cannot be skipped' WHEN event_id % 8 < 3 THEN 'triggers' WHEN event_id % 8 < 5 THEN 'events' WHEN event_id % 8 = 5 THEN 'temporary tables' END AS reason
    FROM events
    """,
)
def flt12_ddl_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(t) for t in _STATEMENTS]), (F.col("event_id") % 8).cast("int"))
    statement = F.replace(text, F.lit("{}"), F.col("event_id").cast("string"))
    return _events(spark, sf_dir).select("event_id", filters.ddl_policy(statement, "skip", True, F.col("event_id") % 5 == 0).alias("p")).select("event_id", "p.*")


@query(
    "flt13_skip_errors",
    """
    SELECT code, boundary, count(*) AS n, (code = 'mysql.1062' AND boundary = 'rolled_back') OR (code = 'ddl.unsupported_alter' AND boundary = 'before_writes') AS skipped FROM (
      SELECT ['mysql.1062', 'ddl.unsupported_alter', 'target.sql', 'dml.multiple_tables'][event_id % 4 + 1] AS code, CASE event_id % 3 WHEN 0 THEN 'before_writes' ELSE 'rolled_back' END AS boundary FROM events) GROUP BY code, boundary
    """,
)
def flt13_skip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in ("mysql.1062", "ddl.unsupported_alter", "target.sql", "dml.multiple_tables")])
    errors = _events(spark, sf_dir).select(F.get(codes, (F.col("event_id") % 4).cast("int")).alias("code"), F.when(F.col("event_id") % 3 == 0, "before_writes").otherwise("rolled_back").alias("boundary"))
    skipped, fatal = filters.split_skips(errors, ["mysql.1062", "ddl.unsupported_alter"])
    return skipped.withColumn("skipped", F.lit(True)).unionByName(fatal.withColumn("skipped", F.lit(False))).groupBy("code", "boundary", "skipped").agg(F.count("*").alias("n"))


@query("flt14_image_shape", "SELECT event_type, count(*) AS broken FROM events WHERE (event_type = 'signup') <> (event_id % 4 = 0) OR (event_type = 'error') <> (event_id % 6 = 1) GROUP BY event_type")
def flt14_image_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    before, after = F.when(F.col("seq") % 4 != 0, F.col("value")), F.when(F.col("seq") % 6 != 1, F.col("value"))
    return log.where(~filters.image_shape(F.col("op"), before, after)).groupBy("event_type").agg(F.count("*").alias("broken"))


# sets of transaction numbers

_ISLANDS = "SELECT event_type AS sid, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT *, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) GROUP BY event_type, g"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("event_type").alias("sid"), F.col("event_id").alias("seq"))


@query("set3_islands", _ISLANDS)
def set3_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtid.islands(_points(spark, sf_dir), ["sid"], "seq", block=256)


_PARTS = "SELECT event_type AS sid, event_id AS lo, event_id + event_id % 5 AS hi FROM events WHERE event_id % 3 = 0"


@query(
    "set4_union",
    f"""
    SELECT sid, min(lo) AS lo, max(hi) AS hi FROM (
      SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY lo) AS g FROM (
        SELECT *, max(hi) OVER (PARTITION BY sid ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_PARTS})))
    GROUP BY sid, g
    """,
)
def set4_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _events(spark, sf_dir).where("event_id % 3 = 0").selectExpr("event_type AS sid", "event_id AS lo", "event_id + event_id % 5 AS hi")
    return gtid.union(parts, ["sid"], blocks=16)


@query("set5_contains", f"SELECT event_id AS seq, event_type AS sid FROM events e WHERE EXISTS (SELECT 1 FROM {_COVERED} c(s, lo, hi) WHERE c.s = e.event_type AND e.event_id BETWEEN c.lo AND c.hi)")
def set5_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _covered(spark).withColumnRenamed("event_type", "sid")
    return gtid.contains(_points(spark, sf_dir), held, ["sid"], "seq").select("seq", "sid")


@query("set6_uncovered", f"WITH i AS ({_ISLANDS}) SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM {_COVERED} c(s, lo, hi) WHERE c.s = i.sid AND c.lo <= i.lo AND c.hi >= i.hi)")
def set6_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _covered(spark).withColumnRenamed("event_type", "sid")
    return gtid.uncovered(gtid.islands(_points(spark, sf_dir), ["sid"], "seq"), held, ["sid"])


@query(
    "set7_remaining",
    f"SELECT sid, CAST(sum(CASE WHEN covered THEN 0 ELSE 1 END) AS BIGINT) AS remaining FROM (SELECT event_type AS sid, EXISTS (SELECT 1 FROM {_COVERED} c(s, lo, hi) WHERE c.s = e.event_type AND e.event_id BETWEEN c.lo AND c.hi) AS covered FROM events e) GROUP BY sid",
)
def set7_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _covered(spark).withColumnRenamed("event_type", "sid")
    return gtid.remaining(gtid.islands(_points(spark, sf_dir), ["sid"], "seq"), held, ["sid"])


@query(
    "set7_remaining_through",
    f"SELECT sid, CAST(top - coalesce((SELECT sum(least(hi, top) - greatest(lo, 1) + 1) FROM {_COVERED} c(s, lo, hi) WHERE c.s = sid AND lo <= top AND hi >= 1), 0) AS BIGINT) AS remaining FROM (SELECT event_type AS sid, max(event_id) AS top FROM events GROUP BY 1)",
)
def set7_remaining_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _covered(spark).withColumnRenamed("event_type", "sid")
    return gtid.remaining(gtid.islands(_points(spark, sf_dir), ["sid"], "seq"), held, ["sid"], through_endpoints=True)


@query(
    "set2_canonical_text",
    f"""
    WITH i AS ({_ISLANDS}), s AS (SELECT sid, sid || ':' || string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ':' ORDER BY lo) AS x FROM i GROUP BY sid)
    SELECT string_agg(x, ',' ORDER BY sid) AS gtid_set FROM s
    """,
)
def set2_canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtid.canonical_text(gtid.islands(_points(spark, sf_dir), ["sid"], "seq"))


@query("set9_normal_tag", "SELECT p_partkey, CASE WHEN regexp_full_match(lower(t), '[a-z_][a-z0-9_]{0,31}') THEN lower(t) END AS tag FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_brand, '#', '_') WHEN 1 THEN p_brand ELSE p_partkey::VARCHAR || 'x' END AS t FROM part)")
def set9_normal_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_brand", F.lit("#"), F.lit("_"))).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("x")))
    return tables.table(spark, sf_dir, "part").select("p_partkey", gtid.normal_tag(text).alias("tag"))


@query("set10_stop_prefix", "SELECT event_id, event_type FROM events WHERE event_id <= (SELECT min(event_id) FROM events WHERE event_type = 'view')")
def set10_stop_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    target = events.where("event_type = 'view'").groupBy("event_type").agg(F.min("event_id").alias("lo"), F.min("event_id").alias("hi"))
    return gtid.prefix_until_covered(events, "event_id", ["event_type"], "event_id", target).select("event_id", "event_type")


@query("ord4_stop_after_transactions", "SELECT event_id FROM events WHERE event_id // 6 < 40")
def ord4_stop_after_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the first 40 transactions, in which a transaction that lacks its end counts too."""
    numbered = transactions.assemble(_stream(spark, sf_dir), "event_id", "kind")
    return transactions.first_transactions(numbered, "event_id", 40).select("event_id")


@query(
    "flt7_wide_intervals",
    """
    SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('click', 5::BIGINT, 4611686018427387904::BIGINT), ('view', 1099511627776, 9223372036854775806), ('error', 70000, 140737488355328)) c(s, lo, hi)
      WHERE c.s = e.event_type AND CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 65536 WHEN 2 THEN event_id * 1099511627776 ELSE 9223372036854775807 - event_id END BETWEEN c.lo AND c.hi)
    """,
)
def flt7_wide_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers up to 2**63 - 1 against intervals as wide as that."""
    number = "CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 65536 WHEN 2 THEN event_id * 1099511627776 ELSE 9223372036854775807 - event_id END AS gno"
    covered = spark.createDataFrame([("click", 5, 1 << 62), ("view", 1 << 40, (1 << 63) - 2), ("error", 70000, 1 << 47)], "event_type string, lo long, hi long")
    return filters.without_covered(_events(spark, sf_dir).selectExpr("event_id", "event_type", number), covered, ["event_type"], "gno").select("event_id")


# transactions: event_id % 6 gives gtid, begin, table_map, rows, rows, xid (or rollback, or a lost end)

_KIND = "CASE event_id % 6 WHEN 0 THEN 'gtid' WHEN 1 THEN 'begin' WHEN 2 THEN 'table_map' WHEN 3 THEN 'rows' WHEN 4 THEN CASE WHEN event_id % 30 = 4 THEN 'table_map' ELSE 'rows' END ELSE CASE WHEN event_id % 42 = 5 THEN 'rollback' ELSE 'xid' END END"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id", f"{_KIND} AS kind", "19 + event_id % 80 AS size")


@query(
    "txn1_assemble",
    f"""
    SELECT event_id // 6 + 1 AS txn, min(event_id) AS first, max(event_id) AS last, count(*) AS events, CAST(sum(19 + event_id % 80) AS BIGINT) AS bytes,
      CAST(sum(CASE WHEN k = 'rows' THEN 1 ELSE 0 END) AS BIGINT) AS row_events,
      CASE WHEN bool_or(k = 'xid') THEN 'committed' WHEN bool_or(k = 'rollback') THEN 'rolledBack' ELSE 'incomplete' END AS outcome,
      CASE WHEN bool_or(k = 'rollback') AND bool_or(k = 'rows') THEN 'sequence' END AS error
    FROM (SELECT *, {_KIND} AS k FROM events) GROUP BY event_id // 6
    """,
)
def txn1_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.transactions(transactions.assemble(_stream(spark, sf_dir), "event_id", "kind"), "event_id", "kind", "size")


@query("txn2_gaps", "SELECT event_id, event_id * 100 AS expected FROM events WHERE event_id > 0 AND event_id % 250 = 0")
def txn2_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = _events(spark, sf_dir).selectExpr("event_id", "event_id * 100 + if(event_id % 250 = 0, 7, 0) AS start", "event_id * 100 + 100 AS end", "'bin.000001' AS file")
    return transactions.gaps(shifted, "event_id", "start", "end", ["file"]).select("event_id", "expected")


@query(
    "txn3_classify",
    """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'begin' WHEN 1 THEN 'statement' WHEN 2 THEN 'commit' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'rollback' ELSE 'statement' END AS kind FROM events
    """,
)
def txn3_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["BEGIN", "begin", "COMMIT", "  savepoint a", "XA START 'x'", "ROLLBACK", "CREATE TABLE t (a INT)"]
    sql = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 7).cast("int"))
    return _events(spark, sf_dir).select("event_id", transactions.classify(sql).alias("kind"))


@query("txn5_limits", "SELECT user_id AS txn, count(*) AS events, count(*) > 50 AS over FROM events GROUP BY user_id")
def txn5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _events(spark, sf_dir).selectExpr("user_id AS txn", "event_id", "'rows' AS kind", "1 AS size")
    return transactions.transactions(grouped, "event_id", "kind", "size", max_events=50).select("txn", "events", F.col("error").isNotNull().alias("over"))


@query("txn8_sequence_errors", f"WITH k AS (SELECT event_id, {_KIND} AS kind FROM events), p AS (SELECT *, lag(kind) OVER (ORDER BY event_id) AS after FROM k) SELECT event_id, kind, after FROM p WHERE (kind IN ('xid', 'rollback') AND after IN ('rows', 'table_map')) OR (kind = 'gtid' AND after NOT IN ('xid', 'rollback'))")
def txn8_sequence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here no rows event closes its statement, so each commit or rollback follows an open one."""
    return transactions.sequence_errors(_stream(spark, sf_dir).withColumn("file", F.lit("f")), "event_id", "kind", ["file"]).select("event_id", "kind", "after")


@query("txn9_poison_prefix", "SELECT event_id FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'error' AND value > 90)")
def txn9_poison_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.before_first_error(_events(spark, sf_dir), "event_id", (F.col("event_type") == "error") & (F.col("value") > 90)).select("event_id")


# decoding


@query("dec3_fingerprint", "SELECT event_id, sha256(props) AS sha256 FROM events")
def dec3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("sha256"))


@query("dec12_operation", "SELECT event_id, CASE 23 + event_id % 10 WHEN 23 THEN 'insert' WHEN 30 THEN 'insert' WHEN 24 THEN 'update' WHEN 31 THEN 'update' WHEN 25 THEN 'delete' WHEN 32 THEN 'delete' END AS op FROM events")
def dec12_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = 23 + F.col("event_id") % 10
    table = F.create_map(*[F.lit(x) for pair in binlog.OPERATIONS.items() for x in pair])
    return _events(spark, sf_dir).select("event_id", F.try_element_at(table, code.cast("int")).alias("op"))


@query(
    "snk8_summary_lines",
    """
    SELECT '{"event_type":"' || event_type || '","applied":' || sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) || ',"bytes":' || sum(event_id % 100) || ',"errorSkipped":' || sum(CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) || ',"events":' || sum(1 + event_id % 3) || ',"filtered":' || sum(CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END) || ',"policySkipped":0,"transactions":' || count(*) || '}' AS line
    FROM events GROUP BY event_type
    """,
)
def snk8_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_id") % 3 == 0, "applied").when(F.col("event_id") % 3 == 1, "errorSkipped").otherwise("filtered")
    groups = _events(spark, sf_dir).select("event_type", outcome.alias("outcome"), (1 + F.col("event_id") % 3).alias("n"), (F.col("event_id") % 100).alias("size"))
    return metrics.summary_lines(metrics.counters(groups, ["event_type"], "outcome", "n", "size", {}, F.lit(True)), ["event_type"])


@query("dec8_packed_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '0000-00-00' WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%m') || '-00' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def dec8_packed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates packed into 24 bits and read back by the decoder's own function; zero and partial dates stay as they are."""
    packed = F.year("o_orderdate") * 512 + F.month("o_orderdate") * 32 + F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(F.dayofmonth("o_orderdate"))
    packed = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(packed).cast("int")

    @F.pandas_udf("string")
    def day(values: pd.Series) -> pd.Series:
        return values.map(scalars.date_text)

    return tables.table(spark, sf_dir, "orders").select("o_orderkey", day(packed).alias("day"))
