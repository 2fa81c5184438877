"""Queries over joins, batches, metrics and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import batching, filters, joins, metrics, partitions
from ..sources import tables



def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


@query(
    "jon1_asof_map",
    """
    WITH m AS (SELECT event_id AS at, user_id, round(value, 4) AS v FROM events WHERE event_type = 'signup'),
    c AS (SELECT event_id AS at FROM events WHERE event_id % 400 = 399)
    SELECT e.event_id, CASE WHEN m.at > coalesce((SELECT max(c.at) FROM c WHERE c.at < e.event_id), -1) THEN m.v END AS map_value
    FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.event_id >= m.at
    """,
)
def jon1_asof_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    found = joins.asof(events, "event_id", ["user_id"], F.col("event_type") == "signup", F.col("event_id") % 400 == 399, F.round("value", 4), "map_value")
    return found.select("event_id", "map_value")


_VERSIONS = "(VALUES (0, 400, 'v1'), (400, 700, 'v2'), (700, NULL, 'v3'))"


@query("jon2_schema_interval", f"SELECT e.event_id, v.name AS version FROM events e LEFT JOIN {_VERSIONS} v(a, b, name) ON e.event_id >= v.a AND (v.b IS NULL OR e.event_id < v.b) AND e.event_type <> 'view'")
def jon2_schema_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([(t, at, v) for t in ("click", "error", "purchase", "signup") for at, v in ((0, "v1"), (400, "v2"), (700, "v3"))], "event_type string, at long, version string")
    history = joins.versions(changes, ["event_type"], "at")
    return joins.temporal(_t(spark, sf_dir, "events"), history, ["event_type"], "event_id").select("event_id", "version")


@query(
    "jon3_map_history",
    """
    SELECT event_id, CASE WHEN event_id % 10 = 0 OR event_id % 7 = 3 THEN 'unknown' WHEN event_id % 6 = 1 THEN 'identity' ELSE 'same' END AS match, CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 3 THEN 'v' || (event_id % 4) END AS version FROM events
    """,
)
def jon3_map_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some maps are not in the history, some are there with another body, some for another table."""
    body = F.col("event_type").cast("binary")
    maps = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 40).alias("offset"), F.sha2(body, 256).alias("sha256"), (F.col("event_id") % 9).alias("table_id"), F.lit("app").alias("db"), "event_type")
    maps = maps.withColumnRenamed("event_type", "tbl")
    history = maps.where("event_id % 10 <> 0").select("offset", F.when(F.col("event_id") % 7 == 3, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"), "table_id", "db", F.when(F.col("event_id") % 6 == 1, F.upper("tbl")).otherwise(F.col("tbl")).alias("tbl"), F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("version"))
    return joins.map_history(maps, history).select("event_id", "match", "version")


@query(
    "jon4_before_image",
    """
    SELECT CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN c.c_acctbal = CASE WHEN o.o_orderkey % 10 = 0 THEN -1 ELSE c.c_acctbal END THEN 'match' ELSE 'differs' END AS state, count(*) AS n
    FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) c ON o.o_custkey = c.c_custkey GROUP BY 1
    """,
)
def jon4_before_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    before = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(customer, "c_custkey", "left")
    changes = before.withColumn("c_acctbal", F.when(F.col("o_orderkey") % 10 == 0, -1.0).otherwise(F.col("c_acctbal")))
    return joins.probe(changes, customer.where("c_custkey % 9 <> 0"), ["c_custkey"], ["c_acctbal"]).groupBy("state").agg(F.count("*").alias("n"))


@query("jon5_key_collisions", "SELECT o_orderkey, o_custkey + 7 AS new_key FROM orders WHERE o_custkey + 7 IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def jon5_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 7).alias("new_key"))
    return joins.collisions(moves, ["new_key"], _t(spark, sf_dir, "customer").where("c_custkey % 4 = 0"), ["c_custkey"])


@query("jon7_fk_component", "SELECT * FROM (VALUES ('customer', 'customer'), ('lineitem', 'customer'), ('nation', 'customer'), ('orders', 'customer'), ('region', 'customer'), ('labels', 'documents'), ('documents', 'documents')) t(table_name, component)")
def jon7_fk_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [("lineitem", "orders"), ("orders", "customer"), ("customer", "nation"), ("nation", "region"), ("labels", "documents")]
    return spark.createDataFrame(sorted(joins.components(edges).items()), "table_name string, component string")


@query("jon8_orphans", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def jon8_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.orphans(lines, _t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), ["l_orderkey"], ["o_orderkey"])


@query("jon9_positional", "SELECT n_nationkey, i::INTEGER AS ordinal, CASE i WHEN 0 THEN n_name WHEN 1 THEN 'x' END AS wire, CASE i WHEN 0 THEN 'name' WHEN 1 THEN 'flag' ELSE 'extra' END AS declared FROM nation, range(3) r(i)")
def jon9_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = joins.positional(F.array("n_name", F.lit("x")), F.array(F.lit("name"), F.lit("flag"), F.lit("extra")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.explode(zipped).alias("z")).select("n_nationkey", "z.*")


@query("jon11_orphan_intents", "SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND event_id < 500)")
def jon11_orphan_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    groups = events.where("event_type = 'signup' AND event_id < 500").select("user_id").distinct()
    return joins.orphans(events.where("event_type = 'purchase'").select("event_id", "user_id"), groups, ["user_id"], ["user_id"]).select("event_id")


@query(
    "jon12_diff",
    """
    WITH a AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_partkey, CASE WHEN l_suppkey % 13 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_linenumber <> 7)
    SELECT l_orderkey, l_partkey, l_quantity, CAST(sum(s) AS BIGINT) AS n FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY 1, 2, 3 HAVING sum(s) <> 0
    """,
)
def jon12_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    other = lines.where("l_linenumber <> 7").withColumn("l_quantity", F.when(F.col("l_suppkey") % 13 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return joins.bag_difference(lines, other, ["l_orderkey", "l_partkey", "l_quantity"])


# batches


@query("bat1_count_batches", "SELECT event_id // 8 AS batch, count(*) AS groups, min(event_id) AS first FROM events GROUP BY 1")
def bat1_count_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.count_batches(_t(spark, sf_dir, "events"), "event_id", 8).groupBy("batch").agg(F.count("*").alias("groups"), F.min("event_id").alias("first"))


@query("bat1_greedy_batches", None)
def bat1_greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _t(spark, sf_dir, "events").selectExpr("event_id div 1000 AS span", "event_id AS seq", "1 + user_id % 40 AS n_rows", "cast(value * 100 AS long) AS cost", "event_type AS tbl")
    return batching.greedy_batches(groups, ["span"], "seq", "n_rows", "cost", "tbl", batching.Policy(transactions=8, rows=100, bytes=20_000))


@query("bat5_barriers", "SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span FROM events")
def bat5_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.barriers(_t(spark, sf_dir, "events"), "event_id", F.col("event_type") == "error").select("event_id", "span")


@query(
    "mut12_insert_chunks",
    """
    WITH r AS (SELECT event_id, op, sum(CASE WHEN op = 'insert' AND b = 'insert' THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS run FROM (SELECT event_id, CASE WHEN event_id % 50 < 45 THEN 'insert' ELSE 'update' END AS op, lag(CASE WHEN event_id % 50 < 45 THEN 'insert' ELSE 'update' END) OVER (ORDER BY event_id) AS b FROM events))
    SELECT CAST(run AS BIGINT) AS run, count(*) AS n, CAST(count(*) // 32 + bit_count(count(*) % 32) AS BIGINT) AS statements FROM r WHERE op = 'insert' GROUP BY run
    """,
)
def mut12_insert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 < 45, "insert").otherwise("update").alias("op"), F.lit("t").alias("tbl"))
    runs = batching.insert_runs(rows, "event_id", ["tbl"], "op").where("op = 'insert'").groupBy("run").agg(F.count("*").alias("n"))
    return runs.select("run", "n", batching.chunk_count(F.col("n")).cast("long").alias("statements"))


@query("mut12_chunk_sizes", "SELECT p_size, CASE WHEN p_size >= 32 THEN '32' || CASE WHEN p_size = 32 THEN '' ELSE ',' END ELSE '' END || concat_ws(',', CASE WHEN p_size & 16 > 0 THEN '16' END, CASE WHEN p_size & 8 > 0 THEN '8' END, CASE WHEN p_size & 4 > 0 THEN '4' END, CASE WHEN p_size & 2 > 0 THEN '2' END, CASE WHEN p_size & 1 > 0 THEN '1' END) AS chunks FROM (SELECT DISTINCT p_size FROM part)")
def mut12_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.concat_ws(",", F.transform(batching.chunk_sizes(F.col("p_size")), lambda c: c.cast("string"))).alias("chunks"))


@query("mut12_insert_bytes", "SELECT c_custkey, CAST(64 + 2 * 8 + 4 + 2 * 6 + 4 + 24 + strlen(c_name) + 16 AS BIGINT) AS bytes FROM customer")
def mut12_insert_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", batching.insert_bytes([(F.col("c_custkey"), "int"), (F.col("c_name"), "text")], ["customer", "c_name"]).alias("bytes"))


@query("mut13_autocommit", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 2 = 0 THEN p_size = 1 ELSE bit_count(p_size) = 1 AND p_size <= 32 END AS autocommit FROM part")
def mut13_autocommit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.when(F.col("p_partkey") % 2 == 0, "update").otherwise("insert")
    return _t(spark, sf_dir, "part").select("p_partkey", batching.autocommit(ops, F.col("p_size"), F.lit(1), F.col("p_partkey") % 5 == 0).alias("autocommit"))


# metrics


@query(
    "agg1_counters",
    """
    SELECT user_id, count(*) AS transactions, CAST(sum(1 + event_id % 3) AS BIGINT) AS events, CAST(sum(event_id % 100) AS BIGINT) AS bytes,
      count(*) FILTER (event_type IN ('click', 'signup', 'purchase')) AS applied, count(*) FILTER (event_type = 'view') AS filtered, 0::BIGINT AS "policySkipped", count(*) FILTER (event_type = 'error') AS "errorSkipped",
      CAST(sum(CASE WHEN event_id % 10 <> 0 THEN event_id % 4 ELSE 0 END) AS BIGINT) AS inserted_rows
    FROM events GROUP BY user_id
    """,
)
def agg1_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "view", "filtered").when(F.col("event_type") == "error", "errorSkipped").otherwise("applied")
    groups = _t(spark, sf_dir, "events").select("user_id", outcome.alias("outcome"), "event_id", (1 + F.col("event_id") % 3).alias("n"), (F.col("event_id") % 100).alias("size"), (F.col("event_id") % 4).alias("ins"))
    return metrics.counters(groups, ["user_id"], "outcome", "n", "size", {"inserted_rows": "ins"}, F.col("event_id") % 10 != 0)


@query("agg2_skips", "SELECT event_type AS code, count(*) AS n FROM events GROUP BY 1")
def agg2_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.skipped_by_code(_t(spark, sf_dir, "events"), "event_type")


_SPANS = "SELECT 'run' AS stage, NULL AS parent, event_id % 90 + 40 AS t, event_id % 50 = 0 AS failed FROM events UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN 'decode' ELSE 'apply' END, 'run', event_id % 30, false FROM events UNION ALL SELECT 'read', 'decode', event_id % 7, event_id % 70 = 0 FROM events"


@query(
    "agg4_stage_times",
    f"""
    WITH s AS ({_SPANS}), i AS (SELECT parent AS stage, sum(t) AS inner_t FROM s WHERE parent IS NOT NULL GROUP BY 1)
    SELECT s.stage, count(*) AS calls, count(*) FILTER (failed) AS failures, CAST(sum(t) AS BIGINT) AS total, max(t) AS longest, CAST(sum(t) - coalesce(max(inner_t), 0) AS BIGINT) AS self FROM s LEFT JOIN i USING (stage) GROUP BY s.stage
    """,
)
def agg4_stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    spans = e.selectExpr("'run' AS stage", "cast(NULL AS string) AS parent", "event_id % 90 + 40 AS t", "event_id % 50 = 0 AS failed")
    spans = spans.union(e.selectExpr("if(event_id % 2 = 0, 'decode', 'apply')", "'run'", "event_id % 30", "false")).union(e.selectExpr("'read'", "'decode'", "event_id % 7", "event_id % 70 = 0"))
    return metrics.stage_times(spans, "stage", "parent", "t", "failed")


@query("agg5_backlog", "SELECT CAST(sum(CASE WHEN o_orderkey < 200 THEN 0 WHEN o_orderkey = 200 THEN greatest(o_orderkey * 10 - 500, 0) ELSE o_orderkey * 10 END) AS BIGINT) AS remaining_bytes FROM orders")
def agg5_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS number", "o_orderkey * 10 AS size")
    return files.agg(F.sum(metrics.backlog(files, "number", "size", F.lit(200), F.lit(500))).alias("remaining_bytes"))


@query("agg6_retained_cost", "SELECT c_custkey, CAST(64 + strlen(c_name) + 48 + strlen(c_mktsegment) + 48 AS BIGINT) AS cost FROM customer")
def agg6_retained_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", metrics.retained_cost(F.array("c_name", "c_mktsegment")).alias("cost"))


@query(
    "win1_rate",
    """
    SELECT event_id, round(CASE WHEN t - f >= 1 THEN (event_id - fe) / (t - f) END, 6) AS rate FROM (
      SELECT event_id, user_id, epoch(ts) AS t, first_value(epoch(ts)) OVER w AS f, first_value(event_id) OVER w AS fe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW))
    """,
)
def win1_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _t(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return metrics.rate_window(samples, ["user_id"], "t", "event_id", 36000).select("event_id", F.round("rate", 6).alias("rate"))


@query(
    "win2_source_rate",
    """
    SELECT event_id, round(CASE WHEN t > lag(t) OVER w THEN (event_id * 3 - lag(event_id * 3) OVER w) / (t - lag(t) OVER w) END, 6) AS source_rate
    FROM (SELECT event_id, epoch(ts) AS t FROM events) WINDOW w AS (ORDER BY event_id)
    """,
)
def win2_source_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _t(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_id") * 3).alias("made"))
    return metrics.source_rate(samples, [], "event_id", "t", "made").select("event_id", F.round("source_rate", 6).alias("source_rate"))


@query(
    "win3_eta",
    """
    SELECT event_id, status, round(CASE WHEN status = 'estimated' THEN remaining / (apply - src) END, 6) AS eta FROM (
      SELECT *, CASE WHEN event_id % 11 = 0 THEN 'paused' WHEN event_id % 40 > 20 THEN 'stale' WHEN remaining = 0 THEN 'caughtUp' WHEN apply <= 0 THEN 'noRecentProgress' WHEN apply - src <= 0 THEN 'notCatchingUp' ELSE 'estimated' END AS status
      FROM (SELECT event_id, event_id % 6 AS remaining, (event_id % 5)::DOUBLE AS apply, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE (event_id % 3)::DOUBLE END AS src FROM events))
    """,
)
def win3_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    status, eta = metrics.estimate(e % 6, (e % 5).cast("double"), (e % 3).cast("double"), e % 2 == 0, metrics.stale(e % 40, 10.0, F.lit(None).cast("boolean")), e % 11 == 0)
    return _t(spark, sf_dir, "events").select("event_id", status.alias("status"), F.round(eta, 6).alias("eta"))


@query(
    "win6_backoff",
    """
    WITH a AS (SELECT event_id, event_id // 9 AS applied FROM events)
    SELECT event_id, least(30.0, power(2.0, row_number() OVER (PARTITION BY applied ORDER BY event_id) - 1))::DOUBLE AS delay FROM a
    """,
)
def win6_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _t(spark, sf_dir, "events").selectExpr("event_id", "event_id div 9 AS applied")
    return metrics.backoff(attempts, [], "event_id", "applied").select("event_id", "delay")


# partitions


@query("prt1_range", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'p0' WHEN o_totalprice < 100000 THEN 'p1' ELSE 'pmax' END AS part FROM orders")
def prt1_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = partitions.Partitioning("range", (("p0", 1000), ("p1", 100000), ("pmax", partitions.MAXVALUE))).route(F.col("o_totalprice"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", route.alias("part"))


@query("prt2_range_columns", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_linenumber, l_orderkey) < (2, 500) THEN 'a' WHEN (l_linenumber, l_orderkey) < (4, 100) THEN 'b' WHEN l_linenumber < 7 OR l_linenumber = 7 THEN 'c' END AS part FROM lineitem")
def prt2_range_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = partitions.by_range_columns([F.col("l_linenumber"), F.col("l_orderkey")], [("a", (2, 500)), ("b", (4, 100)), ("c", (7, partitions.MAXVALUE))])
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", route.alias("part"))


@query("prt3_list", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' END AS part FROM orders")
def prt3_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", partitions.by_list([F.col("o_orderstatus")], [("done", ["F", "P", None]), ("open", ["O"])]).alias("part"))


@query("prt4_hash", "SELECT o_orderkey, ((o_orderkey - 500) % 7 + 7) % 7 AS dummy, abs((o_orderkey - 500) % 7)::INTEGER AS part FROM orders")
def prt4_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_orderkey") - 500
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.pmod(value, F.lit(7)).alias("dummy"), partitions.by_hash(value, 7).alias("part"))


@query("prt4_linear_hash", "SELECT o_orderkey, CASE WHEN o_orderkey & 7 >= 6 THEN (o_orderkey & 7) & 3 ELSE o_orderkey & 7 END::INTEGER AS part FROM orders")
def prt4_linear_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", partitions.by_linear_hash(F.col("o_orderkey"), 6).alias("part"))


@query("prt5_drop_truncate", "SELECT CASE WHEN o_totalprice < 1000 THEN 'p0' ELSE 'pmax' END AS part, count(*) AS n FROM orders WHERE o_totalprice < 1000 OR o_totalprice >= 100000 GROUP BY 1")
def prt5_drop_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed under the old partitioning; dropping p1 removes its rows, the others stay where they are."""
    old = partitions.Partitioning("range", (("p0", 1000), ("p1", 100000), ("pmax", partitions.MAXVALUE)))
    new = old.drop("p1")
    routed = _t(spark, sf_dir, "orders").select(old.route(F.col("o_totalprice")).alias("part"))
    return routed.where(F.col("part").isin(new.names())).groupBy("part").agg(F.count("*").alias("n"))


@query("prt7_misplaced", "SELECT o_orderkey, 'p0' AS part, 'p1' AS belongs FROM orders WHERE o_orderkey % 20 = 0 AND o_totalprice >= 1000")
def prt7_misplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unchecked exchange keeps rows in the partition that holds them; the check lists those that belong elsewhere."""
    rule = partitions.Partitioning("range", (("p0", 1000), ("p1", partitions.MAXVALUE)))
    held = _t(spark, sf_dir, "orders").withColumn("belongs", rule.route(F.col("o_totalprice")))
    held = held.withColumn("part", F.when(F.col("o_orderkey") % 20 == 0, "p0").otherwise(F.col("belongs")))
    return held.where("part <> belongs").select("o_orderkey", "part", "belongs")
