"""Queries over schema evolution, the journal and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..catalog import query
from ..functions import ddl
from ..operators import joins, journal
from ..sources import tables
from ..streaming import apply


LOG = [
    (0, "app", "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_totalprice DOUBLE)"),
    (500, "app", "ALTER TABLE orders ADD COLUMN o_flag INT DEFAULT 7 AFTER o_custkey"),
    (900, "app", "ALTER TABLE orders RENAME COLUMN o_custkey TO o_totalprice, RENAME COLUMN o_totalprice TO o_custkey"),
    (1200, "app", "RENAME TABLE orders TO archive_orders"),
]


@query(
    "ddl6_schema_versions",
    """
    SELECT * FROM (VALUES ('orders', 0::BIGINT, 500::BIGINT, 'o_orderkey,o_custkey,o_totalprice'), ('orders', 500, 900, 'o_orderkey,o_custkey,o_flag,o_totalprice'),
      ('orders', 900, 1200, 'o_orderkey,o_totalprice,o_flag,o_custkey'), ('archive_orders', 1200, NULL, 'o_orderkey,o_totalprice,o_flag,o_custkey')) t(tbl, valid_from, valid_to, columns)
    """,
)
def ddl6_schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, a, b, ",".join(c)) for _, t, a, b, c in ddl.history(LOG)]
    return spark.createDataFrame(rows, "tbl string, valid_from long, valid_to long, columns string")


@query("ddl6_add_column", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey >= 500 THEN 7 END AS o_flag FROM orders")
def ddl6_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written before the column was added have no value for it; later ones its default."""
    orders = tables.table(spark, sf_dir, "orders")
    default = ddl.parse(LOG[1][2]).detail[0][1][0].default
    return orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") >= LOG[1][0], F.lit(int(default))).alias("o_flag"))


@query("ddl7_swap_columns", "SELECT n_nationkey, n_regionkey::VARCHAR AS n_name, n_name AS n_regionkey FROM nation")
def ddl7_swap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = dict(d for _, d in ddl.parse("ALTER TABLE nation RENAME COLUMN n_name TO n_regionkey, RENAME COLUMN n_regionkey TO n_name").detail)
    nation = tables.table(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    return nation.select(*[F.col(c).alias(renames.get(c, c)) for c in nation.columns])


@query("ddl_schema_at_event", "SELECT event_id, CASE WHEN event_id < 500 THEN 'o_orderkey,o_custkey,o_totalprice' WHEN event_id < 900 THEN 'o_orderkey,o_custkey,o_flag,o_totalprice' WHEN event_id < 1200 THEN 'o_orderkey,o_totalprice,o_flag,o_custkey' END AS columns FROM events")
def ddl_schema_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").select("event_id", F.lit("orders").alias("tbl"))
    return joins.temporal(events, ddl6_schema_versions(spark, sf_dir), ["tbl"], "event_id").select("event_id", "columns")


@query("mut8_row_identity", "SELECT * FROM (VALUES ('a', 'primary', 'id'), ('b', 'unique', 'x,y'), ('c', 'fullRow', 'n,s')) t(tbl, kind, columns)")
def mut8_row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = ddl.Registry()
    for sql in (
        "CREATE TABLE a (id INT PRIMARY KEY, n INT)",
        "CREATE TABLE b (x INT NOT NULL, y INT NOT NULL, z INT, UNIQUE Zz (z), UNIQUE k2 (x, y), UNIQUE k3 (y))",
        "CREATE TABLE c (n INT, s VARCHAR(20), g INT AS (n + 1) STORED, UNIQUE (n))",
    ):
        registry.apply(ddl.parse(sql))
    rows = [(name, *ddl.row_identity(t)) for (_, name), t in registry.tables.items()]
    return spark.createDataFrame([(t, k, ",".join(c)) for t, k, c in rows], "tbl string, kind string, columns string")


@query(
    "str6_dedupe_gtid",
    "SELECT event_type AS sid, event_id // 3 AS gno, min(event_id) AS seq FROM events WHERE NOT (event_type = 'click' AND event_id // 3 BETWEEN 0 AND 99) GROUP BY 1, 2",
)
def str6_dedupe_gtid(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = tables.table(spark, sf_dir, "events").selectExpr("event_type AS sid", "event_id div 3 AS gno", "event_id AS seq")
    covered = spark.createDataFrame([("click", 0, 99)], "sid string, lo long, hi long")
    return journal.new_groups(groups, covered, ["sid"], "gno", "seq")


@query("str6_duplicate_gtids", "SELECT event_type AS sid, event_id // 3 AS gno, count(*) AS times FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def str6_duplicate_gtids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.duplicates(tables.table(spark, sf_dir, "events").selectExpr("event_type AS sid", "event_id div 3 AS gno"), ["sid"], "gno")


@query(
    "str11_journal_violations",
    """
    WITH g AS (SELECT event_id AS seq, event_type AS sid, event_id AS gno, event_id * 10 AS s, event_id * 10 + 9 + CASE WHEN event_id % 400 = 0 THEN 5 ELSE 0 END AS e, CASE WHEN event_id % 300 = 299 THEN 'pending' ELSE 'applied' END AS state FROM events WHERE event_id <> 57)
    SELECT 'prefix' AS code, seq FROM (SELECT *, lag(state) OVER (ORDER BY seq) AS b FROM g) WHERE state = 'applied' AND b = 'pending'
    UNION ALL SELECT 'gap', 58
    UNION ALL SELECT 'range', seq FROM (SELECT *, lag(e) OVER (ORDER BY seq) AS b FROM g) WHERE s < b OR e > (SELECT max(event_id) * 10 FROM events)
    UNION ALL SELECT 'covered', seq FROM g WHERE state = 'pending' AND sid = 'view'
    UNION ALL SELECT 'orphan', 57
    """,
)
def str11_journal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    groups = events.where("event_id <> 57").selectExpr("event_id AS seq", "event_type AS sid", "event_id AS gno", "event_id * 10 AS start", "event_id * 10 + 9 + if(event_id % 400 = 0, 5, 0) AS end", "if(event_id % 300 = 299, 'pending', 'applied') AS state")
    intents = events.selectExpr("event_id AS seq", "event_id AS event_offset", "0 AS row")
    covered = spark.createDataFrame([("view", 0, 10_000_000)], "sid string, lo long, hi long")
    length = events.agg(F.max("event_id") * 10).first()[0]
    return journal.violations(groups, intents, covered, F.lit(length))


@query("jon10_evidence", "SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'missing' ELSE 'found' END AS state FROM events")
def jon10_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = tables.table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_id * 3 AS event_offset", "1 AS row")
    return journal.evidence(intents, intents.where("seq % 5 <> 0")).select("seq", "state")


@query("ord6_prunable", "SELECT event_id AS seq FROM events WHERE event_type <> 'error' AND event_id < 800 ORDER BY event_id LIMIT 128")
def ord6_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = tables.table(spark, sf_dir, "events").selectExpr("event_id AS seq", "if(event_type = 'error', 'pending', 'applied') AS state", "event_id AS at")
    return journal.prunable(groups, F.lit(800), "at").select("seq")


@query("snk10_excerpt", "SELECT event_id FROM (SELECT event_id, sum(10 + event_id % 7) OVER (ORDER BY event_id DESC) AS s FROM events WHERE event_id <= 700) WHERE s <= 500")
def snk10_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").selectExpr("event_id", "10 + event_id % 7 AS size")
    return journal.excerpt(events, "event_id", "size", 700, 500).select("event_id")


@query("str16_lifecycle", "SELECT event_id, s AS state, b AS before FROM (SELECT *, lag(s) OVER (ORDER BY event_id) AS b FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'STARTING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'STOPPED' ELSE 'DRAINING' END ELSE 'STOPPED' END AS s FROM events)) WHERE (b = 'STOPPED' AND s <> 'STARTING')")
def str16_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = "CASE event_id % 4 WHEN 0 THEN 'STARTING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN if(event_id % 3 = 0, 'STOPPED', 'DRAINING') ELSE 'STOPPED' END AS state"
    return journal.lifecycle_errors(tables.table(spark, sf_dir, "events").selectExpr("event_id", state), "event_id", "state").select("event_id", "state", "before")


@query(
    "str_stream_equals_batch",
    """
    SELECT user_id, event_id AS last_seq, event_type, round(value, 6) AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'
    """,
)
def str_stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold as a stream: files are applied in micro-batches that replace themselves when run again."""
    folder = scratch.shared_dir(spark, "stream")
    schema = tables.table(spark, sf_dir, "events").schema
    stream = tables.as_event_log(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))
    sink = apply.SnapshotSink(f"{folder}/state", ["user_id"], "seq", "op", ["event_type", "value"], ("event_type", "seq"))
    apply.run_available(stream, sink, f"{folder}/checkpoint")
    return sink.snapshot(spark).select("user_id", F.col("seq").alias("last_seq"), "event_type", F.round("value", 6).alias("value"))


@query(
    "str3_stream_assembler",
    """
    SELECT 'f' || (event_id // 600) AS file, min(event_id) AS first, max(event_id) AS last, count(*) AS events, CAST(sum(19 + event_id % 80) AS BIGINT) AS bytes, 2::BIGINT AS row_events, 'committed' AS outcome, NULL::VARCHAR AS error
    FROM events GROUP BY event_id // 600, event_id // 6 HAVING count(*) = 6
    """,
)
def str3_stream_assembler(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.shared_dir(spark, "assembler")
    schema = tables.table(spark, sf_dir, "events").schema
    kind = "CASE event_id % 6 WHEN 0 THEN 'gtid' WHEN 1 THEN 'begin' WHEN 2 THEN 'table_map' WHEN 3 THEN 'rows' WHEN 4 THEN 'rows_end' ELSE 'xid' END AS kind"
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").selectExpr("concat('f', event_id div 600) AS file", "event_id AS offset", kind, "19 + event_id % 80 AS size")
    assembled = apply.assemble_stream(stream)
    assembled.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(apply.OUTPUT).parquet(f"{folder}/out")


@query(
    "str4_batches_of_groups",
    """
    WITH e AS (SELECT *, event_id // 7 AS gno FROM events), c AS (
      SELECT CASE WHEN event_id % 10 = 3 THEN user_id + 100000 ELSE user_id END AS id, event_id * 2 + 1 AS o, event_id AS seq, value, event_type FROM e WHERE gno % 11 <> 5
      UNION ALL SELECT user_id, event_id * 2, event_id, value, 'error' FROM e WHERE gno % 11 <> 5 AND event_id % 10 = 3 AND event_type <> 'error' AND event_type <> 'signup')
    SELECT id, seq, round(value, 6) AS value FROM (SELECT CASE WHEN event_type IN ('error', 'signup') AND id >= 100000 THEN CASE WHEN event_type = 'error' THEN id - 100000 ELSE id END ELSE id END AS id, o, seq, value, event_type FROM c)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY o DESC) = 1 AND event_type <> 'error'
    """,
)
def str4_batches_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of seven row changes in three batches, of which one comes twice, one overlaps the one before it, and the sink is compacted in between; keys move, and some groups are skipped."""
    log = tables.event_log(spark, sf_dir)
    moved = log.withColumn("id", F.when(F.col("seq") % 10 == 3, F.col("user_id") + 100_000).otherwise(F.col("user_id")))
    changes = moved.select("seq", "op", "id", F.col("user_id").alias("old_id"), F.expr("seq div 7").alias("gno"), F.lit("a").alias("sid"), F.when(F.expr("seq div 7 % 11 = 5"), "mysql.1062").alias("code"), "value")
    sink = apply.SnapshotSink(f"{scratch.shared_dir(spark, 'groups')}/state", ["id"], "seq", "op", ["value"], ("sid", "gno"), ["old_id"], "code")
    top = log.agg(F.max("seq")).first()[0]
    third = top // 21 * 7
    sink(changes.where(F.col("seq") < third), 0)
    sink(changes.where(F.col("seq").between(third - 70, 2 * third - 1)), 1)
    sink(changes.where(F.col("seq").between(third - 70, 2 * third - 1)), 1)
    sink.compact(spark)
    sink(changes.where(F.col("seq") >= third), 2)
    return sink.snapshot(spark).select("id", "seq", F.round("value", 6).alias("value"))
