"""Standard tables, and the change logs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ddl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_event_log(events: DataFrame) -> DataFrame:
    """Rows of ``events`` as a keyed change log: seq, op (insert, update or delete), user_id as key, value as after image."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return events.select(F.col("event_id").alias("seq"), op.alias("op"), "user_id", "event_type", "value", "ts", "props")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_log(table(spark, sf_dir, "events"))


#: Spark types -> canonical column types.
COLUMN_TYPES = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "string": "text", "binary": "blob", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "datetime(6)", "boolean": "tinyint(1)"}


def discover(df: DataFrame, primary_key: tuple[str, ...] = ()) -> ddl.Table:
    """A table's schema from its DataFrame, with the given primary key."""
    known = {k.lower() for k in primary_key}
    columns = tuple(ddl.Column(f.name, COLUMN_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()), f.nullable and f.name.lower() not in known) for f in df.schema.fields)
    return ddl.Table(columns, (ddl.Index("PRIMARY", primary_key, "primary"),) if primary_key else ())
