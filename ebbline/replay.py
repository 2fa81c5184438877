"""Replay of an archive as one batch job: events, transactions, changes, snapshots.

    log = replay.read(spark, "/logs")
    changes = replay.changes(log, include=["app.%"], executed="uuid:1-100")
    rows = replay.snapshot(changes, table, "app", "orders")
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import ddl
from .operators import filters, fold, gtid, transactions
from .sources import binlog

FILE_NUMBER = r"(\d+)$"

#: Column types of a table -> Spark types; what Spark can't hold without loss stays text.
SPARK_TYPES = {"tinyint": "int", "smallint": "int", "mediumint": "int", "int": "long", "bigint": "long", "float": "float", "double": "double", "year": "int", "bit": "decimal(20,0)", "enum": "int", "set": "decimal(20,0)"}


def read(spark: SparkSession, path: str, tables: Sequence[str] = ()) -> DataFrame:
    """Events of a file or folder; with tables (patterns db.table), the rows of others are not decoded."""
    binlog.register(spark)
    reader = spark.read.format("binlog")
    return (reader.option("tables", ",".join(tables)) if tables else reader).load(path)


def groups(events: DataFrame) -> DataFrame:
    """One row for each transaction (file, txn): offsets, counts, outcome, error, gtid. Files are assembled independently."""
    return _groups(_assembled(events))


def _assembled(events: DataFrame) -> DataFrame:
    """file, offset, kind, gtid, size, txn of each event: what groups need, without the images of rows."""
    narrow = events.select("file", "offset", "kind", "gtid", (F.col("next_pos") - F.col("offset")).alias("size"))
    return transactions.assemble(narrow, "offset", "kind", ["file"])


def _groups(assembled: DataFrame) -> DataFrame:
    # a group has one start, so one number at most
    return transactions.transactions(assembled, "offset", "kind", "size", ["file"], gtid=F.max(F.when(F.col("kind") == "gtid", F.col("gtid"))))


def changes(events: DataFrame, include: Sequence[str] = (), ignore: Sequence[str] = (), executed: str = "", stop_at: str = "", after_transactions: int | None = None) -> DataFrame:
    """Row changes of committed transactions in source order.

    Columns: file_no, offset, row_ordinal (the order), gtid, db, tbl, op, before, after, fk_checks. Groups that executed
    covers are left out; stop_at (a set) or after_transactions ends the replay after a whole group; an archive that ends
    before it is a ReplayError.
    """
    spark = events.sparkSession
    events = scratch.written(events, "events")  # files are decoded once
    assembled = scratch.written(_assembled(events), "assembled")
    found = _groups(assembled).where("error IS NULL AND outcome IN ('committed', 'statement')")
    found = found.withColumn("file_no", F.regexp_extract("file", FILE_NUMBER, 1).cast("long")).withColumn("at", F.struct("file_no", "first"))
    found = found.withColumn("sid", F.regexp_extract("gtid", r"^([^:]+)", 1)).withColumn("tag", F.regexp_extract("gtid", r":([a-z_]\w*):", 1)).withColumn("gno", F.regexp_extract("gtid", FILE_NUMBER, 1).cast("long"))
    if executed:
        found = filters.without_covered(found, gtid.frame(spark, executed), ["sid", "tag"], "gno")
    if stop_at or after_transactions is not None:
        # the order of the groups as a number: running count over files, one row for each group
        from .operators import running

        # a group's place: groups of earlier files, and those before it in its own
        per_file = found.groupBy("file_no").agg(F.count("*").alias("n")).withColumn("x", F.col("file_no"))
        base = running.running(per_file, [], "x", inclusive=False, base=("sum", F.col("n"))).select("file_no", "base")
        counted = running.running(found, ["file_no"], "first", inclusive=False, within=("sum", F.lit(1)))
        found = counted.join(base, "file_no").withColumn("place", F.col("base") + F.col("within")).drop("base", "within")
        found = scratch.written(found, "groups")  # the stop is found in several jobs
        target = gtid.frame(spark, stop_at) if stop_at else None
        if target is not None and not gtid.uncovered(target, _seen(spark, found, executed), ["sid", "tag"]).isEmpty():
            raise ReplayError("the archive ends before its groups cover the stop set")
        if target is None and found.count() < after_transactions:
            raise ReplayError(f"the archive ends before {after_transactions} transactions")
        if target is not None:
            found = gtid.prefix_until_covered(found, "place", ["sid", "tag"], "gno", target, after_transactions)
        else:
            found = found.where(F.col("place") < after_transactions)
    # places of the row events of the groups that stay; their images are shuffled once, or not at all where few stay
    rows = events.where("kind = 'rows' AND NOT filtered").where(~filters.ignored(F.col("db"), F.col("tbl"), include, ignore))
    places = assembled.where("kind = 'rows'").select("file", "offset", "txn").join(found.select("file", "txn", "gtid", "file_no"), ["file", "txn"]).drop("txn")
    kept = rows.drop("gtid").join(scratch.written(places, "places"), ["file", "offset"])
    exploded = kept.select("file_no", "offset", "gtid", "db", "tbl", (F.col("row_flags").bitwiseAND(F.lit(2)) == 0).alias("fk_checks"), F.posexplode("rows").alias("row_ordinal", "r"))
    return exploded.select("file_no", "offset", "row_ordinal", "gtid", "db", "tbl", "fk_checks", "r.op", "r.before", "r.after")


class ReplayError(ValueError):
    """A replay whose stop condition its archive does not reach."""


def _seen(spark: SparkSession, found: DataFrame, executed: str) -> DataFrame:
    """The canonical set of the groups that were found and of those executed before."""
    keys = ["sid", "tag"]
    seen = gtid.islands(found, keys, "gno")
    return gtid.union(seen.unionByName(gtid.frame(spark, executed)), keys) if executed else seen


def _value(image: str, i: int, column: ddl.Column):
    cell = F.get(F.col(image), F.lit(i))
    base = column.type.split("(")[0]
    if base in ddl.CATEGORIES["binary"] or base in ddl.CATEGORIES["geometry"]:
        return cell["bin"]
    target = SPARK_TYPES.get(base, "string")
    if base == "bigint" and column.unsigned:
        target = "decimal(20,0)"
    if base == "decimal":
        digits = column.type.partition("(")[2].rstrip(")") or "10,0"
        precision, _, scale = digits.partition(",")
        target = f"decimal({precision},{scale or 0})" if int(precision) <= 38 else "string"
    return cell["value"].cast(target)


def typed(changes_: DataFrame, table: ddl.Table, db: str, tbl: str) -> DataFrame:
    """Changes of one table with typed before and after structs: one pass, no shuffle."""
    mine = changes_.where((F.col("db") == db) & (F.col("tbl") == tbl))
    image = lambda name: F.when(F.col(name).isNotNull(), F.struct(*[_value(name, i, c).alias(c.name) for i, c in enumerate(table.columns)]))
    return mine.withColumn("before", image("before")).withColumn("after", image("after"))


def snapshot(changes_: DataFrame, table: ddl.Table, db: str, tbl: str) -> DataFrame:
    """The table's rows after all changes: keyed by its row identity, or as a bag where it has none."""
    rows = typed(changes_, table, db, tbl)
    names = [c.name for c in table.columns]
    kind, keys = ddl.row_identity(table)
    if kind == "fullRow":
        signed = F.array_compact(F.array(F.when(F.col("before").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("row"))), F.when(F.col("after").isNotNull(), F.struct(F.lit(1).alias("sign"), F.col("after").alias("row")))))
        bag = rows.select(F.explode(signed).alias("s")).select("s.sign", "s.row.*")
        return fold.expand_bag(fold.bag_fold(bag, names, "sign").drop("broken"), "n")
    old, new, plain = ([f"_{p}_{k}" for k in keys] for p in ("old", "new", "key"))
    keyed = rows.select("op", "after", "file_no", "offset", "row_ordinal", *[F.col("before")[k].alias(o) for k, o in zip(keys, old, strict=True)], *[F.col("after")[k].alias(n) for k, n in zip(keys, new, strict=True)])
    split = fold.split_key_moves(keyed, old, new, plain, "op").withColumn("_at", F.struct("file_no", "offset", "row_ordinal", "sub"))
    return fold.keyed_snapshot(split, plain, "_at", "op", ["after"]).select("after.*")
