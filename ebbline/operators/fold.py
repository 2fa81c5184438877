"""Folds of ordered row changes into table states.

A change has an order (seq), an operation (insert, update or delete), a key before
and after it, and an after image. Keyed folds are single hash aggregates with
map-side partials: a hot key costs each task one row. Keyless tables are bags:
each change adds +1 or -1 to its full row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import running


def keyed_snapshot(log: DataFrame, keys: list[str], seq: str, op: str, columns: list[str]) -> DataFrame:
    """The table after all changes: each key's newest image, unless its newest change deletes it."""
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(seq, op, *columns), F.col(seq)).alias("_last"))
    return newest.where(F.col("_last")[op] != "delete").select(*keys, *[F.col("_last")[c].alias(c) for c in [seq, *columns]])


def update_fold(log: DataFrame, keys: list[str], seq: str, op: str, columns: list[str]) -> DataFrame:
    """What the updates alone make of each key: the newest image, the order of the last update and how many there were. Keys must not move."""
    newest = log.where(F.col(op) == "update").groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("_last"), F.max(seq).alias("last_seq"), F.count("*").alias("updates"))
    return newest.select(*keys, "last_seq", "updates", *[F.col("_last")[c].alias(c) for c in columns])


def deleted_keys(log: DataFrame, keys: list[str], seq: str, op: str) -> DataFrame:
    """Keys whose newest change deletes them, with its order."""
    newest = log.groupBy(*keys).agg(F.max_by(op, seq).alias("_op"), F.max(seq).alias("deleted_at"))
    return newest.where("_op = 'delete'").drop("_op")


def split_key_moves(log: DataFrame, old_keys: list[str], new_keys: list[str], keys: list[str], op: str) -> DataFrame:
    """An update that changes the key becomes a delete of the old key (sub 0) and an insert of the new one (sub 1).

    Afterwards each key can be folded by itself, in the order (seq, sub).
    """
    moved = F.lit(False)
    for old, new in zip(old_keys, new_keys, strict=True):
        moved = moved | ~F.col(old).eqNullSafe(F.col(new))
    named = lambda names: [F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]
    plain = F.struct(F.lit(1).alias("sub"), F.col(op).alias("op"), *[F.when(F.col(op) == "delete", F.col(o)).otherwise(F.col(n)).alias(k) for o, n, k in zip(old_keys, new_keys, keys, strict=True)])
    parts = F.when(
        (F.col(op) == "update") & moved,
        F.array(F.struct(F.lit(0).alias("sub"), F.lit("delete").alias("op"), *named(old_keys)), F.struct(F.lit(1).alias("sub"), F.lit("insert").alias("op"), *named(new_keys))),
    ).otherwise(F.array(plain))
    rest = [c for c in log.columns if c not in (op, *old_keys, *new_keys, *keys)]
    return log.select(*rest, F.explode(parts).alias("_p")).select(*rest, "_p.*")


def bag_fold(log: DataFrame, columns: list[str], sign: str) -> DataFrame:
    """A keyless table after all changes: full rows with their multiplicity n, and broken where deletes outnumber inserts.

    Rows are compared as a whole: null equals null, text by bytes, and floats by value and sign of zero.
    """
    log, identity = with_identity(log, columns)
    folded = log.groupBy(*identity).agg(*[F.first(c).alias(c) for c in columns], F.sum(sign).alias("n"))
    return folded.select(*columns, "n", (F.col("n") < 0).alias("broken")).where("n <> 0")


def with_identity(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with grouping columns under which two rows are equal only if their bytes are: -0.0 and 0.0 differ."""
    names = []
    for i, c in enumerate(columns):
        number = dict(rows.dtypes)[c] in ("double", "float")  # as text, in which -0.0 and 0.0 differ
        rows = rows.withColumn(f"_i{i}", F.col(c).cast("string") if number else F.col(c))
        names.append(f"_i{i}")
    return rows, names


def bag_legality(log: DataFrame, columns: list[str], seq: str, sign: str) -> DataFrame:
    """The changes that would delete a row that isn't there: running multiplicity below zero."""
    log, identity = with_identity(log, columns)
    return running.running(log, identity, seq, _left=("sum", F.col(sign))).where("_left < 0").drop(*identity)


def expand_bag(bag: DataFrame, n: str) -> DataFrame:
    """Each row of a bag as often as its multiplicity says."""
    return bag.where(F.col(n) > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop("_copy", n)


def duplicate_inserts(log: DataFrame, keys: list[str], seq: str, op: str) -> DataFrame:
    """Inserts of a key that is there already (error 1062): the key's change before is no delete."""
    seen = running.previous(log, keys, seq, before=F.col(op))
    return seen.where((F.col(op) == "insert") & F.col("before").isNotNull() & (F.col("before") != "delete")).drop("before")


def affected_rows(log: DataFrame, keys: list[str], seq: str, op: str, columns: list[str]) -> DataFrame:
    """log with expected_affected: 0 for an update whose after image equals the key's image before, else 1."""
    image = F.struct(*columns)
    seen = running.previous(log, keys, seq, _before=F.struct(F.col(op).alias("op"), image.alias("image")))
    same = (F.col(op) == "update") & (F.col("_before")["op"] != "delete") & F.col("_before")["image"].eqNullSafe(image)
    return seen.withColumn("expected_affected", F.when(same, 0).otherwise(1)).drop("_before")


def generated_mismatch(rows: DataFrame, stored: str, computed: Column) -> DataFrame:
    """Rows whose stored generated column differs from its expression (null equals null)."""
    return rows.where(~F.col(stored).eqNullSafe(computed))


def truncated(log: DataFrame, table: list[str], seq: str, op: str) -> DataFrame:
    """The changes of each table after its last truncate."""
    last = log.groupBy(*table).agg(F.max(F.when(F.col(op) == "truncate", F.col(seq))).alias("_cut"))
    joined = log.join(last, table)
    return joined.where((F.col(op) != "truncate") & (F.col("_cut").isNull() | (F.col(seq) > F.col("_cut")))).drop("_cut")


def group_problems(events: DataFrame, keys: list[str], transactional: bool = False) -> DataFrame:
    """Groups that may not be applied, before any write: (keys, code), the first rule that a group breaks.

    events, one row each, of assembled groups: outcome, gtid (null if anonymous), op (of row events: insert, update or delete; else null),
    ends_statement, filtered, db and tbl. Codes: outcome (not committed), identity (no number), boundary (rows but no statement end),
    dml.multiple_statements and dml.multiple_tables (unless transactional), operation. Groups whose row events are all filtered have nothing to apply.
    """
    rows, kept = F.col("is_rows"), F.col("is_rows") & ~F.coalesce(F.col("filtered"), F.lit(False))
    table = F.when(kept, F.struct("db", "tbl"))
    found = events.groupBy(*keys).agg(
        F.every(F.col("outcome").eqNullSafe(F.lit("committed"))).alias("_committed"),
        F.max("gtid").alias("_gtid"),
        F.count_if(rows & F.coalesce(F.col("ends_statement"), F.lit(False))).alias("_ends"),
        F.count_if(kept).alias("_kept"),
        F.min(table).alias("_first"),
        F.max(table).alias("_last"),
        F.count_if(kept & ~F.coalesce(F.col("op").isin("insert", "update", "delete"), F.lit(False))).alias("_odd"),
    )
    code = F.when(~F.col("_committed"), "outcome").when(F.col("_gtid").isNull(), "identity").when(F.col("_kept") == 0, F.lit(None)).when(F.col("_ends") < 1, "boundary")
    if not transactional:
        code = code.when(F.col("_ends") > 1, "dml.multiple_statements").when(F.col("_first") != F.col("_last"), "dml.multiple_tables")
    return found.withColumn("code", code.when(F.col("_odd") > 0, "operation")).where("code IS NOT NULL").select(*keys, "code")


def flatten(groups: DataFrame, rows: str, order: list[str]) -> DataFrame:
    """Groups with an array of row changes -> a row for each change with its ordinal from 0, in source order."""
    rest = [c for c in groups.columns if c != rows]
    return groups.select(*rest, F.posexplode(rows).alias("row_ordinal", "_r")).select(*rest, "row_ordinal", "_r.*")


def recovery(log: DataFrame, keys: list[str], seq: str, before: str, after: str) -> DataFrame:
    """For each key: the first before image, the last after image, the number of changes, and ambiguous where a
    change's before image isn't the after image of the key's change before it."""
    chained = running.previous(log, keys, seq, _last=F.struct(F.col(after).alias("v")))
    broken = F.col("_last").isNotNull() & ~F.col("_last")["v"].eqNullSafe(F.col(before))
    return chained.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(before).alias("v")), F.col(seq))["v"].alias("initial"),
        F.max_by(F.struct(F.col(after).alias("v")), F.col(seq))["v"].alias("final"),
        F.count("*").alias("touches"),
        F.max(broken.cast("int")).cast("boolean").alias("ambiguous"),
    )


def enum_label(ordinal: Column, labels: list[str]) -> Column:
    """Label of an ENUM ordinal: '' for 0, null beyond the labels."""
    listed = F.array(*[F.lit(x) for x in labels])
    return F.when(ordinal == 0, "").when((ordinal > 0) & (ordinal <= len(labels)), F.get(listed, ordinal.cast("int") - 1))


def set_labels(mask: Column, labels: list[str]) -> Column:
    """Labels of a SET bit mask, joined by commas."""
    bit = lambda i: (F.shiftright(mask.cast("long"), i).bitwiseAND(F.lit(1))) == 1
    return F.concat_ws(",", *[F.when(bit(i), F.lit(x)) for i, x in enumerate(labels)])


def latest_by_window(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Each key's newest change as a whole row; for wide rows without a fixed column list."""
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
