"""Transactions assembled from an ordered event stream.

Events carry file, start and end offsets and a kind: fde, previous_gtids, gtid,
anonymous, begin, commit, rollback, statement, xid, table_map, rows, rotate, stop.
Group numbers are running counts of group starts, folded block by block, so one
long file is assembled in parallel; no group may cross files, so files are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running

MAX_EVENTS = 4096
MAX_BYTES = 256 << 20

STARTS = ("gtid", "anonymous")
ENDS = ("xid", "commit", "rollback", "statement")


def classify(sql: Column) -> Column:
    """Kind of a Query event: the exact words BEGIN, COMMIT, ROLLBACK; unsupported for XA, START, SAVEPOINT and RELEASE; else statement."""
    word = F.upper(F.regexp_extract(F.ltrim(sql), r"^([A-Za-z]+)", 1))
    return (
        F.when(sql == "BEGIN", "begin").when(sql == "COMMIT", "commit").when(sql == "ROLLBACK", "rollback")
        .when(word.isin("XA", "START", "SAVEPOINT", "RELEASE"), "unsupported").otherwise("statement")
    )


def assemble(events: DataFrame, order: str, kind: str, keys: list[str] = ()) -> DataFrame:
    """events with txn (number of the group within keys, from 1; null before the first group and for events between groups)."""
    keys = list(keys)
    start = F.col(kind).isin(*STARTS).cast("int")
    end = F.col(kind).isin(*ENDS).cast("int")
    # the order of the last start and of the last end before this event: open while no end has come since
    marked = running.running(events, keys, order, _starts=("sum", start), _ended=("max", F.when(end == 1, F.col(order)), False), _started=("max", F.when(start == 1, F.col(order))))
    open_ = F.col("_started").isNotNull() & (F.col("_ended").isNull() | (F.col("_ended") < F.col("_started")))
    return marked.withColumn("txn", F.when(open_, F.col("_starts"))).drop("_starts", "_ended", "_started")


def transactions(assembled: DataFrame, order: str, kind: str, size: str, keys: list[str] = (), max_events: int = MAX_EVENTS, max_bytes: int = MAX_BYTES, **more: Column) -> DataFrame:
    """One row for each group: first and last order, events, bytes, rows, outcome and error, and an aggregate name=column more each.

    outcome: committed, rolledBack, statement, or incomplete where no end came. error: sequence (a rollback of rows), limit, or null.
    """
    groups = assembled.where("txn IS NOT NULL").groupBy(*keys, "txn").agg(
        F.min(order).alias("first"),
        F.max(order).alias("last"),
        F.count("*").alias("events"),
        F.sum(size).alias("bytes"),
        F.sum(F.when(F.col(kind) == "rows", 1).otherwise(0)).alias("row_events"),
        F.max(F.when(F.col(kind).isin(*ENDS), F.col(kind))).alias("end"),
        *[value.alias(name) for name, value in more.items()],
    )
    outcome = F.when(F.col("end").isin("xid", "commit"), "committed").when(F.col("end") == "rollback", "rolledBack").when(F.col("end") == "statement", "statement").otherwise("incomplete")
    error = F.when((F.col("end") == "rollback") & (F.col("row_events") > 0), "sequence").when((F.col("events") > max_events) | (F.col("bytes") > max_bytes), "limit")
    return groups.withColumn("outcome", outcome).withColumn("error", error).drop("end")


#: Transactions after which a run may be told to stop.
STOP_RANGE = (1, 1_000_000)


def first_transactions(assembled: DataFrame, order: str, most: int) -> DataFrame:
    """The events of the first ``most`` transactions of a log in one order, and what stands between them; nothing after the last one's end."""
    if not STOP_RANGE[0] <= most <= STOP_RANGE[1]:
        raise ValueError(f"between {STOP_RANGE[0]} and {STOP_RANGE[1]} transactions")
    last = assembled.where(F.col("txn") == most).agg(F.max(order).alias("_last"))
    return assembled.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).drop("_last")  # one row


def gaps(events: DataFrame, order: str, start: str, end: str, keys: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """Events that don't start where the event before them ended. excluded (keys, lo, hi): ranges that the source has left out, which are no gaps."""
    seen = running.previous(events, keys, order, _end=F.col(end))
    if excluded is not None:
        skipped = excluded.select(*keys, F.col("lo").alias("_end"), F.col("hi").alias(start)).distinct()
        seen = seen.join(skipped, [*keys, "_end", start], "left_anti")
    return seen.where(F.col("_end").isNotNull() & (F.col("_end") != F.col(start))).withColumnRenamed("_end", "expected")


def before_first_error(rows: DataFrame, order: str, bad: Column, keys: list[str] = ()) -> DataFrame:
    """The rows before the first bad one: after a failure nothing more may come out."""
    keys = list(keys)
    if not keys:
        first = rows.where(bad).agg(F.min(order).alias("_first"))
        return rows.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")
    first = rows.where(bad).groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, keys, "left").where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


#: state, kind -> next state; other pairs are errors. The groups of one file in order.
MACHINE = {
    ("idle", "fde"): "idle", ("idle", "previous_gtids"): "idle", ("idle", "gtid"): "gtid", ("idle", "anonymous"): "gtid",
    ("idle", "begin"): "transaction", ("gtid", "begin"): "transaction", ("idle", "statement"): "idle", ("gtid", "statement"): "idle",
    ("transaction", "table_map"): "statement_open", ("statement_open", "table_map"): "statement_open",
    ("statement_open", "rows"): "statement_open", ("statement_open", "rows_end"): "transaction",
    ("transaction", "commit"): "idle", ("transaction", "rollback"): "idle", ("transaction", "xid"): "idle",
    ("idle", "rotate"): "rotated", ("rotated", "fde"): "idle", ("idle", "stop"): "stopped",
}


def sequence_errors(events: DataFrame, order: str, kind: str, keys: list[str]) -> DataFrame:
    """Events that may not follow the event before them, by the kinds alone (rows_end: rows that close their statement).

    The state after an event depends only on its kind, so the check needs no sequential fold.
    """
    after: dict[str, set[str]] = {}
    for (_, k), state in MACHINE.items():
        after.setdefault(k, set()).add(state)
    follows = {p: {k for (state, k) in MACHINE if state in states} for p, states in after.items()}
    seen = running.previous(events, keys, order, _before=F.col(kind))
    good = F.col("_before").isNull() & F.col(kind).isin("fde", *[k for (s, k) in MACHINE if s == "idle"])
    for p, kinds in follows.items():
        good = good | ((F.col("_before") == p) & F.col(kind).isin(*sorted(kinds))) if kinds else good
    return seen.where(~F.coalesce(good, F.lit(False))).withColumnRenamed("_before", "after")
