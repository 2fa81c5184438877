"""Counters, stage times, backlog, rates and estimates over the apply log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import running


def counters(groups: DataFrame, by: list[str], outcome: str, events: str, size: str, rows: dict[str, str], acknowledged: Column) -> DataFrame:
    """Totals by outcome: groups, events, bytes, and the rows of each operation as far as they are acknowledged."""
    outcomes = ("applied", "filtered", "policySkipped", "errorSkipped")
    return groups.groupBy(*by).agg(
        F.count("*").alias("transactions"),
        F.sum(events).alias("events"),
        F.sum(size).alias("bytes"),
        *[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes],
        *[F.sum(F.when(acknowledged, F.col(c)).otherwise(0)).alias(name) for name, c in rows.items()],
    )


def summary_lines(totals: DataFrame, by: list[str]) -> DataFrame:
    """Totals as JSON lines, one for each group: its keys, then the other columns by name. Nulls are written as null."""
    rest = sorted(c for c in totals.columns if c not in by)
    return totals.select(F.to_json(F.struct(*by, *rest), {"ignoreNullFields": "false"}).alias("line"))


def stage_times(spans: DataFrame, stage: str, parent: str, total: str, failed: str) -> DataFrame:
    """Per stage: calls, failures, total, longest, and self time (total less that of the stages it calls)."""
    own = spans.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("calls"), F.count_if(F.col(failed)).alias("failures"), F.sum(total).alias("total"), F.max(total).alias("longest"))
    inner = spans.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("stage")).agg(F.sum(total).alias("inner"))
    return own.join(inner, "stage", "left").withColumn("self", F.col("total") - F.coalesce("inner", F.lit(0))).drop("inner")


def backlog(files: DataFrame, number: str, size: str, at_file: Column, at_position: Column) -> Column:
    """Bytes of a file that lie after the coordinate (file number, position)."""
    return F.when(F.col(number) < at_file, 0).when(F.col(number) == at_file, F.greatest(F.col(size) - at_position, F.lit(0))).otherwise(F.col(size))


def retained_cost(values: Column) -> Column:
    """Weight of a row's values in memory: 64 for the row, and length + 48 for each value."""
    return F.aggregate(values, F.lit(64).cast("long"), lambda acc, v: acc + F.coalesce(F.octet_length(v), F.lit(0)) + 48)


def rate_window(samples: DataFrame, keys: list[str], time: str, count: str, seconds: int, stretch: int = 64) -> DataFrame:
    """samples with rate: growth of count a second over the window before each sample; null under a span of one second.

    time: seconds as a number. The window is a frame by time, so late rows only matter inside it. Time is cut into
    stretches of ``stretch`` windows; a sample also goes to the next stretch where frames still reach back to it, so no
    task holds a whole source.
    """
    width = seconds * stretch
    number = F.floor(F.col(time) / width)
    near = F.col(time) - number * width >= width - seconds
    copies = F.when(near, F.array(F.struct(number.alias("b"), F.lit(True).alias("own")), F.struct((number + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(number.alias("b"), F.lit(True).alias("own"))))
    laid = samples.withColumn("_x", F.explode(copies)).withColumn("_stretch", F.col("_x.b")).withColumn("_own", F.col("_x.own")).drop("_x")
    frame = Window.partitionBy(*keys, "_stretch").orderBy(time).rangeBetween(-seconds, 0)
    span = F.col(time) - F.first(time).over(frame)
    grown = F.col(count) - F.first(count).over(frame)
    return laid.withColumn("rate", F.when(span >= 1, grown / span)).where("_own").drop("_stretch", "_own")


def source_rate(samples: DataFrame, keys: list[str], order: str, time: str, produced: str) -> DataFrame:
    """samples with source_rate: what the source made a second since the sample before; null where time stands still."""
    seen = running.previous(samples, keys, order, _t=F.col(time), _p=F.col(produced))
    span = F.col(time) - F.col("_t")
    return seen.withColumn("source_rate", F.when(span > 0, (F.col(produced) - F.col("_p")) / span)).drop("_t", "_p")


def estimate(remaining: Column, apply_rate: Column, source_rate: Column, replay: Column, stale: Column, paused: Column) -> tuple[Column, Column]:
    """(status, seconds to go). The effective rate is the apply rate less, while live, the source's rate; stale samples give no estimate."""
    effective = apply_rate - F.when(replay, F.lit(0.0)).otherwise(F.coalesce(source_rate, F.lit(0.0)))
    status = (
        F.when(paused, "paused").when(stale, "stale").when(remaining == 0, "caughtUp").when(apply_rate.isNull() | (apply_rate <= 0), "noRecentProgress")
        .when(effective <= 0, "notCatchingUp").otherwise("estimated")
    )
    return status, F.when(status == "estimated", remaining / effective)


def stale(age: Column, poll: float, error: Column) -> Column:
    """A sample older than two polls, or one whose poll failed."""
    return (age > 2 * poll) | F.coalesce(error, F.lit(False))


def backoff(attempts: DataFrame, keys: list[str], order: str, applied: str, first: float = 1.0, most: float = 30.0) -> DataFrame:
    """attempts with delay: doubling from first up to most; the count of failures starts anew when the applied count changes."""
    seen = running.previous(attempts, keys, order, _a=F.col(applied))
    marked = seen.withColumn("_new", (~F.col(applied).eqNullSafe(F.col("_a"))).cast("int"))
    runs = running.running(marked, keys, order, _run=("sum", F.col("_new")))
    numbered = running.running(runs, [*keys, "_run"], order, _k=("sum", F.lit(1)))
    return numbered.withColumn("delay", F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), F.least(F.col("_k") - 1, F.lit(60))))).drop("_a", "_new", "_run", "_k")
