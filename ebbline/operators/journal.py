"""The apply journal: intents before writes, acknowledgements after, and what recovery may do.

State tables are DataFrames of groups (seq, sid, gno, start, end, state) with state
pending or applied, and of intents (seq, event_offset, row). Checks give rows
(code, seq), so a journal is sound exactly if the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters, running


def violations(groups: DataFrame, intents: DataFrame, covered: DataFrame, durable: Column) -> DataFrame:
    """Broken invariants: acknowledgements out of order, gaps in the numbers, ranges that overlap or lie beyond the durable
    length, pending groups that are covered already, and intents without a group."""
    seen = running.previous(groups, [], "seq", _state=F.col("state"), _seq=F.col("seq"), _end=F.col("end"))
    order = seen.where((F.col("state") == "applied") & (F.col("_state") == "pending")).select(F.lit("prefix").alias("code"), "seq")
    gap = seen.where(F.col("_seq").isNotNull() & (F.col("seq") != F.col("_seq") + 1)).select(F.lit("gap").alias("code"), "seq")
    bounds = seen.where((F.col("start") > F.col("end")) | (F.col("end") > durable) | (F.col("start") < F.col("_end"))).select(F.lit("range").alias("code"), "seq")
    pending = groups.where("state = 'pending'")
    fresh = filters.without_covered(pending, covered, ["sid"], "gno")
    repeated = pending.join(fresh, "seq", "left_anti").select(F.lit("covered").alias("code"), "seq")
    orphan = intents.join(groups, "seq", "left_anti").select(F.lit("orphan").alias("code"), "seq").distinct()
    return order.unionByName(gap).unionByName(bounds).unionByName(repeated).unionByName(orphan)


def new_groups(groups: DataFrame, covered: DataFrame, keys: list[str], number: str, order: str) -> DataFrame:
    """Groups that are not covered yet, each number once (the first by order): at-least-once delivery becomes exactly once."""
    fresh = filters.without_covered(groups, covered, keys, number)
    first = fresh.groupBy(*keys, number).agg(F.min(order).alias("_first"))
    return fresh.join(first, [*keys, number]).where(F.col(order) == F.col("_first")).drop("_first")


def duplicates(groups: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Numbers that come more than once: an error while live."""
    return groups.groupBy(*keys, number).agg(F.count("*").alias("times")).where("times > 1")


class ResolveError(ValueError):
    """A resolution that the journal does not allow."""


def resolve(pending: list[int], action: str, chosen: list[int]) -> list[tuple[int, str]]:
    """pending numbers in order -> (number, new state). retry must name them all; mark_applied and skip exactly the earliest."""
    if action == "retry":
        if sorted(chosen) != pending:
            raise ResolveError("retry names the whole pending set")
        return [(n, "pending") for n in pending]
    if action not in ("mark_applied", "skip"):
        raise ResolveError(f"action {action}")
    if chosen != pending[:1] or not chosen:
        raise ResolveError("only the earliest pending group can be resolved")
    return [(chosen[0], "applied" if action == "mark_applied" else "skipped")]


def evidence(intents: DataFrame, relay: DataFrame) -> DataFrame:
    """Intents beside the row events of the relay: state found, or missing."""
    there = relay.select("event_offset", "row", F.lit(True).alias("_there")).distinct()
    joined = intents.join(there, ["event_offset", "row"], "left")
    return joined.withColumn("state", F.when(F.col("_there"), "found").otherwise("missing")).drop("_there")


def prunable(groups: DataFrame, cutoff: Column, time: str, most: int = 128) -> DataFrame:
    """The oldest applied groups from before the cutoff, at most ``most`` at a time."""
    return groups.where((F.col("state") == "applied") & (F.col(time) < cutoff)).orderBy("seq").limit(most)


def excerpt(events: DataFrame, offset: str, size: str, focus: int, budget: int) -> DataFrame:
    """Events around a failure: the nearest ones before and at the focus whose sizes fit the budget."""
    before = events.where(F.col(offset) <= focus).withColumn("_back", -F.col(offset))
    return running.running(before, [], "_back", _sum=("sum", F.col(size))).where(F.col("_sum") <= budget).drop("_back", "_sum")


#: States of a run and what may follow each.
LIFECYCLE = {
    "STARTING": ("RUNNING", "STOPPED", "BLOCKED"), "RUNNING": ("DRAINING", "RECONNECTING", "TARGET_RECONNECTING", "STOPPED", "BLOCKED"), "DRAINING": ("STOPPED", "BLOCKED"),
    "RECONNECTING": ("RUNNING", "DRAINING", "STOPPED", "BLOCKED"), "TARGET_RECONNECTING": ("RUNNING", "DRAINING", "STOPPED", "BLOCKED"), "STOPPED": ("STARTING",), "BLOCKED": ("STARTING",),
}


def lifecycle_errors(log: DataFrame, order: str, state: str) -> DataFrame:
    """State changes that may not happen."""
    seen = running.previous(log, [], order, _before=F.col(state))
    good = F.lit(False)
    for before, after in LIFECYCLE.items():
        good = good | ((F.col("_before") == before) & F.col(state).isin(*after))
    return seen.where(F.col("_before").isNotNull() & ~good).withColumnRenamed("_before", "before")
