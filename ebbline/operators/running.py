"""Running aggregates over long ordered groups, without a task that holds a whole group.

The rows are written once. The order column is then cut into blocks at quantiles of its
values, so dense and sparse orders give blocks of like size. A window runs inside each block;
one row for each key and block carries what the blocks before it add up to. So the
whole log of one source, or a log without any key, is folded in parallel, and its source is read once.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch

#: Blocks at most: the carry of one key is a window over so many rows.
BLOCKS = 256

_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def block_of(order: Column, bounds: list[Any], first: int = 0) -> Column:
    """The number of ascending bounds at or below order, as a tree of comparisons."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(order < F.lit(bounds[middle]), block_of(order, bounds[:middle], first)).otherwise(block_of(order, bounds[middle + 1 :], first + middle + 1))


def bounds_of(rows: DataFrame, order: str, blocks: int) -> list[Any]:
    """At most blocks - 1 distinct quantiles of the order. One small row reaches the driver."""
    if blocks < 2:
        return []
    found = rows.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    return sorted(set(found or ()))


def running(rows: DataFrame, keys: list[str], order: str, blocks: int | None = None, inclusive: bool = True, **aggregates: tuple) -> DataFrame:
    """rows with a column more for each aggregate name=(kind, value[, inclusive]): its fold over the rows up to this one.

    kind: sum, max, min, or last (the newest value that is not null). Without
    ``inclusive`` the row itself doesn't count. Sums start at 0, the others at null.
    Rows with equal order are folded in no fixed order, so the order should be unique for each key.
    The order is a number, a date or a timestamp.
    """
    spark = rows.sparkSession
    for name, (_, value, *_) in aggregates.items():
        rows = rows.withColumn(f"_v_{name}", value)
    given = rows.columns
    void = {name for name, kind in rows.dtypes if kind == "void"}
    cut = scratch.written(rows.select(*[c for c in given if c not in void]), "running")
    for name in void:
        cut = cut.withColumn(name, F.lit(None))
    blocks = blocks or min(BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("_block", F.when(F.col(order).isNotNull(), block_of(F.col(order), bounds_of(cut, order, blocks))))
    groups = [*keys, "_block"]
    including = {n: (more[0] if more else inclusive) for n, (_, _, *more) in aggregates.items()}
    within = {flag: Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if flag else -1) for flag in (True, False)}
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*groups).agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") if kind == "last" else _FOLD[kind](f"_v_{n}").alias(f"_t_{n}") for n, (kind, *_) in aggregates.items()])
    carried = totals.select(*groups, *[(F.last(f"_t_{n}", ignorenulls=True) if kind == "last" else _FOLD[kind](f"_t_{n}")).over(before).alias(f"_c_{n}") for n, (kind, *_) in aggregates.items()])
    for name, (kind, *_) in aggregates.items():
        value = F.col(f"_v_{name}")
        cut = cut.withColumn(f"_w_{name}", (F.last(value, ignorenulls=True) if kind == "last" else _FOLD[kind](value)).over(within[including[name]]))
    on = None
    for g in groups:
        same = F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}"))
        on = same if on is None else on & same
    joined = cut.alias("x").join(carried.alias("y"), on, "left")
    out = [F.col(f"x.{c}") for c in given if c not in aggregates and c not in {f"_v_{n}" for n in aggregates}]
    for name, (kind, *_) in aggregates.items():
        mine, carry = F.col(f"x._w_{name}"), F.col(f"y._c_{name}")
        out.append((F.coalesce(mine, carry) if kind == "last" else _COMBINE[kind](carry, mine)).alias(name))
    return joined.select(*out)


def previous(rows: DataFrame, keys: list[str], order: str, blocks: int | None = None, **values: Column) -> DataFrame:
    """rows with a column more for each name=value: the value in the row before, by key and order (null in the first)."""
    wrapped = {name: ("last", F.struct(value.alias("v"))) for name, value in values.items()}
    found = running(rows, keys, order, blocks, inclusive=False, **wrapped)
    for name in values:
        found = found.withColumn(name, F.col(name)["v"])
    return found
