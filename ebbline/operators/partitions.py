"""Partition routing and partition maintenance, as column expressions and registry folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAXVALUE = object()


class PartitionError(ValueError):
    """An operation that the partitioning does not allow."""


def by_range(value: Column, bounds: Sequence[tuple[str, object]]) -> Column:
    """VALUES LESS THAN: the first partition whose bound is above the value. A null goes to the first; a value above all bounds to none (null)."""
    out = F.when(value.isNull(), bounds[0][0])
    for name, bound in bounds:
        out = out.when(F.lit(True) if bound is MAXVALUE else value < F.lit(bound), name)
    return out


def by_range_columns(values: Sequence[Column], bounds: Sequence[tuple[str, Sequence[object]]]) -> Column:
    """Tuples are compared column by column; MAXVALUE is above everything, null below."""

    def less(at: int, bound: Sequence[object]) -> Column:
        if at == len(bound):
            return F.lit(False)
        if bound[at] is MAXVALUE:
            return F.lit(True)
        low = values[at].isNull() | (values[at] < F.lit(bound[at]))
        return low | ((values[at] == F.lit(bound[at])) & less(at + 1, bound))

    out = None
    for name, bound in bounds:
        fits = F.coalesce(less(0, bound), F.lit(False))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def by_list(values: Sequence[Column], lists: Sequence[tuple[str, Sequence[object]]]) -> Column:
    """The partition that lists the value (or tuple); null only where a list holds None; else none (null)."""
    out = None
    for name, items in lists:
        fits = F.lit(False)
        for item in items:
            row = item if isinstance(item, tuple) else (item,)
            same = F.lit(True)
            for v, x in zip(values, row, strict=True):
                same = same & v.eqNullSafe(F.lit(x))
            fits = fits | same
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def by_hash(value: Column, count: int) -> Column:
    """HASH: the absolute remainder; a null is 0."""
    return F.coalesce(F.abs(value % count), F.lit(0)).cast("int")


def by_linear_hash(value: Column, count: int) -> Column:
    """LINEAR HASH: the bits under the next power of two, halved while beyond the count."""
    power = 1
    while power < count:
        power *= 2
    value = F.coalesce(value, F.lit(0)).cast("long")
    out = value.bitwiseAND(F.lit(power - 1))
    while power > 1:
        power //= 2
        out = F.when(out >= count, out.bitwiseAND(F.lit(power - 1))).otherwise(out)
    return out.cast("int")


@dataclass(frozen=True)
class Partitioning:
    """method: range, list, hash or key. parts: (name, bound or list); for hash and key only count matters."""

    method: str
    parts: tuple[tuple[str, object], ...] = ()
    count: int = 0
    columns: tuple[str, ...] = ()

    def names(self) -> list[str]:
        return [n for n, _ in self.parts] if self.parts else [f"p{i}" for i in range(self.count)]

    def add(self, *parts: tuple[str, object]) -> Partitioning:
        if self.method not in ("range", "list"):
            raise PartitionError("hash partitions are added by number")
        if {n for n, _ in parts} & set(self.names()):
            raise PartitionError("duplicate partition")
        if self.method == "range":
            bounds = [b for _, b in (*self.parts, *parts)]
            if MAXVALUE in bounds[:-1] or any(b is not MAXVALUE and a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
                raise PartitionError("bounds must increase")
        return replace(self, parts=(*self.parts, *parts))

    def add_hash(self, number: int) -> Partitioning:
        if self.method.split()[-1] not in ("hash", "key") or number < 1:
            raise PartitionError("not hashed")
        more = tuple((f"p{i}", None) for i in range(self.count, self.count + number)) if self.parts else ()
        return replace(self, parts=self.parts + more, count=self.count + number)

    def coalesce(self, number: int) -> Partitioning:
        if self.method.split()[-1] not in ("hash", "key") or not 0 < number < self.count:
            raise PartitionError("cannot coalesce")
        return replace(self, parts=self.parts[: self.count - number], count=self.count - number)

    def drop(self, *names: str) -> Partitioning:
        if self.method not in ("range", "list") or not set(names) <= set(self.names()) or len(names) >= len(self.parts):
            raise PartitionError("cannot drop")
        return replace(self, parts=tuple(p for p in self.parts if p[0] not in names))

    def reorganize(self, old: Sequence[str], new: Sequence[tuple[str, object]]) -> Partitioning:
        """Adjoining partitions are replaced; range partitions keep their outer bound."""
        names = self.names()
        at = sorted(names.index(n) for n in old)
        if set(n for n, _ in new) & (set(names) - set(old)):
            raise PartitionError("duplicate partition")
        if at != list(range(at[0], at[0] + len(at))):
            raise PartitionError("partitions must adjoin")
        if self.method == "range" and at[-1] + 1 < len(names) and new[-1][1] != self.parts[at[-1]][1]:
            raise PartitionError("outer bound changes")
        return replace(self, parts=(*self.parts[: at[0]], *new, *self.parts[at[-1] + 1 :]))

    def depends_on(self, column: str) -> bool:
        return column.lower() in map(str.lower, self.columns)

    def route(self, *values: Column) -> Column:
        if self.method == "range":
            return by_range(values[0], self.parts) if len(values) == 1 else by_range_columns(values, self.parts)
        if self.method == "list":
            return by_list(values, self.parts)
        if self.method.endswith("key"):
            raise PartitionError("keys are hashed by the server")
        number = by_linear_hash(values[0], self.count) if self.method.startswith("linear") else by_hash(values[0], self.count)
        return F.get(F.array(*[F.lit(n) for n in self.names()]), number)


def exchanged(rows: DataFrame, partition: str, others: DataFrame, name: str, route: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EXCHANGE PARTITION: rows with a column ``partition`` against a table without one -> (rows after, table after, misplaced rows).

    The partition ``name`` and the table change places. With route (the partition that a row's values ask for) rows of the table
    that belong elsewhere are misplaced; an exchange without validation keeps them where they are put.
    """
    inside = rows.where(F.col(partition).eqNullSafe(F.lit(name))).drop(partition)
    put = others.withColumn(partition, F.lit(name))
    after = rows.where(~F.col(partition).eqNullSafe(F.lit(name))).unionByName(put)
    wrong = put.where(~F.coalesce(route == F.lit(name), F.lit(False))) if route is not None else put.limit(0)
    return after, inside, wrong


def truncated(rows: DataFrame, partition: str, names: Sequence[str]) -> DataFrame:
    """TRUNCATE PARTITION: the rows of the named partitions go, the partitions stay."""
    return rows.where(~F.coalesce(F.col(partition).isin(*names), F.lit(False)))
