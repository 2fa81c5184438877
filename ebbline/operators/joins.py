"""The joins that a change log needs: as-of, temporal, existence checks, constraint graphs and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fold, running


def asof(events: DataFrame, order: str, keys: list[str], is_map: Column, clears: Column, value: Column, name: str, scope: list[str] = ()) -> DataFrame:
    """events with the value of the newest map row of their keys before them, unless a clearing row of their scope came since.

    Map rows carry keys; clearing rows (end of statement, query, rotate) end all maps of the scope.
    """
    scope = list(scope)
    cleared = running.running(events, scope, order, inclusive=False, _cleared=("max", F.when(clears, F.col(order))))
    found = running.running(cleared, [*scope, *keys], order, _map=("last", F.when(is_map, F.struct(F.col(order).alias("at"), value.alias("v")))))
    alive = F.col("_map").isNotNull() & (F.col("_cleared").isNull() | (F.col("_map")["at"] > F.col("_cleared")))
    return found.withColumn(name, F.when(alive, F.col("_map")["v"])).drop("_map", "_cleared")


def temporal(events: DataFrame, history: DataFrame, keys: list[str], order: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Each event with the version of its key that is valid at its order: start <= order < end (a null end is open).

    Versions of a key don't overlap, and orders are whole numbers. Events and versions are laid in one order, so
    the events of one hot table are spread over blocks; the version that begins last at or before an event is the only one
    that can hold it. Events without a version, with a null key or a null order keep null columns.
    """
    rest = [c for c in history.columns if c not in keys]
    place = lambda c, side: (F.col(c).cast("decimal(20,0)") * 2 + side).cast("decimal(22,0)").alias("_place")
    marks = history.select(*keys, F.struct(*rest).alias("_version"), place(start, 0))
    rows = events.select(*keys, F.struct(*events.columns).alias("_event"), place(order, 1))
    seen = running.running(rows.unionByName(marks, allowMissingColumns=True), keys, "_place", _held=("last", F.col("_version")))
    known = F.col("_place").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    valid = known & (F.col("_held")[end].isNull() | (F.col("_event")[order] < F.col("_held")[end]))
    return seen.where("_event IS NOT NULL").select("_event.*", *[F.when(valid, F.col("_held")[c]).alias(c) for c in rest])


def map_history(maps: DataFrame, history: DataFrame, offset: str = "offset", sha: str = "sha256", identity: tuple[str, ...] = ("table_id", "db", "tbl")) -> DataFrame:
    """Table maps against a recorded schema history, by offset and fingerprint of the map event -> maps with the history's other columns and match.

    match: same; identity (that event is recorded for another table: an error); unknown (an event that the history does not hold). Offsets are
    unique within a history, so a map meets one row. Names compare by bytes; a null is like no value but null.
    """
    there = history.select(F.col(offset).alias("_o"), F.col(sha).alias("_s"), F.struct(*identity).alias("_id"), *[c for c in history.columns if c not in (offset, sha, *identity)])
    joined = maps.join(there, (F.col(offset) == F.col("_o")) & (F.col(sha) == F.col("_s")), "left")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).cast("binary" if c != identity[0] else "string").eqNullSafe(F.col("_id")[c].cast("binary" if c != identity[0] else "string"))
    return joined.withColumn("match", F.when(F.col("_o").isNull(), "unknown").when(same, "same").otherwise("identity")).drop("_o", "_s", "_id")


def versions(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Changes of a schema -> its versions with valid_from and valid_to."""
    after = running.previous(changes.withColumn("_o", -F.col(order)), keys, "_o", valid_to=F.col(order))
    return after.withColumnRenamed(order, "valid_from").drop("_o")


def probe(changes: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each change's before image against the table's row: state is match, differs or missing."""
    there = table.select(*keys, F.struct(*columns).alias("_row"))
    joined = changes.join(there, keys, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col("_row")[c])
    return joined.withColumn("state", F.when(F.col("_row").isNull(), "missing").when(same, "match").otherwise("differs")).drop("_row")


def collisions(changes: DataFrame, new_keys: list[str], table: DataFrame, keys: list[str]) -> DataFrame:
    """Key-changing updates whose new key the table holds already."""
    there = table.select(*[F.col(k).alias(n) for k, n in zip(keys, new_keys, strict=True)])
    return changes.join(there, new_keys, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose key (no part null) has no parent."""
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, child_keys, strict=True)])
    return child.dropna(subset=child_keys).join(known, child_keys, "left_anti")


def components(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Tables connected by foreign keys -> the smallest name of their component. A schema's edges, at most a few hundred."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {t: find(t) for t in root}


def positional(wire: Column, declared: Column) -> Column:
    """Wire columns beside declared columns by place: an array of (ordinal, wire, declared); a missing side is null."""
    zipped = F.arrays_zip(wire.alias("wire"), declared.alias("declared"))
    return F.transform(zipped, lambda z, i: F.struct(i.cast("int").alias("ordinal"), z["wire"].alias("wire"), z["declared"].alias("declared")))


def bag_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that a and b hold differently often, with n > 0 more in a and n < 0 more in b: one aggregate instead of two EXCEPT ALL.

    Rows are equal by bytes, as in a keyless table.
    """
    signed = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    return fold.bag_fold(signed, columns, "_s").drop("broken")
