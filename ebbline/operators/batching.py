"""Batches and insert chunks of ordered transactions.

A greedy packing with several limits is sequential, so it runs within the spans
between barriers (or files), each in one task as a streaming pass over its sorted
rows; nothing but running totals is held. Limits by count alone are arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running


@dataclass(frozen=True)
class Policy:
    """Limits of a batch: groups, rows, bytes and age; and of an insert chunk: rows and bytes."""

    transactions: int = 8
    rows: int = 4096
    bytes: int = 8 << 20
    delay_ms: int = 25
    insert_rows: int = 32
    insert_bytes: int = 1 << 20
    prepared: int = 8
    split_tables: bool = False


def count_batches(groups: DataFrame, number: str, size: int) -> DataFrame:
    """Batches of ``size`` groups: the group's number (from 0) over the size."""
    return groups.withColumn("batch", F.floor(F.col(number) / size))


def greedy_batches(groups: DataFrame, spans: list[str], order: str, rows: str, cost: str, table: str, policy: Policy, time_ms: str | None = None) -> DataFrame:
    """groups with batch (from 0 in each span).

    A batch is closed before a group that would pass the rows or bytes limit (or that changes the table, if tables split),
    and after one that reaches the number of groups, the rows or the bytes. A group beyond a limit is a batch of its own.
    With time_ms (when a group came, in milliseconds) a batch is also closed before a group that comes delay_ms or more after its first one.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields)
    at = {c: groups.columns.index(c) for c in (*spans, order, rows, cost, table, *([time_ms] if time_ms else []))}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, batch, count, n, size, name, began = None, 0, 0, 0, 0, None, None
        for piece in stream:
            out = []
            times = piece.column(at[time_ms]).to_pylist() if time_ms else [None] * piece.num_rows
            for *key, r, c, t, now in zip(*[piece.column(at[s]).to_pylist() for s in spans], piece.column(at[rows]).to_pylist(), piece.column(at[cost]).to_pylist(), piece.column(at[table]).to_pylist(), times, strict=True):
                if key != span:
                    span, batch, count, n, size = key, 0, 0, 0, 0
                aged = now is not None and began is not None and now - began >= policy.delay_ms
                if count and (aged or n + r > policy.rows or size + c > policy.bytes or (policy.split_tables and t != name)):
                    batch, count, n, size = batch + 1, 0, 0, 0
                if not count:
                    began = now
                out.append(batch)
                count, n, size, name = count + 1, n + r, size + c, t
                if count >= policy.transactions or n >= policy.rows or size >= policy.bytes:
                    batch, count, n, size = batch + 1, 0, 0, 0
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, pa.int64())], names=[*piece.schema.names, "batch"])

    return groups.repartition(*spans).sortWithinPartitions(*spans, order).mapInArrow(run, f"{fields}, batch long")


def barriers(events: DataFrame, order: str, is_barrier: Column, keys: list[str] = ()) -> DataFrame:
    """events with span: the number of barriers (DDL, filtered group, schema miss, idle) before them."""
    return running.running(events, list(keys), order, inclusive=False, span=("sum", is_barrier.cast("int")))


def insert_runs(rows: DataFrame, order: str, same: list[str], op: str, keys: list[str] = ()) -> DataFrame:
    """rows with run: neighbours that are all inserts and agree in ``same`` have one number."""
    image = F.struct(F.col(op), *same)
    seen = running.previous(rows, list(keys), order, _before=image)
    starts = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(image) | (F.col(op) != "insert")
    return running.running(seen.withColumn("_start", starts.cast("int")).drop("_before"), list(keys), order, run=("sum", F.col("_start"))).drop("_start")


def chunk_count(n: Column, most: int = 32) -> Column:
    """Statements for a run of n inserts: chunks of ``most`` (a power of two) rows, then descending powers of two."""
    return F.floor(n / most) + F.bit_count((n % most).cast("long"))


def chunk_sizes(n: Column, most: int = 32) -> Column:
    """Sizes of those chunks in order, as an array."""
    full = F.array_repeat(F.lit(most), F.floor(n / most).cast("int"))
    powers = []
    p = most // 2
    while p:
        powers.append(F.when((n % most).cast("long").bitwiseAND(F.lit(p)) != 0, F.lit(p)))
        p //= 2
    return F.concat(full, F.array_compact(F.array(*powers)))


def insert_bytes(columns: list[tuple[Column, str]], identifiers: list[str]) -> Column:
    """Estimated size of an INSERT of one row: 64, names twice and 4 each; text and decimals length + 16, JSON twice the length + 64, others 24."""
    total = F.lit(64 + sum(2 * len(i) + 4 for i in identifiers)).cast("long")
    for value, kind in columns:
        if kind in ("text", "decimal", "temporal", "binary"):
            part = F.coalesce(F.octet_length(value) + 16, F.lit(24))
        elif kind == "json":
            part = F.coalesce(F.octet_length(value) * 2 + 64, F.lit(24))
        else:
            part = F.lit(24)
        total = total + part
    return total


def autocommit(ops: Column, rows: Column, runs: Column, generated: Column, most: int = 32) -> Column:
    """Whether a group needs no transaction of its own: one update or delete, or inserts that fit one chunk; nothing generated."""
    one_chunk = (ops == "insert") & (runs == 1) & (F.bit_count(rows.cast("long")) == 1) & (rows <= most)
    return ~generated & (((ops != "insert") & (rows == 1)) | one_chunk)
