"""Binary logs from row changes: an encoder of events, and a writer that puts numbered files into a folder.

It writes the newest row events with full images, one transaction for each group, and
covers the column types that ``KINDS`` names. A file is encoded in parts, cut at quantiles
of the order, by tasks that hold one part each; a first pass over the rows finds where each part
begins. One task for each file then copies its parts to the final name, so a task that is run
again leaves the same files.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import running
from . import binlog

#: Kind -> (type code, bytes of its metadata).
KINDS = {"tinyint": (1, b""), "int": (3, b""), "bigint": (8, b""), "double": (5, b"\x08"), "varchar": (15, struct.pack("<H", 4000))}
_PACK = {k: struct.Struct(f) for k, f in (("tinyint", "<b"), ("int", "<i"), ("bigint", "<q"), ("double", "<d"))}
ROW_EVENTS = {"insert": 30, "update": 31, "delete": 32}


class LogEncoder:
    """One file's bytes, event after event, or those of a part that begins at the offset ``base``."""

    def __init__(self, server_id: int = 1, base: int = 0) -> None:
        self.data, self.server_id, self.base = bytearray(), server_id, base
        if base:
            return
        self.data += binlog.MAGIC
        self.event(15, struct.pack("<H", 4) + b"8.4.0".ljust(50, b"\0") + struct.pack("<IB", 0, 19) + b"\0" * 42 + b"\x01")

    def event(self, kind: int, body: bytes, ts: int = 0) -> None:
        size = binlog.HEADER.size + len(body) + 4
        raw = binlog.HEADER.pack(ts, kind, self.server_id, size, (self.base + len(self.data) + size) % (1 << 32), 0) + body
        self.data += raw + zlib.crc32(raw).to_bytes(4, "little")

    def gtid(self, sid: str, number: int) -> None:
        self.event(33, b"\x01" + uuid.UUID(sid).bytes + struct.pack("<Q", number) + b"\x02" + struct.pack("<QQ", 0, 1))

    def query(self, sql: str, db: str) -> None:
        self.event(2, struct.pack("<IIBHH", 1, 0, len(db.encode()), 0, 0) + db.encode() + b"\0" + sql.encode())

    def xid(self, number: int) -> None:
        self.event(16, struct.pack("<Q", number))

    def rotate(self, name: str) -> None:
        self.event(4, struct.pack("<Q", 4) + name.encode())

    def table_map(self, number: int, db: str, tbl: str, columns: list[tuple[str, str]]) -> None:
        """columns: (name, kind); all may be null, all numbers are signed."""
        self.event(19, _map_body(number, db, tbl, tuple(columns)))

    def rows(self, op: str, number: int, kinds: list[str], images: list[list[list[Any]]]) -> None:
        """images: for each row its before image, its after image, or both; each a list of values."""
        width = (len(kinds) + 7) // 8
        full = ((1 << len(kinds)) - 1).to_bytes(width, "little")
        out = [number.to_bytes(6, "little"), struct.pack("<HH", 1, 2), _packed(len(kinds)), full * (2 if op == "update" else 1)]
        for row in images:
            for image in row:
                nulls = 0
                cells = []
                for i, (k, v) in enumerate(zip(kinds, image, strict=True)):
                    if v is None:
                        nulls |= 1 << i
                    else:
                        cells.append(_value(k, v))
                out.append(nulls.to_bytes(width, "little"))
                out += cells
        self.event(ROW_EVENTS[op], b"".join(out))


@functools.lru_cache(64)
def _map_body(number: int, db: str, tbl: str, columns: tuple[tuple[str, str], ...]) -> bytes:
    text = lambda s: bytes([len(s.encode())]) + s.encode()
    types, meta = bytes(KINDS[k][0] for _, k in columns), b"".join(KINDS[k][1] for _, k in columns)
    names = b"".join(text(n) for n, _ in columns)
    optional = b"\x04" + _packed(len(names)) + names
    nullable = ((1 << len(columns)) - 1).to_bytes((len(columns) + 7) // 8, "little")
    return number.to_bytes(6, "little") + b"\x01\0" + text(db) + b"\0" + text(tbl) + b"\0" + _packed(len(columns)) + types + _packed(len(meta)) + meta + nullable + optional


def _packed(n: int) -> bytes:
    return bytes([n]) if n < 251 else b"\xfc" + struct.pack("<H", n) if n < 1 << 16 else b"\xfd" + n.to_bytes(3, "little")


def _value(kind: str, value: Any) -> bytes:
    if kind == "varchar":
        raw = str(value).encode()
        return struct.pack("<H", len(raw)) + raw
    return _PACK[kind].pack(value)


#: Row changes of a part at about, and parts at most.
PART, PARTS = 10_000, 256


def write_log(changes: DataFrame, folder: str, columns: list[tuple[str, str]], db: str, tbl: str, sid: str, files: int, file: str = "file_no", group: str = "gno", order: str = "seq", rotate: bool = True, part: int = PART) -> int:
    """Writes row changes as files ``bin.000001`` up to number ``files``; returns how many row changes they hold.

    changes: file (int from 1), group (the transaction's number), order (a number, date or timestamp), op, before and after (structs of the columns, or null).
    A group lies in one file; every file is written, those without changes with no transaction. With ``rotate`` a file names the next one.
    The driver holds one short row for each part.
    """
    names, kinds = [n for n, _ in columns], [k for _, k in columns]
    image = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(c)[n].alias(n) for n in names])).alias(c)
    spark = changes.sparkSession
    rows = changes.select(F.col(file).cast("int").alias("file"), F.col(group).cast("long").alias("group"), F.col(order).alias("order"), "op", image("before"), image("after")).where(F.col("file").between(1, files) & F.col("op").isNotNull())
    blocks = min(PARTS, -(-rows.select("order").count() // part))
    cut = rows.withColumn("block", F.when(F.col("order").isNull(), -1).otherwise(running.block_of(F.col("order"), running.bounds_of(rows.select("order"), "order", blocks))))
    laid = cut.repartition(max(blocks, files), "file", "block").sortWithinPartitions("file", "block", "order")
    parts, where = f"{folder}/_parts", "file int, block int, first long, last long, size long, n long"
    head, opening, closing, mapped = (len(x.data) for x in (LogEncoder(), _part("gtid", sid, 1, "BEGIN", db), _part("xid", 1), _part("table_map", 7, db, tbl, columns)))

    def measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(file, block, first and last group, bytes with all openings and without the last closing, row changes) of each part of a task."""
        out: dict[tuple[int, int], list[int]] = {}
        for batch in stream:
            if not batch.num_rows:
                continue
            file_, group_, block_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 6))
            sizes = _row_sizes(batch, kinds)
            cuts = np.flatnonzero(np.concatenate([[True], (file_[1:] != file_[:-1]) | (block_[1:] != block_[:-1])])).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(file_)], strict=True):
                key, groups = (int(file_[low]), int(block_[low])), group_[low:high]
                entry = out.get(key)
                new = int((groups[1:] != groups[:-1]).sum()) * (opening + closing)
                if entry is None:
                    entry = out[key] = [int(groups[0]), 0, opening, 0]
                elif entry[1] != groups[0]:
                    new += opening + closing
                entry[1] = int(groups[-1])
                entry[2] += new + int(sizes[low:high].sum()) + (high - low) * mapped
                entry[3] += high - low
        if out:
            table = list(zip(*[(*k, *v) for k, v in out.items()], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["file", "block", "first", "last", "size", "n"])

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log: LogEncoder | None = None
        key, now, closes, end, n = None, None, False, 0, 0

        def close() -> None:
            if key is None:
                return
            if closes:
                log.xid(now)
            if log.base + len(log.data) != end:
                raise RuntimeError(f"part {key} has {len(log.data)} bytes, expected {end - log.base}")
            _put(f"{parts}/{key[0]}-{key[1]}", log.data)

        for batch in stream:
            n += batch.num_rows
            images = [_images(batch.column(i)) for i in (4, 5)]
            for f, block, g, op, before, after in zip(*[batch.column(i).to_pylist() for i in (0, 6, 1, 3)], *images, strict=True):
                if (f, block) != key:
                    close()
                    key = (f, block)
                    base, goes_on, closes, end = places[key]
                    log, now = LogEncoder(base=base), g if goes_on else None
                if g != now:
                    if now is not None:
                        log.xid(now)
                    now = g
                    log.gtid(sid, g)
                    log.query("BEGIN", db)
                log.table_map(7, db, tbl, columns)
                log.rows(op, 7, kinds, [[v for v in (before, after) if v is not None]])
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    found = sorted(tuple(r) for r in laid.mapInArrow(measure, where).collect())
    places: dict[tuple[int, int], tuple[int, bool, bool, int]] = {}
    at: dict[int, int] = {}
    for i, (f, block, first, last, size, _) in enumerate(found):
        # a group that goes on past a part is closed by the next one, where its own next group begins or at its end
        goes_on = i > 0 and found[i - 1][0] == f and found[i - 1][3] == first
        closes = not (i + 1 < len(found) and found[i + 1][0] == f and found[i + 1][2] == last)
        base = at.get(f, head)
        at[f] = base + size - (opening if goes_on else 0) + (closing if closes else 0)
        places[f, block] = (base, goes_on, closes, at[f])
    written = sum(r[0] for r in laid.mapInArrow(encode, "n long").collect())

    def join(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for number in batch.column(0).to_pylist():
                last = LogEncoder(base=at.get(number, head))
                if rotate and number < files:
                    last.rotate(f"bin.{number + 1:06d}")
                _put(f"{folder}/bin.{number:06d}", LogEncoder().data, [f"{parts}/{f}-{b}" for f, b in sorted(places) if f == number], last.data)
            yield batch

    spark.range(1, files + 1, 1, files).mapInArrow(join, "id long").count()
    if places:
        filesystem, inner = binlog._open(parts)
        filesystem.delete_dir(inner)
    return written


def _part(event: str, *given: Any) -> LogEncoder:
    """A part that begins with an event."""
    log = LogEncoder(base=1)
    getattr(log, event)(*given[:2] if event == "gtid" else given)
    if event == "gtid":
        log.query(*given[2:])
    return log


def _images(column: pa.StructArray) -> list[tuple | None]:
    """The structs of a column as tuples of their values."""
    rows = zip(*[c.to_pylist() for c in column.flatten()], strict=True)
    return [row if there else None for row, there in zip(rows, column.is_valid().to_pylist(), strict=True)]


def _row_sizes(batch: pa.RecordBatch, kinds: list[str]) -> np.ndarray:
    """Bytes of the row event of each change of a batch (file, group, order, op, before, after)."""
    width, op = (len(kinds) + 7) // 8, batch.column(3)
    update = pc.equal(op, "update").to_numpy(zero_copy_only=False)
    out = binlog.HEADER.size + 4 + 6 + 4 + len(_packed(len(kinds))) + np.where(update, 2 * width, width)
    for column in (batch.column(4), batch.column(5)):
        there = column.is_valid().to_numpy(zero_copy_only=False)
        out = out + there * width
        for kind, values in zip(kinds, column.flatten(), strict=True):
            if kind == "varchar":
                size = 2 + pc.fill_null(pc.binary_length(values.cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            else:
                size = _PACK[kind].size
            out = out + values.is_valid().to_numpy(zero_copy_only=False) * size
    return out


def _put(path: str, data: bytes, files: list[str] = (), end: bytes = b"") -> None:
    """Writes data, the bytes of files and end under a name that appears when all is there."""
    filesystem, inner = binlog._open(path)
    filesystem.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{os.path.dirname(inner)}/_{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as out:
        out.write(data)
        for name in files:
            source, there = binlog._open(name)
            with source.open_input_stream(there) as stream:
                while piece := stream.read(8 << 20):
                    out.write(piece)
        out.write(end)
    filesystem.move(part, inner)
