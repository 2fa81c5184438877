"""Binary change logs: frames, events, table maps and row images, and the ``binlog`` data source.

Files are read frame by frame through Arrow's file systems (local, HDFS, object
stores), with bounded memory. A file longer than ``SPLIT`` bytes is cut into ranges, a
partition each: a range begins at its first Query event, where no table map is open, so it
is decoded as the whole file would be. Each frame is checked
(offset, length, CRC32) before anything in it is parsed. Errors raise
``BinlogError`` with a code and the offset; truncation is an error, not an end.
"""

from __future__ import annotations

import hashlib
import io
import json
import operator
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import jsondoc, scalars
from ..operators import gtid

MAGIC = b"\xfebin"
HEADER = struct.Struct("<IBIIIH")
IN_USE = 0x1

#: Event types that are accepted; any other is an error. Fixed values of the format.
EVENT_NAMES = {
    2: "QUERY", 3: "STOP", 4: "ROTATE", 15: "FORMAT_DESCRIPTION", 16: "XID", 19: "TABLE_MAP", 23: "WRITE_ROWS_V1", 24: "UPDATE_ROWS_V1", 25: "DELETE_ROWS_V1",
    30: "WRITE_ROWS", 31: "UPDATE_ROWS", 32: "DELETE_ROWS", 33: "GTID", 34: "ANONYMOUS_GTID", 35: "PREVIOUS_GTIDS", 39: "PARTIAL_UPDATE_ROWS", 42: "GTID_TAGGED",
}
OPERATIONS = {23: "insert", 30: "insert", 24: "update", 31: "update", 39: "update", 25: "delete", 32: "delete"}

MAX_COLUMNS, MAX_ROWS, MAX_EVENT = 256, 4096, 64 << 20

#: Bytes of a file that one partition reads; option ``split`` of the source, 0 for whole files.
SPLIT = 8 << 20
#: Events that go to Spark at once: at most so many, and no more once their bytes reach the second number.
BATCH_EVENTS, BATCH_BYTES = 5000, 1 << 20
#: Bodies of table maps and Query events that a decoder remembers, and their bytes at most.
REMEMBERED, REMEMBERED_BYTES = 256, 4096

CELL = "struct<kind: string, value: string, bin: binary>"
SCHEMA = (
    "file string, offset long, next_pos long, event_type int, event_name string, ts long, server_id long, flags int, sha256 string, kind string, table_id long, db string, tbl string, "
    f"gtid string, xid decimal(20,0), sql string, error_code int, context string, row_flags int, filtered boolean, columns array<string>, rows array<struct<op: string, before: array<{CELL}>, after: array<{CELL}>>>"
)


class BinlogError(ValueError):
    def __init__(self, code: str, offset: int, reason: str) -> None:
        super().__init__(f"{code} at {offset}: {reason}")
        self.code, self.offset = code, offset


@dataclass
class TableMap:
    table_id: int
    db: str
    tbl: str
    types: list[int]
    meta: list[int]
    nullable: list[bool]
    unsigned: list[bool]
    names: list[str | None]
    charsets: list[int | None]
    labels: dict[int, list[str]] = field(default_factory=dict)
    primary_key: list[int] = field(default_factory=list)
    readers: list = field(default_factory=list)


class _Bytes:
    """A cursor that fails where the data end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise IndexError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def packed(self) -> int:
        first = self.number(1)
        if first < 251:
            return first
        width = {252: 2, 253: 3, 254: 8}.get(first)
        if width is None:
            raise ValueError("packed integer")
        return self.number(width)

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i >> 3] >> (i & 7) & 1) for i in range(n)]

    def left(self) -> int:
        return len(self.data) - self.at


def frames(stream: BinaryIO, most: int = MAX_EVENT, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, raw event) of a file, without parsing: truncation and lengths out of bounds are errors. The stream stands at offset ``at``, an event's or 0."""
    if at == 0:
        if stream.read(4) != MAGIC:
            raise BinlogError("MALFORMED", 0, "magic")
        at = 4
    while head := stream.read(19):
        if len(head) < 19:
            raise BinlogError("MALFORMED", at, "truncated header")
        size = int.from_bytes(head[9:13], "little")
        if not 23 <= size <= most:
            raise BinlogError("LIMIT" if size > most else "MALFORMED", at, f"event size {size}")
        body = stream.read(size - 19)
        if len(body) < size - 19:
            raise BinlogError("MALFORMED", at, "truncated event")
        yield at, head + body
        at += size


def range_start(stream: BinaryIO, low: int, limit: int, size: int, window: int = 1 << 20) -> int | None:
    """The first offset from low to below limit where a Query event stands that names its own end and has its checksum; None if there is none.

    The bytes inside an event pass only if they hold a whole event for this very place; the range before notices that.
    """
    while low < limit:
        stream.seek(low)
        data = stream.read(window + HEADER.size)
        raw = np.frombuffer(data, dtype=np.uint8)
        places = np.flatnonzero(raw[4 : 4 + min(window, limit - low, max(len(raw) - HEADER.size + 1, 0))] == 2)
        number = lambda k: sum(raw[places + k + i].astype(np.int64) << (8 * i) for i in range(4))
        length = number(9) if len(places) else places
        fits = (length >= 23) & (length <= MAX_EVENT) & (low + places + length <= size)
        fits &= (low + places + length) % (1 << 32) == (number(13) if len(places) else places)
        for place, n in zip(places[fits].tolist(), length[fits].tolist(), strict=True):
            stream.seek(low + place)
            event = stream.read(n)
            if zlib.crc32(event[:-4]) == int.from_bytes(event[-4:], "little"):
                return low + place
        low += window
    return None


_EMPTY = dict.fromkeys(("table_id", "db", "tbl", "gtid", "xid", "sql", "error_code", "context", "row_flags", "columns", "rows"))


class Decoder:
    """Events of one file in order: keeps the open table maps, and refuses everything after the first error."""

    def __init__(self, file: str = "", wanted=None) -> None:
        """wanted(db, tbl): whether a table's rows are decoded; the others only keep their identity."""
        self.file, self.wanted = file, wanted
        self.maps: dict[int, TableMap] = {}
        self.dropped: set[int] = set()
        self.failed: BinlogError | None = None
        self.known: dict[tuple[int, bytes], tuple] = {}

    def _remember(self, kind: int, body: bytes, found: tuple) -> None:
        if len(body) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[kind, body] = found

    def decode(self, offset: int, raw: bytes) -> dict[str, Any]:
        if self.failed:
            raise BinlogError("POISONED", offset, str(self.failed))
        try:
            return self._decode(offset, raw)
        except BinlogError as e:
            self.failed = e
            raise
        except (IndexError, ValueError, struct.error, UnicodeDecodeError) as e:
            self.failed = BinlogError("MALFORMED", offset, str(e))
            raise self.failed from e

    def _decode(self, offset: int, raw: bytes) -> dict[str, Any]:
        ts, kind, server, size, next_pos, flags = HEADER.unpack_from(raw)
        if size != len(raw):
            raise BinlogError("MALFORMED", offset, "length")
        if next_pos and next_pos != (offset + size) % (1 << 32):
            raise BinlogError("MALFORMED", offset, "next position")
        checked = raw[:-4]
        if kind == 15:  # the in-use bit is set while the file is written and doesn't count
            checked = raw[:17] + struct.pack("<H", flags & ~IN_USE) + raw[19:-4]
        if zlib.crc32(checked) != int.from_bytes(raw[-4:], "little"):
            raise BinlogError("CRC", offset, "checksum")
        if kind not in EVENT_NAMES:
            raise BinlogError("UNSUPPORTED", offset, f"event type {kind}")
        # the header has the end's lower 32 bits, or 0
        row = _EMPTY | {"file": self.file, "offset": offset, "next_pos": next_pos and offset + size, "event_type": kind, "event_name": EVENT_NAMES[kind], "ts": ts, "server_id": server, "flags": flags, "sha256": hashlib.sha256(raw).hexdigest(), "filtered": False}
        body = _Bytes(raw[19:-4])
        if kind == 15:
            row["kind"] = "fde"
            if body.number(2) != 4:
                raise BinlogError("UNSUPPORTED", offset, "format version")
            self.maps.clear()
        elif kind == 2:
            self._query(body, row)
        elif kind == 3:
            row["kind"] = "stop"
        elif kind == 4:
            row["kind"] = "rotate"
            position = body.number(8)
            row["sql"] = f"{body.take(body.left()).decode()}:{position}"
            self.maps.clear()
        elif kind == 16:
            row["kind"], row["xid"] = "xid", body.number(8)
        elif kind in (33, 34):
            row["kind"] = "gtid" if kind == 33 else "anonymous"
            body.take(1)
            sid, number = body.take(16).hex(), body.number(8)
            if kind == 33:
                row["gtid"] = f"{sid[:8]}-{sid[8:12]}-{sid[12:16]}-{sid[16:20]}-{sid[20:]}:{number}"
        elif kind == 35:
            row["kind"] = "previous_gtids"
            row["gtid"] = ",".join(_gtid_texts(gtid.decode(body.take(body.left()))))
        elif kind == 42:
            row["kind"], row["gtid"] = "gtid", _tagged(body)
        elif kind == 19:
            self._table_map(offset, body, row)
        else:
            self._rows(offset, kind, body, row)
        return row

    def _query(self, body: _Bytes, row: dict[str, Any]) -> None:
        found = self.known.get((2, body.data))
        if found is None:
            fields = {}
            self._query_fields(body, fields)
            self._remember(2, body.data, found := (fields,))
        row |= found[0]
        self.maps.clear()
        self.dropped.clear()

    @staticmethod
    def _query_fields(body: _Bytes, row: dict[str, Any]) -> None:
        body.take(8)
        size = body.number(1)
        row["error_code"] = body.number(2)
        status = body.take(body.number(2))
        row["db"] = body.take(size).decode()
        body.take(1)
        row["sql"] = body.take(body.left()).decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
        row["context"] = json.dumps(query_context(status), sort_keys=True)
        word = re.match(r"\s*([A-Za-z]*)", row["sql"])[1].upper()
        row["kind"] = {"BEGIN": "begin", "COMMIT": "commit", "ROLLBACK": "rollback"}.get(row["sql"]) or ("unsupported" if word in ("XA", "START", "SAVEPOINT", "RELEASE") else "statement")

    def _table_map(self, offset: int, body: _Bytes, row: dict[str, Any]) -> None:
        row["kind"] = "table_map"
        found = self.known.get((19, body.data))
        if found:
            number, table, fields = found
            row |= fields
            self.dropped.discard(number)
            self.maps[number] = table
            return
        number = body.number(6)
        body.take(2)
        db = body.take(body.number(1)).decode()
        body.take(1)
        tbl = body.take(body.number(1)).decode()
        body.take(1)
        row |= {"table_id": number, "db": db, "tbl": tbl}
        if self.wanted is not None and not self.wanted(db, tbl):
            row["filtered"] = True
            self.dropped.add(number)
            self.maps.pop(number, None)
            return
        self.dropped.discard(number)
        count = body.packed()
        if count > MAX_COLUMNS:
            raise BinlogError("LIMIT", offset, "columns")
        types = list(body.take(count))
        meta_bytes = _Bytes(body.take(body.packed()))
        meta = [_metadata(t, meta_bytes) for t in types]
        real = [(m >> 8 if t == 254 and m >> 8 in (247, 248) else t) for t, m in zip(types, meta, strict=True)]
        table = TableMap(number, db, tbl, real, meta, body.bits(count), [False] * count, [None] * count, [None] * count)
        seen = set()
        while body.left():
            tag = body.number(1)
            part = _Bytes(body.take(body.packed()))
            if tag in seen:
                raise BinlogError("MALFORMED", offset, f"field {tag} twice")
            seen.add(tag)
            _optional(table, tag, part)
        self.maps[number] = table
        row["columns"] = [n or f"@{i + 1}" for i, n in enumerate(table.names)]
        table.readers = [_reader(*c) for c in zip(table.types, table.meta, table.unsigned, table.charsets, strict=True)]
        self._remember(19, body.data, (number, table, {"table_id": number, "db": db, "tbl": tbl, "columns": row["columns"]}))

    def _rows(self, offset: int, kind: int, body: _Bytes, row: dict[str, Any]) -> None:
        number = body.number(6)
        row |= {"kind": "rows", "table_id": number, "row_flags": body.number(2)}
        if row["row_flags"] & ~3:
            raise BinlogError("UNSUPPORTED", offset, "row flags")
        last = row["row_flags"] & 1
        if number in self.dropped:
            row["filtered"] = True
        else:
            table = self.maps.get(number)
            if table is None:
                raise BinlogError("SCHEMA", offset, f"no table map {number}")
            row |= {"db": table.db, "tbl": table.tbl, "rows": list(self._images(offset, kind, body, table))}
            if not row["rows"]:
                raise BinlogError("MALFORMED", offset, "no rows")
        if last:
            self.maps.clear()
            self.dropped.clear()

    def _images(self, offset: int, kind: int, body: _Bytes, table: TableMap) -> Iterator[dict[str, Any]]:
        if kind >= 30:
            body.take(body.number(2) - 2)
        count = body.packed()
        if count != len(table.types):
            raise BinlogError("SCHEMA", offset, "column count")
        operation = OPERATIONS[kind]
        first = body.bits(count)
        second = body.bits(count) if operation == "update" else first
        made = 0
        if kind != 39 and all(first) and all(second):
            width = (count + 7) // 8
            data, at = body.data, body.at
            while at < len(data):
                made += 1
                if made > MAX_ROWS:
                    raise BinlogError("LIMIT", offset, "rows")
                before = after = None
                if operation != "insert":
                    before, at = _whole_image(data, at, table, width)
                if operation != "delete":
                    after, at = _whole_image(data, at, table, width)
                yield {"op": operation, "before": before, "after": after}
            return
        while body.left():
            made += 1
            if made > MAX_ROWS:
                raise BinlogError("LIMIT", offset, "rows")
            before = None if operation == "insert" else _image(body, table, first)
            partial: list[bool] | None = None
            after = None
            if operation != "delete":
                if kind == 39 and body.packed() & 1:
                    partial = body.bits(sum(1 for t in table.types if t == 245))
                after = _image(body, table, second, partial, before)
            yield {"op": operation, "before": before, "after": after}


def _gtid_texts(rows: list[tuple[str, str, int, int]]) -> Iterator[str]:
    for sid, tag, low, high in rows:
        yield sid + (f":{tag}" if tag else "") + (f":{low}" if low == high else f":{low}-{high}")


def _varlen(body: _Bytes) -> int:
    """Trailing ones of the first byte count the bytes that follow; the rest is the number, little endian."""
    first = body.number(1)
    more = 8 if first == 255 else (~first & (first + 1)).bit_length() - 1
    if more == 8:
        return body.number(8)
    return int.from_bytes(bytes([first]) + body.take(more), "little") >> (more + 1)


def _tagged(body: _Bytes) -> str:
    """A serialised message: version, size, last field needed; then numbered fields 0 flags, 1 UUID, 2 number (zigzag), 3 tag."""
    for _ in range(3):
        _varlen(body)
    sid, number, tag = "", 0, ""
    while body.left():
        name = _varlen(body)
        if name == 0:
            _varlen(body)
        elif name == 1:
            sid = bytes(_varlen(body) for _ in range(16)).hex()
        elif name == 2:
            number = _varlen(body)
            number = number >> 1 ^ -(number & 1)
        elif name == 3:
            tag = body.take(_varlen(body)).decode("ascii")
            break
        else:
            break
    if not sid:
        raise ValueError("tagged GTID")
    return f"{sid[:8]}-{sid[8:12]}-{sid[12:16]}-{sid[16:20]}-{sid[20:]}" + (f":{tag}" if tag else "") + f":{number}"


def _metadata(kind: int, data: _Bytes) -> int:
    if kind in (4, 5, 17, 18, 19, 245, 252, 255):
        return data.number(1)
    if kind in (15, 16):
        return data.number(2)
    if kind in (246, 247, 248, 253, 254):
        return data.number(1) << 8 | data.number(1)
    if kind in (1, 2, 3, 7, 8, 9, 10, 13):
        return 0
    raise ValueError(f"column type {kind}")


_NUMERIC, _TEXT = (1, 2, 3, 4, 5, 8, 9, 246), (15, 252, 253, 254)


def _optional(table: TableMap, tag: int, data: _Bytes) -> None:
    """Optional metadata: 1 signs, 2 default charset, 3 charset of each column, 4 names, 5 SET labels, 6 ENUM labels, 8 and 9 primary key."""
    of = lambda kinds: [i for i, t in enumerate(table.types) if t in kinds]
    if tag == 1:
        raw = data.take(data.left())
        for n, i in enumerate(of(_NUMERIC)):
            table.unsigned[i] = bool(raw[n >> 3] >> (7 - (n & 7)) & 1)
    elif tag == 2:
        texts = of(_TEXT)
        default = data.packed()
        for i in texts:
            table.charsets[i] = default
        while data.left():
            table.charsets[texts[data.packed()]] = data.packed()
    elif tag == 3:
        for i in of(_TEXT):
            table.charsets[i] = data.packed()
    elif tag == 4:
        names = []
        while data.left():
            names.append(data.take(data.packed()).decode())
        if len(names) != len(table.types):
            raise ValueError("column names")
        table.names = names
    elif tag in (5, 6):
        for i in of((248,) if tag == 5 else (247,)):
            table.labels[i] = [data.take(data.packed()).decode("utf-8", "replace") for _ in range(data.packed())]
    elif tag == 8:
        while data.left():
            table.primary_key.append(data.packed())
    elif tag == 9:
        while data.left():
            table.primary_key.append(data.packed())
            data.packed()


def _image(body: _Bytes, table: TableMap, present: list[bool], partial: list[bool] | None = None, before: list | None = None) -> list[dict[str, Any]]:
    used = [i for i, p in enumerate(present) if p]
    nulls = dict(zip(used, body.bits(len(used)), strict=True))
    out, json_number = [], 0
    for i, (kind, meta) in enumerate(zip(table.types, table.meta, strict=True)):
        delta = False
        if kind == 245:
            delta = bool(partial and partial[json_number])
            json_number += 1
        if not present[i]:
            out.append({"kind": "absent", "value": None, "bin": None})
        elif nulls[i]:
            if not table.nullable[i]:
                raise ValueError("null in a column that is not null")
            out.append({"kind": "null", "value": None, "bin": None})
        elif delta:
            changes = jsondoc.decode_diff(body.take(body.number(4)))
            if before is None or before[i]["kind"] != "json":
                raise ValueError("partial JSON without its document")
            out.append({"kind": "json", "value": jsondoc.dumps(jsondoc.apply_changes(jsondoc.loads(before[i]["value"]), changes)), "bin": None})
        else:
            out.append(_cell(body, kind, meta, table.unsigned[i], table.charsets[i]))
    return out


_NULL = {"kind": "null", "value": None, "bin": None}


def _whole_image(data: bytes, at: int, table: TableMap, width: int) -> tuple[list[dict[str, Any]], int]:
    """(image, its end) from an offset on, where all columns are present."""
    nulls = int.from_bytes(data[at : at + width], "little")
    at += width
    if at > len(data):
        raise IndexError("truncated")
    out = []
    for i, read in enumerate(table.readers):
        if nulls >> i & 1:
            if not table.nullable[i]:
                raise ValueError("null in a column that is not null")
            out.append(_NULL)
        else:
            cell, at = read(data, at)
            out.append(cell)
    return out, at


_INTEGERS = {(1, False): "<b", (2, False): "<h", (3, False): "<i", (8, False): "<q", (1, True): "<B", (2, True): "<H", (3, True): "<I", (8, True): "<Q"}


def _reader(kind: int, meta: int, unsigned: bool, charset: int | None):
    """(data, offset) -> (the next cell of a column as ``_cell`` gives it, its end); common types without a cursor."""
    if (kind, unsigned) in _INTEGERS:
        form = struct.Struct(_INTEGERS[kind, unsigned])
        get, width, name = form.unpack_from, form.size, "unsigned" if unsigned else "signed"
        return lambda data, at: ({"kind": name, "value": str(get(data, at)[0]), "bin": None}, at + width)
    if kind == 5:
        get_double = struct.Struct("<d").unpack_from
        return lambda data, at: ({"kind": "float64", "value": scalars.float_text(_finite(get_double(data, at)[0])), "bin": None}, at + 8)
    if kind == 15 and charset != 63:
        head = 2 if meta > 255 else 1

        def read_text(data: bytes, at: int) -> tuple[dict[str, Any], int]:
            low = at + head
            high = low + int.from_bytes(data[at:low], "little")
            if low > len(data) or high > len(data):
                raise IndexError("truncated")
            try:
                return {"kind": "utf8", "value": data[low:high].decode(), "bin": None}, high
            except UnicodeDecodeError:
                return {"kind": "encodedText", "value": None, "bin": data[low:high]}, high

        return read_text

    def read(data: bytes, at: int) -> tuple[dict[str, Any], int]:
        body = _Bytes(data)
        body.at = at
        return _cell(body, kind, meta, unsigned, charset), body.at

    return read


def _cell(body: _Bytes, kind: int, meta: int, unsigned: bool, charset: int | None) -> dict[str, Any]:
    width = {1: 1, 2: 2, 9: 3, 3: 4, 8: 8}.get(kind)
    if width:
        number = int.from_bytes(body.take(width), "little", signed=not unsigned)
        return {"kind": "unsigned" if unsigned else "signed", "value": str(number), "bin": None}
    text = None
    if kind == 4:
        (number,) = struct.unpack("<f", body.take(4))
        text = ("float32", scalars.float_text(_finite(number), True))
    elif kind == 5:
        (number,) = struct.unpack("<d", body.take(8))
        text = ("float64", scalars.float_text(_finite(number)))
    elif kind == 246:
        precision, scale = meta >> 8, meta & 255
        text = ("decimal", scalars.decimal_text(body.take(scalars.decimal_size(precision, scale)), precision, scale))
    elif kind == 10:
        text = ("temporal", scalars.date_text(body.number(3)))
    elif kind == 13:
        text = ("temporal", scalars.year_text(body.number(1)))
    elif kind == 7:
        text = ("temporal", scalars.timestamp_text(body.take(4)[::-1], 0))
    elif kind in (17, 18, 19):
        size = {17: 4, 18: 5, 19: 3}[kind] + (meta + 1) // 2
        make = {17: scalars.timestamp_text, 18: scalars.datetime_text, 19: scalars.time_text}[kind]
        text = ("temporal", make(body.take(size), meta))
    elif kind == 16:
        bits = (meta & 255) + 8 * (meta >> 8)
        number = int.from_bytes(body.take((bits + 7) // 8), "big")
        if number >> bits:
            raise ValueError("bits beyond the width")
        text = ("unsigned", str(number))
    elif kind in (247, 248):
        text = ("unsigned", str(body.number(meta & 255)))
    elif kind == 245:
        text = ("json", jsondoc.dumps(jsondoc.decode_binary(body.take(body.number(meta)))))
    if text:
        return {"kind": text[0], "value": text[1], "bin": None}
    if kind in (252, 255):
        data = body.take(body.number(meta))
    elif kind in (15, 253):
        data = body.take(body.number(2 if meta > 255 else 1))
    else:  # CHAR and BINARY: the length's upper bits are folded into the type byte
        most = ((meta >> 4 & 0x300) ^ 0x300) + (meta & 255)
        data = body.take(body.number(2 if most > 255 else 1))
        if charset == 63:
            data = data.ljust(most, b"\0")
    if charset in (63, None) and (kind == 255 or charset == 63 or kind == 252):
        return {"kind": "binary", "value": None, "bin": data}
    try:
        value = data.decode()
        return {"kind": "utf8", "value": value.rstrip(" ") if kind == 254 else value, "bin": None}
    except UnicodeDecodeError:
        return {"kind": "encodedText", "value": None, "bin": data}


def _finite(number: float) -> float:
    if number != number or number in (float("inf"), float("-inf")):
        raise ValueError("number is not finite")
    return number


def query_context(status: bytes) -> dict[str, Any]:
    """Status variables of a Query event that change what its text means."""
    out: dict[str, Any] = {}
    body = _Bytes(status)
    while body.left():
        code = body.number(1)
        if code == 0:
            flags = body.number(4)
            out["foreign_key_checks"] = not flags & (1 << 26)
            out["sql_auto_is_null"] = bool(flags & (1 << 14))
        elif code == 1:
            out["sql_mode"] = body.number(8)
        elif code == 2:
            body.take(body.number(1) + 1)
        elif code == 3:
            out["auto_increment"] = [body.number(2), body.number(2)]
        elif code == 4:
            out["charset"] = [body.number(2), body.number(2), body.number(2)]
        elif code == 5:
            out["time_zone"] = body.take(body.number(1)).decode()
        elif code == 6:
            body.take(body.number(1))
        elif code in (7, 8):
            out["lc_time_names" if code == 7 else "charset_database"] = body.number(2)
        elif code == 9:
            body.take(8)
        elif code == 11:
            out["invoker"] = [body.take(body.number(1)).decode(), body.take(body.number(1)).decode()]
        elif code == 12:
            count = body.number(1)
            names = []
            for _ in range(count if count != 254 else 0):
                end = body.data.index(b"\0", body.at)
                names.append(body.take(end - body.at).decode())
                body.take(1)
            out["databases"] = names
        elif code == 13:
            out["microseconds"] = body.number(3)
        elif code == 16:
            out["explicit_defaults_for_timestamp"] = bool(body.number(1))
        elif code == 17:
            out["ddl_xid"] = body.number(8)
        elif code == 18:
            out["default_collation"] = body.number(2)
        elif code in (19, 20):
            body.take(1)
        else:
            raise ValueError(f"status variable {code}")
    return out


# data source ----------------------------------------------------------------


def _files(path: str) -> list[str]:
    """A file, or the sorted plain files of a folder."""
    from pyarrow import fs

    filesystem, inner = _open(path)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        prefix = path.rstrip("/")
        return sorted(f"{prefix}/{i.base_name}" for i in filesystem.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and re.search(r"\.\d+$", i.base_name))
    return [path]


def _open(path: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _splits(files: list[str], options: dict[str, str]) -> list[InputPartition]:
    """Partitions (path, low, high) of files: ranges of ``split`` bytes at most, of like size; the last one of a file has no end."""
    split = int(options.get("split") or SPLIT) if options.get("split") != "0" else 0
    out = []
    for path in files:
        filesystem, inner = _open(path)
        size = filesystem.get_file_info(inner).size or 0
        count = max(1, -(-size // split)) if split > 0 else 1
        bounds = [size * i // count for i in range(count)]
        out += [InputPartition((path, low, high)) for low, high in zip(bounds, [*bounds[1:], None], strict=True)]
    return out


def read_file(path: str, wanted=None, low: int = 0, high: int | None = None) -> Iterator[dict[str, Any]]:
    """Events of a file; with bounds those from the first range start at or after low up to that at or after high."""
    for _, row in _read_range(path, wanted, low, high):
        yield row


def _read_range(path: str, wanted, low: int, high: int | None) -> Iterator[tuple[int, dict[str, Any]]]:
    """(bytes, event)"""
    filesystem, inner = _open(path)
    decoder = Decoder(path.rsplit("/", 1)[-1], wanted)
    with filesystem.open_input_file(inner) as source:
        size = source.size()
        if low:
            low = range_start(source, low, size if high is None else high, size)
            if low is None:  # its bytes belong to events of the range before
                return
        stop = None if high is None else range_start(source, high, size, size)
        source.seek(low)
        offset = low
        for offset, raw in frames(io.BufferedReader(source, 1 << 20), at=low):
            if stop is not None and offset >= stop:
                break
            yield len(raw), decoder.decode(offset, raw)
        if stop is not None and offset != stop:  # also where the file ends before it
            raise BinlogError("SPLIT", offset, f"an event holds another event's bytes at {stop}; read whole files (option split 0)")


def _lists(sizes: list[int | None], values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Lists of the given sizes over values; None is a null list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum([n or 0 for n in sizes], out=offsets[1:])
    mask = pa.array([n is None for n in sizes], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind, mask=mask)


def _batch(events: list[dict[str, Any]], schema: pa.Schema) -> pa.RecordBatch:
    names = schema.names
    arrays = []
    for name, kind, found in zip(names, schema.types, zip(*map(operator.itemgetter(*names), events), strict=True), strict=True):
        if name == "rows":
            arrays.append(_rows_array(found, kind))
        elif name == "xid":
            arrays.append(pa.array([None if x is None else Decimal(x) for x in found], kind))
        elif name == "columns":  # few different lists, each held by many events
            known: dict[int, int] = {}
            places = [None if x is None else known.setdefault(id(x), len(known)) for x in found]
            lists = {id(x): x for x in found if x is not None}
            arrays.append(pa.array([lists[k] for k in known], kind).take(pa.array(places, pa.int32())))
        else:
            arrays.append(pa.array(found, kind))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _rows_array(found: list[list[dict[str, Any]] | None], kind: pa.ListType) -> pa.Array:
    rows = [r for rs in found if rs is not None for r in rs]
    row_type = kind.value_type
    parts = [pa.array([r["op"] for r in rows], pa.string())]
    for name in ("before", "after"):
        images = [r[name] for r in rows]
        cells = [c for image in images if image is not None for c in image]
        list_type = row_type.field(name).type
        values = pa.StructArray.from_arrays([pa.array([c[n] for c in cells], t) for n, t in (("kind", pa.string()), ("value", pa.string()), ("bin", pa.binary()))], fields=list(list_type.value_type))
        parts.append(_lists([None if image is None else len(image) for image in images], values, list_type))
    return _lists([None if rs is None else len(rs) for rs in found], pa.StructArray.from_arrays(parts, fields=list(row_type)), kind)


def _batches(partition: InputPartition, schema: StructType, tables: str | None) -> Iterator[pa.RecordBatch]:
    """The events of a partition as Arrow batches, bounded in number and bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held, size = [], 0
    for n, row in _read_range(partition.value[0], _wanted(tables), *partition.value[1:]):
        held.append(row)
        size += n
        if len(held) >= BATCH_EVENTS or size >= BATCH_BYTES:
            yield _batch(held, arrow)
            held, size = [], 0
    if held:
        yield _batch(held, arrow)


def file_number(path: str) -> int:
    """The number at the end of a file's name: 999999 comes before 1000000."""
    return int(re.search(r"(\d+)$", path)[1])


def _wanted(tables: str | None):
    """Names or patterns of the option tables -> (db, tbl) -> whether the rows are decoded: % any run, _ one character, a backslash the next one itself."""
    if not tables:
        return None
    parts = []
    for pattern in (t.strip() for t in tables.split(",")):
        out, i = "", 0
        while i < len(pattern):
            c = pattern[i]
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                out += re.escape(pattern[i])
            else:
                out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
            i += 1
        parts.append(out)
    fits = re.compile("|".join(f"(?:{p})" for p in parts), re.DOTALL).fullmatch
    return lambda db, tbl: fits(f"{db}.{tbl}") is not None


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.options, self.only = schema, options["path"], options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """File equality prunes partitions; the others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.only = {f.value}
            elif isinstance(f, In) and f.attribute == ("file",):
                self.only = set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return _splits([f for f in _files(self.path) if self.only is None or f.rsplit("/", 1)[-1] in self.only], self.options)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.schema, self.options.get("tables"))


class _Stream(DataSourceStreamReader):
    """New files of a folder by number; a batch takes all that are there, each in ranges. The driver lists names and sizes and decodes nothing."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path, self.options = schema, options["path"], options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max(map(file_number, _files(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _splits([f for f in sorted(_files(self.path), key=file_number) if start["after"] < file_number(f) <= end["after"]], self.options)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.schema, self.options.get("tables"))


class BinlogDataSource(DataSource):
    """``spark.read.format("binlog").load(path)``: options path (a file or a folder), tables (patterns db.table, comma separated) and split (bytes of a partition, 0 for whole files)."""

    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(schema, dict(self.options))


def same_bytes(events: DataFrame, folder: str) -> DataFrame:
    """events(file, offset, next_pos, sha256, ...) with ``same``: whether sha256 is that of the file's bytes from offset to next_pos.

    Each task reads the bytes of its own events, one event at a time; in the order of the source that is one pass over the files.
    """
    given = events.schema
    names = given.fieldNames()
    file, offset, next_pos, digest = (names.index(n) for n in ("file", "offset", "next_pos", "sha256"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, at = None, None, -1
        for batch in stream:
            same = []
            for f, low, high, expected in zip(*[batch.column(i).to_pylist() for i in (file, offset, next_pos, digest)], strict=True):
                if f != name:
                    if source is not None:
                        source.close()
                    filesystem, inner = _open(f"{folder.rstrip('/')}/{f}")
                    name, source, at = f, io.BufferedReader(filesystem.open_input_file(inner), 1 << 20), 0
                if low != at:
                    source.seek(low)
                raw = source.read(max(high - low, 0))
                at = low + len(raw)
                same.append(hashlib.sha256(raw).hexdigest() == expected)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], names=[*names, "same"])
        if source is not None:
            source.close()

    return events.mapInArrow(run, StructType([*given.fields, StructField("same", BooleanType())]))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinlogDataSource)
