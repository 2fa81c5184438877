"""An independent encoder of binary log events for tests."""

import struct
import zlib

MAGIC = b"\xfebin"


class Log:
    def __init__(self, server_id=1):
        self.data, self.server_id = bytearray(MAGIC), server_id
        self.event(15, struct.pack("<H", 4) + b"8.4.0".ljust(50, b"\0") + struct.pack("<IB", 0, 19) + b"\0" * 42 + b"\x01")

    def event(self, kind, body, ts=1, flags=0):
        size = 19 + len(body) + 4
        head = struct.pack("<IBIIIH", ts, kind, self.server_id, size, len(self.data) + size, flags)
        self.data += head + body + struct.pack("<I", zlib.crc32(head + body))
        return self

    def gtid(self, number, sid="00112233-4455-6677-8899-aabbccddeeff"):
        return self.event(33, b"\x01" + bytes.fromhex(sid.replace("-", "")) + struct.pack("<Q", number) + b"\x02" + struct.pack("<QQ", 0, 1))

    def query(self, sql, db="app", status=b"", error=0):
        return self.event(2, struct.pack("<IIBHH", 1, 0, len(db), error, len(status)) + status + db.encode() + b"\0" + sql.encode())

    def xid(self, n=7):
        return self.event(16, struct.pack("<Q", n))

    def table_map(self, number, db, tbl, types, meta=b"", nullable=None, optional=b""):
        nullable = [True] * len(types) if nullable is None else nullable
        bits = bytearray((len(types) + 7) // 8)
        for i, n in enumerate(nullable):
            bits[i >> 3] |= n << (i & 7)
        body = number.to_bytes(6, "little") + b"\x01\0" + bytes([len(db)]) + db.encode() + b"\0" + bytes([len(tbl)]) + tbl.encode() + b"\0"
        return self.event(19, body + bytes([len(types)]) + bytes(types) + bytes([len(meta)]) + meta + bytes(bits) + optional)

    def rows(self, kind, number, columns, images, flags=1):
        """images: for each row the concatenated images, each a list of bytes or None, all columns present."""
        full = bytes([(1 << columns) - 1 & 255]) if columns <= 8 else ((1 << columns) - 1).to_bytes((columns + 7) // 8, "little")
        body = number.to_bytes(6, "little") + struct.pack("<HH", flags, 2) + bytes([columns]) + full * (2 if kind == 31 else 1)
        for row in images:
            for image in row:
                nulls = sum((v is None) << i for i, v in enumerate(image))
                body += nulls.to_bytes((columns + 7) // 8, "little") + b"".join(v for v in image if v is not None)
        return self.event(kind, body)


def names(*columns):
    body = b"".join(bytes([len(c)]) + c.encode() for c in columns)
    return b"\x04" + bytes([len(body)]) + body
