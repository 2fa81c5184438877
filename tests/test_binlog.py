import io
import struct

import pytest

from ebbline.functions import jsondoc, scalars
from ebbline.sources import binlog
from tests import wire


def decode(data, **kw):
    decoder = binlog.Decoder("f", **kw)
    return [decoder.decode(at, raw) for at, raw in binlog.frames(io.BytesIO(bytes(data)))]


def sample():
    log = wire.Log()
    log.gtid(5).query("BEGIN")
    log.table_map(9, "app", "t", [3, 15, 8, 1], meta=struct.pack("<H", 400), optional=b"\x01\x01\x40" + wire.names("id", "name", "big", "tiny"))
    text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    row = lambda i, s, b, t: [struct.pack("<i", i), None if s is None else text(s), struct.pack("<Q", b), struct.pack("<b", t)]
    log.rows(30, 9, 4, [[row(-1, "é🙂", 2**64 - 1, -128)], [row(2, None, 0, 127)]], flags=0)
    log.rows(31, 9, 4, [[row(2, None, 0, 1), row(2, "x", 1, 1)]], flags=0)
    log.rows(32, 9, 4, [[row(2, "x", 1, 1)]])
    log.xid()
    return log


def test_events_and_images():
    rows = decode(sample().data)
    assert [r["kind"] for r in rows] == ["fde", "gtid", "begin", "table_map", "rows", "rows", "rows", "xid"]
    assert rows[1]["gtid"] == "00112233-4455-6677-8899-aabbccddeeff:5"
    assert rows[3]["columns"] == ["id", "name", "big", "tiny"]
    insert, update, delete = rows[4]["rows"], rows[5]["rows"], rows[6]["rows"]
    assert [c["value"] for c in insert[0]["after"]] == ["-1", "é🙂", str(2**64 - 1), "-128"]
    assert insert[1]["after"][1]["kind"] == "null" and insert[0]["before"] is None
    assert update[0]["before"][1]["kind"] == "null" and update[0]["after"][1]["value"] == "x"
    assert delete[0]["after"] is None and delete[0]["op"] == "delete"


def test_truncation_at_every_byte_is_an_error():
    data = sample().data
    ends = {4}
    for at, raw in binlog.frames(io.BytesIO(bytes(data))):
        ends.add(at + len(raw))
    for n in range(len(data)):
        if n not in ends:
            with pytest.raises(binlog.BinlogError):
                decode(data[:n])


def test_every_flipped_byte_is_noticed():
    data = sample().data
    for n in range(4, len(data)):
        broken = bytearray(data)
        broken[n] ^= 0x55
        with pytest.raises(binlog.BinlogError):
            decode(broken)


def test_filtered_tables_keep_identity_only():
    rows = decode(sample().data, wanted=lambda db, tbl: False)
    assert rows[3]["filtered"] and rows[4]["filtered"] and rows[4]["rows"] is None


def test_maps_end_with_the_statement():
    log = sample()
    log.rows(32, 9, 4, [[[struct.pack("<i", 1), None, struct.pack("<Q", 1), b"\x01"]]])
    with pytest.raises(binlog.BinlogError, match="SCHEMA"):
        decode(log.data)


def test_poisoned_after_an_error():
    decoder = binlog.Decoder()
    with pytest.raises(binlog.BinlogError):
        decoder.decode(4, b"\0" * 30)
    with pytest.raises(binlog.BinlogError, match="POISONED"):
        decoder.decode(4, b"\0" * 30)


def test_scalars():
    assert scalars.decimal_text(bytes.fromhex("81 0DFB38D2 04D2".replace(" ", "")), 14, 4) == "1234567890.1234"
    assert scalars.decimal_text(bytes.fromhex("7E F204C72D FB2D".replace(" ", "")), 14, 4) == "-1234567890.1234"
    assert scalars.date_text(2026 << 9 | 1 << 5 | 31) == "2026-01-31"
    assert scalars.date_text(0) == "0000-00-00"
    assert scalars.year_text(0) == "0000" and scalars.year_text(126) == "2026"
    packed = ((2026 * 13 + 3) << 5 | 9) << 17 | 23 << 12 | 59 << 6 | 58
    assert scalars.datetime_text((packed + (1 << 39)).to_bytes(5, "big") + (123456).to_bytes(3, "big"), 6) == "2026-03-09 23:59:58.123456"
    whole = 838 << 12 | 59 << 6 | 59
    assert scalars.time_text((whole + (1 << 23)).to_bytes(3, "big"), 0) == "838:59:59"
    assert scalars.time_text((-(whole) + (1 << 23)).to_bytes(3, "big"), 0) == "-838:59:59"
    assert scalars.timestamp_text(struct.pack(">I", 86400) + b"\x32", 2) == "1970-01-02 00:00:00.50"
    assert scalars.float_text(struct.unpack("<f", struct.pack("<f", 0.1))[0], True) == "0.1"


def small_object(**fields):
    """A small binary object with inline 16-bit integers and short texts."""
    keys = sorted(fields, key=lambda k: (len(k), k))
    at = 4 + len(keys) * 4 + len(keys) * 3
    key_part, entries, tail = b"", b"", b""
    for k in keys:
        key_part += struct.pack("<HH", at + len(tail), len(k))
        tail += k.encode()
    for k in keys:
        v = fields[k]
        if isinstance(v, int):
            entries += b"\x05" + struct.pack("<h", v)
        else:
            entries += b"\x0c" + struct.pack("<H", at + len(tail))
            tail += bytes([len(v.encode())]) + v.encode()
    return b"\x00" + struct.pack("<HH", len(keys), at + len(tail)) + key_part + entries + tail


def test_binary_json():
    assert jsondoc.decode_binary(small_object(a=-3, bc="é")) == {"a": -3, "bc": "é"}
    with pytest.raises(jsondoc.JsonError):
        jsondoc.decode_binary(small_object(a=1, b="xyz")[:-2])


def test_json_changes_and_paths():
    doc = jsondoc.loads('{"a":[1,2,{"b":null}],"k e":"v"}')
    assert jsondoc.get(doc, '$.a[last].b') is None and jsondoc.get(doc, '$."k e"') == "v" and jsondoc.get(doc, "$.a[last-1]") == 2
    made = jsondoc.apply_changes(doc, [(0, "$.a[0]", 9), (1, "$.a[99]", "end"), (1, "$.new", True), (2, '$."k e"', None)])
    assert jsondoc.dumps(made) == '{"a":[9,2,{"b":null},"end"],"new":true}'
    for bad in [(0, "$.x", 1), (1, "$.a", 1), (2, "$.a[7]", None), (0, "$", 1), (3, "$.a", 1)]:
        with pytest.raises(jsondoc.JsonError):
            jsondoc.apply_changes(doc, [bad])
    for text in ('{"a":1,"a":2}', "[" * 101 + "]" * 101, "NaN", "1e999"):
        with pytest.raises(jsondoc.JsonError):
            jsondoc.loads(text)
    assert not jsondoc.equal(1, 1.0) and not jsondoc.equal(True, 1) and jsondoc.equal({"a": 1, "b": 2}, {"b": 2, "a": 1})
    assert list(jsondoc.match_fields({"b": [1.5], "a": "x"})) == [("$", "OBJECT", None, 2), ('$."a"', "STRING", "x", None), ('$."b"', "ARRAY", None, 1), ('$."b"[0]', "DOUBLE", "1.5", None)]


def test_opaque_years():
    year = lambda text: jsondoc.Typed("OPAQUE", jsondoc.opaque_text(13, text))
    assert jsondoc.years_to_integers({"a": [year(b"2026"), 1], "b": year(b"0")}) == {"a": [2026, 1], "b": 0}
    for bad in (b"1900", b"2156", b"", b"20x6"):
        with pytest.raises(jsondoc.JsonError):
            jsondoc.years_to_integers(year(bad))


def test_data_source_reads_folders(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"bin.{i:06d}").write_bytes(bytes(sample().data))
    binlog.register(spark)
    df = spark.read.format("binlog").load(str(tmp_path))
    assert df.count() == 16
    rows = df.where("file = 'bin.000002' AND kind = 'rows'").selectExpr("explode(rows) r").selectExpr("r.op", "r.after[0].value AS id").collect()
    assert [(r.op, r.id) for r in rows] == [("insert", "-1"), ("insert", "2"), ("update", "2"), ("delete", None)]
    few = spark.read.format("binlog").option("tables", "app.other").load(str(tmp_path))
    assert few.where("rows IS NOT NULL").count() == 0


def long_log(groups=200):
    from ebbline.sources import binlog_writer

    log = binlog_writer.LogEncoder()
    for g in range(1, groups + 1):
        log.gtid("00112233-4455-6677-8899-aabbccddeeff", g)
        log.query("BEGIN", "app")
        for k in range(40 if g == 50 else 2):
            log.table_map(7, "app", "t", [("id", "bigint"), ("s", "varchar")])
            log.rows("insert", 7, ["bigint", "varchar"], [[[g * 100 + k, None if k else f"é{g}" * (g % 9)]]])
        log.xid(g)
    return log


def test_a_long_file_is_read_in_ranges(spark, tmp_path):
    (tmp_path / "bin.000001").write_bytes(bytes(long_log().data))
    (tmp_path / "bin.000002").write_bytes(bytes(sample().data))
    binlog.register(spark)
    load = lambda split: spark.read.format("binlog").option("split", split).load(str(tmp_path))
    assert load(0).rdd.getNumPartitions() == 2
    want = sorted(map(repr, load(0).collect()))
    for split in (1000, 4099):
        assert load(split).rdd.getNumPartitions() > 4
        assert sorted(map(repr, load(split).collect())) == want
    decoded = decode(long_log().data)
    path = str(tmp_path / "bin.000001")
    size = len(long_log().data)
    for step in (97, 700, 5000):
        bounds = [*range(0, size, step), None]
        found = [r for low, high in zip(bounds, bounds[1:]) for r in binlog.read_file(path, None, low, high)]
        assert [{**r, "file": "f"} for r in found] == decoded
    (tmp_path / "bin.000001").write_bytes(bytes(long_log().data[:-3]))
    with pytest.raises(Exception, match="truncated"):
        load(1000).count()


def test_an_event_inside_an_event_is_noticed(tmp_path):
    """Bytes in a row that are a whole Query event for their very place: an error in ranges, never other rows."""
    from ebbline.sources import binlog_writer

    place = 500
    inner = binlog_writer.LogEncoder(base=place)
    inner.query("BEGIN", "")
    log = binlog_writer.LogEncoder()
    log.query("BEGIN", "app")
    body = struct.pack("<IIBHH", 1, 0, 3, 0, 0) + b"app\0SELECT '"
    pad = place - len(log.data) - binlog.HEADER.size - len(body)
    log.event(2, body + b"x" * pad + bytes(inner.data) + b"'")
    assert bytes(log.data)[place : place + len(inner.data)] == bytes(inner.data)
    path = tmp_path / "bin.000001"
    path.write_bytes(bytes(log.data))
    assert [r["kind"] for r in binlog.read_file(str(path))] == ["fde", "begin", "statement"]
    with pytest.raises(binlog.BinlogError, match="SPLIT"):
        list(binlog.read_file(str(path), None, 0, place - 5))


def test_parts_of_written_files_make_the_same_bytes(spark, tmp_path):
    from ebbline.sources import binlog_writer

    rows = [(1 if i < 60 else 2, i // 7 + 1 if i != 30 else 1, i, ("insert", "update", "delete")[i % 3], (i, "o") if i % 3 else None, None if i % 3 == 2 else (i, None if i % 4 else "é" * i)) for i in range(100)]
    changes = spark.createDataFrame(rows, "file_no int, gno long, seq long, op string, before struct<id: long, s: string>, after struct<id: long, s: string>")
    columns, sid = [("id", "bigint"), ("s", "varchar")], "00112233-4455-6677-8899-aabbccddeeff"
    want = {n: binlog_writer.LogEncoder() for n in (1, 2, 3)}
    for n, log in want.items():
        now = None
        for f, g, _, op, before, after in rows:
            if f != n:
                continue
            if g != now:
                if now is not None:
                    log.xid(now)
                now = g
                log.gtid(sid, g)
                log.query("BEGIN", "app")
            log.table_map(7, "app", "t", columns)
            log.rows(op, 7, ["bigint", "varchar"], [[list(v) for v in (before, after) if v is not None]])
        if now is not None:
            log.xid(now)
        if n < 3:
            log.rotate(f"bin.{n + 1:06d}")
    for part in (3, 10, 1000):
        folder = tmp_path / f"p{part}"
        assert binlog_writer.write_log(changes, str(folder), columns, "app", "t", sid, 3, part=part) == 100
        assert {p.name: p.read_bytes() for p in folder.iterdir()} == {f"bin.{n:06d}": bytes(log.data) for n, log in want.items()}


def test_same_bytes(spark, tmp_path):
    (tmp_path / "bin.000001").write_bytes(bytes(long_log(20).data))
    binlog.register(spark)
    events = spark.read.format("binlog").load(str(tmp_path)).selectExpr("file", "offset", "next_pos", "kind", "IF(kind = 'xid', sha2('x', 256), sha256) AS sha256")
    found = {(r.kind, r.same) for r in binlog.same_bytes(events.repartition(3), str(tmp_path)).collect()}
    assert ("xid", False) in found and all(same == (kind != "xid") for kind, same in found) and len(found) == 6


def test_stream_and_batch_deal_a_long_file_in_ranges(tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    (tmp_path / "bin.000001").write_bytes(bytes(long_log().data))
    schema = StructType([StructField("file", StringType()), StructField("offset", LongType()), StructField("kind", StringType())])
    options = {"path": str(tmp_path), "split": "1000"}
    stream, reader = binlog._Stream(schema, options), binlog._Reader(schema, options)
    want = [(r["offset"], r["kind"]) for r in decode(long_log().data)]
    for source, parts in ((stream, stream.partitions({"after": -1}, stream.latestOffset())), (reader, reader.partitions())):
        assert len(parts) > 10
        assert [(r["offset"], r["kind"]) for p in parts for b in source.read(p) for r in b.to_pylist()] == want
