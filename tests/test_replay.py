import struct

from ebbline import replay
from ebbline.__main__ import main
from ebbline.functions import ddl
from tests import wire

UUID = "00112233-4455-6677-8899-aabbccddeeff"


def image(k, s):
    return [struct.pack("<i", k), None if s is None else struct.pack("<H", len(s)) + s.encode()]


def write(folder):
    """Two files: inserts, an update, a key move, a delete, a rollback without rows and another table."""
    for number, groups in ((1, [(1, 30, [[image(1, "a")], [image(2, "b")]], "t"), (2, 31, [[image(2, "b"), image(2, "c")]], "t")]), (2, [(3, 31, [[image(1, "a"), image(7, "a")]], "t"), (4, 30, [[image(9, "z")]], "u"), (5, 32, [[image(2, "c")]], "t"), (6, 30, [[image(8, None)]], "t")])):
        log = wire.Log()
        for gno, kind, rows, tbl in groups:
            log.gtid(gno).query("BEGIN")
            log.table_map(5, "app", tbl, [3, 15], meta=struct.pack("<H", 300))
            log.rows(kind, 5, 2, rows).xid()
        log.gtid(100 + number).query("BEGIN").query("ROLLBACK")
        (folder / f"bin.{number:06d}").write_bytes(bytes(log.data))


def test_snapshot_of_an_archive(spark, tmp_path):
    write(tmp_path)
    keyed = ddl.parse("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(60))").detail["table"]
    bag = ddl.parse("CREATE TABLE t (id INT, s VARCHAR(60))").detail["table"]
    events = replay.read(spark, str(tmp_path)).cache()
    assert sorted((g.outcome, g.gtid[-3:]) for g in replay.groups(events).collect() if g.outcome != "committed") == [("rolledBack", "101"), ("rolledBack", "102")]
    rows = lambda t, **k: sorted(map(tuple, replay.snapshot(replay.changes(events, **k), t, "app", "t").collect()))
    assert rows(keyed) == rows(bag) == [(7, "a"), (8, None)]
    assert rows(keyed, stop_at=f"{UUID}:1-2") == [(1, "a"), (2, "c")] == rows(keyed, after_transactions=2)
    assert rows(keyed, executed=f"{UUID}:3-6") == [(1, "a"), (2, "c")]
    assert rows(keyed, ignore=["app.t"]) == [] and replay.changes(events, include=["app.u"]).count() == 1
    assert replay.read(spark, str(tmp_path), ["app.u"]).where("kind = 'rows' AND NOT filtered").count() == 1


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path)
    assert main(["blackhole", str(tmp_path)]) == 0 and capsys.readouterr().out.strip().endswith("38")
    assert main(["changes", str(tmp_path), "--include", "app.u"]) == 0 and '"op":"insert"' in capsys.readouterr().out
