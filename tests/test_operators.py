import random

import pytest
from pyspark.sql import functions as F

from ebbline.functions import expressions
from ebbline.functions.expressions import column
from ebbline.operators import filters, fold, gtid, journal, partitions, running, transactions
from ebbline.sources import archive, binlog
from tests import wire

UUID = "00112233-4455-6677-8899-aabbccddeeff"


def test_running_in_blocks(spark):
    r = random.Random(1)
    rows = [(k, i, r.choice([None, r.randrange(10)])) for k in ("a", "b", None) for i in sorted(r.sample(range(500), 60))]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    found = {(x.k, x.i): x for x in running.running(df, ["k"], "i", 16, s=("sum", F.col("v")), m=("max", F.col("v")), l=("last", F.col("v"))).collect()}
    before = {(x.k, x.i): x.p for x in running.previous(df, ["k"], "i", 16, p=F.col("v")).collect()}
    for k in ("a", "b", None):
        total, top, last, prior = 0, None, None, None
        for _, i, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1]):
            assert before[k, i] == prior
            prior = v
            if v is not None:
                total, top, last = total + v, v if top is None else max(top, v), v
            assert (found[k, i].s, found[k, i].m, found[k, i].l) == (total, top, last)


def test_folds_against_a_sequential_apply(spark):
    for seed in range(4):
        r = random.Random(seed)
        table, log = {}, []
        for seq in range(300):
            keys = sorted(table)
            op = r.choice(["insert", "update", "move", "delete"])
            if op == "insert" or not keys:
                k = r.randrange(1000)
                if k in table:
                    continue
                table[k] = seq
                log.append((seq, "insert", None, k, seq))
            else:
                k = r.choice(keys)
                if op == "delete":
                    del table[k]
                    log.append((seq, "delete", k, None, None))
                else:
                    new = k if op == "update" else r.randrange(1000)
                    if new != k and new in table:
                        continue
                    del table[k]
                    table[new] = seq
                    log.append((seq, "update", k, new, seq))
        df = spark.createDataFrame(log, "seq long, op string, old long, new long, v long")
        split = fold.split_key_moves(df, ["old"], ["new"], ["k"], "op").withColumn("o", F.col("seq") * 2 + F.col("sub"))
        assert {x.k: x.v for x in fold.keyed_snapshot(split, ["k"], "o", "op", ["v"]).collect()} == table


def test_bags_tell_bytes_apart(spark):
    df = spark.createDataFrame([(0.0, "a", 1), (-0.0, "a", 1), (None, "A", 1), (None, "A", -1), (1.0, "x ", 1), (1.0, "x", -1)], "f double, s string, sign int")
    assert sorted((str(x.f), x.s, x.n, x.broken) for x in fold.bag_fold(df, ["f", "s"], "sign").collect()) == [("-0.0", "a", 1, False), ("0.0", "a", 1, False), ("1.0", "x", -1, True), ("1.0", "x ", 1, False)]


def test_patterns():
    for bad in ("", "a", "a.b.c", "a.b\\", "x" * 513 + ".b"):
        with pytest.raises(filters.PatternError):
            filters.check_patterns([bad])
    with pytest.raises(filters.PatternError):
        filters.check_patterns(["a.b"] * 129)
    assert filters.check_patterns([r"a\.x.b%"])


def test_number_sets(spark):
    text = f"{UUID}:1-3:5:tag_1:7, {UUID.upper()}:4:9-10"
    rows = gtid.parse(text)
    assert rows == [(UUID, "", 1, 5), (UUID, "", 9, 10), (UUID, "tag_1", 7, 7)]
    assert gtid.decode(gtid.encode(rows)) == rows and gtid.decode(gtid.encode(rows[:2])) == rows[:2]
    assert gtid.canonical_text(gtid.frame(spark, text), tag="tag").first()[0] == f"{UUID}:1-5:9-10:tag_1:7"
    for bad in ("x:1", f"{UUID}:0", f"{UUID}:5-3", UUID, f"{UUID}:1x"):
        with pytest.raises(gtid.GtidError):
            gtid.parse(bad)
    for n in range(len(gtid.encode(rows))):
        with pytest.raises(gtid.GtidError):
            gtid.decode(gtid.encode(rows)[:n])


def test_set_algebra_against_python_sets(spark):
    r = random.Random(3)
    pick = lambda: [(s, lo, lo + r.randrange(6)) for s in "ab" for lo in r.sample(range(200), 25)]
    a, b = pick(), pick()
    frame = lambda x: spark.createDataFrame(x, "sid string, lo long, hi long")
    points = lambda x: {(s, i) for s, lo, hi in x for i in range(lo, hi + 1)}
    ca, cb = (gtid.union(frame(x), ["sid"], 16) for x in (a, b))
    found = sorted(map(tuple, ca.collect()))
    assert points(found) == points(a) and all(s != t or h + 1 < l2 for (s, _, h), (t, l2, _) in zip(found, found[1:], strict=False))
    assert sorted(map(tuple, gtid.islands(spark.createDataFrame(sorted(points(a)), "sid string, seq long"), ["sid"], "seq", 16).collect())) == found
    assert {x.sid: x.remaining for x in gtid.remaining(ca, cb, ["sid"]).collect()} == {s: len({p for p in points(a) - points(b) if p[0] == s}) for s in "ab"}
    assert {tuple(x) for x in gtid.uncovered(ca, cb, ["sid"]).collect()} == {x for x in found if not any(y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in map(tuple, cb.collect()))}


def test_transactions_with_errors(spark):
    kinds = ["fde", "gtid", "begin", "rows", "rollback", "gtid", "begin", "xid", "gtid", "statement", "stop", "gtid", "begin"]
    df = spark.createDataFrame([(i, k, 10) for i, k in enumerate(kinds)], "o long, kind string, size long")
    found = [(x.first, x.last, x.outcome, x.error) for x in transactions.transactions(transactions.assemble(df, "o", "kind"), "o", "kind", "size").orderBy("first").collect()]
    assert found == [(1, 4, "rolledBack", "sequence"), (5, 7, "committed", None), (8, 9, "statement", None), (11, 12, "incomplete", None)]


def test_resolution():
    assert journal.resolve([4, 5], "retry", [5, 4]) == [(4, "pending"), (5, "pending")]
    assert journal.resolve([4, 5], "skip", [4]) == [(4, "skipped")]
    for action, chosen in (("retry", [4]), ("skip", [5]), ("mark_applied", [4, 5]), ("other", [4]), ("skip", [])):
        with pytest.raises(journal.ResolveError):
            journal.resolve([4, 5], action, chosen)


def test_partition_maintenance():
    p = partitions.Partitioning("range", (("a", 1), ("b", 5)))
    assert p.add(("c", partitions.MAXVALUE)).names() == ["a", "b", "c"]
    assert p.add(("c", 9)).reorganize(["a", "b"], [("x", 5)]).parts == (("x", 5), ("c", 9))
    h = partitions.Partitioning("hash", count=4)
    assert h.add_hash(2).coalesce(3).names() == ["p0", "p1", "p2"]
    for bad in (lambda: p.add(("c", 3)), lambda: p.add(("a", 9)), lambda: p.drop("a", "b"), lambda: h.coalesce(4), lambda: p.add_hash(1), lambda: p.add(("c", 9)).reorganize(["a", "c"], [("x", 9)]), lambda: p.add(("c", 9)).reorganize(["a"], [("x", 2)])):
        with pytest.raises(partitions.PartitionError):
            bad()


def test_expression_nulls_and_errors(spark):
    df = spark.createDataFrame([(1, None, "a'b"), (None, 2, None)], "a int, b int, s string")
    out = df.select(
        column("GREATEST(a, b)").alias("g"), column("a <=> NULL").alias("n"), column("NOT a").alias("t"), column("a IS NOT TRUE").alias("u"), column("INTERVAL(a, 1, 2)").alias("i"),
        column("s = 'a''b' XOR TRUE").alias("x"), column("-a DIV 0").alias("d"), column("CASE WHEN a THEN 'y' END").alias("c"), column("~0").alias("z"), column("1 << 64").alias("w"),
    ).collect()
    assert [tuple(map(str, r)) for r in out] == [("None", "False", "False", "False", "1", "False", "None", "y", "18446744073709551615", "0"), ("None", "True", "None", "True", "-1", "None", "None", "None", "18446744073709551615", "0")]
    for bad in ("1 +", "(1", "SLEEP(1)", "a BETWEEN 1", "CASE END", "'open", "/* open", "1 2", "(" * 200 + "1" + ")" * 200):
        with pytest.raises(expressions.ExpressionError):
            column(bad)
    assert expressions.render(expressions.push_not(expressions.parse("NOT (a < 1 OR NOT b = 2)"))) == "((`a` >= 1) and (`b` = 2))"
    assert expressions.render(expressions.parse("1 + 2 * power(3, a) - -4")) == "((1 + (2 * pow(3,`a`))) - -4)"


def test_archives(spark, tmp_path):
    for i in (9, 10):
        log = wire.Log().gtid(i).query("BEGIN").xid()
        log.event(4, (4).to_bytes(8, "little") + f"bin.{i + 1:06d}".encode())
        (tmp_path / f"bin.{i:06d}").write_bytes(bytes(log.data))
    found = archive.inventory(str(tmp_path))
    assert found.files == ("bin.000009", "bin.000010")
    binlog.register(spark)
    events = spark.read.format("binlog").load(str(tmp_path))
    assert archive.adjacency(events, found.frame(spark)).collect() == []
    (tmp_path / "bin.000012").write_bytes(bytes(wire.Log().gtid(11).query("BEGIN").data))
    codes = {tuple(r) for r in archive.adjacency(spark.read.format("binlog").load(str(tmp_path)), archive.inventory(str(tmp_path)).frame(spark)).collect()}
    assert codes == {("bin.000012", "gap"), ("bin.000012", "rotation"), ("bin.000012", "incomplete")}
    set_of = lambda t: gtid.frame(spark, t)
    assert archive.validate(spark, set_of(f"{UUID}:9-10"), set_of(f"{UUID}:1-8"), set_of(f"{UUID}:1-8"), set_of(f"{UUID}:1-10")) == []
    assert len(archive.validate(spark, set_of(f"{UUID}:9-10"), set_of(f"{UUID}:1-7"), set_of(f"{UUID}:1-8"), set_of(f"{UUID}:1-10"))) == 2
    with pytest.raises(archive.ArchiveError):
        archive.inventory(str(tmp_path), "bin.000099")


def test_relay_records():
    data = archive.relay_frame({"file": "a", "offset": 4}, b"raw") + archive.relay_frame({}, b"")
    assert [(m, raw) for _, m, raw in archive.read_relay(data)] == [({"file": "a", "offset": 4}, b"raw"), ({}, b"")]
    with pytest.raises(archive.ArchiveError):
        archive.read_relay(data[:-1])


def test_batches_run_again_replace_themselves(spark, tmp_path):
    import pytest

    from ebbline.streaming.apply import SinkError, SnapshotSink

    sink = SnapshotSink(str(tmp_path / "s"), ["k"], "seq", "op", ["v"], ("sid", "gno"), ["old"], "code")
    schema = "sid string, gno long, seq long, op string, old long, k long, v long, code string"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    first = frame(("a", 1, 1, "insert", None, 1, 10, None), ("a", 1, 2, "insert", None, 2, 20, None), ("a", 1, 3, "insert", None, 3, 30, None), ("a", 2, 4, "delete", 2, None, None, "mysql.1062"))
    again = [("a", 1, 1, "insert", None, 1, 10, None), ("a", 1, 2, "insert", None, 2, 20, None), ("a", 1, 3, "insert", None, 3, 30, None)]
    second = frame(*again, ("a", 3, 5, "update", 1, 7, 11, None), ("a", 3, 6, "update", 2, 1, 21, None), ("a", 3, 7, "insert", None, 9, 90, None), (None, None, 8, "insert", None, 50, 5, None))
    state = lambda: {r.k: r.v for r in sink.snapshot(spark).collect()}
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        sink(batch, number)
    after = {7: 11, 1: 21, 3: 30, 9: 90, 50: 5}
    assert state() == after
    with pytest.raises(SinkError):
        sink(frame(("a", 3, 60, "insert", None, 4, 4, None)), 2)
    for _ in range(2):
        sink.compact(spark)
        assert state() == after and [(r.gno, r.code) for r in sink.skips(spark).collect()] == [(2, "mysql.1062")]
    sink(second, 1)  # a base holds it
    sink(frame(*again, ("a", 4, 70, "delete", 3, None, None, None)), 2)
    sink.compact(spark)
    sink(frame(("a", 2, 80, "insert", None, 8, 8, None), ("a", 5, 81, "insert", None, 8, 9, None)), 3)
    assert state() == {7: 11, 1: 21, 9: 90, 50: 5, 8: 9}


def test_json_as_sql():
    import pytest

    from ebbline.functions import jsondoc

    typed = jsondoc.Typed
    value = {"a": typed("DECIMAL", "-12.50"), "b": [1, typed("DATE", "2026-01-31"), typed("UNSIGNED INTEGER", "18446744073709551615")], "it's": typed("TIME", "-01:02:03.000004"), "x": None}
    assert jsondoc.to_sql(value) == (
        """JSON_SET(CAST('{"a":-12.50,"b":[1,"2026-01-31",18446744073709551615],"it''s":"-01:02:03.000004","x":null}' AS JSON),'$."a"',CAST('-12.50' AS DECIMAL(4,2)),"""
        """'$."b"[1]',CAST('2026-01-31' AS DATE),'$."b"[2]',CAST(18446744073709551615 AS UNSIGNED),'$."it''s"',CAST('-01:02:03.000004' AS TIME(6)))"""
    )
    assert jsondoc.to_sql([1, "a\\b'"]) == """CAST('[1,"a\\\\\\\\b''"]' AS JSON)"""
    blob, year = typed("BLOB", jsondoc.opaque_text(252, b"xyz")), typed("OPAQUE", jsondoc.opaque_text(13, b"2026"))
    assert [jsondoc.scratch_type(x) for x in (blob, year, typed("BIT", jsondoc.opaque_text(16, b"ab")), typed("OPAQUE", jsondoc.opaque_text(15, b"abc")), typed("TIMESTAMP", "x"))] == ["BLOB", "YEAR", "BIT(16)", "VARBINARY(3)", "TIMESTAMP(6)"]
    assert jsondoc.to_sql({"k": blob}, lambda path, leaf: f"(SELECT c FROM s WHERE p = '{path}')").endswith("""'$."k"',(SELECT c FROM s WHERE p = '$."k"'))""")
    for broken in (blob, typed("GEOMETRY", "base64:type255:AA==")):
        with pytest.raises(jsondoc.JsonError):
            jsondoc.to_sql({"k": broken}, None if broken is blob else lambda path, leaf: "x")


def test_batches_age(spark):
    from ebbline.operators import batching

    groups = spark.createDataFrame([(0, i, 1, 1, "t", t) for i, t in enumerate([0, 10, 24, 25, 49, 50, 200])] + [(1, 0, 1, 1, "t", 7)], "span int, seq int, n int, cost int, tbl string, ms long")
    found = batching.greedy_batches(groups, ["span"], "seq", "n", "cost", "tbl", batching.Policy(), "ms").orderBy("span", "seq").collect()
    assert [r.batch for r in found] == [0, 0, 0, 1, 1, 2, 3, 0]


def test_versions_in_one_order(spark):
    from ebbline.operators import joins

    history = spark.createDataFrame([("t", 0, 5, "a"), ("t", 5, 9, "b"), ("t", 20, None, "c"), (None, 0, None, "n")], "k string, valid_from long, valid_to long, v string")
    events = spark.createDataFrame([("t", i, i) for i in (-1, 0, 4, 5, 8, 9, 19, 20, 2**62)] + [(None, 3, 100), ("u", 3, 101), ("t", None, 102)], "k string, at long, id long")
    found = {r.id: r.v for r in joins.temporal(events, history, ["k"], "at").collect()}
    assert found == {-1: None, 0: "a", 4: "a", 5: "b", 8: "b", 9: None, 19: None, 20: "c", 2**62: "c", 100: None, 101: None, 102: None}


def test_rate_windows_across_stretches(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from ebbline.operators import metrics

    samples = spark.range(400).select((F.col("id") % 3).alias("s"), (F.col("id") * 1.7).alias("t"), (F.col("id") * F.col("id")).alias("n"))
    frame = Window.partitionBy("s").orderBy("t").rangeBetween(-30, 0)
    span = F.col("t") - F.first("t").over(frame)
    plain = samples.withColumn("rate", F.when(span >= 1, (F.col("n") - F.first("n").over(frame)) / span))
    assert sorted(map(str, metrics.rate_window(samples, ["s"], "t", "n", 30, 2).collect())) == sorted(map(str, plain.collect()))
