"""Sets of transaction numbers by source, as closed intervals (keys, lo, hi).

A canonical set is sorted, disjoint and without adjacent intervals. Numbers are cut
into blocks, so the numbers of one source never meet in one task: a block is
compacted by itself, and only the intervals that touch a block's edge go on.
"""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import running

BLOCK = 1 << 16
MAX_SOURCES, MAX_RANGES, MAX_TEXT, MAX_SEQ = 64, 4096, 1 << 20, 2**63 - 1
_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_TAG = r"[a-z_][a-z0-9_]{0,31}"


class GtidError(ValueError):
    """Text or bytes that are no set of transaction numbers."""


def islands(points: DataFrame, keys: list[str], seq: str, block: int = BLOCK) -> DataFrame:
    """Distinct points -> canonical intervals (keys, lo, hi)."""
    cut = points.select(*keys, F.col(seq).alias("_s"), F.floor(F.col(seq) / block).alias("_b")).distinct()
    order = Window.partitionBy(*keys, "_b").orderBy("_s")
    inside = cut.withColumn("_g", F.col("_s") - F.row_number().over(order)).groupBy(*keys, "_b", "_g").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    edge = (F.pmod("lo", F.lit(block)) == 0) | (F.pmod("hi", F.lit(block)) == block - 1)
    inside = inside.withColumn("_edge", edge)
    order = Window.partitionBy(*keys).orderBy("lo")
    edges = inside.where("_edge").withColumn("_new", (F.col("lo") != F.lag("hi").over(order) + 1).cast("int"))
    edges = edges.withColumn("_g2", F.sum(F.coalesce("_new", F.lit(1))).over(order))
    joined = edges.groupBy(*keys, "_g2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return inside.where("NOT _edge").select(*keys, "lo", "hi").unionByName(joined.select(*keys, "lo", "hi"))


def union(intervals: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Any intervals -> the canonical set that they cover."""
    # of equal lows the longest holds the others, so one row for each low is enough
    longest = intervals.groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    reach = running.running(longest, keys, "lo", blocks, inclusive=False, reach=("max", F.col("hi")))
    starts = reach.withColumn("_new", F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1), 1).otherwise(0))
    numbered = running.running(starts, keys, "lo", blocks, _g=("sum", F.col("_new")))
    return numbered.groupBy(*keys, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def contains(points: DataFrame, intervals: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The points that the set holds."""
    from .filters import without_covered

    outside = without_covered(points.select(*keys, seq).distinct(), intervals, keys, seq)
    return points.join(outside, [*keys, seq], "left_anti")


def uncovered(required: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of required that no single interval of the canonical set held covers; none: held covers required.

    Both are laid in one order; the interval of held that begins last at or before a low bound is the only one that can cover it.
    """
    ours = required.select(*keys, "lo", "hi", F.lit(1).alias("_side"))
    there = held.select(*keys, "lo", "hi", F.lit(0).alias("_side"))
    place = F.col("lo").cast("decimal(20,0)") * 2 + F.col("_side")
    seen = running.running(ours.unionByName(there).withColumn("_o", place.cast("decimal(22,0)")), keys, "_o", _reach=("max", F.when(F.col("_side") == 0, F.col("hi"))))
    return seen.where((F.col("_side") == 1) & (F.col("_reach").isNull() | (F.col("_reach") < F.col("hi")))).select(*required.columns)


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str], through_endpoints: bool = False) -> DataFrame:
    """Transactions of wanted that are not done, for each key: size of wanted less size of the overlap. Both sets canonical.

    through_endpoints: wanted is 1 up to the highest number of each key.
    """
    if through_endpoints:
        wanted = wanted.groupBy(*keys).agg(F.lit(1).cast("long").alias("lo"), F.max("hi").alias("hi"))
    # |wanted less done| = |wanted or done| - |done|: two sums over disjoint intervals, and no interval meets another one
    size = F.sum((F.col("hi").cast("decimal(20,0)") - F.col("lo") + 1).cast("decimal(20,0)"))
    both = union(wanted.select(*keys, "lo", "hi").unionByName(done.select(*keys, "lo", "hi")), keys).groupBy(*keys).agg(size.alias("both"))
    own = done.groupBy(*keys).agg(size.alias("done"))
    there = wanted.select(*keys).distinct()
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    joined = there.alias("w").join(both.alias("b"), on("w", "b")).join(own.alias("d"), on("w", "d"), "left")
    left = F.col("both") - F.coalesce("done", F.lit(0).cast("decimal(20,0)"))
    return joined.select(*[F.col(f"w.{k}").alias(k) for k in keys], F.least(left, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("remaining"))


def canonical_text(intervals: DataFrame, sid: str = "sid", tag: str | None = None) -> DataFrame:
    """A canonical set -> one row with its text ``uuid[:tag]:lo[-hi]...,...``: sources and tags in order, lower case."""
    span = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    label = F.coalesce(F.lower(F.col(tag)), F.lit("")) if tag else F.lit("")
    by_tag = intervals.groupBy(F.lower(F.col(sid)).alias("s"), label.alias("t")).agg(F.sort_array(F.collect_list(F.struct("lo", span.alias("x")))).alias("l"))
    tagged = by_tag.select("s", "t", F.concat_ws(":", F.when(F.col("t") != "", F.col("t")), F.transform("l", lambda v: v["x"])).alias("x"))
    by_source = tagged.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("l"))
    text = by_source.select("s", F.concat_ws(":", "s", F.transform("l", lambda v: v["x"])).alias("x"))
    return text.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("s", "x"))), lambda v: v["x"])).alias("gtid_set"))


def normal_tag(tag: Column) -> Column:
    """A tag in lower case; null if it is no tag (a letter or _, then letters, digits and _, 32 at most)."""
    return F.when(F.lower(tag).rlike(f"^{_TAG}$"), F.lower(tag))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Text -> canonical rows (sid, tag, lo, hi); GtidError where a bound or the form is broken."""
    if len(text.encode()) > MAX_TEXT:
        raise GtidError("text too long")
    found: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for part in filter(None, (p.strip() for p in text.replace("\n", "").split(","))):
        sid, *rest = (x.strip().lower() for x in part.split(":"))
        if not re.fullmatch(_UUID, sid) or not rest:
            raise GtidError(f"no source: {part!r}")
        tag, spans = "", 0
        for item in rest:
            if re.fullmatch(_TAG, item):
                tag = item
                continue
            span = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", item)
            low = int(span[1]) if span else 0
            high = int(span[2] or span[1]) if span else 0
            if not span or not 0 < low <= high < MAX_SEQ:
                raise GtidError(f"no range: {item!r}")
            found.setdefault((sid, tag), []).append((low, high))
            spans += 1
        if not spans:
            raise GtidError(f"no range: {part!r}")
    if len({s for s, _ in found}) > MAX_SOURCES:
        raise GtidError("too many sources")
    rows: list[tuple[str, str, int, int]] = []
    for (sid, tag), spans_ in sorted(found.items()):
        merged: list[list[int]] = []
        for low, high in sorted(spans_):
            if merged and low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        rows += [(sid, tag, low, high) for low, high in merged]
    if len(rows) > MAX_RANGES:
        raise GtidError("too many ranges")
    return rows


def frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse(text), "sid string, tag string, lo long, hi long")


def encode(rows: list[tuple[str, str, int, int]]) -> bytes:
    """Canonical rows -> the body of a Previous_gtids event: counts and half-open ranges, little endian; with tags the tagged form."""
    by: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for sid, tag, low, high in rows:
        by.setdefault((sid, tag), []).append((low, high))
    tagged = any(tag for _, tag in by)
    head = (1 << 56 | len(by) << 8 | 1) if tagged else len(by)
    out = [struct.pack("<Q", head)]
    for (sid, tag), spans in sorted(by.items()):
        out.append(bytes.fromhex(sid.replace("-", "")))
        if tagged:
            out.append(bytes([len(tag) << 1]) + tag.encode())
        out.append(struct.pack("<Q", len(spans)) + b"".join(struct.pack("<QQ", low, high + 1) for low, high in spans))
    return b"".join(out)


def decode(body: bytes) -> list[tuple[str, str, int, int]]:
    """The inverse of encode; GtidError where the body is broken."""
    try:
        (head,) = struct.unpack_from("<Q", body)
        tagged = head >> 56 == 1
        count, at = (head >> 8 & (1 << 48) - 1) if tagged else head, 8
        rows = []
        for _ in range(count):
            raw = body[at : at + 16].hex()
            at += 16
            tag = ""
            if tagged:
                size = body[at] >> 1
                tag = body[at + 1 : at + 1 + size].decode("ascii")
                at += 1 + size
            (spans,) = struct.unpack_from("<Q", body, at)
            at += 8
            if spans > MAX_RANGES:
                raise GtidError("too many ranges")
            for _ in range(spans):
                low, stop = struct.unpack_from("<QQ", body, at)
                at += 16
                if not 0 < low < stop <= MAX_SEQ:
                    raise GtidError("broken range")
                rows.append((f"{raw[:8]}-{raw[8:12]}-{raw[12:16]}-{raw[16:20]}-{raw[20:]}", tag, low, stop - 1))
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise GtidError("truncated set") from e
    if at != len(body):
        raise GtidError("bytes after the set")
    return rows


def prefix_until_covered(groups: DataFrame, order: str, keys: list[str], seq: str, target: DataFrame, after_transactions: int | None = None) -> DataFrame:
    """The groups up to the first at which all of target is seen, or up to the given number of them, whichever comes first.

    Each target interval is counted down by the groups in it; the group that brings the last count to zero is the last one.
    """
    from .filters import without_covered

    points = groups.select(order, *keys, seq)
    outside = without_covered(points, target, keys, seq)
    needed = points.join(outside, [order, *keys, seq], "left_anti").dropDuplicates([*keys, seq])
    total = target.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("need"))
    done = needed.agg(F.count("*").alias("got"), F.max(order).alias("at")).crossJoin(total)  # two rows of one line each
    limits = done.select(F.when(F.col("got") >= F.col("need"), F.col("at")).alias("stop"))
    stopped = groups.crossJoin(F.broadcast(limits)).where(F.col("stop").isNull() | (F.col(order) <= F.col("stop"))).drop("stop")
    return stopped.where(F.col(order) < after_transactions) if after_transactions is not None else stopped
