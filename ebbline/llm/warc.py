"""WARC records, files of them, and a Merkle fixity audit of archive replicas.

Each archive is cut into segments of ``SEGMENT`` record numbers. Inside a segment the
records stand in order, and a leaf hashes a record's offset, length and digest; a
node hashes its ``FANOUT`` children, so it stands for an ordered range of offsets.
Above, a node hashes the up to ``SPREAD`` segments, or nodes, of one range of numbers, on to
one root for the archive; as many levels as the numbers' range needs, so sparse numbers
give no node more children. Every level is made once from the one below and written. The
audit compares roots and then, level by level, reads only the children of nodes that
differ; records are compared where a lowest node differs, and nothing is read below
nodes that agree. All of it is DataFrame work on digests: the bodies are read once and
never shuffled, and no step gathers more than one node's children.

Defined results: null url or body is the empty one; a null record number is put into
one of ``SEGMENT`` segments of its own by its digest; records of one number are
told apart by their order; an empty archive has no nodes; other columns are ignored.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEGMENT = 1024
FANOUT = 16
#: Segments, or nodes of them, under a node above.
SPREAD = 64

#: Damage planted into the audited replica of the query: one character changed, and records left out.
ALTERED, MISSING = (97, 5), (50021, 7)


def record_text(number: Column, url: Column, body: Column) -> Column:
    """A response record of WARC 1.1 as text."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(records: DataFrame, number: str, record: str) -> DataFrame:
    """records(number, record) -> leaves: segment, place, number, nth, offset, length, digest. One narrow shuffle by segment."""
    found = records.select(F.col(f"`{number}`").cast("long").alias("number"), F.octet_length(F.col(f"`{record}`")).cast("long").alias("length"), F.sha2(F.col(f"`{record}`").cast("binary"), 256).alias("digest"))
    strays = -1 - F.pmod(F.xxhash64("digest"), F.lit(SEGMENT))
    segment = F.coalesce(F.shiftright("number", SEGMENT.bit_length() - 1), strays).cast("long")
    order = Window.partitionBy("segment").orderBy("number", "digest")
    alike = Window.partitionBy("segment", "number").orderBy("digest")
    return (
        found.withColumn("segment", segment)
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("nth", F.row_number().over(alike) - 1)
        .select("segment", "place", "number", "nth", "offset", "length", "digest")
    )


def _node(rows: DataFrame, keys: list[Column], child: str, hash_: Column) -> DataFrame:
    """Groups children under their parents: the hash of the parent is that of its children's hashes in order."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(child).alias("c"), hash_.alias("h")))).alias("kids"))
    return listed.select(*[c for c in listed.columns if c != "kids"], F.sha2(F.concat_ws(",", F.transform("kids", lambda k: k["h"])).cast("binary"), 256).alias("hash"))


def levels_over(leaves: list[DataFrame]) -> tuple[int, int, int]:
    """(levels within a segment, levels above, smallest segment) that one root over each of the archives needs. The driver sees one row."""
    both = leaves[0].select("segment", "place")
    for more in leaves[1:]:
        both = both.unionByName(more.select("segment", "place"))
    row = both.agg(F.min("segment"), F.max("segment"), F.max("place")).first()
    if row[0] is None:
        return 1, 0, 0
    inner = upper = 1
    while (row[2] // FANOUT**inner) > 0:
        inner += 1
    upper = 0
    while ((row[1] - row[0]) // SPREAD**upper) > 0:
        upper += 1
    return inner, upper, row[0]


def _above(level: int, inner: int, first: int) -> tuple[Column, Column]:
    """(segment, node) of the parent of a node of this level (-1: a leaf, whose node is its place)."""
    if level < inner - 1:
        return F.col("segment"), F.floor(F.col("node") / FANOUT).cast("long")
    over = F.col("segment") - first if level == inner - 1 else F.col("segment")
    return F.floor(over / SPREAD).cast("long"), F.lit(0).cast("long")


def tree(leaves: DataFrame, inner: int, upper: int, first: int) -> list[DataFrame]:
    """Levels (segment, node, hash) from the lowest nodes to the archive's root, each written.

    Levels within a segment number their nodes in it; above, segment is the number of a range of segments and node is 0.
    """
    leaf = F.sha2(F.concat_ws(":", F.col("offset"), F.col("length"), F.col("digest")).cast("binary"), 256)
    rows = leaves.select("segment", F.col("place").cast("long").alias("node"), leaf.alias("hash"))
    levels: list[DataFrame] = []
    for level in range(-1, inner + upper - 1):
        segment, node = _above(level, inner, first)
        child = "node" if level < inner - 1 else "segment"
        below = rows.select(F.col(child).alias("child"), "hash", segment.alias("up"), node.alias("over"))
        made = _node(below, [F.col("up").alias("segment"), F.col("over").alias("node")], "child", F.col("hash"))
        rows = common.written(made, "nodes")
        levels.append(rows)
    return levels


def audit(kept: DataFrame, held: DataFrame) -> DataFrame:
    """Leaves of the archive as it should be, and as a replica holds it -> records that differ.

    Columns: number, nth, segment, offset, length, digest (as they should be), found_offset, found_digest, status: altered,
    moved (same bytes elsewhere), missing or extra.
    """
    kept, held = common.written(kept, "leaves"), common.written(held, "leaves")
    inner, upper, start = levels_over([kept, held])
    ours, theirs = tree(kept, inner, upper, start), tree(held, inner, upper, start)
    bad = None
    for level in range(len(ours) - 1, -1, -1):
        pair = []
        for nodes in (ours[level], theirs[level]):
            if bad is not None:
                segment, node = _above(level, inner, start)
                nodes = nodes.withColumn("up", segment).withColumn("over", node).join(bad, ["up", "over"], "left_semi").drop("up", "over")
            pair.append(nodes)
        differ = pair[0].join(pair[1].withColumnRenamed("hash", "found"), ["segment", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("found")))
        bad = common.written(differ.select(F.col("segment").alias("up"), F.col("node").alias("over")), "differ")
        if bad.isEmpty():
            break
    lowest = bad.select(F.col("up").alias("segment"), F.col("over").alias("node"))
    sides = [leaves.withColumn("node", F.floor(F.col("place") / FANOUT)).join(lowest, ["segment", "node"], "left_semi").drop("node", "place") for leaves in (kept, held)]
    found = sides[1].select("segment", F.col("number").alias("n2"), F.col("nth").alias("nth2"), F.col("offset").alias("found_offset"), F.col("length").alias("found_length"), F.col("digest").alias("found_digest"))
    a = sides[0].alias("a")
    joined = a.join(found.withColumnRenamed("segment", "s2"), F.col("segment").eqNullSafe(F.col("s2")) & F.col("number").eqNullSafe(F.col("n2")) & (F.col("nth") == F.col("nth2")), "full")
    status = F.when(F.col("nth").isNull(), "extra").when(F.col("nth2").isNull(), "missing").when(F.col("digest") != F.col("found_digest"), "altered").when(F.col("offset") != F.col("found_offset"), "moved")
    return joined.select(F.coalesce("number", "n2").alias("number"), F.coalesce("nth", "nth2").alias("nth"), F.coalesce("segment", "s2").alias("segment"), "offset", "length", "digest", "found_offset", "found_digest", status.alias("status")).where("status IS NOT NULL")


def page_records(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("number"), record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: some pages with another first character, some left out."""
    body = F.coalesce(F.col("html"), F.lit(""))
    changed = F.when(F.col("page_id") % ALTERED[0] == ALTERED[1], F.concat(F.lit("X"), F.expr("substring(coalesce(html, ''), 2)"))).otherwise(body)
    there = F.coalesce(F.col("page_id") % MISSING[0] != MISSING[1], F.lit(True))
    return pages.where(there).select("page_id", "url", changed.alias("html"))


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    found = audit(archive(page_records(pages), "number", "record"), archive(page_records(damaged_copy(pages)), "number", "record"))
    return found.select(F.col("number").alias("page_id"), "segment", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("digest").alias("expected_sha256"), "found_offset", "found_digest", "status").withColumnRenamed("found_digest", "found_sha256")


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10)"
_LEAVES = f"SELECT page_id, page_id // {SEGMENT} AS segment, strlen(rec) AS len, sha256(rec) AS sha, coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // {SEGMENT} ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT page_id, {_RECORD} AS rec FROM ("
AUDIT_SQL = f"""
WITH a AS ({_LEAVES} SELECT page_id, url, coalesce(html, '') AS body FROM pages))),
b AS ({_LEAVES} SELECT page_id, url, CASE WHEN page_id % {ALTERED[0]} = {ALTERED[1]} THEN 'X' || substring(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS body FROM pages WHERE page_id % {MISSING[0]} <> {MISSING[1]})))
SELECT a.page_id AS page_id, CAST(a.segment AS BIGINT) AS segment, CAST(a.off AS BIGINT) AS record_offset, CAST(a.len AS BIGINT) AS record_length, a.sha AS expected_sha256,
       CAST(b.off AS BIGINT) AS found_offset, b.sha AS found_sha256,
       CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.sha <> b.sha THEN 'altered' ELSE 'moved' END AS status
FROM a LEFT JOIN b ON a.page_id = b.page_id
WHERE b.page_id IS NULL OR a.sha <> b.sha OR a.off <> b.off
"""


# files ----------------------------------------------------------------------


class _Source:
    """Bytes of a file, plain or a chain of gzip members, read in order; knows where the record now read begins in the file."""

    def __init__(self, data: bytes, most: int) -> None:
        self.data, self.at, self.most = memoryview(data), 0, most
        self.zipped = data[:2] == b"\x1f\x8b"
        self.held, self.begin, self.mark = bytearray(), 0, 0
        self.inflate = None

    def more(self) -> bool:
        """Takes some more bytes; False at the end."""
        if not self.zipped:
            part = self.data[self.at : self.at + (1 << 20)]
            self.held += part
            self.at += len(part)
            return bool(len(part))
        while True:
            if self.inflate is None:
                if self.at >= len(self.data):
                    return False
                self.inflate = zlib.decompressobj(31)
                if not self.held:
                    self.mark = self.at
            part = self.data[self.at : self.at + (1 << 16)]
            out = self.inflate.decompress(bytes(part), 1 << 22)
            rest = self.inflate.unused_data or self.inflate.unconsumed_tail
            self.at += len(part) - len(rest)
            if self.inflate.eof:
                self.inflate = None
            elif not part and not out:
                raise ValueError("truncated gzip member")
            if out:
                self.held += out
                if len(self.held) > self.most:
                    raise ValueError(f"record of more than {self.most} bytes")
                return True

    def until(self, size: int) -> bool:
        while len(self.held) < size:
            if not self.more():
                return False
        return True

    def next(self, size: int) -> bytes:
        """The next size bytes; what follows is a new record."""
        out = bytes(self.held[:size])
        del self.held[:size]
        self.begin += size
        if self.zipped and not self.held:
            self.mark = self.at
        return out


#: Bytes of one record at most.
MAX_RECORD = 1 << 30


def parse_warc(data: bytes, most: int = MAX_RECORD) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers with lower-case names, whole record) of each record of a file, plain or gzipped record by record; ValueError where it is broken.

    The offset in a gzipped file is that of the record's member; the length is that of the plain record.
    """
    source = _Source(data, most)
    try:
        while source.until(1):
            at = source.mark if source.zipped else source.begin
            head = source.held.find(b"\r\n\r\n")
            while head < 0 and len(source.held) < 1 << 20 and source.more():
                head = source.held.find(b"\r\n\r\n")
            if head < 0 or not source.held.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at {at}")
            lines = source.held[:head].decode("utf-8", "replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else -1
            end = head + 4 + size + 4
            if size < 0 or end > most or not source.until(end) or source.held[end - 4 : end] != b"\r\n\r\n":
                raise ValueError(f"broken WARC record at {at}")
            yield at, end, headers, source.next(end)
    except zlib.error as e:
        raise ValueError(f"broken gzip member at {source.mark}") from e


def read_warc(spark: SparkSession, path: str, most: int = MAX_RECORD) -> DataFrame:
    """WARC files, plain or gzipped -> path, offset, length, type, record_id, target_uri, record (its bytes), error.

    A task holds one file and gives its records some at a time; a broken file gives its records up to the break and one row with the error.
    """
    names = ["path", "offset", "length", "type", "record_id", "target_uri", "record", "error"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in stream:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for at, length, headers, record in parse_warc(data.as_py(), most):
                        rows.append((name, at, length, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), record, None))
                        size += length
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append((name, None, None, None, None, None, None, str(e)))
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset long, length long, type string, record_id string, target_uri string, record binary, error string")


def write_warc(records: DataFrame, folder: str, number: str = "number", record: str = "record", zipped: bool = True, most: int = 256 << 20) -> DataFrame:
    """records(number, record) -> files of whole records below folder; returns (file, records, bytes) as a written table.

    Records are dealt and ordered by number; a file has at most ``most`` bytes before zipping, or one longer record. Each record is a gzip member of its own.
    """
    suffix = ".warc.gz" if zipped else ".warc"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size, file_no = TaskContext.get().partitionId(), 0, 0, 0
        held: list[bytes] = []
        done: list[tuple] = []

        def flush() -> None:
            nonlocal held, count, size, file_no
            if held:
                name = f"part-{part:06d}-{file_no:06d}{suffix}"
                common.put_file(f"{folder}/{name}", b"".join(held))
                done.append((name, count, sum(map(len, held))))
                held, count, size, file_no = [], 0, 0, file_no + 1

        for batch in common.batches(stream):
            for raw in batch.column(0).to_pylist():
                if held and size + len(raw) > most:
                    flush()
                held.append(gzip.compress(raw, mtime=0) if zipped else raw)
                count, size = count + 1, size + len(raw)
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    laid = records.select(F.col(f"`{number}`").alias("n"), F.col(f"`{record}`").cast("binary").alias("r")).where("r IS NOT NULL").repartitionByRange(common.shuffle_parts(records.sparkSession), "n").sortWithinPartitions("n", "r")
    return common.written(laid.select("r").mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")
