"""Binary token-id files: one concatenated id array, document boundaries and doc_ids in Elias-Fano code.

A file begins with a fixed header, then the Elias-Fano sequences of boundaries and
of doc_ids, then the ids (16 bits each where the vocabulary allows it, else 32).
``EliasFano.select(i)`` gives one boundary from a sample stored in the file and one
short scan, ``EliasFano.run`` those of some neighbours; a table of 64-bit offsets is
neither stored nor built.

Writers hold one range of doc_ids each, cut files at ``MAX_IDS`` ids (a longer
document has a file of its own) and put them whole into the shared folder, so a
retried task leaves the same files. The driver sees one total for each range.

Defined results: null text is empty text (the end id alone); a null doc_id is the
smallest; equal doc_ids keep a place each; other columns are ignored.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ordered, words

MAX_IDS = 1 << 22
SAMPLE = 256
MAGIC = b"EFTOKID2"
_HEADER = struct.Struct("<8sIIQQQQ")  # magic, bytes of an id, part, ids of the part before this file, documents, ids, bytes of the first sequence


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values, about 2 + log2(range / length) bits each.

    The upper bits stand in unary, the lower ones packed. The place of every ``SAMPLE``-th
    one among the upper bits is kept with the sequence, so that ``select`` finds a
    value by one sample and a short count of ones, and ``run`` some neighbours alike.
    """

    def __init__(self, count: int, first: int, low_bits: int, samples: np.ndarray, low: bytes, high: bytes) -> None:
        self.count, self.first, self.low_bits, self.samples, self.low, self.high = count, first, low_bits, samples, low, high

    @classmethod
    def of(cls, values: np.ndarray, first: int | None = None, chunk: int = 1 << 16) -> EliasFano:
        """values ascending (int64 or uint64); first is taken off each (the smallest, if not given). A chunk (a multiple of 8) is packed at a time."""
        count = len(values)
        first = (int(values[0]) if count else 0) if first is None else first
        base = np.uint64(first % (1 << 64))
        top = int((values[-1:].astype(np.uint64) - base)[0]) if count else 0
        low_bits = max(0, (top // count).bit_length() - 1) if count else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        bits = np.zeros((top >> low_bits) + count if count else 0, dtype=np.uint8)
        low, samples = [], []
        for at in range(0, count, chunk):
            offsets = values[at : at + chunk].astype(np.uint64) - base
            ones = (offsets >> np.uint64(low_bits)).astype(np.int64) + np.arange(at, at + len(offsets))
            bits[ones] = 1
            samples.append(ones[(-at) % SAMPLE :: SAMPLE].astype(np.uint64))
            if low_bits:
                low.append(np.packbits(((offsets[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes())
        return cls(count, first, low_bits, np.concatenate(samples) if samples else np.zeros(0, dtype=np.uint64), b"".join(low), np.packbits(bits, bitorder="little").tobytes())

    def tobytes(self) -> bytes:
        return struct.pack("<QqIQQQ", self.count, self.first, self.low_bits, len(self.samples), len(self.low), len(self.high)) + self.samples.astype("<u8").tobytes() + self.low + self.high

    @classmethod
    def frombytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        count, first, low_bits, n_samples, n_low, n_high = struct.unpack_from("<QqIQQQ", data, at)
        at += 44
        samples = np.frombuffer(data, dtype="<u8", count=n_samples, offset=at)
        at += 8 * n_samples
        return cls(count, first, low_bits, samples, data[at : at + n_low], data[at + n_low : at + n_low + n_high]), at + n_low + n_high

    def run(self, begin: int, end: int) -> np.ndarray:
        """Values begin to end - 1 as int64: from the sample before the first, only the bytes that hold them are read."""
        begin, end = max(begin, 0), min(end, self.count)
        if begin >= end:
            return np.zeros(0, dtype=np.int64)
        sample = begin // SAMPLE
        byte = int(self.samples[sample]) >> 3
        stop = -(-end // SAMPLE)
        last = (int(self.samples[stop]) >> 3) + 1 if stop < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8, count=last - byte, offset=byte), bitorder="little")) + 8 * byte
        ones = ones[int(np.searchsorted(ones, int(self.samples[sample]))) + begin - sample * SAMPLE :][: end - begin]
        values = (ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start = begin * self.low_bits
            span = np.frombuffer(self.low, dtype=np.uint8, count=((end * self.low_bits + 7) >> 3) - (start >> 3), offset=start >> 3)
            low = np.unpackbits(span, bitorder="little")[start & 7 :][: (end - begin) * self.low_bits].reshape(-1, self.low_bits)
            for k in range(self.low_bits):
                values |= low[:, k].astype(np.uint64) << np.uint64(k)
        return (values + np.uint64(self.first % (1 << 64))).astype(np.int64)

    def select(self, i: int) -> int:
        """Value i: from the sampled place, count ones byte by byte; then its low bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        rest = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := rest.bit_count()) <= left:
            left -= ones
            byte += 1
            rest = self.high[byte]
        for _ in range(left):
            rest &= rest - 1
        place = byte * 8 + (rest & -rest).bit_length() - 1
        low, start = 0, i * self.low_bits
        if self.low_bits:
            span = self.low[start >> 3 : (start + self.low_bits + 7) >> 3]
            low = int.from_bytes(span, "little") >> (start & 7) & ((1 << self.low_bits) - 1)
        value = ((place - i) << self.low_bits | low) + self.first
        return (value + (1 << 63)) % (1 << 64) - (1 << 63)


def pack_file(part: int, before: int, keys: list[int], ids: list[bytes], width: int) -> bytes:
    """One file of documents in order; ids as little-endian unsigned 32-bit."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    array = np.frombuffer(b"".join(ids), dtype="<u4")
    head = EliasFano.of(ends, 0).tobytes() + EliasFano.of(np.array(keys, dtype=np.int64)).tobytes()
    return _HEADER.pack(MAGIC, width, part, before, len(keys), len(array), len(head)) + head + array.astype("<u2" if width == 2 else "<u4").tobytes()


class TokenFile:
    """A file read back: document(i) gives its ids without reading the others' boundaries."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.part, self.before, self.documents, self.total, size = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token-id file")
        self.bounds, at = EliasFano.frombytes(data, _HEADER.size)
        self.keys, _ = EliasFano.frombytes(data, at)
        self.ids = np.frombuffer(data, dtype="<u2" if self.width == 2 else "<u4", offset=_HEADER.size + size, count=self.total)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)].astype("<u4")


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int, folder: str, max_ids: int = MAX_IDS) -> DataFrame:
    """Writes the files below folder; returns the manifest (part, file, n_docs, n_ids) as a written table."""
    rows, _ = ordered.by_doc_id(documents)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words.word_encoder(tokenizer_path)
        width = 2 if max(coder.vocabulary_size, end_id + 1) <= 1 << 16 else 4
        part, before, number, size = None, 0, 0, 0
        keys: list[int] = []
        ids: list[bytes] = []
        made: list[tuple] = []

        def flush() -> None:
            nonlocal keys, ids, size, number, before
            if keys:
                name = f"part-{part:06d}-{number:06d}.eft"
                common.put_file(f"{folder}/{name}", pack_file(part, before, keys, ids, width))
                made.append((part, name, len(keys), size))
                number, before = number + 1, before + size
            keys, ids, size = [], [], 0

        for batch in common.batches(stream, 4 << 20):
            parts_, _, keys_, texts = batch.columns
            for p, key, encoded in zip(parts_.to_pylist(), keys_.to_pylist(), coder.encode_many(texts.to_pylist()), strict=True):
                if p != part:
                    flush()
                    part, before, number = p, 0, 0
                data = encoded + end
                if keys and size + len(data) // 4 > max_ids:
                    flush()
                keys.append(key)
                ids.append(data)
                size += len(data) // 4
        flush()
        coder.release()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "n_docs", "n_ids"])

    return common.written(rows.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def _part_bases(manifest: DataFrame) -> dict[int, int]:
    """part -> ids of the parts before it. The driver sees one row a part."""
    bases, base = {}, 0
    for r in sorted(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        bases[r["part"]], base = base, base + r["n"]
    return bases


def _read(spark: SparkSession, folder: str, manifest: DataFrame, last: str, of: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ``of`` each document's ids, read from the files."""
    bases = _part_bases(manifest)
    names = ["key", "start", "n_tokens", last]
    sql = {pa.binary(): "binary", pa.int64(): "long"}[kind]
    if not bases:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {last} {sql}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for data in batch.column(0):
                file = TokenFile(data.as_py())
                first = bases[file.part] + file.before
                for at in range(0, file.documents, 1024):
                    to = min(at + 1024, file.documents)
                    cuts = file.bounds.run(at, to + 1)
                    got = [of(file.ids[a:b]) for a, b in itertools.pairwise(cuts.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(file.keys.run(at, to)), pa.array(first + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(got, kind)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(folder).select("content")
    return files.mapInArrow(run, f"key long, start long, n_tokens long, {last} {sql}").select(ordered.doc_id_of().alias("doc_id"), *names[1:])


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    return _read(spark, folder, manifest, "ids", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def token_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32; the ids stay where the file is read."""
    return _read(spark, folder, manifest, "ids_crc32", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark, "token-ids")
    manifest = write_token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return token_digests(spark, folder, manifest)
