"""Lempel-Ziv phrase fingerprints: the set of phrases of a document's incremental
(LZ78) parse, kept as the K smallest hashes; two fingerprints estimate the
Jaccard similarity of the phrase sets, which follows how well one text helps to
compress the other.

The parse reads code points and works on whole texts. Fingerprints are a map-only
step; comparing each document with the next one by id takes one shuffle of the texts.

Defined results: null text is empty text; the empty text has the empty
fingerprint, which is like itself (1) and unlike all others (0); equal texts have
equal fingerprints; a table of one document has itself as the next one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, ordered

#: Hashes that a fingerprint keeps at most.
K = 128

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, as far as a text has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            ones = np.ones(size, dtype=np.uint64)
            ones[1:] = np.uint64(_BASE)
            self.up = np.multiply.accumulate(ones)
            ones[1:] = np.uint64(_INVERSE)
            self.down = np.multiply.accumulate(ones)


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def parse(text: str, at: int, seen: set[str], ends: list[int]) -> int:
    """Incremental parse from ``at``: each phrase is the shortest substring not in seen.

    Adds phrases to seen and their ends to ends. Returns where the unfinished last
    phrase (one that seen holds, or nothing) begins.
    """
    add, put = seen.add, ends.append
    for end in range(at + 1, len(text) + 1):
        word = text[at:end]
        if word not in seen:
            add(word)
            put(end)
            at = end
    return at


def phrase_hashes(text: str, at: int, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that begin at ``at`` and stop at ends: prefix sums of a polynomial, so no phrase is rebuilt."""
    if not ends:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(text[at : ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    _POWERS.reach(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_mix(codes + np.uint64(_BASE)) * _POWERS.up[: len(codes)], out=sums[1:])
    stop = np.array(ends, dtype=np.int64) - at
    start = np.concatenate([[0], stop[:-1]])
    return (_mix((sums[stop] - sums[start]) * _POWERS.down[start] + (stop - start).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes)[:k]


def fingerprint(text: str, k: int = K) -> np.ndarray:
    """The k smallest distinct phrase hashes of text, ascending."""
    ends: list[int] = []
    parse(text, 0, set(), ends)
    return smallest(phrase_hashes(text, 0, ends), k)


def fingerprint_pair(text: str, keep: int, tail: str, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of text and of text[:keep] + tail; their common prefix is parsed once."""
    seen: set[str] = set()
    ends: list[int] = []
    at = parse(text[:keep], 0, seen, ends)
    shared = phrase_hashes(text, 0, ends)
    mine: list[int] = []
    parse(text, at, seen, mine)
    seen.difference_update([text[i:j] for i, j in zip([at, *mine], mine, strict=False)])
    theirs: list[int] = []
    edited = text[at:keep] + tail
    parse(edited, 0, seen, theirs)
    return (
        smallest(np.concatenate([shared, phrase_hashes(text, at, mine)]), k),
        smallest(np.concatenate([shared, phrase_hashes(edited, 0, theirs)]), k),
    )


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two phrase sets; exact where both have at most k phrases."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u4").astype(np.uint32)


def fingerprints(documents: DataFrame, column: str = "text", k: int = K) -> DataFrame:
    """documents with a column ``fingerprint`` (hexadecimal) more, without a shuffle."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: as_text(fingerprint(t or "", k)))

    return documents.withColumn("fingerprint", of(F.col(column)))


def edited_fingerprints(documents: DataFrame, k: int = K) -> DataFrame:
    """Each document against its edited text (its last quarter replaced by the start of the next document) and the next document."""
    rows, _ = ordered.by_doc_id(documents, edges=True)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, key, text
        waiting: tuple | None = None  # a finished row without near_next, and its fingerprint
        out: list[tuple] = []

        def close(print_: np.ndarray) -> None:
            row, own = waiting
            out.append((*row, likeness(own, print_, k)))

        for batch in common.batches(stream):
            for part, edge, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == part:
                    mine = held[2]
                    keep = len(mine) - len(mine) // 4
                    tail = text[: len(mine) // 4]
                    own, edited = fingerprint_pair(mine, keep, tail, k)
                    if waiting is not None:
                        close(own)
                    row = (held[1], len(mine), hashlib.sha256((mine[:keep] + tail).encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(edited), likeness(own, edited, k))
                    waiting = (row, own)
                if not edge:
                    held = (part, key, text)
                elif held is not None and held[0] == part:
                    close(fingerprint(text, k))
                    held = waiting = None
            if len(out) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    made = rows.mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.select(ordered.doc_id_of().alias("doc_id"), *names[1:])


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
