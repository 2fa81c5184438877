"""Best-fit packing of documents into fixed-length sequences after Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is its histogram of
lengths: at most ``limit`` numbers, whatever the size of the corpus. The driver
fixes dominating sets on the histogram, packs the rest by best fit decreasing, and
gets a table of slots whose size depends on limit only. Each piece takes the slot
of its rank among the pieces of its length; ranks are local counts plus one base
for each (partition, length), so no length is gathered in one task.

Defined results: null text is empty text (the end id alone); a null or repeated
doc_id is a document like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, words

LIMIT = 4096


@dataclass(frozen=True)
class Group:
    """``bins`` sequences with the same content: (length, copies) in order from offset 0."""

    bins: int
    content: tuple[tuple[int, int], ...]


def reduce_dominated(counts: np.ndarray, limit: int) -> list[Group]:
    """Martello-Toth reduction on a histogram (changed in place): bins fixed for good.

    For the longest length w with r = limit - w left, the set {w, k}, k the longest
    piece that fits, dominates every other set with w if nothing else fits with w, or
    k = r, or no two pieces fit together, or no three do and every two that do are no
    longer than k. Then as many bins {w, k} as there are pairs are fixed at once.
    """
    fixed: list[Group] = []
    changed = True
    while changed:
        changed = False
        w = limit
        while w > 0:
            if not counts[w]:
                w -= 1
                continue
            partner = _dominating(counts, w, limit)
            if partner is None:
                w -= 1
                continue
            if partner == 0:
                bins, content = int(counts[w]), ((w, 1),)
                counts[w] = 0
            elif partner == w:
                bins, content = int(counts[w]) // 2, ((w, 2),)
                counts[w] -= 2 * bins
            else:
                bins, content = int(min(counts[w], counts[partner])), ((w, 1), (partner, 1))
                counts[w] -= bins
                counts[partner] -= bins
            fixed.append(Group(bins, content))
            changed = True
    return fixed


def _dominating(counts: np.ndarray, w: int, limit: int) -> int | None:
    """The partner of w in a dominating set; 0: w alone; None: no set is known to dominate."""
    rest = limit - w
    counts[w] -= 1
    try:
        fits = np.flatnonzero(counts[: rest + 1])
        if not len(fits):
            return 0
        longest = int(fits[-1])
        if longest == rest:
            return longest
        small = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
        if len(small) < 2 or small[0] + small[1] > rest:
            return longest
        if len(small) == 3 and small.sum() <= rest:
            return None
        # the longest two that fit together: for each a, the longest b <= rest - a (twice the same only if there are two)
        at = np.searchsorted(fits, rest - fits, side="right") - 1
        same = (at >= 0) & (fits[at] == fits) & (counts[fits] < 2)
        at = at - same
        sums = np.where(at >= 0, fits + fits[at], 0)
        return longest if int(sums.max()) <= longest else None
    finally:
        counts[w] += 1


def best_fit(counts: np.ndarray, limit: int) -> list[Group]:
    """Best fit decreasing on a histogram: the bins of equal content are handled at once."""
    open_bins: dict[int, list[Group]] = defaultdict(list)
    room = np.zeros(limit + 1, dtype=bool)
    done: list[Group] = []

    def keep(group: Group, left: int) -> None:
        if left:
            open_bins[left].append(group)
            room[left] = True
        else:
            done.append(group)

    for length in range(limit, 0, -1):
        pieces = int(counts[length])
        while pieces:
            places = np.flatnonzero(room[length:])
            if len(places):
                left = length + int(places[0])
                group = open_bins[left].pop()
                if not open_bins[left]:
                    room[left] = False
            else:
                left, group = limit, Group(pieces, ())
            each = left // length
            full = min(group.bins, pieces // each)
            if full:
                keep(Group(full, (*group.content, (length, each))), left - each * length)
                pieces -= full * each
            others = group.bins - full
            if others and pieces and pieces < each:
                keep(Group(1, (*group.content, (length, pieces))), left - pieces * length)
                pieces, others = 0, others - 1
            if others and group.content:
                keep(Group(others, group.content), left)
    for groups in open_bins.values():
        done += groups
    return done


def pack(counts: np.ndarray, limit: int = LIMIT) -> list[Group]:
    """counts[l] pieces of length l -> groups of equal sequences that hold them all."""
    rest = np.array(counts, dtype=np.int64)
    return reduce_dominated(rest, limit) + best_fit(rest, limit)


def lower_bound(counts: np.ndarray, limit: int = LIMIT) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    counts = np.asarray(counts, dtype=np.int64)
    lengths = np.arange(limit + 1)
    n, total = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(total[-1]) // limit)
    for k in range(limit // 2 + 1):
        above = int(n[-1] - n[limit - k])
        middle = int(n[limit - k] - n[limit // 2])
        weight = int(total[limit // 2] - (total[k - 1] if k else 0))
        free = middle * limit - int(total[limit - k] - total[limit // 2])
        best = max(best, above + middle + max(0, -(-(weight - free) // limit)))
    return best


class Slots:
    """(length, rank among the pieces of that length) -> (sequence, offset)."""

    def __init__(self, groups: list[Group]) -> None:
        rows, taken, first = [], defaultdict(int), 0
        for group in groups:
            offset = 0
            for length, copies in group.content:
                rows.append((length, taken[length], first, offset, copies))
                taken[length] += group.bins * copies
                offset += length * copies
            first += group.bins
        rows.sort()
        self.bins = first
        self.table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.keys = self.table[:, 0] << 46 | self.table[:, 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.keys, length << 46 | rank, side="right") - 1]
        nth = rank - row[:, 1]
        return row[:, 2] + nth // row[:, 4], row[:, 3] + nth % row[:, 4] * length


def tokenised_pieces(documents: DataFrame, tokenizer_path: str, end_id: int, limit: int = LIMIT) -> DataFrame:
    """documents(doc_id, text) -> doc_id, piece, start, length, ids_crc32, and part and rank_in_part for the ranks. No shuffle."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words.word_encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in common.batches(stream, 4 << 20):
            rows, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, encoded in enumerate(coder.encode_many([t or "" for t in batch.column(1).to_pylist()])):
                data = encoded + end
                for p in range(-(-len(data) // (4 * limit))):
                    cut = data[4 * limit * p : 4 * limit * (p + 1)]
                    size = len(cut) // 4
                    rows.append(i)
                    piece.append(p)
                    start.append(p * limit)
                    length.append(size)
                    crc.append(zlib.crc32(cut))
                    rank.append(seen[size])
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())], names=names
            )
        coder.release()

    return common.crossed_out(documents, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long")


def place_pieces(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A written table of tokenised_pieces -> the same pieces with sequence_id and offset."""
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counted = common.written(counted, "piece-counts")
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots = Slots(pack(histogram, limit))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # bases has a row for each length in each part and grows with the parts, so it is never broadcast
    ranked = pieces.join(bases.hint("merge"), ["part", "length"])
    placed = ranked.withColumn("at", place("length", F.col("base") + F.col("rank_in_part")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = LIMIT) -> DataFrame:
    return place_pieces(common.written(tokenised_pieces(documents, tokenizer_path, end_id, limit), "pieces"), limit)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
