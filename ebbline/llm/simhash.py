"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made in one map-only pass. Different fingerprints only are then
dealt into buckets: two that differ in at most 3 bits agree in one of four blocks
of 16 bits whole, so each goes to four buckets. A bucket of over ``BUCKET``
fingerprints is dealt again by four blocks of the bits that it does not share,
until buckets are small or few bits are left; that loses no link. In a bucket the
fingerprints are sorted by Gray rank and grouped into nodes that hold the bits all
members share; pairs of nodes are descended while the differences among their
shared bits stay within the limit, and pairs that cannot differ more are linked
without a descent. A bucket gives one link for each member at most, never all pairs.

Components come from contraction rounds over written tables, with pointer doubling in
each; copies of one fingerprint are joined to its component and never paired.

``near_duplicates`` links texts whose sets of word shingles have a Jaccard similarity of
at least 0.8, so that every such pair is connected. Such texts may differ in more bits than
pigeonhole blocks can bear, so their buckets are min-hashes of the shingles: four of
them, of which such a pair shares each with the chance of its similarity. Large buckets
are dealt again by four further min-hashes. In a bucket the Gray-order index
gives the pairs within ``NEAR_BITS`` bits, of which ``FORESTS`` disjoint spanning forests of the
closest are kept; each kept pair is then compared by its exact sets of shingles, and
so is each text with the first of its very set of shingles.

That joins most groups but may miss a pair, so ``rest_links`` gives every pair that can reach the
similarity and is not connected by then. All texts order their shingles alike, those
that a sample finds frequent last; two sets of that similarity share one of their first
n - ceil(0.8 n) + 1 shingles. Holders of one of these are paired if the sizes,
the places in the order and the sketches of both sets allow the similarity: each of these
bounds holds for every pair, so none is lost. Then the exact sets decide.

Defined results: null text is empty text; texts without words have fingerprint
zero and are linked like others; a null doc_id is never the smallest; repeated rows
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BUCKET = 1000
#: Of near_duplicates: words of a shingle, least similarity, bits searched, min-hashes of a level, levels.
NEAR_SHINGLE, SIMILARITY, NEAR_BITS, MINS, LEVELS = 5, 0.8, 20, 4, 4
#: Disjoint spanning forests of close pairs that are compared exactly: up to so many pairs a text and bucket.
FORESTS = 3
#: Texts (about) whose shingles are counted for the order of rest_links, texts that make one frequent, frequent shingles held.
SAMPLE, FREQUENT, HELD = 10_000, 3, 100_000
#: Against rounding in bounds on sizes and similarities.
EPS = 1e-9
FANOUT = 8
#: Links that one task labels in the last round of components.
IN_ONE_TASK = 100_000
_FULL = (1 << 64) - 1


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle of a text with A-Z lowered, repeats included; of all its words if there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:], strict=False)], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, repeats counted; 0 without words."""
    return simhash(shingle_hashes(text, shingle, seed))


_DRAWN = np.array([xxhash.xxh64_intdigest(b"min-hash", k) for k in range(2 * MINS * LEVELS)], dtype=np.uint64)
_SHIFTS, _FACTORS = _DRAWN[: MINS * LEVELS], _DRAWN[MINS * LEVELS :] | np.uint64(1)


def min_hashes(hashes: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """MINS * LEVELS min-hashes of a set of shingle hashes; zeros without hashes."""
    least = np.full(len(_FACTORS), (1 << 64) - 1 if len(hashes) else 0, dtype=np.uint64)
    for at in range(0, len(hashes), chunk):
        mixed = hashes[at : at + chunk] ^ _SHIFTS[:, None]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _FACTORS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _FACTORS[::-1, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def jaccard(a: str, b: str, shingle: int = NEAR_SHINGLE) -> float:
    """Similarity of the sets of word shingles of two texts; texts without words are alike."""
    x, y = (np.unique(shingle_hashes(t, shingle)) for t in (a, b))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def spanning(count: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a lightest spanning forest of nodes 0 to count - 1; of equal weights the first edge."""
    rank = np.empty(len(a), dtype=np.int64)
    rank[np.argsort(weight, kind="stable")] = np.arange(len(a))
    edge_of = np.argsort(rank)
    component = np.arange(count)
    kept: list[np.ndarray] = []
    none = len(a)
    while True:
        x, y = component[a], component[b]
        open_ = x != y
        if not open_.any():
            return np.sort(edge_of[np.concatenate(kept)]) if kept else np.zeros(0, dtype=np.int64)
        a, b, rank, x, y = a[open_], b[open_], rank[open_], x[open_], y[open_]
        best = np.full(count, none, dtype=np.int64)
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        place = np.full(none, -1, dtype=np.int64)
        place[rank] = np.arange(len(rank))
        own = np.flatnonzero(best < none)
        chosen = place[best[own]]
        kept.append(np.unique(best[own]))
        to = np.arange(count)
        to[own] = np.where(x[chosen] == own, y[chosen], x[chosen])
        both = to[to] == np.arange(count)
        to = np.where(both & (np.arange(count) < to), np.arange(count), to)
        while not (to[to] == to).all():
            to = to[to]
        component = to[component]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray code: neighbours in this order differ in few bits."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index of fingerprints that are grouped into buckets and sorted by Gray rank in each.

    A node of a level covers up to FANOUT nodes below and never two buckets. It
    keeps the AND and the OR of its members: where they are equal, all members share the bit.
    """

    def __init__(self, buckets: np.ndarray, values: np.ndarray) -> None:
        """buckets: ascending group numbers; values: uint64, of one group side by side."""
        self.order = order = np.lexsort((gray_rank(values), buckets))
        self.values = values[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # and, or, first child (one more at the end)
        low = high = self.values
        owner = buckets[order]
        self.levels.append((low, high, np.arange(len(low) + 1)))
        while len(owner) and (owner[1:] == owner[:-1]).any():
            new = np.r_[True, owner[1:] != owner[:-1]]
            first = np.flatnonzero(new)
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            starts = np.flatnonzero(place % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, high, np.r_[starts, len(owner)]))
            owner = owner[starts]

    def _members(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First member and one past the last of each node."""
        start, stop = nodes, nodes + 1
        for k in range(level, 0, -1):
            children = self.levels[k][2]
            start, stop = children[start], children[stop]
        return start, stop

    def links(self, most: int, chunk: int = 20_000, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) arrays of members within ``most`` bits. All such pairs are connected by the links; only with ``every`` are they all among them."""
        top = len(self.levels) - 1
        if top < 1:
            return
        roots = np.arange(len(self.levels[top][0]))
        work = [(top, roots, roots)]
        while work:
            level, a, b = work.pop()
            if len(a) > chunk:
                work += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            low, high, _ = self.levels[level]
            known = ~((low[a] ^ high[a]) | (low[b] ^ high[b]))
            differ = np.bitwise_count((low[a] ^ low[b]) & known).astype(np.int64)
            alive = differ <= most
            if level == 0:
                alive &= a != b
                if alive.any():
                    yield a[alive], b[alive]
                continue
            sure = alive & (differ + np.bitwise_count(~known) <= (-1 if every else most))
            if sure.any():
                yield from self._all(level, a[sure], b[sure])
            rest = alive & ~sure
            if rest.any():
                work.append((level - 1, *self._children(level, a[rest], b[rest])))

    def _all(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links every member of both nodes to the first member of a."""
        for nodes in (a, b):
            start, stop = self._members(level, nodes)
            size = stop - start
            member = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
            hub = np.repeat(self._members(level, a)[0], size)
            other = member != hub
            yield hub[other], member[other]

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        children = self.levels[level][2]
        na, nb = children[a + 1] - children[a], children[b + 1] - children[b]
        size = na * nb
        pair = np.repeat(np.arange(len(a)), size)
        nth = np.arange(len(pair)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        x, y = children[a][pair] + nth // nb[pair], children[b][pair] + nth % nb[pair]
        wanted = (a != b)[pair] | (x <= y)
        return x[wanted], y[wanted]

    def closest(self, most: int, forests: int = FORESTS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) within ``most`` bits: a spanning forest of the closest ones, then one of the closest other ones, and so on.

        Chunks of pairs are merged into the forests one by one; what that drops is in none of the forests of all pairs.
        """
        a = b = np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            x, y = (np.concatenate([old, *new]) for old, new in zip((a, b), zip(*held, strict=True), strict=True))
            weight = np.bitwise_count(self.values[x] ^ self.values[y])
            rest, kept = np.arange(len(x)), []
            for _ in range(forests):
                found = spanning(len(self.values), x[rest], y[rest], weight[rest])
                kept.append(rest[found])
                rest = np.delete(rest, found)
            chosen = np.concatenate(kept)
            return x[chosen], y[chosen]

        for pair in self.links(most, every=True):
            held.append(pair)
            size += len(pair[0])
            if size > 1 << 20:
                a, b = merged()
                held, size = [], 0
        return merged() if held else (a, b)

    def forest(self, most: int) -> np.ndarray:
        """For each member, the first member of its linked set."""
        label = np.arange(len(self.values))
        for a, b in self.links(most):
            while True:
                x, y = label[a], label[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while True:
                    next_ = label[label]
                    if (next_ == label).all():
                        break
                    label = next_
        return label


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, print (the 64 bits as a signed long), in one pass without a shuffle."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream):
            made = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return common.crossed_out(documents, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, print long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _blocks(mask: int, count: int) -> list[int]:
    """The clear bits of mask in ``count`` runs of about equal size, each as a mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in free[len(free) * k // count : len(free) * (k + 1) // count]) for k in range(count)]


def bucketed(prints: DataFrame, most: int = MAX_BITS, largest: int = BUCKET) -> DataFrame:
    """Different prints -> (mask, value, print): any two within ``most`` bits share a (mask, value).

    By the pigeonhole rule most + 1 blocks suffice. Buckets over ``largest`` are dealt again by the bits outside their mask
    while at least 4 bits for each block are left; below that a bucket holds few fingerprints, as all differ.
    """
    masks = [_signed(m) for m in _blocks(0, most + 1)]
    rows = prints.select(F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"), "print").withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
    ready = None
    while True:
        rows = common.written(rows.select("mask", "value", "print"), "simhash-buckets")
        large = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("mask", "value")
        finer = {m: [_signed((m % (1 << 64)) | b) for b in _blocks(m % (1 << 64), most + 1)] for m in masks if 64 - bin(m % (1 << 64)).count("1") >= 4 * (most + 1)}
        if not finer:
            break
        large = common.written(large.where(F.col("mask").isin(list(finer))), "simhash-large")
        if large.isEmpty():
            break
        small = rows.join(large, ["mask", "value"], "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        table = F.create_map(*[x for m, parts in finer.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(p).cast("long") for p in parts]))])
        again = rows.join(large, ["mask", "value"], "left_semi")
        rows = again.select(F.explode(table[F.col("mask")]).alias("mask"), "print").withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        masks = sorted({p for parts in finer.values() for p in parts})
    return rows if ready is None else ready.unionByName(rows)


def _by_bucket(stream: Iterator[pa.RecordBatch], keys: int, rows_at_once: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Batches sorted by their first ``keys`` columns -> (number of each row's bucket, columns), whole buckets of about rows_at_once rows in all."""
    held: pa.Table | None = None
    for batch in _then_none(stream):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < rows_at_once:
                continue
        if held is None:
            return
        columns = [c.combine_chunks() for c in held.columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        new_bucket = np.zeros(held.num_rows, dtype=bool)
        new_bucket[0] = True
        for c in columns[:keys]:
            values = c.to_numpy()
            new_bucket[1:] |= values[1:] != values[:-1]
        last = held.num_rows if batch is None else int(np.flatnonzero(new_bucket)[-1])
        if last:
            yield np.cumsum(new_bucket)[:last], [c.slice(0, last) for c in columns]
            held = held.slice(last) if last < held.num_rows else None


def _then_none(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from stream
    yield None


def near_links(prints: DataFrame, most: int = MAX_BITS, largest: int = BUCKET, rows_at_once: int = 100_000) -> DataFrame:
    """Different prints -> links (a, b), a spanning forest of each bucket; their closure holds every pair within ``most`` bits."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, (_, _, prints_) in _by_bucket(stream, 2, rows_at_once):
            index = GrayIndex(buckets, np.ascontiguousarray(prints_.to_numpy()).view(np.uint64))
            label = index.forest(most)
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(index.values[label[linked]].view(np.int64)), pa.array(index.values[linked].view(np.int64))], names=["a", "b"])

    parts = common.shuffle_parts(prints.sparkSession)
    dealt = bucketed(prints, most, largest).repartition(parts, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.select("mask", "value", "print").mapInArrow(run, "a long, b long")


def _labelled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), few enough for one task -> (node, root)."""
    batches = [b for b in stream if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    kind = table.schema.field(0).type
    ends = pa.concat_arrays([*table.column(0).chunks, *table.column(1).chunks])
    names, place = np.unique(ends.to_numpy(zero_copy_only=False), return_inverse=True)
    label = np.arange(len(names))
    a, b = place[: table.num_rows], place[table.num_rows :]
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), kind), pa.array(names[label].tolist(), kind)], names=["node", "root"])


def components(links: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """links (a, b) -> node, root: every node that has links, and the smallest node of its component.

    Each round sends every node to its smallest neighbour, doubles these pointers until
    they end, and contracts the links, so chains in any order take few rounds. Once
    at most ``in_one_task`` links are left, one task labels them. Each table is written, so
    lost executors cost no earlier round.
    """
    edges = common.written(links.where("a <> b").distinct(), "links")
    kind = links.schema["a"].dataType.simpleString()
    roots = None
    while left := edges.count():
        if left <= in_one_task:
            best = common.written(edges.coalesce(1).mapInArrow(_labelled, f"node {kind}, root {kind}"), "best")
        else:
            both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
            best = common.written(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")), "best")
            while True:
                onward = best.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
                doubled = best.join(onward, "root", "left")
                doubled = common.written(doubled.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "best")
                best = doubled.drop("moved")
                if doubled.where("moved").isEmpty():
                    break
        if roots is None:
            roots = best
        else:
            step = roots.join(best.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            roots = common.written(step, "roots")
        if left <= in_one_task:
            break
        moved = edges.join(best.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(best.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = common.written(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots


def frequent_shingles(texts: DataFrame, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Hashes of the shingles that at least FREQUENT of about SAMPLE texts(node, text) hold, the rarest first: HELD at most.

    Only the lower half of all hashes is counted: the order puts the others later anyhow.
    """
    every = max(1, -(-texts.count() // SAMPLE))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream, 1 << 20):
            found = [np.unique(shingle_hashes(t or "", shingle)) for t in batch.column(0).to_pylist()]
            found = [h[: np.searchsorted(h, np.uint64(1 << 63))] for h in found]
            yield pa.RecordBatch.from_arrays([_lists(found)], names=["token"])
        common.trim_memory()

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text").mapInArrow(run, "token array<long>")
    counts = some.select(F.explode("token").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    held = counts.orderBy(F.desc("n"), "token").limit(HELD).toArrow()
    return held.column("token").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit words as lists of signed longs."""
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.uint64, copy=False).view(np.int64)))


class Prefixes:
    """The first shingles of a set, in an order that all sets share: by hash, then the frequent ones, the rarest of them first."""

    def __init__(self, frequent: np.ndarray, similarity: float) -> None:
        order = np.argsort(frequent)
        self.frequent, self.rank, self.similarity = frequent[order], order + 1, similarity

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """found: ascending hashes. Sets of at least that similarity share one of those returned; a set without shingles has a zero."""
        if not len(found):
            return np.zeros(1, dtype=np.uint64)
        keep = len(found) - int(np.ceil(self.similarity * len(found) - EPS)) + 1
        if len(self.frequent):
            place = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
            rank = np.where(self.frequent[place] == found, self.rank[place], 0)
            if rank.any():
                found = found[np.argsort(rank, kind="stable")]
        return found[:keep]


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """Bits that tell which low ends of hashes an odd number of different hashes has: two sets differ in at least as many hashes as their sketches in bits."""
    size = min(max(256, 1 << (2 * len(found)).bit_length()), 1 << 20)
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def least_difference(a: bytes, b: bytes) -> int:
    """Bits in which two odd sketches differ; the longer is folded to the size of the other."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
    if len(x) < len(y):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def sketches(texts: DataFrame, shingle: int = NEAR_SHINGLE, prefixes: Prefixes | None = None) -> DataFrame:
    """texts(node, text) -> node, h (a hash of node), print, mins (the min-hashes), and of the set of shingles: size, digest, odd (its odd sketch), prefix. One pass without a shuffle. node: text or bytes."""
    prefixes = prefixes or Prefixes(np.zeros(0, dtype=np.uint64), SIMILARITY)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream, 1 << 20):
            hashes = [shingle_hashes(t or "", shingle) for t in batch.column(2).to_pylist()]
            prints = np.array([simhash(h) for h in hashes], dtype=np.uint64).view(np.int64)
            hashes = [np.unique(h) for h in hashes]
            digests = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in hashes], dtype=np.uint64).view(np.int64)
            odd = pa.array([odd_sketch(h).tobytes() for h in hashes], pa.binary())
            columns = [batch.column(0), batch.column(1), pa.array(prints), _lists([min_hashes(h) for h in hashes])]
            columns += [pa.array([len(h) for h in hashes], pa.int64()), pa.array(digests), odd, _lists([prefixes(h) for h in hashes])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "h", "print", "mins", "size", "digest", "odd", "prefix"])
        common.trim_memory()

    columns = f"node {_kind(texts)}, h long, print long, mins array<long>, size long, digest long, odd binary, prefix array<long>"
    return texts.select("node", F.xxhash64("node").alias("h"), "text").mapInArrow(run, columns)


def _kind(texts: DataFrame) -> str:
    return texts.schema["node"].dataType.simpleString()


def min_bucketed(made: DataFrame, largest: int = BUCKET) -> DataFrame:
    """sketches -> (key, node, print): MINS buckets for each node; those of over ``largest`` nodes are dealt again, LEVELS times at most."""
    rows, ready = made.withColumn("key", F.lit(0).cast("long")), None
    for level in range(LEVELS):
        keys = F.array(*[F.xxhash64("key", F.lit(level * MINS + k), F.col("mins")[level * MINS + k]) for k in range(MINS)])
        rows = rows.select(F.explode(keys).alias("key"), "node", "print", "mins")
        if level == LEVELS - 1:
            break
        rows = common.written(rows, "near-buckets")
        large = common.written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("key"), "near-large")
        small = rows.join(large, "key", "left_anti").drop("mins")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            return ready
        rows = rows.join(large, "key", "left_semi")
    return ready.unionByName(rows.drop("mins"))


def alike_pairs(texts: DataFrame, links: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of links (a, b) between different nodes whose texts(node, text) have at least that similarity, each once; written."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x or "", y or "", shingle) for x, y in zip(a, b, strict=True)], dtype="float64")

    links = common.written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "near-links")
    # the texts of linked nodes, by a hash of the node: a small table where links are few, so that the texts need not be shuffled for it
    linked = links.select(F.xxhash64("a").alias("h")).unionByName(links.select(F.xxhash64("b").alias("h"))).distinct()
    linked = common.written(linked, "near-linked")
    held = common.written(texts.join(linked, F.xxhash64("node") == F.col("h"), "left_semi").select("node", "text"), "near-texts")
    pairs = links.join(held.select(F.col("node").alias("a"), F.col("text").alias("one")), "a").join(held.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return common.written(pairs.where(alike("one", "other") >= similarity).select("a", "b"), "near-alike")


def close_links(made: DataFrame, bits: int = NEAR_BITS, largest: int = BUCKET, rows_at_once: int = 100_000) -> DataFrame:
    """sketches -> links (a, b) that are likely alike: of each bucket of min-hashes some forests of prints within ``bits``, and all texts of one set of shingles to the first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, (_, nodes, prints_) in _by_bucket(stream, 1, rows_at_once):
            index = GrayIndex(buckets, np.ascontiguousarray(prints_.to_numpy()).view(np.uint64))
            a, b = (nodes.take(pa.array(index.order[x])) for x in index.closest(bits))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    parts = common.shuffle_parts(made.sparkSession)
    dealt = min_bucketed(made.select("node", "print", "mins"), largest).repartition(parts, "key").sortWithinPartitions("key")
    kind = _kind(made)
    same = made.groupBy("digest").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("digest", "a")
    same = made.select("digest", F.col("node").alias("b")).join(same, "digest").select("a", "b")
    return dealt.select("key", "node", "print").mapInArrow(run, f"a {kind}, b {kind}").unionByName(same)


def holder_pairs(buckets: np.ndarray, roots: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) arrays of the holders of one shingle (buckets, ascending) of different roots that may reach the similarity, if that shingle is the first both hold."""
    order = np.lexsort((size, buckets))
    first = np.r_[True, buckets[1:] != buckets[:-1]]
    bucket, size, place, roots = np.cumsum(first)[order], size[order], place[order], roots[order]
    # in a bucket by size, the partners of a row are those after it up to a size
    width = int(size.max()) + 2
    keys = bucket * width + size
    stop = np.searchsorted(keys, bucket * width + np.minimum((size / similarity + EPS).astype(np.int64), width - 1), side="right")
    count = stop - np.arange(len(keys)) - 1
    busy = np.flatnonzero(count > 0)
    ends = np.cumsum(count[busy])
    at = 0
    while at < len(busy):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + chunk, side="right")))
        some = busy[at:to]
        x = np.repeat(some, count[some])
        y = x + 1 + np.arange(len(x)) - np.repeat(ends[at:to] - count[some] - done, count[some])
        both = np.minimum(size[x] - place[x], size[y] - place[y])
        wanted = (roots[x] != roots[y]) & (both >= (size[x] + size[y]) * similarity / (1 + similarity) - EPS)
        yield order[x[wanted]], order[y[wanted]]
        at = to


#: A holder of a shingle: its hash, hashes of the text's node and of its root, the size of the set, the place of the shingle.
_HOLDER = np.dtype([("token", "<u8"), ("h", "<i8"), ("root", "<i8"), ("size", "<i4"), ("place", "<i4")])


def rest_links(made: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """sketches, and node, root of those connected -> links (a, b): all pairs of different roots of at least that similarity are among them."""
    parts = common.shuffle_parts(made.sparkSession)
    ranges = 16 * parts

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream, 1 << 20):
            h, root, size = (c.to_numpy() for c in batch.columns[:3])
            tokens, count = batch.column(3).flatten().to_numpy().view(np.uint64), batch.column(3).value_lengths().to_numpy()
            part = (tokens * _FACTORS[0] >> np.uint64(32)) % np.uint64(ranges)
            held = np.empty(len(tokens), dtype=_HOLDER)
            held["token"], held["h"], held["root"], held["size"] = tokens, np.repeat(h, count), np.repeat(root, count), np.repeat(size, count)
            held["place"] = np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count)
            order = np.argsort(part, kind="stable")
            held, part = held[order], part[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            found = [x.tobytes() for x in np.split(held, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(found, pa.binary())], names=["part", "held"])
        common.trim_memory()

    def paired(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(b"".join(blobs), dtype=_HOLDER)
        held = held[np.argsort(held["token"], kind="stable")]
        new = held["token"][1:] != held["token"][:-1]
        shared = ~(np.r_[True, new] & np.r_[new, True])
        held = held[shared]
        if not len(held):
            return
        h, columns = held["h"], (held[c].astype(np.int64) for c in ("root", "size", "place"))
        for x, y in holder_pairs(held["token"], *columns, similarity):
            pairs = np.unique(np.stack([np.minimum(h[x], h[y]), np.maximum(h[x], h[y])], axis=1), axis=0)
            for k in range(0, len(pairs), 1 << 16):
                some = pairs[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].copy()), pa.array(some[:, 1].copy())], names=["ha", "hb"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = -1, []
        for batch in stream:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if blobs:
                        yield from paired(blobs)
                    now, blobs = part, []
                blobs.append(blob)
        if blobs:
            yield from paired(blobs)
        common.trim_memory()

    @F.pandas_udf("long")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([least_difference(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    rooted = made.join(roots, "node", "left").select("h", F.xxhash64(F.coalesce("root", "node")).alias("root"), "size", "prefix")
    dealt = rooted.mapInArrow(deal, "part int, held binary").repartition(parts, "part").sortWithinPartitions("part")
    pairs = common.written(dealt.mapInArrow(run, "ha long, hb long").distinct(), "near-rest")
    for end in ("a", "b"):
        pairs = pairs.join(made.select(F.col("h").alias(f"h{end}"), F.col("node").alias(end), F.col("size").alias(f"size_{end}"), F.col("odd").alias(f"odd_{end}")), f"h{end}")
    most = (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + EPS
    return pairs.where(differ("odd_a", "odd_b") <= most).select("a", "b")


def near_duplicates(texts: DataFrame, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE, bits: int = NEAR_BITS, largest: int = BUCKET, rows_at_once: int = 100_000) -> DataFrame:
    """Different texts(node, text) -> links (a, b) of exact similarity at least ``similarity``, which connect all such pairs. node: text or bytes, unique.

    A null text is the empty text; texts without words are alike. Each bucket gives some forests, never all its pairs.
    """
    made = common.written(sketches(texts, shingle, Prefixes(frequent_shingles(texts, shingle), similarity)), "near-sketches")
    close = alike_pairs(texts, close_links(made, bits, largest, rows_at_once), similarity, shingle)
    rest = alike_pairs(texts, rest_links(made, components(close), similarity), similarity, shingle)
    return close.unionByName(rest)


def near_groups(documents: DataFrame, most: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """documents -> doc_id, print, component_id: the smallest doc_id that links reach."""
    made = common.written(fingerprints(documents, shingle), "prints")
    kinds = common.written(made.groupBy("print").agg(F.min("doc_id").alias("smallest")), "kinds")
    roots = components(near_links(kinds.select("print"), most))
    member = kinds.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "smallest", F.coalesce("root", "print").alias("root"))
    member = common.written(member, "members")
    named = common.written(member.groupBy("root").agg(F.min("smallest").alias("component_id")), "named")
    named = member.join(named, "root").select("print", "component_id")
    return made.join(named, "print").select("doc_id", "print", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(common.table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
