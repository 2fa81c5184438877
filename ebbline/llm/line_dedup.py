"""Line dedup by pairwise alignment: a later document loses the blocks that it shares with an earlier one.

A document is read as lines, and a line is cut further at every sentence end: after
one of ``ENDS`` with up to two closing quotes or brackets where white space follows, and
after one of ``WIDE_ENDS`` with or without it. The cuts depend on the text around
them alone, so a passage inside a long line is cut alike in every document. Each such
piece is a line in what follows; pieces without words are passed over.

Each line gives the shortest run of ``MIN_WORDS`` words that starts with it and the
shortest that ends with it (``windows``); long lines are runs by themselves. The hash of
a run is what documents are linked by: a document makes a pair with the first document
that holds one of its runs, so it has at most one pair for each run, and no pairs
are made among the holders of a frequent one. Any block of enough words that stands in
two documents begins and ends with such runs and is covered by them, so the pairs of
a document hold between them every block that it shares with any earlier one.

Each pair is aligned by patience diff (``align``): the shared runs that the fewest rows
hold are put in order first, the others between them. What the alignment leaves out
because it stands in another order, moved or repeated, is put into further increasing
chains (``chains``). Runs that adjoin in both documents are one block (``aligned_blocks``), and
the later document loses the lines of its blocks.

Defined results: documents with a null doc_id or text stay as they are and hold
back nothing; rows that repeat a doc_id are not compared with each other, but what
one of them loses goes from each that holds it at the same line; a document may
lose all its text and then has the empty text; other columns, however named, are
kept.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 5
ENDS = ".!?…।॥؟۔։።"
WIDE_ENDS = "。！？｡"
_CLOSE = "\"'”’»)\\]}）」』"
_SPACE = r"[ \t 　]"
_CUT = re.compile(rf"(\n+)|[{ENDS}][{_CLOSE}]{{0,2}}({_SPACE}+)|[{WIDE_ENDS}][{_CLOSE}]{{0,2}}({_SPACE}*)")


def lines_of(text: str) -> list[str]:
    """Lines at even places, what separates them at odd ones; joined they are the text."""
    parts, at = [], 0
    for m in _CUT.finditer(text):
        start, stop = m.span(m.lastindex)
        parts.append(text[at:start])
        parts.append(text[start:stop])
        at = stop
    parts.append(text[at:])
    return parts


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without white space at its ends."""
    return xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass")) - (1 << 63)


def windows(hashes: list[int], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, stop, hash) of the shortest runs of ``least`` words that start or end with each line; each run once."""
    out = []
    for i, count in enumerate(words):
        if count >= least:
            out.append((i, i + 1, hashes[i]))
            continue
        stop, total = i + 1, count
        while total < least and stop < len(words):
            total += words[stop]
            stop += 1
        if total >= least:
            out.append((i, stop, run_hash(hashes[i:stop])))
        start, total = i, count
        while total < least and start:
            start -= 1
            total += words[start]
        if total - count >= least or (total >= least and words[start] >= least):  # else the run from start is the same
            out.append((start, i + 1, run_hash(hashes[start : i + 1])))
    return out


EMPTY = line_hash("")


def run_hash(hashes: list[int]) -> int:
    return xxhash.xxh64_intdigest(array("q", hashes).tobytes()) - (1 << 63)


def text_windows(text: str, least: int) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Windows of the lines with words, their numbers among all lines, and their hashes."""
    number, words, hashes = [], [], []
    for n, line in enumerate(lines_of(text)[::2]):
        count = len(line.split())
        if count:
            number.append(n)
            words.append(count)
            hashes.append(line_hash(line))
    return windows(hashes, words, least), number, hashes


def document_windows(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """documents(doc_id, text) -> hash, doc_id, line (the place of the run's first line among those with words)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream, 2 << 20):
            hashes, row, start = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = text_windows(text, least)[0]
                start += [w[0] for w in found]
                hashes += [w[2] for w in found]
                row += [i] * len(found)
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), ids, pa.array(start, pa.int32())], names=["hash", "doc_id", "line"])

    known = documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return known.mapInArrow(run, "hash long, doc_id long, line int")


def shared_windows(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, line, hash, partner, partner_line, holders: each run that an earlier document holds, and a place of it in the first that does.

    Runs are found once and written. The first holders come from an aggregate with partial
    sums in each task; a run that very many documents hold is one row of it, and what
    joins that row may be split among tasks.
    """
    runs = common.written(document_windows(documents, least), "line-runs")
    first = runs.groupBy("hash").agg(F.min("doc_id").alias("partner"), F.min_by("line", "doc_id").alias("partner_line"), F.max("doc_id").alias("last"), F.count("*").alias("holders"))
    first = common.written(first.where("last > partner").drop("last"), "line-holders")  # a plain side, so that a hot run's rows can be split
    return runs.join(first, "hash").where("doc_id > partner").select("doc_id", "line", "hash", "partner", "partner_line", "holders")


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    below: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        below.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    chain, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        chain.append(i)
        i = below[i]
    return chain[::-1]


def align(pairs: list[tuple[int, int, int]]) -> list[int]:
    """(line, partner's line, holders), ascending by line -> places of the aligned ones, in order in both documents.

    Those with the fewest holders are aligned first; the others only between the anchors that this gives.
    """
    fewest = min((p[2] for p in pairs), default=0)
    rare = [i for i, p in enumerate(pairs) if p[2] == fewest]
    anchors = [rare[k] for k in longest_increasing([pairs[i][1] for i in rare])]
    out: list[int] = []
    before = (-1, -1)
    at = 0
    for anchor in [*anchors, None]:
        after = pairs[anchor][:2] if anchor is not None else (1 << 62, 1 << 62)
        gap = []
        while at < len(pairs) and pairs[at][0] < after[0]:
            if pairs[at][2] != fewest and before[1] < pairs[at][1] < after[1]:
                gap.append(at)
            at += 1
        out += [gap[k] for k in longest_increasing([pairs[i][1] for i in gap])]
        if anchor is not None:
            out.append(anchor)
            before = after
    return out


def chains(pairs: list[tuple[int, int, int]]) -> list[list[int]]:
    """The alignment, and then increasing chains of all places that it left out: each goes on the chain whose end is nearest below it."""
    main = align(pairs)
    taken = set(main)
    found: list[list[int]] = [main]
    tops: list[int] = []  # ends of the further chains, ascending
    chain_of: list[int] = []
    for i in range(len(pairs)):
        if i not in taken:
            value = pairs[i][1]
            at = bisect_left(tops, value) - 1
            if at >= 0:
                found[chain_of[at]].append(i)
                tops[at] = value
            else:
                tops.insert(0, value)
                chain_of.insert(0, len(found))
                found.append([i])
    return found


def blocks(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, last) places in pairs of each block: runs that adjoin in both documents."""
    out: list[tuple[int, int]] = []
    for chain in chains(pairs):
        for k, i in enumerate(chain):
            if k and (pairs[i][0] - pairs[chain[k - 1]][0], pairs[i][1] - pairs[chain[k - 1]][1]) == (1, 1):
                out[-1] = (out[-1][0], i)
            else:
                out.append((i, i))
    return out


def aligned_blocks(shared: list[tuple[int, int, int, int, int]], stops: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """Shared runs (line, hash, partner, partner's line, holders) of a document -> blocks (partner, line, line past the end, partner's line), by pairs.

    stops has the line past the end of each run (line, hash) of the document; others are passed over.
    """
    by_partner: dict[int, dict[tuple[int, int], tuple[int, int, int]]] = {}
    for line, hash_, partner, partner_line, holders in shared:
        if (line, hash_) in stops:
            by_partner.setdefault(partner, {})[line, hash_] = (line, partner_line, holders)
    out = []
    for partner, found in sorted(by_partner.items()):
        runs = sorted(found, key=lambda r: (*found[r], r[1]))
        pairs = [found[r] for r in runs]
        for first, last in blocks(pairs):
            covered = [stops[runs[first]], stops[runs[last]]]
            out.append((partner, pairs[first][0], max(covered), pairs[first][1]))
    return out


def doomed_lines(text: str, shared: list[tuple[int, int, int, int, int]], least: int = MIN_WORDS) -> dict[int, int]:
    """Number -> hash of the lines in blocks of the pairs of a document; lines without words between two of a block go too."""
    found, number, hashes = text_windows(text, least)
    gone: dict[int, int] = {}
    for _, start, stop, _ in aligned_blocks(shared, {(first, h): past for first, past, h in found}):
        for n in range(number[start], number[stop - 1]):
            gone.setdefault(n, EMPTY)
        for k in range(start, stop):
            gone[number[k]] = hashes[k]
    return gone


def without_lines(text: str, gone: dict[int, int]) -> str:
    """text without the lines whose number and hash are in gone, and without what separated them from the next ones."""
    parts = lines_of(text)
    keep = []
    for n in range(0, len(parts), 2):
        if n // 2 in gone and gone[n // 2] == line_hash(parts[n]):
            continue
        keep += parts[n : n + 2]
    if len(keep) % 2 == 0 and keep and len(keep) < len(parts):
        keep.pop()  # the separator of a last line that is gone
    return "".join(keep)


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d struct: the row of documents as it was, text: what is left of it, removed: lines with words deleted)."""
    names = ["line", "hash", "partner", "partner_line", "holders"]
    shared = shared_windows(documents, min_words).groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("shared"))

    @F.pandas_udf("text string, removed int")
    def rest(texts: pd.Series, *found: pd.Series) -> pd.DataFrame:
        left, removed = [], []
        for text, *of in zip(texts, *found, strict=True):
            gone = {} if of[0] is None or text is None else doomed_lines(text, list(zip(*(x.tolist() for x in of), strict=True)), min_words)
            left.append(without_lines(text, gone) if gone else text)
            removed.append(sum(h != EMPTY for h in gone.values()))
        return pd.DataFrame({"text": pd.Series(left, dtype=object), "removed": pd.Series(removed, dtype="int32")})

    # rows without a doc_id have no partner and are spread by their texts
    spread = F.when(F.col("d")["doc_id"].isNull(), F.xxhash64(F.col("d")["text"])).otherwise(F.lit(0).cast("long"))
    rows = documents.select(F.struct("*").alias("d")).withColumn("spread", spread)
    shared = shared.withColumn("none", F.lit(0).cast("long"))
    joined = rows.join(shared, (F.col("d")["doc_id"].cast("long") == F.col("doc_id")) & (F.col("spread") == F.col("none")), "left")
    made = joined.withColumn("made", rest(F.when(F.col("shared").isNotNull(), F.col("d")["text"]), *[F.col("shared")[n] for n in names]))
    left = F.when(F.col("shared").isNull(), F.col("d")["text"]).otherwise(F.col("made")["text"])
    return made.select("d", left.alias("text"), F.coalesce(F.col("made")["removed"], F.lit(0)).alias("removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(common.table(spark, sf_dir, "documents"))
    return kept.select(F.col("d.doc_id").alias("doc_id"), F.col("removed").cast("long").alias("lines_removed"), "text")
