"""URL filters: longest-match host/path rules before a logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled URL table (at most
``MAX_LABELLED`` rows; the bound is a parameter) and shipped as one weight
vector of 2**BITS floats. URLs are judged in one narrow pass without a shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path and
is judged like any other; repeated rows give repeated results; other columns of
the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 16
GRAMS = (3, 4, 5)
MAX_LABELLED = 20_000

#: (verdict, host, path prefix): a rule fits its host and every subdomain.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Words of hosts and paths from which the small labelled table is made; compounds share their parts, as such hosts do.
BLOCK_PARTS = (
    ("casino", "poker", "slots", "bets", "betting", "jackpot", "lottery", "roulette"), ("pills", "viagra", "pharma", "steroids", "cialis"), ("adult", "xxx", "cams", "porn", "sexy", "escorts"),
    ("loans", "payday", "credit-fix", "crypto-gain"), ("spam", "spam-farm", "click-farm", "link-farm", "ads", "ads-track", "tracker", "popunder"), ("warez", "keygen", "crack", "torrent", "malware", "phish"),
)
BLOCK_FIRST = ("", "cheap-", "free-", "best-", "win-", "hot-", "buy-")
ALLOW_WORDS = (
    "news", "blog", "docs", "library", "university", "museum", "weather", "recipes", "garden", "science", "history", "travel", "music", "school", "council", "journal", "theatre", "railway", "atlas", "station", "northern", "another", "attention", "thinking", "nation",
    "orchestra", "earth", "harvest", "shore", "mathematics", "therapy", "the-times", "method", "author", "gather", "mother", "father", "weather-map", "leather", "feather", "either", "brother", "theory", "theatre-guide", "thesis", "thread", "thirteen", "thunder", "throne", "three",
    "tension", "mention", "edition", "action", "fiction", "section", "question", "reason", "season", "ration", "portion", "caution", "option", "motion", "notion", "lesson", "person", "open-data", "town-hall", "city-guide", "food-bank", "book-club", "health", "hospital", "energy", "forest", "river",
)


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block or 0 to allow), made from the words by rule: each word in some hosts, and in a path of another host."""
    rows = []
    block = [f"{first}{part}" for family in BLOCK_PARTS for k, part in enumerate(family) for first in ("", BLOCK_FIRST[1 + k % 6])]
    for label, words in ((1, block), (0, ALLOW_WORDS * 2)):
        for i, word in enumerate(words):
            other = ALLOW_WORDS[(i * 7 + 3) % len(ALLOW_WORDS)]
            for k, front in enumerate(("", "m.", "blog.", "www.")):
                end = ("", "/", ".html", "?page=2&ref=x", "#top")[(i + k) % 5]
                rows.append((f"http{'s' * ((i + k) % 2)}://{front}{word}.{('example.com', 'example.net', 'example.org', 'test')[(i // 2 + k) % 4]}/{('en', 'de', 'fr', 'es')[(i // 3 + k) % 4]}/{(i * 4 + k) * 7919 % 20011}{end}", label))
            rows.append((f"http://{other}.example.org/{word}/{i * 31 % 997}.html", label))
    return rows


_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered;
    path: from there up to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_LOWER), path


def rule_index(rules: Iterable[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """host -> [(path prefix, verdict)], the longest path first."""
    index: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        index.setdefault(host, []).append((path, verdict))
    for found in index.values():
        found.sort(key=lambda x: -len(x[0]))
    return index


def match_rule(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits, or two nulls. One dictionary probe for each label of the host."""
    best: tuple[int, str | None, str | None] = (-1, None, None)
    domain = host
    while domain:
        for prefix, verdict in index.get(domain, ()):
            if path.startswith(prefix):
                if len(domain) + len(prefix) > best[0]:
                    best = (len(domain) + len(prefix), domain + prefix, verdict)
                break
        domain = domain.partition(".")[2]
    return best[1], best[2]


def features(hosts: list[str], paths: list[str], bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each hashed byte n-gram of ``^host$`` and ``path``; host and path hash apart. Vectorised over the batch."""
    rows, cells = [], []
    for salt, texts in ((0x9E3779B9, [f"^{h}$" for h in hosts]), (0x85EBCA6B, paths)):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        code = np.full(len(data), salt, dtype=np.uint64)
        for n in range(1, max(grams) + 1):
            size = len(data) - n + 1
            if size <= 0:
                break
            code = (code[:size] * np.uint64(0x100000001B3)) ^ (data[n - 1 :] + np.uint64(1))
            if n in grams:
                whole = owner[:size] == owner[n - 1 :]
                mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
                rows.append(owner[:size][whole])
                cells.append(mixed[whole].astype(np.int64))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(cells)


def scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability of block for each URL: logistic of the mean n-gram weight, scaled by the root of the count."""
    row, cell = features(hosts, paths, int(np.log2(len(weights))))
    total = np.bincount(row, weights=weights[cell], minlength=len(hosts))
    count = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(total / np.sqrt(count) + bias)))


def fit(labelled: list[tuple[str, int]], bits: int = BITS, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-2, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression on at most max_labelled labelled URLs, in a fixed order: the same table gives the same weights."""
    labelled = sorted(labelled, key=lambda x: (str(x[0]), x[1]))[:max_labelled]
    parts = [split_url(u) for u, _ in labelled]
    hosts, paths = [h for h, _ in parts], [p for _, p in parts]
    y = np.array([label for _, label in labelled], dtype=float)
    row, cell = features(hosts, paths, bits)
    norm = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    weights, bias = np.zeros(1 << bits), 0.0
    for _ in range(rounds if len(y) else 0):
        z = np.bincount(row, weights=weights[cell], minlength=len(y)) * norm + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(cell, weights=(error * norm)[row], minlength=1 << bits) + ridge * weights)
        bias -= rate * error.mean()
    return weights, bias


def labelled_rows(labelled: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """At most ``most`` distinct rows of a table (url, label), those whose hashes are smallest; rows with another label or none are left out."""
    rows = labelled.select(F.col("`url`").cast("string").alias("url"), F.col("`label`").cast("int").alias("label")).where("url IS NOT NULL AND label IN (0, 1)").distinct()
    return [tuple(r) for r in rows.orderBy(F.xxhash64("url", "label"), "url", "label").limit(most).collect()]


def judge(pages: DataFrame, labelled: DataFrame | list[tuple[str, int]] | None = None, rules: Iterable[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, score; every row once.

    labelled: a small table (url, label: 1 to block, 0 to allow) from which the model is fitted; without one, that of ``labelled_urls``.
    """
    if isinstance(labelled, DataFrame):
        labelled = labelled_rows(labelled)
    weights, bias = fit(labelled_urls() if labelled is None else labelled)
    index = rule_index(rules)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream):
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            score = scores(weights, bias, hosts, paths)
            rules_hit, verdicts = [], []
            for host, path, s in zip(hosts, paths, score, strict=True):
                rule, verdict = match_rule(host, path, index)
                rules_hit.append(rule)
                verdicts.append(verdict or ("block" if s >= threshold else "allow"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(rules_hit, pa.string()), pa.array(verdicts, pa.string()), pa.array(score)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return common.crossed_out(pages, "page_id", "url").mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, score double")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
