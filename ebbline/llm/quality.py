"""Quality classifier by co-training: a text-content view and a page-metadata view.

The text view is a logistic regression on hashed trigrams of the letters of the whole text
(case and all that is no letter left out), the metadata view one on language, source, length and
layout counts, which never reads which letters there are; so the views share no feature. In each
of ``ROUNDS`` rounds both views score all unlabelled documents; those of which a
view is most certain go, with its label, to the other view, which is fitted with
them added. Both are calibrated on labelled documents that no fit has seen, and a
logistic combination of the two scores every document in one map-only pass.

Bounds: the fit uses at most ``LABELLED`` labelled documents, those whose hashed
ids are smallest, and each view hands over ``EXCHANGE`` documents a round at most,
the most certain of all; their features (about 4 KB each) are what reaches the driver.

Defined results: null text is empty text; null language or source is a value of
its own; several labels of a document count as the lowest; a null quality is no
label; of rows that share a doc_id the one with the smallest (text, lang, source) stands for all in a fit; without labels of both kinds every document has score 1 and is kept; other
columns, however named, are kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LABELLED = 3000
ROUNDS = 3
#: Pseudo-labels that a view hands over in a round at most, and the certainty that they need.
EXCHANGE, CERTAIN = 300, 0.95
#: A document is kept from this score on.
THRESHOLD = 0.5
TEXT_BITS = 11
SLOTS = 16

_KIND = np.zeros(256, dtype=np.int64)  # of a byte: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence mark, 6 symbol, 7 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 7 if _b >= 128 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t\n\r\x0b\x0c" else 5 if _c in ".,;:!?'\"" else 6 if 32 < _b < 127 else 0


#: Letters in lower case and bytes beyond ASCII as they are; anything else is a gap.
_LETTERS = bytes(b if chr(b).islower() and b < 128 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def text_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed trigrams of letters and gaps: a vector of length one, or zero for short texts."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LETTERS), dtype=np.uint8).astype(np.uint32)
    size = 1 << TEXT_BITS
    if len(data) < 3:
        return np.zeros(size, dtype=np.float32)
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761) >> np.uint32(32 - TEXT_BITS)
    return np.sqrt(np.bincount(code, minlength=size) / len(code)).astype(np.float32)


def page_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source (hashed slots), length, and counts of the layout: letters and capitals, other kinds of bytes, lines, words, repeats."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = np.bincount(_KIND[data], minlength=8) / max(len(data), 1)
    letters = shares[1] + shares[2] + shares[7]
    kinds = [letters, shares[2] / max(letters, 1e-9), *shares[[0, 3, 4, 5, 6]]]
    words = text.split()
    lines = text.count("\n") + 1
    shape = [np.log1p(len(data)), np.log1p(lines), np.log1p(len(words) / lines), len(data) / max(len(words), 1) / 10, len(set(words)) / max(len(words), 1)]
    out = np.zeros(2 * SLOTS + len(kinds) + len(shape))
    out[zlib.crc32(repr(lang).encode()) % SLOTS] = 1
    out[SLOTS + zlib.crc32(repr(source).encode()) % SLOTS] = 1
    out[2 * SLOTS :] = [*kinds, *shape]
    return out


@dataclass
class Logistic:
    """A linear model on standardised features."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float = 1.0, steps: int = 150) -> Logistic:
    """Weighted ridge logistic regression by accelerated gradient steps from zero: the same data give the same model."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    y, sample_weight = y.astype(np.float32), sample_weight.astype(np.float32)
    total = float(sample_weight.sum())
    weights = ahead = np.zeros(x.shape[1], dtype=np.float32)
    bias = bias_ahead = 0.0
    # the largest curvature, by a few power steps
    v = np.full(x.shape[1], x.shape[1] ** -0.5, dtype=np.float32)
    for _ in range(8):
        v = (sample_weight * (z @ v)) @ z / total
        top = float(np.linalg.norm(v)) or 1.0
        v = (v / top).astype(np.float32)
    rate = 1 / (0.25 * (top + 1) + ridge / total)
    momentum = 1.0
    for _ in range(steps):
        error = sample_weight * (_sigmoid(z @ ahead + bias_ahead) - y) / total
        new = (ahead - np.float32(rate) * (error @ z + np.float32(ridge / total) * ahead)).astype(np.float32)
        new_bias = bias_ahead - rate * float(error.sum())
        next_ = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = new + np.float32((momentum - 1) / next_) * (new - weights)
        bias_ahead = new_bias + (momentum - 1) / next_ * (new_bias - bias)
        weights, bias, momentum = new, new_bias, next_
    return Logistic(weights, bias, mean, scale)


@dataclass
class CoTrained:
    text: Logistic
    page: Logistic
    text_scale: Logistic
    page_scale: Logistic
    combined: Logistic

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: by text, by page, and combined."""
        a, b = self.text.logit(text)[:, None], self.page.logit(page)[:, None]
        return _sigmoid(self.text_scale.logit(a)), _sigmoid(self.page_scale.logit(b)), _sigmoid(self.combined.logit(np.hstack([a, b])))


#: Models of both views -> for each view, features and labels of the documents that the other view hands to it.
Proposals = Callable[[list[Logistic]], list[tuple[np.ndarray, np.ndarray]]]


def quotas(y: np.ndarray, exchange: int = EXCHANGE) -> dict[int, int]:
    """Documents of each label that a view hands over in a round: by the labels' shares, one at least."""
    return {1: max(1, int(exchange * y.mean())), 0: max(1, int(exchange * (1 - y.mean())))}


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, propose: Proposals, rounds: int = ROUNDS) -> CoTrained:
    """Every fourth labelled row is held out for calibration; the rest and exchanged pseudo-labels fit the views."""
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    calibrate = held if held.any() else ~held
    weight = {1.0: 0.5 / max(y.mean(), 1e-9), 0.0: 0.5 / max(1 - y.mean(), 1e-9)}
    known = [([x[~held]], [y[~held]]) for x in (text, page)]
    models: list[Logistic] = []
    for turn in range(rounds + 1):
        models = []
        for rows, labels in known:
            label = np.concatenate(labels)
            models.append(fit_logistic(np.vstack(rows), label, np.where(label == 1, weight[1.0], weight[0.0])))
        if turn < rounds:
            for (rows, labels), (new, given) in zip(known, propose(models), strict=True):
                if len(given):
                    rows.append(new)
                    labels.append(given)
    a, b = models[0].logit(text[calibrate])[:, None], models[1].logit(page[calibrate])[:, None]
    ones = np.ones(int(calibrate.sum()))
    return CoTrained(models[0], models[1], fit_logistic(a, y[calibrate], ones), fit_logistic(b, y[calibrate], ones), fit_logistic(np.hstack([a, b]), y[calibrate], ones))


def from_pool(pool: list[np.ndarray], quota: dict[int, int]) -> Proposals:
    """Proposals from feature matrices (text, page) of unlabelled documents in memory."""
    used: list[set[int]] = [set(), set()]

    def propose(models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray]]:
        sure = [_sigmoid(m.logit(x)) for m, x in zip(models, pool, strict=True)]
        out = []
        for k in (0, 1):
            rows: list[int] = []
            labels: list[float] = []
            for label, most in quota.items():
                certainty = sure[1 - k] if label else 1 - sure[1 - k]
                best = [int(r) for r in np.argsort(-certainty, kind="stable") if certainty[r] >= CERTAIN and int(r) not in used[k]][:most]
                used[k].update(best)
                rows += best
                labels += [float(label)] * len(best)
            out.append((pool[k][rows], np.array(labels)))
        return out

    return propose


def _slices(text: pa.Array, lang: pa.Array, source: pa.Array, rows: int = 256) -> Iterator[list[tuple]]:
    """Rows of (text, lang, source) as Python values, a few at a time: a batch of long texts is never held twice."""
    for at in range(0, len(text), rows):
        yield list(zip(*(c.slice(at, rows).to_pylist() for c in (text, lang, source)), strict=True))


def _matrices(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([text_features(t) for t, _, _ in rows]), np.array([page_features(*r) for r in rows])


def _view(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("`doc_id`").cast("long").alias("doc_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in ("text", "lang", "source")])


def _smallest_ids(ids: DataFrame, count: int) -> list[tuple]:
    """At most ``count`` rows, those whose hashed doc_id is smallest."""
    return [tuple(r) for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(count).collect()]


def _features_of(view: DataFrame, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of the documents with the given ids (a bounded number, so that side may be broadcast)."""

    @F.arrow_udf("struct<text: binary, page: binary>")
    def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        rows = [r for part in _slices(text, lang, source) for r in part]
        made = [pa.array([text_features(t).astype(np.float16).tobytes() for t, _, _ in rows], pa.binary()), pa.array([page_features(*r).astype(np.float32).tobytes() for r in rows], pa.binary())]
        return pa.StructArray.from_arrays(made, ["text", "page"])

    wanted = view.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))  # as Arrow: no Python worker makes these rows
    one = view.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "r.*")
    rows = one.select("doc_id", features("text", "lang", "source").alias("f")).select("doc_id", "f.text", "f.page").collect()
    return {r["doc_id"]: (np.frombuffer(r["text"], dtype=np.float16).astype(np.float32), np.frombuffer(r["page"], dtype=np.float32)) for r in rows}


def _from_corpus(view: DataFrame, known: DataFrame, quota: dict[int, int]) -> Proposals:
    """Proposals from all unlabelled documents: each round is one pass over the texts, which leaves two numbers a document."""
    used: list[set[int]] = [set(), set()]

    def propose(models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray]]:
        @F.arrow_udf("struct<p0: double, p1: double>")
        def views(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
            out = [np.zeros((2, 0))]
            for rows in _slices(text, lang, source):
                x, p = _matrices(rows)
                out.append(np.vstack([_sigmoid(models[0].logit(x)), _sigmoid(models[1].logit(p))]))
            return pa.StructArray.from_arrays([pa.array(c) for c in np.hstack(out)], ["p0", "p1"])

        scored = view.where("doc_id IS NOT NULL").select("doc_id", views("text", "lang", "source").alias("p")).select("doc_id", "p.*")
        scored = common.written(scored.join(known.select("doc_id"), "doc_id", "left_anti"), "views")
        picks: list[dict[int, float]] = []
        for k in (0, 1):
            found: dict[int, float] = {}
            for label, most in quota.items():
                sure = F.col(f"p{1 - k}") if label else 1 - F.col(f"p{1 - k}")
                best = scored.where(sure >= CERTAIN).orderBy(sure.desc(), F.xxhash64("doc_id"), "doc_id").limit(most + len(used[k]))
                fresh = [r[0] for r in best.select("doc_id").collect() if r[0] not in used[k] and r[0] not in found][:most]
                found |= dict.fromkeys(fresh, float(label))
            used[k].update(found)
            picks.append(found)
        features = _features_of(view, sorted({*picks[0], *picks[1]}))
        out = []
        for k, found in enumerate(picks):
            ids = sorted(i for i in found if i in features)
            out.append((np.array([features[i][k] for i in ids], dtype=np.float32), np.array([found[i] for i in ids])))
        return out

    return propose


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, exchange: int = EXCHANGE, rounds: int = ROUNDS) -> CoTrained | None:
    """Fits the model; None without labels of both kinds."""
    view = _view(documents)
    ids = view.where("doc_id IS NOT NULL").select("doc_id").distinct()
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`quality`").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = dict(_smallest_ids(known.join(ids, "doc_id"), labelled))
    if len(set(chosen.values())) < 2:
        return None
    features = _features_of(view, sorted(chosen))
    keys = sorted(features)
    y = np.array([chosen[k] for k in keys], dtype=float)
    return co_train(*(np.array([features[k][v] for k in keys], dtype=np.float32) for v in (0, 1)), y, _from_corpus(view, known, quotas(y, exchange)), rounds)


def scorer(model: CoTrained | None) -> Callable[..., Column]:
    """A function of the columns (text, lang, source): struct of p_text, p_page, score. One pass over whole texts."""

    @F.arrow_udf("struct<p_text: double, p_page: double, score: double>")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        out = [np.zeros((3, 0))]
        if model is None:
            out.append(np.ones((3, len(text))))
        else:
            out += [np.vstack(model.scores(*_matrices(rows))) for rows in _slices(text, lang, source)]
        return pa.StructArray.from_arrays([pa.array(c) for c in np.hstack(out)], ["p_text", "p_page", "score"])

    return score


def score_documents(documents: DataFrame, model: CoTrained | None) -> DataFrame:
    """(d struct: the row of documents, q struct: p_text, p_page, score), every row once."""
    rows = documents.select(F.struct("*").alias("d"))
    return rows.withColumn("q", scorer(model)(*[F.col("d")[c].cast("string") for c in ("text", "lang", "source")]))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without the rows that score below the threshold."""
    return score_documents(documents, train(documents, labels)).where(F.col("q.score") >= threshold).select("d.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    scored = score_documents(documents, train(documents, common.table(spark, sf_dir, "labels")))
    return scored.select(F.col("d.doc_id").alias("doc_id"), "q.p_text", "q.p_page", "q.score", (F.col("q.score") >= THRESHOLD).alias("keep"))
