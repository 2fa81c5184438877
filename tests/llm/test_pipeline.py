import hashlib
import math
import random
import string
import zlib

import duckdb
import numpy as np

import corpus_pipeline
from ebbline.llm import quality, registry
from tests.llm import fixtures
from tests.llm.test_lines import all_pairs, cut
from tests.llm.test_simhash import plain_similarity

BIG = "/root/testdata/sf0.01"


def test_held_out_accuracy():
    rows = duckdb.sql(f"SELECT text, lang, source, quality FROM '{BIG}/documents.parquet' LEFT JOIN '{BIG}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    known, other = [r for r in rows if r[3] is not None], [r for r in rows if r[3] is None]
    x = np.array([quality.text_features(r[0]) for r in known + other])
    p = np.array([quality.page_features(*r[:3]) for r in known + other])
    y = np.array([r[3] for r in known], dtype=float)
    n, k = len(known), len(known) * 2 // 3
    model = quality.co_train(x[:k], p[:k], y[:k], quality.from_pool([x[n:], p[n:]], quality.quotas(y[:k], 60)))
    scores = model.scores(x[k:n], p[k:n])
    assert np.mean((scores[2] >= 0.5) == y[k:]) >= 0.95
    assert np.mean(scores[2][y[k:] == 1] < 0.5) <= 0.02


def test_quality_hard_cases(spark):
    df, rows = fixtures.hard_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    assert quality.score_documents(df, model).count() == len(rows)
    assert quality.keep_good(df, labels, threshold=0.0).count() == len(rows) and quality.keep_good(df, labels).columns == df.columns
    one_kind = labels.where("quality = 1")
    assert quality.train(df, one_kind) is None and quality.keep_good(df, one_kind).count() == len(rows)
    assert quality.keep_good(fixtures.empty_documents(spark), labels).collect() == []


def plain_scores(model, text, lang, source):
    """The scores of one document by loops over its bytes; shares no code with the operator but the fitted numbers."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw]
    counts = [0] * 2048
    for x, y, z in zip(letters, letters[1:], letters[2:]):
        counts[((x * 65536 + y * 256 + z) * 2654435761 % 2**32) >> 21] += 1
    total = max(sum(counts), 1)
    text_view = [(c / total) ** 0.5 for c in counts]
    kinds = {k: 0 for k in "oaAd .sx"}
    for b in raw:
        c = chr(b)
        kinds["x" if b >= 128 else "a" if c in string.ascii_lowercase else "A" if c in string.ascii_uppercase else "d" if c in string.digits else " " if c in " \t\n\r\x0b\x0c" else "." if c in ".,;:!?'\"" else "s" if 32 < b < 127 else "o"] += 1
    n = max(len(raw), 1)
    share = {k: v / n for k, v in kinds.items()}
    known = share["a"] + share["A"] + share["x"]
    words, lines = (text or "").split(), (text or "").count("\n") + 1
    page_view = [0.0] * 32
    page_view[zlib.crc32(repr(lang).encode()) % 16] = 1
    page_view[16 + zlib.crc32(repr(source).encode()) % 16] = 1
    page_view += [known, share["A"] / max(known, 1e-9), share["o"], share["d"], share[" "], share["."], share["s"]]
    page_view += [math.log1p(len(raw)), math.log1p(lines), math.log1p(len(words) / lines), len(raw) / max(len(words), 1) / 10, len(set(words)) / max(len(words), 1)]

    def logit(m, x):
        return sum((v - mean) / scale * w for v, mean, scale, w in zip(x, m.mean.tolist(), m.scale.tolist(), m.weights.tolist(), strict=True)) + m.bias

    a, b = logit(model.text, text_view), logit(model.page, page_view)
    squash = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return squash(logit(model.text_scale, [a])), squash(logit(model.page_scale, [b])), squash(logit(model.combined, [a, b]))


def test_scores_against_loops(spark):
    df, rows = fixtures.hard_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    found = sorted((str((r.d.doc_id, r.d.text)), r.q.p_text, r.q.p_page, r.q.score) for r in quality.score_documents(df, model).collect())
    wanted = sorted((str((i, t)), *plain_scores(model, t, lang, source)) for i, t, lang, source, _ in rows)
    assert len(found) == len(wanted) and all(x[0] == y[0] and np.allclose(x[1:], y[1:], atol=2e-3) for x, y in zip(found, wanted, strict=True))
    kept = {str((r.doc_id, r.text)) for r in quality.keep_good(df, labels).collect()}
    assert kept == {x[0] for x in wanted if x[3] >= 0.5}


def near_groups(texts):
    """Groups of texts that chains of five-word similarities of 0.8 or more connect, by comparing all pairs."""
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and plain_similarity(texts[i], texts[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_stages(spark):
    df, rows = fixtures.hard_documents(spark)
    assert df.columns[5:] == ["key", "part", "score", "d", "fingerprint"]  # names that clash with the stages' own
    r = random.Random(4)
    near = []
    for k in (1, 2, 4, 5):
        words = rows[k][1].split()
        for _ in range(max(1, len(words) // 60)):
            words[r.randrange(len(words))] = "other"
        near.append((300 + k, " ".join(words), "en", "src1", 7, "x", 1, 2.0, "y", "z"))
    docs = df.unionByName(spark.createDataFrame(near, df.schema))
    before = docs.collect()

    good = corpus_pipeline.common.written(corpus_pipeline.quality_stage(spark, docs, fixtures.SF), "t")
    model = quality.train(docs, corpus_pipeline.common.table(spark, fixtures.SF, "labels"))
    assert sorted(map(str, good.collect())) == sorted(str(x) for x in before if model is None or plain_scores(model, x.text, x.lang, x.source)[2] >= 0.5)

    # the lines of all documents, as the classifier may drop the copies here
    kept = corpus_pipeline.common.written(corpus_pipeline.line_stage(spark, docs, fixtures.SF), "t").collect()
    left = all_pairs([(x.doc_id, x.text) for x in before])
    once = [x for x in kept if x.doc_id != 7]
    assert all(cut(x.text) == left[x.doc_id] for x in once if x.doc_id is not None and x.text is not None)
    assert {x.doc_id for x in kept} == {x.doc_id for x in before if x.doc_id is None or x.text is None or left[x.doc_id] or not x.text.split()}
    assert all(x.n_chars == len(x.text) or x.text == y.text for x in kept if x.text is not None for y in before if y.doc_id == x.doc_id)

    alone = corpus_pipeline.common.written(corpus_pipeline.near_stage(spark, docs, fixtures.SF), "t")
    texts = sorted({x.text or "" for x in before})
    group = dict(zip(texts, near_groups(texts), strict=True))
    first = {}
    for x in sorted(before, key=lambda x: (x.doc_id is None, x.doc_id or 0, hashlib.sha256((x.text or "").encode()).hexdigest())):
        first.setdefault(group[x.text or ""], (x.doc_id, x.text or ""))
    assert sorted(((x.doc_id, x.text or "") for x in alone.collect()), key=str) == sorted(first.values(), key=str) and len(first) < len(texts)

    packed = corpus_pipeline.STAGES[-1][1](spark, alone, fixtures.SF)
    assert {x.doc_id for x in packed.collect()} == {i for i, _ in first.values()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, fixtures.empty_documents(spark), fixtures.SF).collect() == [], name
        if name != "best_fit_packing":
            assert stage(spark, docs, fixtures.SF).columns == docs.columns, name


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, fixtures.SF).count() > 0
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)
    assert set(corpus_pipeline.queries()) == {"pipeline"}


def test_near_stage_chooses_by_row(spark):
    one, two = fixtures.texts(2)
    docs = [(5, one), (5, two), (5, two), (9, one), (None, two), (None, "a text of its own without an id"), (None, "a text of its own without an id"), (-3, "below zero"), (2, "below zero")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_stage(spark, table, fixtures.SF)
    assert left.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, one), (5, two), (None, docs[5][1]), (-3, "below zero")], key=str)
