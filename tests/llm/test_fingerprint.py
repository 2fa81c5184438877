import hashlib
import random

from ebbline.llm import lz_fingerprint as lz
from tests.llm import fixtures


def reference(text, k=lz.K):
    """Phrases of the incremental parse, one by one."""
    seen, at = set(), 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in seen:
            seen.add(text[at:end])
            at = end
    return seen


def test_phrases_and_pairs():
    texts = fixtures.texts(12)
    for t, o in zip(texts, texts[1:], strict=False):
        ends = []
        seen = set()
        lz.parse(t, 0, seen, ends)
        assert seen == reference(t) and len(lz.phrase_hashes(t, 0, ends)) == len(seen) == len(set(lz.phrase_hashes(t, 0, ends).tolist()))
        keep = len(t) - len(t) // 4
        own, edited = lz.fingerprint_pair(t, keep, o[: len(t) // 4])
        assert (own == lz.fingerprint(t)).all() and (edited == lz.fingerprint(t[:keep] + o[: len(t) // 4])).all()
        assert lz.likeness(own, edited) > lz.likeness(own, lz.fingerprint(o))
        assert (lz.from_text(lz.as_text(own)) == own).all()


def test_estimate_is_near_the_exact_likeness():
    texts = fixtures.texts(30)
    for t, o in zip(texts, texts[1:], strict=False):
        a, b = reference(t), reference(o)
        assert abs(lz.likeness(lz.fingerprint(t), lz.fingerprint(o)) - len(a & b) / len(a | b)) < 0.15
    assert lz.likeness(lz.fingerprint(""), lz.fingerprint("")) == 1 and lz.likeness(lz.fingerprint(""), lz.fingerprint("a")) == 0


def test_next_documents(spark):
    df, rows = fixtures.hard_documents(spark)
    found = lz.edited_fingerprints(df).collect()
    ordered = sorted(((i is not None, i or 0, t or "", i) for i, t, *_ in rows), key=lambda r: r[:3])
    assert len(found) == len(rows)
    want = []
    for (_, _, t, i), (_, _, o, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + o[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), lz.as_text(lz.fingerprint(t)), lz.as_text(lz.fingerprint(edited)), lz.likeness(lz.fingerprint(t), lz.fingerprint(edited)), lz.likeness(lz.fingerprint(t), lz.fingerprint(o))))
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_few_documents(spark):
    assert lz.edited_fingerprints(fixtures.empty_documents(spark)).collect() == []
    one = lz.edited_fingerprints(spark.createDataFrame([(5, "abcabc")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_large_ids_keep_every_row(spark):
    """Ids beyond 2**53, which quantiles round."""
    r = random.Random(3)
    ids = sorted({r.getrandbits(63) - (1 << 62) for _ in range(60)} | {(1 << 60) + k for k in range(60)})
    table = spark.createDataFrame([(i, f"text number {k} of some words {k * 7}") for k, i in enumerate(ids)], "doc_id long, text string")
    found = sorted((x.doc_id, x.near_next) for x in lz.edited_fingerprints(table).collect())
    texts = [f"text number {k} of some words {k * 7}" for k in range(len(ids))]
    assert found == [(i, lz.likeness(lz.fingerprint(texts[k]), lz.fingerprint(texts[(k + 1) % len(ids)]))) for k, i in enumerate(ids)]
