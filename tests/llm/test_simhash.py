import random
import re

import numpy as np
import xxhash

from ebbline.llm import simhash
from tests.llm import fixtures


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(values):
    v, p = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 3):
            a, b = find(i), find(int(j) + i + 1)
            if a != b:
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def cloud(r, base, n, most):
    out = set()
    for _ in range(n):
        x = base
        for _ in range(r.randrange(most)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_index_against_brute_force():
    r = random.Random(1)
    for k in range(20):
        values = sorted({x for _ in range(5) for x in cloud(r, r.getrandbits(64), 80, 9)})
        index = simhash.GrayIndex(np.zeros(len(values), dtype=int), np.array(values, dtype=np.uint64))
        assert index.forest(3).tolist() == plain_groups(index.values)
    ranks = simhash.gray_rank(np.array([i ^ i >> 1 for i in range(1000)], dtype=np.uint64))
    assert ranks.tolist() == list(range(1000))


def test_large_buckets_are_dealt_again(spark):
    r = random.Random(2)
    values = cloud(r, r.getrandbits(64), 600, 12)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
    roots = {x.node % (1 << 64): x.root for x in simhash.components(simhash.near_links(df, 3, 40)).collect()}
    groups, plain = {}, {}
    for v, g in zip(values, plain_groups(values), strict=True):
        groups.setdefault(roots.get(v, ("own", v)), set()).add(v)
        plain.setdefault(g, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_documents(spark):
    df, rows = fixtures.hard_documents(spark)
    found = sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in simhash.near_groups(df).collect()), key=str)
    prints = [plain_print(t or "") for _, t, *_ in rows]
    group = plain_groups(prints)
    first = {}
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    assert found == sorted(((i, p, first.get(g)) for (i, *_), p, g in zip(rows, prints, group, strict=True)), key=str)
    assert simhash.near_groups(fixtures.empty_documents(spark)).collect() == []


def plain_similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def test_lightest_forest():
    r = random.Random(3)
    for _ in range(40):
        n = r.randrange(2, 40)
        edges = [(r.randrange(n), r.randrange(n), r.randrange(6)) for _ in range(r.randrange(120))]
        edges = [e for e in edges if e[0] != e[1]]
        kept = simhash.spanning(n, *(np.array([e[k] for e in edges], dtype=np.int64) for k in range(3))).tolist()
        p, want = list(range(n)), []
        for k in sorted(range(len(edges)), key=lambda k: (edges[k][2], k)):
            a, b, _ = edges[k]
            if p[a] != p[b]:
                old, new = p[a], p[b]
                p = [new if x == old else x for x in p]
                want.append(k)
        assert kept == sorted(want)


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(6)
    base = fixtures.texts(40)
    texts = dict.fromkeys([*base, "", " ", "two words", "two  words", "one two three four five six"])
    for t in base:
        words = t.split()
        for _ in range(6):
            changed = list(words)
            for _ in range(max(1, int(len(words) * r.choice([0.005, 0.01, 0.02, 0.03])))):
                changed[r.randrange(len(changed))] = r.choice(words)
            texts[" ".join(changed)] = None
    texts = list(texts)
    pairs = {(f"{i:04d}", f"{j:04d}") for i in range(len(texts)) for j in range(i) if plain_similarity(texts[i], texts[j]) >= 0.8}
    table = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "node string, text string").selectExpr("cast(node AS binary) AS node", "text")
    for largest in (1000, 5):
        links = simhash.near_duplicates(table, largest=largest)
        found = [(bytes(x.b).decode(), bytes(x.a).decode()) for x in links.collect()]
        assert set(found) <= pairs and len(found) == len(set(found))
        root = {bytes(x.node).decode(): bytes(x.root).decode() for x in simhash.components(links).collect()}
        apart = [(a, b) for a, b in pairs if root.get(a, a) != root.get(b, b)]
        assert len(pairs) > 200 and len(apart) <= 0.02 * len(pairs), (len(pairs), len(apart))
    assert simhash.near_duplicates(spark.createDataFrame([], "node string, text string")).collect() == []


def connected(names, pairs):
    """The smallest name that chains of pairs reach, for each name."""
    root = {x: x for x in names}
    for a, b in pairs:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        if old != new:
            root = {x: new if y == old else y for x, y in root.items()}
    return root


def test_near_duplicates_leave_no_pair_out(spark):
    r = random.Random(8)
    base = [t.split()[:150] for t in fixtures.texts(12)]
    texts = dict.fromkeys(["", " ", "\n", "one", "One", "a b c d", "a b c d e f g h", "a b c d e f g h i", "b c d e f g h i"])
    for k, words in enumerate(base):
        half = len(words) // 2
        texts |= dict.fromkeys(" ".join(x) for x in (words, words[:half] * 30 + words[half:], words[:half] + words[half:] * 30))  # nearly one set of shingles, far prints
        for n in (60, 100, 130):  # prefixes about the threshold, and one changed word in so many
            texts[" ".join(words[: n + k % 3])] = None
            texts[" ".join(w if i % 40 != k else "other" for i, w in enumerate(words[:n]))] = None
        texts[" ".join(words[:40] + [r.choice(words) for _ in range(7)])] = None
    texts = list(texts)
    names = [f"{i:04d}" for i in range(len(texts))]
    pairs = [(names[j], names[i]) for i in range(len(texts)) for j in range(i) if plain_similarity(texts[i], texts[j]) >= 0.8]
    table = spark.createDataFrame(list(zip(names, texts, strict=True)), "node string, text string")
    for bits in (simhash.NEAR_BITS, 0):
        found = [(x.a, x.b) for x in simhash.near_duplicates(table, bits=bits).collect()]
        assert set(found) <= set(pairs) and len(found) == len(set(found))
        assert connected(names, found) == connected(names, pairs), bits


def test_bounds_hold_for_every_pair():
    r = random.Random(9)
    words = np.array(sorted({r.getrandbits(64) for _ in range(400)}), dtype=np.uint64)
    prefixes = simhash.Prefixes(np.array(r.sample(words.tolist(), 60), dtype=np.uint64), 0.8)
    for _ in range(300):
        one = np.unique(np.array(r.sample(words.tolist(), r.randrange(1, 300)), dtype=np.uint64))
        n = len(one)
        other = np.unique(np.concatenate([one[r.sample(range(n), n - r.randrange(n // 8 + 1))], np.array(r.sample(words.tolist(), r.randrange(n // 10 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(one, other))
        assert simhash.least_difference(simhash.odd_sketch(one).tobytes(), simhash.odd_sketch(other).tobytes()) <= n + len(other) - 2 * both
        if both / (n + len(other) - both) >= 0.8:
            x, y = prefixes(one), prefixes(other)
            token = next(t for t in x if t in y)
            places = np.array([x.tolist().index(token), y.tolist().index(token)])
            found = list(simhash.holder_pairs(np.zeros(2, dtype=np.int64), np.array([1, 2]), np.array([n, len(other)]), places, 0.8))
            assert sum(len(i) for i, _ in found) == 1
    sizes = np.array([r.randrange(1, 30) for _ in range(60)])
    buckets, roots = np.sort([r.randrange(5) for _ in sizes]), np.array([r.randrange(6) for _ in sizes])
    for chunk in (1, 10, 1 << 20):
        found = [tuple(sorted(p)) for x, y in simhash.holder_pairs(buckets, roots, sizes, np.zeros(60, dtype=np.int64), 0.8, chunk) for p in zip(x.tolist(), y.tolist(), strict=True)]
        assert sorted(found) == [(i, j) for i in range(60) for j in range(i + 1, 60) if buckets[i] == buckets[j] and roots[i] != roots[j] and min(sizes[i], sizes[j]) * 5 >= max(sizes[i], sizes[j]) * 4]


def test_long_chains_take_few_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    for most in (100_000, 20, 0):
        assert {x.node: x.root for x in simhash.components(chain, most).collect()} == {**dict.fromkeys(range(201), 0), 400: 400, 500: 400}
    named = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert {x.node: x.root for x in simhash.components(named).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
