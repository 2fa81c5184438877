import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ebbline.llm import common, packing, token_ids, words
from tests.llm import fixtures

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_give_the_library_ids(library):
    coder, r = words.WordEncoder(PATH), random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "é", "Ü", "ß", "漢", "🙂", "'s", "'LL", "1", "!", "%%%", "\x1d", "\x85", "\xa0", "\u0301", "The", "<|endoftext|>", "<|", "\ufeff", "١", "Σ", "İ", "ª", "½", "µ", "Á", "\xad", "\x00", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(2500)] + fixtures.texts(20)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "\n", "\xa0", "\x85", "A", "É", "²", "½", "7", "42", "%%", "..", "«", "\xad", "\x00", "'S", "don't", "hello"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(2500)]
    many = coder.encode_many(texts)
    for t, ids in zip(texts, many, strict=True):
        wanted = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode_bytes(t), "<u4").tolist() == wanted and np.frombuffer(ids, "<u4").tolist() == wanted
    assert coder._pattern == words.CUT and coder.encode_many([]) == [] and coder.encode_many([""]) == [b""]


def test_many_sparse_ids_take_little_memory():
    keys = np.cumsum(np.random.default_rng(4).integers(1, 1 << 40, 4_000_000))
    tracemalloc.start()
    coded, _ = token_ids.EliasFano.frombytes(token_ids.EliasFano.of(keys).tobytes())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300 << 20
    assert all(coded.select(i) == keys[i] for i in range(0, len(keys), 99_991)) and (coded.run(2_000_000, 2_000_900) == keys[2_000_000:2_000_900]).all()


def test_elias_fano():
    r = random.Random(2)
    for _ in range(60):
        values = np.sort(np.array([r.randrange(-(1 << r.randrange(1, 63)), 1 << r.randrange(1, 63)) for _ in range(r.randrange(1, 900))], dtype=np.int64))
        coded, size = token_ids.EliasFano.frombytes(token_ids.EliasFano.of(values).tobytes())
        assert (coded.run(0, len(values)) == values).all()
        assert all(coded.select(i) == values[i] for i in r.sample(range(len(values)), min(40, len(values))))
        for _ in range(10):
            a, b = sorted(r.randrange(len(values) + 1) for _ in range(2))
            assert coded.run(a, b).tolist() == values[a:b].tolist()
    dense = token_ids.EliasFano.of(np.cumsum(np.random.default_rng(1).integers(0, 600, 10_000)), 0)
    assert 8 * (len(dense.low) + len(dense.high)) < 10_000 * (2 + np.log2(300) + 1)
    assert token_ids.EliasFano.of(np.zeros(0, dtype=np.int64)).run(0, 1).tolist() == []
    with pytest.raises(IndexError):
        dense.select(10_000)


def test_files_round_trip(spark, library):
    df, rows = fixtures.hard_documents(spark)
    folder = common.shared_dir(spark, "t")
    manifest = token_ids.write_token_files(df, PATH, 2, folder, max_ids=3000)
    assert manifest.count() > 5
    found = token_ids.read_token_files(spark, folder, manifest).orderBy("start").collect()
    start = 0
    for row, (_, _, t, i) in zip(found, sorted(((i is not None, i or 0, t or "", i) for i, t, *_ in rows), key=lambda r: r[:3]), strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    none = common.shared_dir(spark, "t")
    assert token_ids.read_token_files(spark, none, token_ids.write_token_files(fixtures.empty_documents(spark), PATH, 2, none)).collect() == []


def test_file_access():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 5)]
    file = token_ids.TokenFile(token_ids.pack_file(4, 9, [-5, 7, 7], ids, 2))
    assert [file.document(i).tolist() for i in range(3)] == [[0, 1, 2], [], [0, 1, 2, 3, 4]] and file.keys.run(0, 3).tolist() == [-5, 7, 7] and (file.part, file.before) == (4, 9)
    with pytest.raises(ValueError):
        token_ids.TokenFile(b"x" * 80)


def fewest(items, limit):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= limit:
                bins[b] += items[i]
                place(i + 1, bins)
                bins[b] -= items[i]
        place(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    r = random.Random(5)
    for k in range(250):
        limit = r.choice([10, 17, 30])
        items = [r.randrange(limit // 4, limit * 2 // 3) for _ in range(8)] if k % 3 == 0 else [r.randrange(1, limit + 1) for _ in range(r.randrange(9))]
        counts = np.bincount(items, minlength=limit + 1)
        rest = counts.copy()
        fixed = packing.reduce_dominated(rest, limit)
        best = fewest(items, limit)
        assert sum(g.bins for g in fixed) + fewest([i for i in range(limit + 1) for _ in range(rest[i])], limit) == best
        groups = packing.pack(counts, limit)
        assert packing.lower_bound(counts, limit) <= best <= sum(g.bins for g in groups)
        back = np.zeros(limit + 1, dtype=int)
        for g in groups:
            assert sum(n * c for n, c in g.content) <= limit
            for n, c in g.content:
                back[n] += c * g.bins
        assert (back == counts).all()


def test_near_the_bound():
    lengths = np.minimum(np.random.default_rng(1).lognormal(6.3, 1, 100_000).astype(int) + 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    assert sum(g.bins for g in packing.pack(counts)) <= packing.lower_bound(counts) * 1.001


def test_packed_table(spark, library):
    df, rows = fixtures.hard_documents(spark)
    limit = 512
    found = packing.pack_documents(df, PATH, 1, limit).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, p, p * limit, len(ids[p * limit : (p + 1) * limit]), zlib.crc32(ids[p * limit : (p + 1) * limit].tobytes())) for p in range(-(-len(ids) // limit))]
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    assert packing.pack_documents(fixtures.empty_documents(spark), PATH).collect() == []


def test_documents_reach_the_lower_bound(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(documents, PATH).select("length", "sequence_id").collect()
    counts = np.bincount([r.length for r in rows], minlength=packing.LIMIT + 1)
    rest = counts.copy()
    fixed = sum(g.bins for g in packing.reduce_dominated(rest, packing.LIMIT))
    assert len({r.sequence_id for r in rows}) <= packing.lower_bound(counts) + 1 and fixed > 0
