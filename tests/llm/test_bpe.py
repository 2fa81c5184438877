import random

import public_tokenizers
import pytest
import tiktoken

from ebbline.llm import bpe
from tests.llm import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "🙂", "'s", "'ll", "1", "23", "!", "...", "%%%", "\x1d", "\x85", "\xa0", "\u0301", "the", "ing", "\r\n", "<|endoftext|>", "\ufeff", "١"]


@pytest.fixture(scope="module")
def coder():
    return bpe.byte_bpe(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.transducer.ranks, special_tokens={})


def strings(n):
    r = random.Random(4)
    yield from ("".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(n))
    yield from ("".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD000), r.randrange(0x10000, 0x1F000)])) for _ in range(50)) for _ in range(n // 10))


def test_same_ids_as_the_library(coder, library):
    for t in [*strings(1500), *fixtures.texts(20), "a" * 3000, " " * 500]:
        assert coder.encode(t) == library.encode_ordinary(t)
        assert coder.decode(coder.encode(t)) == t


def test_states_and_simulation_agree(coder):
    few = bpe.Transducer(coder.transducer.ranks, max_states=0)
    for t in fixtures.texts(10):
        for word in t.split():
            raw = (" " + word).encode()
            assert coder.transducer.encode(raw) == few.encode(raw) == bpe.merge(raw, few.ranks)


def test_streaming_decode_in_any_cuts(coder):
    for t in strings(200):
        assert "".join(coder.stream(coder.encode(t), 1)) == t
    for raw in (b"\xe2\x82", b"\xf0\x9f", b"\xed\xa0\x80", b"a\xffb", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\x80"):
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(raw[i : i + 1]) for i in range(len(raw))) + machine.finish() == raw.decode("utf-8", "replace")


def test_table(spark, library):
    df, rows = fixtures.hard_documents(spark)
    import hashlib
    import struct

    found = sorted(map(tuple, bpe.decode_digests(bpe.encode_documents(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    assert bpe.encode_documents(fixtures.empty_documents(spark), PATH, public_tokenizers.PATTERN).collect() == []
