"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A tokenisation is the BPE result exactly where each two neighbours are what BPE
makes of their joined bytes. So for each prefix of the input one token can end
there, and the transducer reads bytes from left to right, keeps the candidates
that a longer token could still overrule, and emits a token as soon as all
candidates agree on it (the lookahead is bounded by the longest token). Sets of
candidates become states when first reached, up to a bounded number. A piece that
leaves the states known by then goes through another method with the same result: a
longest-first backtracking search over a trie, which emits at the end of the piece.

Defined results: null text is empty text and has no tokens; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: States that are built; pieces that leave them are run on the candidates themselves.
MAX_STATES = 30_000
#: Token pairs, and words in each of two generations, that a process remembers.
MAX_PAIRS = 500_000
MAX_WORDS = 120_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """BPE by definition: join the neighbours of lowest rank (under ``below``), the first of equals, until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class _State:
    """pending: bytes whose tokens are not settled; paths: (start in pending, tokens before it) for each place where a longer token may still begin."""

    __slots__ = ("last", "paths", "pending", "tail", "then")

    def __init__(self, last: int, pending: bytes, paths: list[tuple[int, tuple[int, ...]]]) -> None:
        self.last, self.pending, self.paths = last, pending, paths
        self.tail = paths[-1][1]
        self.then: dict[int, tuple[_State, tuple[int, ...]]] = {}


class Transducer:
    """Bytes of one piece -> token ids, for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.begun = {t[:i] for t in ranks for i in range(1, len(t))}
        self.max_states = max_states
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.states: dict[tuple[int, bytes], _State] = {}
        self.start = self._state(-1, b"", [(0, ())])

    def _state(self, last: int, pending: bytes, paths: list[tuple[int, tuple[int, ...]]]) -> _State:
        found = self.states.get((last, pending))
        if found is None:
            found = self.states[last, pending] = _State(last, pending, paths)
        return found

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or one that merges don't reach."""
        if token not in self.halves:
            parts = merge(self.tokens[token], self.ranks, token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 and self.ranks.get(self.tokens[parts[0]] + self.tokens[parts[1]]) == token else None
        return self.halves[token]

    def _joined(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are when b follows a (-1: nothing).

        Going back through the merges that made the edges of a and b, the latest
        first, no merge across the boundary may come before the one undone.
        """
        known = self.pairs.get(a << 20 | b)
        if known is not None:
            return known
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        good = len(self.tokens[b]) == 1 or self._halves(b) is not None
        if good and a >= 0:
            ranks, tokens = self.ranks, self.tokens
            x, y, before = a, b, 1 << 60
            while True:
                across = ranks.get(tokens[x] + tokens[y])
                if across is not None and across < before:
                    good = False
                    break
                made_x = x if len(tokens[x]) > 1 else -1
                made_y = y if len(tokens[y]) > 1 else -1
                if made_x < 0 and made_y < 0:
                    break
                # of two merges of equal rank, the left one comes first: one that makes y stops a merge across of its own rank no more
                if made_x > made_y:
                    before, x = made_x, self._halves(x)[1]
                else:
                    before, y = made_y + 1, self._halves(y)[0]
        self.pairs[a << 20 | b] = good
        return good

    def _build(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        pending = state.pending + bytes((byte,))
        ranks, begun = self.ranks, self.begun
        paths, whole = [], None
        for at, path in state.paths:
            rest = pending[at:] if at else pending
            if whole is None:
                token = ranks.get(rest)
                if token is not None and self._joined(path[-1] if path else state.last, token):
                    whole = (*path, token)
            if rest in begun:
                paths.append((at, path))
        if whole is None:
            raise ValueError("the ranks leave bytes without a token")
        settled = len(whole)
        for _, path in paths:
            settled = min(settled, len(path))
            while path[:settled] != whole[:settled]:
                settled -= 1
        paths.append((len(pending), whole))
        if settled:
            out = whole[:settled]
            cut = sum([len(self.tokens[t]) for t in out])
            step = self._state(out[-1], pending[cut:], [(at - cut, path[settled:]) for at, path in paths]), out
        else:
            step = self._state(state.last, pending, paths), ()
        state.then[byte] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for i, byte in enumerate(piece):
            step = state.then.get(byte)
            if step is None:
                if len(self.states) >= self.max_states:
                    return self._run(piece, i - len(state.pending), state.last, out)
                step = self._build(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return out + list(state.tail)

    @cached_property
    def _trie(self) -> tuple[dict[int, int], list[int]]:
        """(node << 8 | byte -> node, token of each node or -1); the root is 0."""
        step: dict[int, int] = {}
        token = [-1]
        for bytes_, rank in self.ranks.items():
            node = 0
            for byte in bytes_:
                next_ = step.get(node << 8 | byte)
                if next_ is None:
                    next_ = step[node << 8 | byte] = len(token)
                    token.append(-1)
                node = next_
            token[node] = rank
        return step, token

    def _run(self, piece: bytes, at: int, before: int, out: list[int]) -> list[int]:
        """The same without states: adds the tokens of piece[at:] to out, after the settled token ``before``.

        The longest token that may follow is taken first. The tokens up to a place are the only ones that can end there,
        so a place from which nothing fits is given up for good, and the token before it is replaced by a shorter one.
        """
        step, token_of = self._trie
        pairs, joined, walk = self.pairs, self._joined, step.get
        size = len(piece)
        given_up: set[int] = set()
        choices: list[list[tuple[int, int]]] = []  # of each place on the way: tokens that begin there, shortest first
        way: list[tuple[int, int]] = []  # (place, token before it)
        while at < size:
            node, end, found = 0, at, []
            for byte in piece[at:] if size - at < 256 else memoryview(piece)[at:]:  # a long rest is not copied at each token
                node = walk(node << 8 | byte)
                if node is None:
                    break
                end += 1
                if token_of[node] >= 0:
                    found.append((token_of[node], end))
            while True:
                while found:
                    token, end = found.pop()
                    if end in given_up:
                        continue
                    good = pairs.get(before << 20 | token)
                    if good is None:
                        good = joined(before, token)
                    if good:
                        break
                else:
                    if not way:
                        raise ValueError("the ranks leave bytes without a token")
                    given_up.add(at)
                    at, before = way.pop()
                    found = choices.pop()
                    continue
                way.append((at, before))
                choices.append(found)
                at, before = end, token
                break
        return [*out, *[token for _, token in way[1:]], before] if way else out


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any cuts, gives text, and holds back an unfinished character.

    The state is (continuation bytes still due, lowest and highest allowed next byte).
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        """The next state; None for a byte that cannot follow."""
        due, low, high = state
        if due:
            return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
        if byte < 0x80:
            return 0, 0, 0
        if 0xC2 <= byte <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= byte <= 0xEF:
            return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
        if 0xF0 <= byte <= 0xF4:
            return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
        return None

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """Bytes at the end that begin a character and could still complete it: 0 to 3."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state: tuple[int, int, int] | None = (0, 0, 0)
                for byte in data[-back:]:
                    state = state and cls.step(state, byte)
                return back if state and state[0] else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Remembered(dict):
    """key -> make(key), for the keys of the last two generations of ``limit`` keys each."""

    def __init__(self, make, limit: int = MAX_WORDS) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Texts -> ids by a rank file and a pattern, and back.

    No match of the pattern spans a boundary from a character that is no white space to
    a space, so a text is cut at such spaces, and each different segment is matched
    and put through the transducer once while the table of segments holds it.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern}

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(load_ranks(self.path))

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {rank: token for token, rank in load_ranks(self.path).items()}

    @cached_property
    def _matches(self):
        return regex.compile(self.pattern).findall

    @cached_property
    def _after_space(self) -> Remembered:
        return Remembered(self._segment)

    @cached_property
    def _pieces(self) -> Remembered:
        return Remembered(lambda piece: array("I", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes())

    def _segment(self, text: str) -> bytes | None:
        """The ids of a segment and the space before it; None if it doesn't end where a unit ends."""
        if self._letters_first:
            if text.isalpha():
                return self._pieces[" " + text]
            if text[-1:] in _MARKS and text[:-1].isalpha():
                return self._pieces[" " + text[:-1]] + self._pieces[text[-1]]
        return self._unit(" " + text) if text and not text[-1].isspace() else None

    @cached_property
    def _letters_first(self) -> bool:
        """Whether the pattern takes a space and letters as one match, and a mark after letters as one of its own."""
        return self._matches(" Aé字ǅʰ") == [" Aé字ǅʰ"] and all(self._matches(f" ab{m}") == [" ab", m] for m in _MARKS)

    def _unit(self, text: str) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._matches(text)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            found = list(map(self._after_space.__getitem__, rest))
            if None not in found:
                return self._unit(first) + b"".join(found)
        return b"".join(map(self._unit, re.findall(r"\s*\S+|\s+", text) if not re.search("[\x1c-\x1f]", text) else [text]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def stream_bytes(self, ids: list[int], chunk: int = 4096) -> Iterator[bytes]:
        """The bytes of the ids, some tokens at a time."""
        of = self.tokens.__getitem__
        for at in range(0, len(ids), chunk):
            yield b"".join(map(of, ids[at : at + chunk]))

    def stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text as the ids arrive: an unfinished character waits for its other bytes."""
        machine = Utf8Machine()
        arriving = iter(ids)
        while some := list(itertools.islice(arriving, chunk)):
            yield from map(machine.feed, self.stream_bytes(some, chunk))
        yield machine.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids, 1 << 16))


_MARKS = frozenset(".,;:!?%$#&*|")
_MADE: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder for each process: its tables outlast the task."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(path, pattern)
    return _MADE[path, pattern]


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """documents(doc_id, text) -> doc_id, ids (binary, little-endian unsigned 32-bit)."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in common.batches(stream, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.encode_bytes(t or "") for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return common.crossed_out(documents, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode_digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encode_documents' rows -> n_tokens, the digests of the ids and of the decoded bytes, and whether the incremental machine reads these as whole UTF-8."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in common.batches(stream, 4 << 20):
            counts, ids_sha, text_sha, whole = [], [], [], []
            for data in batch.column(1).to_pylist():
                ids = np.frombuffer(data, dtype="<u4").tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(data).hexdigest())
                digest, machine, sound = hashlib.sha256(), Utf8Machine(), True
                for raw in coder.stream_bytes(ids):
                    digest.update(raw)
                    sound = "\ufffd" not in machine.feed(raw) and sound
                text_sha.append(digest.hexdigest())
                whole.append(sound and not machine.held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(whole, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_whole"])

    return encoded.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_whole boolean")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return decode_digests(encode_documents(common.table(spark, sf_dir, "documents"), path, pattern), path, pattern)
