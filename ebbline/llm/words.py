"""Whole texts -> token ids with the tokenizers library, each different piece once.

The tokenizer files meant here split at white space and normalise each word by
itself, so a text's ids are the ids of its pieces in turn. Texts of one-byte
characters are lowered and cut into the pieces of the file's pattern many at a time
(``encode_many``), and each different piece goes through the library's BPE model. Other
texts go word by word: a plain word as above, any other through the whole tokenizer.
A file with other rules than these is used text by text.

What is remembered between texts is bounded: two generations of ``KEPT`` pieces of at
most 64 bytes, about 40 MB in all.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex

from . import common
from .bpe import Remembered

_PLAIN = regex.compile(r"[\x21-\x7eÀ-ÿ]+").fullmatch
_MARKS = frozenset(".,;:!?%$#&*|")
#: White space by Python but not by Unicode: such a text is encoded whole.
_CONTROL = regex.compile("[\x1c-\x1f]").search

#: Pieces and words in each of two generations that a process remembers.
KEPT = 100_000
#: Bytes of text that are cut into pieces at once, and pieces that one call of the library takes.
AT_ONCE, CALL = 1 << 21, 8192

#: The pattern whose pieces are cut here many at a time.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: For each one-byte character: 0 white space, 1 letter, 2 number (each is a piece), 3 anything else.
_KIND = bytes(0 if regex.match(r"\s", c) else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(256)))
_LOWERED = bytes(ord(c.lower()) for c in map(chr, range(256)))


def cut_pieces(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Lowered one-byte text -> the pieces of CUT as a binary array, and the place where each begins in data."""
    kinds = np.frombuffer(data.translate(_KIND), dtype=np.uint8)
    first = np.empty(len(kinds), dtype=bool)
    first[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    first |= kinds == 2
    first &= kinds != 0
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in np.flatnonzero((raw == 39) & first).tolist():  # an apostrophe that begins a piece, with its ending
        for ending in _ENDINGS:
            if data.startswith(ending, at + 1):
                first[at + 1] = False
                after = at + 1 + len(ending)
                if after < len(kinds) and kinds[after] == 1:
                    first[after] = True
                break
    kept = kinds != 0
    starts = np.flatnonzero(first[kept])
    body = raw[kept]
    offsets = np.append(starts, len(body)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]), np.flatnonzero(first)


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


_LETTERS = {b: c for b, c in enumerate(byte_letters()) if b != 32}


class WordEncoder:
    def __init__(self, path: str) -> None:
        self.path = path

    def __getstate__(self) -> dict:
        return {"path": self.path}

    @cached_property
    def tokenizer(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one task
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _of_pieces(self):
        """The file's model behind a plain split at spaces, and for each id whether it ends a piece."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        ends = np.zeros(self.vocabulary_size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[i] = bool(suffix) and token.endswith(suffix)
        return plain, ends

    @cached_property
    def _pattern(self) -> str | None:
        """The file's splitting pattern, if its rules are the ones that this class knows."""
        with open(self.path, encoding="utf-8") as f:
            rules = json.load(f)
        try:
            steps = [(n["type"], n.get("content")) for n in rules["normalizer"]["normalizers"]]
            split, mapped = rules["pre_tokenizer"]["pretokenizers"]
            fits = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and rules["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"} and (split["behavior"], split["invert"]) == ("Removed", True) and mapped["type"] == "ByteLevel" and not mapped["use_regex"] and not mapped["add_prefix_space"] and rules["post_processor"] is None and not any(set(t["content"]) & set(" \t\n") for t in rules["added_tokens"])
        except (KeyError, TypeError, ValueError):
            fits = False
        return split["pattern"]["Regex"] if fits else None

    @cached_property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    @cached_property
    def _pieces(self) -> Remembered:
        letters, model = byte_letters(), self.tokenizer.model

        def make(piece: str) -> bytes:
            plain = piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode()])
            return array("I", [t.id for t in model.tokenize(plain)]).tobytes()

        return Remembered(make, KEPT)

    @cached_property
    def _words(self) -> Remembered:
        find, pieces = regex.compile(self._pattern).findall, self._pieces

        letters_first = find("aé") == ["aé"] and all(find(f"ab{m}") == ["ab", m] for m in _MARKS)

        def make(word: str) -> bytes:
            if letters_first and max(word) <= "ÿ":
                if word.isalpha():
                    return pieces[word.lower()]
                if word[-1] in _MARKS and word[:-1].isalpha():
                    return pieces[word[:-1].lower()] + pieces[word[-1]]
            if _PLAIN(word) and "<|" not in word:
                return b"".join(map(pieces.__getitem__, find(word.lower())))
            return self._library(word)

        return Remembered(make, KEPT)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers, without special tokens added."""
        if self._pattern is None or _CONTROL(text):
            return self._library(text)
        return b"".join(map(self._words.__getitem__, text.split()))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode_bytes of each text, many texts at a time."""
        if self._pattern != CUT:
            return [self.encode_bytes(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None or "<|" in text or _CONTROL(text):
                out[i] = self.encode_bytes(text)
                continue
            held.append((i, raw))
            size += len(raw)
            if size >= AT_ONCE:
                self._one_byte(held, out)
                held, size = [], 0
        if held:
            self._one_byte(held, out)
        return out

    def _one_byte(self, held: list[tuple[int, bytes]], out: list[bytes]) -> None:
        """Each different piece of the texts is looked up once; ids are then gathered by Arrow."""
        found, at = cut_pieces(b" ".join([raw for _, raw in held]).translate(_LOWERED))
        coded = found.dictionary_encode()
        ids = pa.array(self._ids_of(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        ends = np.cumsum([len(raw) + 1 for _, raw in held])
        stops = np.searchsorted(at, ends)
        offsets = np.frombuffer(ids.buffers()[1], dtype=np.int32, count=len(ids) + 1) if len(ids) else np.zeros(1, dtype=np.int32)
        body = memoryview(ids.buffers()[2] or b"") if len(ids) else b""
        begin = 0
        for (i, _), stop in zip(held, offsets[stops].tolist(), strict=True):
            out[i] = bytes(body[begin:stop])
            begin = stop

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (one-byte characters, lowered)."""
        known, older = self._known
        found = list(map(known.get, pieces))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = older.get(pieces[i])
                if ids is None:
                    missing.append(i)
                elif len(known) < KEPT:
                    known[pieces[i]] = ids
        for first in range(0, len(missing), CALL):
            some = missing[first : first + CALL]
            words = [pieces[i] for i in some]
            for i, word, ids in zip(some, words, self._tokenised(words), strict=True):
                found[i] = ids
                if len(word) <= 64:
                    known[word] = ids
            if len(known) >= KEPT:
                known, older = self._known = {}, known
        return found

    @cached_property
    def _known(self) -> tuple[dict[bytes, bytes], dict[bytes, bytes]]:
        return {}, {}

    def _tokenised(self, words: list[bytes]) -> list[bytes]:
        plain, ends = self._of_pieces
        text = b" ".join(words).decode("latin-1").encode().decode("latin-1").translate(_LETTERS)
        ids = np.array(plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):  # not a model whose last tokens are marked
            return [array("I", [t.id for t in plain.model.tokenize(w.decode("latin-1").encode().decode("latin-1").translate(_LETTERS))]).tobytes() for w in words]
        data = ids.tobytes()
        cuts = [0, *(4 * stops).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def release(self) -> None:
        """Forgets all pieces and words, and hands freed memory back: a worker outlives its task, and others share its executor."""
        for name in ("_known", "_words", "_pieces"):
            self.__dict__.pop(name, None)
        common.trim_memory()


_MADE: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each process: the file is read once; what a task remembers goes with ``release``."""
    if path not in _MADE:
        _MADE[path] = WordEncoder(path)
    return _MADE[path]
