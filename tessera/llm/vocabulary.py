"""Chunk-cached encoding with the tokenizers library.

A text is split at single spaces and line ends, where the tokenizers here
never join symbols; a chunk is split by the vocabulary's own pattern into words, and
each distinct word is encoded by the library's model once. Both caches map
to little-endian 32-bit ids, so the ids of a text are one bytes.join.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import public_tokenizers
import regex

from .common import held_by_worker

#: Entries kept in each cache of a Python worker before it starts anew.
MOST_CHUNKS, MOST_WORDS = 600_000, 400_000

#: The pattern of the lower-case vocabulary (a fixed value of its file).
_LOWER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class _Words(dict):
    """Word (as its bytes' characters) -> ids."""

    def __init__(self, model):
        super().__init__()
        self.model, self.chars = model, _byte_chars()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        shown = word.encode().decode("latin-1").translate(self.chars)
        got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(word) <= 64:
            self[word] = got
        return got


class _Chunks(dict):
    """Chunk -> ids; None where white space at an end may belong to a neighbour."""

    def __init__(self, words: _Words, pattern: str, spaced: bool, before: str = " "):
        super().__init__()
        self.before, self.words, self.find, self.spaced = before, words, regex.compile(pattern).findall, spaced

    def ids(self, chunk: str) -> bytes:
        if not self.spaced:
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = "".join(c.lower() for c in chunk) if not chunk.isascii() else chunk.lower()
        return b"".join(map(self.words.__getitem__, self.find(chunk)))

    def __missing__(self, chunk: str) -> bytes | None:
        if len(self) >= MOST_CHUNKS:
            self.clear()
        if self.spaced:
            got = None if not chunk or chunk != chunk.strip() else self.ids(self.before + chunk)
        else:
            got = self.ids(chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got


class ChunkEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    spaced: the byte-level vocabulary, whose words keep the space before
    them; a text in which white space meets white space is then split by the
    pattern as a whole. Else the lower-case one, where white space has no id.
    As in the library's default, the string of a special token gives that
    token's id wherever it stands, and splits the text.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only added tokens that match as they stand are supported")
        self.special = {t.content: int(i).to_bytes(4, "little") for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        words = _Words(self.tokenizer.model)
        self.chunks = _Chunks(words, public_tokenizers.PATTERN if spaced else _LOWER, spaced)
        self.firsts = _Chunks(words, public_tokenizers.PATTERN, spaced, "")
        self.line_end = words["\n"] if spaced else b""

    def encode(self, text: str) -> bytes:
        if self.at_special and any(x in text for x in self.special):
            return b"".join(self.special.get(x) or self._plain(x) for x in self.at_special.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        get = self.chunks.__getitem__
        if not self.spaced:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        out = []
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(b"".join([self.firsts[first], *map(get, rest)]))
        except TypeError:  # a None among the parts
            return self.chunks.ids(text)
        return self.line_end.join(out)


def chunk_encoder(path: str, spaced: bool) -> ChunkEncoder:
    return held_by_worker(("chunks", path), lambda: ChunkEncoder(path, spaced))


def slices(texts: list[str], most_chars: int = 2_000_000):
    """Consecutive ranges of texts of at most so many characters together (or one text)."""
    at = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most_chars:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, len(texts)
