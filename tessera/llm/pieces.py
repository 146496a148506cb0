"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 4)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_by_worker, id_column, ids_of, ragged, table, text_column
from .vocabulary import slices

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_FAR = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)  # golden ratio, for multiplicative hashing


class PieceModel:
    """A BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str, most: int = 700_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        if any(SPACE in p[1:] and p.strip(SPACE) for p, _, kind in pieces if kind == 1):
            raise ValueError("the model has pieces that span words")
        self.unk, self.bos, self.eos = 0, 1, 2
        for i, (_, _, kind) in enumerate(pieces):
            if kind == 2:
                self.unk = i
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.n = len(pieces)
        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.byte_id = np.zeros(256, np.int64)
        self.surface: list[bytes] = []
        self.is_byte = np.zeros(self.n, bool)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_id[int(p[1:-1], 16)] = i
                self.is_byte[i] = True
            self.surface.append(bytes([int(p[1:-1], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode())
        score = np.array([s for _, s, _ in pieces])
        order = np.unique(-score, return_inverse=True)[1]
        # symbols: the ids of pieces; characters that are no piece come after them
        self.symbol = dict(self.id_of)
        pairs = {}
        together: set[tuple[str, str]] = set()  # symbols that stand side by side within some piece
        unsafe = np.zeros(self.n, bool)
        for p, i in self.id_of.items():
            parts = [[p[a:b] for b in range(a + 1, len(p) + 1) if b == a + 1 or p[a:b] in self.id_of] for a in range(len(p))]
            together.update((x, y) for a in range(len(p) - 1) for x in parts[a] if a + len(x) < len(p) for y in parts[a + len(x)])
            for cut in range(1, len(p)):
                halves = p[:cut], p[cut:]
                if all(len(x) == 1 or x in self.id_of for x in halves):
                    a, b = (self.symbol.setdefault(x, self.n + len(self.symbol)) for x in halves)
                    pairs[a << 32 | b] = i
                    for x in halves:  # a longer piece that is as good as its part: only the leftmost may merge at once
                        if len(x) > 1 and order[i] <= order[self.id_of[x]]:
                            unsafe[self.id_of[x]] = True
        ties = np.bincount(order[list(self.id_of.values())], minlength=order.max() + 1)
        self.unsafe = unsafe | (ties[order] > 1)
        for x, y in together:
            pairs.setdefault(self.symbol.setdefault(x, self.n + len(self.symbol)) << 32 | self.symbol.setdefault(y, self.n + len(self.symbol)), -1)
        self._index(pairs, order)
        self.most = most
        self.cache: dict[str, bytes] = {}
        if any("\n" in p for p in self.id_of):
            raise ValueError("the model has pieces with line ends")
        self.line_end = int(self.byte_id[10]).to_bytes(4, "little")

    def _index(self, pairs: dict[int, int], order: np.ndarray) -> None:
        """Pairs in an open-addressed table of arrays: looked up by a multiplication and a few probes.

        Pairs that merge have the rank and id of their piece. Those that only
        stand side by side within a piece have _FAR: what lies around them
        may yet merge across. All others never do.
        """
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int64)
        self.table_rank = np.full(1 << bits, _FAR, np.int32)
        self.table_piece = np.full(1 << bits, -1, np.int32)
        self.probes = 1
        key = np.fromiter(pairs.keys(), np.int64, len(pairs))
        piece = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)
        while len(key):  # each free slot takes the first that asks for it; the others try the next one
            free = self.table[slot] == -1
            taker = np.zeros(len(key), bool)
            taker[np.unique(slot, return_index=True)[1]] = True
            taker &= free
            at = slot[taker]
            self.table[at], self.table_piece[at] = key[taker], piece[taker]
            self.table_rank[at] = np.where(piece[taker] >= 0, order[piece[taker]], _FAR)
            key, piece, slot = key[~taker], piece[~taker], (slot[~taker] + 1) & int(self.mask)
            self.probes += len(key) > 0

    def _ranked(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank (far: none) and merged piece of the pair that begins at each of these places, and whether anything can ever merge across it."""
        right = np.minimum(at + 1, len(sym) - 1)
        same = (word[at] == word[right]) & (right > at)
        key = sym[at] << 32 | sym[right]
        slot = (key.view(np.uint64) * _MIX) >> self.shift
        for _ in range(self.probes):
            other = self.table[slot] != key
            other &= self.table[slot] != -1
            if not other.any():
                break
            slot = np.where(other, (slot + np.uint64(1)) & self.mask, slot)
        found = same & (self.table[slot] == key)
        return np.where(found, self.table_rank[slot], _FAR), self.table_piece[slot], found

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has.

        Flat arrays hold all symbols. Segments begin as words, and are cut
        wherever two neighbours stand side by side in no piece: what lies on
        either side of such a place never merges across it, so the sides are
        independent from then on. In each round every segment finds its
        best pair; all its leftmost occurrences merge at once where nothing
        better can come of that, else the first alone; merged symbols are
        taken out; segments without a pair leave. Segments soon are a few
        symbols long, so that rounds don't grow with the length of a word.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        get, later = self.symbol.get, self.n + len(self.symbol)
        chars = list(text)
        sym = np.fromiter((get(c, later + 1) for c in chars), np.int64, len(chars))
        word = of = np.repeat(np.arange(len(words), dtype=np.int32), size)
        char = np.arange(len(chars), dtype=np.int32)
        rank, piece, joins = self._ranked(sym, word, np.arange(len(sym)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            # segments end where nothing joins
            word = np.cumsum(~joins, dtype=np.int32) - ~joins
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            best = np.repeat(best, length)
            over = best == _FAR
            if over.any():
                done.append((sym[over], char[over]))
                keep = ~over
                sym, word, char, rank, piece, joins, best = (x[keep] for x in (sym, word, char, rank, piece, joins, best))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            w = word[at]
            # of hits that overlap the one before, every other one merges
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (w[1:] != w[:-1])])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = (np.arange(len(at)) - begin) % 2 == 0
            lead = np.concatenate([[True], w[1:] != w[:-1]])
            take &= lead | ~self.unsafe[piece[at]]
            at = at[take]
            sym[at] = piece[at]
            keep, changed = np.ones(len(sym), bool), np.zeros(len(sym), bool)
            keep[at + 1] = False
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            sym, word, char, rank, piece, joins, changed = (x[keep] for x in (sym, word, char, rank, piece, joins, changed))
            at = np.flatnonzero(changed)
            rank[at], piece[at], joins[at] = self._ranked(sym, word, at)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym, char = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(char)
        sym, char = sym[order], char[order]
        word = of[char]
        other = np.flatnonzero(sym >= self.n)
        count = np.ones(len(sym), np.int64)
        if len(other):  # characters without a piece become bytes
            raw = [chars[i].encode() for i in char[other].tolist()]
            count[other] = [len(x) for x in raw]
            to = np.cumsum(count) - count
            out = np.repeat(sym, count)
            out[ragged(to[other], count[other])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym = out
        return sym, np.bincount(word, weights=count, minlength=len(words)).astype(np.int64)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] != " " and "  " not in text and SPACE not in text and text[-1] != " ":
            return text.split(" ")
        return [x[1:] for x in _WORD.findall(SPACE + text.replace(" ", SPACE))]  # each has a leading space

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without begin and end, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > self.most:
            self.cache.clear()
        parts = [self.words(x) for x in texts]
        new: set[str] = set()
        for x in parts:
            new.update(x)
        new.difference_update(self.cache)
        learn = list(new)
        for i in range(0, len(learn), 20_000):
            self._learn(learn[i : i + 20_000])
        return [b"".join(map(self.cache.__getitem__, x)) for x in parts]

    def _learn(self, words: list[str]) -> None:
        """No piece holds a line end beside other characters, so lines of a word are merged apart."""
        lines = [(SPACE + x).split("\n") for x in words]
        known = list(dict.fromkeys(y for x in lines for y in x))
        ids, lengths = self.merge(known)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(lengths)).tolist()
        of = {x: raw[a:b] for x, a, b in zip(known, [0, *ends], ends)}
        self.cache.update((x, self.line_end.join(map(of.__getitem__, y))) for x, y in zip(words, lines))

    def decode(self, ids: np.ndarray) -> str:
        """The text of these ids; the dummy prefix goes, byte pieces that are no UTF-8 become U+FFFD each."""
        ids = ids[(ids != self.bos) & (ids != self.eos)]
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if raw[:1] == b" " and len(ids) and ids[0] != self.unk and not self.is_byte[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def piece_model(path: str) -> PieceModel:
    return held_by_worker(("pieces", path), lambda: PieceModel(path))


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (begin and end included) and the decoded text; a null text counts as empty, rows repeat as they come."""
    return _encoded(docs, model, "doc_id long, ids array<int>, decoded string", lambda ids, text: (ids.tolist(), text))


def _encoded(docs: DataFrame, model: str | None, schema: str, made) -> DataFrame:
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_model(path)
        for batch in batches:
            texts, keys = batch["text"].tolist(), ids_of(batch["doc_id"])
            for a, b in slices(texts):
                rows = []
                for raw in pieces.encode(texts[a:b]):
                    ids = np.concatenate([[pieces.bos], np.frombuffer(raw, "<u4"), [pieces.eos]])
                    rows.append(made(ids, pieces.decode(ids)))
                out = pd.DataFrame(rows, columns=names[1:])
                out.insert(0, "doc_id", pd.array(keys[a:b], dtype="Int64"))
                yield out

    return docs.select(id_column(), text_column().alias("text")).mapInPandas(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of documents.

    Null and empty texts are the begin and end ids alone; a null doc_id stays
    null; repeated rows come as often as they are; no rows give none; texts
    are encoded whole, in time that grows with their length, spaces or not.
    """
    def digest(ids: np.ndarray, text: str) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _encoded(table(spark, sf_dir, "documents"), None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)
