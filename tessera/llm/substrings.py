"""Repeated-substring removal by longest-previous-factor arrays (operator 1).

A byte goes if a ``window``-byte string over it also starts in a document
with a smaller doc_id. The suffixes of the whole corpus are never in one
place; they are dealt out so that equal windows meet:

1. Each window has a key, the least hash of the ``anchor``-byte strings in
   it. Neighbouring windows mostly share their key and form a run. Blocks
   of documents send each distinct key once to the key's bucket, which
   answers which keys another block has as well.
2. Blocks send the bytes of the runs with such keys, each distinct string
   once. The bucket sorts the suffixes of all strings of a key and works out
   their longest previous factors (suffix order, common prefixes of
   neighbours, previous and next smaller document); where one is at least
   ``window`` long, the window is a repeat. A string that a smaller document
   has whole needs no sort: its suffixes' factors reach its end.
3. Blocks take the answers and cut the texts.

Blocks are dealt by row, whatever the ids, and written once, in buckets, so
that all three steps read them where they lie.

Whole copies of a document are found first by digest, so that copies send
nothing. A key of very many documents is marked hot in step 1; its runs are
sent window by window under the window's own hash, so that the edges of a
passage that very many documents share spread over all buckets.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from .common import bucketed, materialize, ragged, ship, table, text_column

WINDOW, ANCHOR = 50, 16
#: Text of one block; documents longer than that make larger blocks.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 48
#: A key of so many documents is hot.
HOT_DOCUMENTS = 4096
#: Windows per run at most: answers are bit masks of 64.
RUN = 64
#: Suffixes that are sorted at once; those of one key stay together.
SUFFIXES = 50_000
_NULL_ID = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # fixed multipliers of a 64-bit mixer
#: Types of the columns that go before the bytes of runs: key, doc_id, row, first window, number of windows.
HEAD = "<u8", "<i8", "<u4", "<u8", "<u1"
SIDE = "block int, kind int, bucket int, a binary, b binary"


def rolling_hash(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes that start at a place, by doubling; k may be any number."""
    with np.errstate(over="ignore"):
        level = raw.astype(np.uint64) + np.uint64(1)
        out, done, mult, size = None, 0, _MIX[0], 1
        while True:
            if k & size:
                if out is None:
                    out = level
                else:
                    n = len(raw) - (done + size) + 1
                    out = out[:n] * mult + level[done : done + n]
                done += size
            if size * 2 > k:
                break
            level = level[:-size] * mult + level[size:]
            mult, size = mult * mult, size * 2
        out = out ^ (out >> np.uint64(31))
        out *= _MIX[1]
        out ^= out >> np.uint64(29)
    return out


def window_runs(text: bytes, window: int, anchor: int, stretch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each run; long texts are taken in stretches."""
    raw = np.frombuffer(text, np.uint8)
    got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(raw) - window + 1, stretch):
        key, first, length = _runs(raw[at : at + stretch + window - 1], window, anchor)
        got.append((key, first + at, length))
    return tuple(np.concatenate(x) for x in zip(*got))


def _runs(raw: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    least, size, span = rolling_hash(raw, anchor), 1, window - anchor + 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: size - span], least[span - size :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    length = np.diff(np.append(first, len(least)))
    if length.max() > RUN:
        parts = -(-length // RUN)
        step = ragged(np.zeros(len(parts), np.int64), parts) * RUN
        first, length = np.repeat(first, parts) + step, np.repeat(length, parts)
        length = np.minimum(length - step, RUN)
    return least[first], first, length


def nearest_smaller(value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before it with a smaller value, or -1, and the least ``common`` on the way to it, by pointer jumping.

    common[i] belongs to the step from i - 1 to i.
    """
    at, least = np.arange(len(value)) - 1, common.copy()
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[value[at[todo]] >= value[todo]]
        over = at[todo]
        least[todo] = np.minimum(least[todo], least[over])
        at[todo] = at[over]
        todo = todo[at[todo] >= 0]
    least[at < 0] = 0
    return at, least


def longest_previous_factor(suffixes: np.ndarray, length: np.ndarray, document: np.ndarray) -> np.ndarray:
    """How much of each suffix, from its start, also starts in a smaller document.

    suffixes is a matrix of bytes, a suffix a row, of which ``length`` count.
    Rows are sorted; neighbours' longest common prefixes are taken; and as a
    prefix that two suffixes share is the least one between them, the longest
    factor of a smaller document lies at the nearest place of such a document
    before or after in suffix order.
    """
    n, width = suffixes.shape
    inside = np.arange(width) < length[:, None]
    padded = np.ascontiguousarray(np.where(inside, suffixes, 0))
    keys = padded.view(f"S{width}").reshape(-1)
    # padding looks like a zero byte; only where there are such bytes must shorter ones come first
    order = np.lexsort((length, keys)) if ((padded == 0) & inside).any() else np.argsort(keys)
    text, doc, size = suffixes[order], document[order], length[order]
    common = np.zeros(n, np.int64)
    differs = text[1:] != text[:-1]
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    before = nearest_smaller(doc, common)[1]
    after = nearest_smaller(doc[::-1], np.append(0, common[:0:-1]))[1][::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


class _Block:
    """The documents of one block in a fixed order; copies of earlier documents take no part in the search."""

    def __init__(self, docs: pd.DataFrame, firsts: dict[str, int]):
        docs = docs.sort_values(["key", "text"], kind="stable")
        self.docs = docs
        self.ids = docs["key"].to_numpy(np.int64)
        self.null = docs["no_id"].to_numpy(bool)
        self.texts = [x.encode() for x in docs["text"]]
        first = [firsts.get(hashlib.md5(x).hexdigest(), _NULL_ID) for x in self.texts] if firsts else [_NULL_ID] * len(self.texts)
        self.copy = np.array(first, np.int64) < self.ids if len(first) else np.zeros(0, bool)

    def runs(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, row, first window and number of windows of all runs."""
        got = [(i, *window_runs(x, window, anchor)) for i, x in enumerate(self.texts) if not self.copy[i]]
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.repeat([g[0] for g in got], [len(g[1]) for g in got])
        key, first, length = (np.concatenate([g[k] for g in got]) for k in (1, 2, 3))
        return key, rows.astype(np.int64), first, length


def _firsts(side: pd.DataFrame) -> dict[str, int]:
    rows = side[side["kind"] == 0]
    return {a.decode(): int(b) for a, b in zip(rows["a"], rows["b"])}


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "a", "b"]).astype({"block": np.int32, "kind": np.int32, "bucket": np.int32})


def spans_of(texts: list[bytes], starts: list[np.ndarray], ends: list[np.ndarray]) -> dict[str, list]:
    """text, and the spans of bytes to remove (starts and ends)."""
    return {"text": [x.decode() for x in texts], "starts": [x.tolist() for x in starts], "ends": [x.tolist() for x in ends]}


SPANS = "text string, starts array<long>, ends array<long>"


def repeated_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, carry: tuple[str, ...] = (), make=spans_of, schema: str = SPANS) -> DataFrame:
    """doc_id, what make(texts as bytes, starts, ends) gives for the spans to remove, and the columns to carry.

    Null texts are empty. Rows of one doc_id remove nothing from each other;
    a null doc_id counts as larger than all others. Repeated rows come each;
    no rows give none; texts are taken whole, however long; columns that are
    not carried are ignored.
    """
    spark = docs.sparkSession
    # pandas would turn ids beside nulls into floating point
    doc_id = F.col("doc_id").cast("long")
    own = [F.coalesce(doc_id, F.lit(_NULL_ID)).alias("key"), doc_id.isNull().alias("no_id"), text_column().alias("text")]
    size = docs.agg(F.sum(F.octet_length(text_column())).alias("n")).collect()[0]["n"] or 0
    blocks = max(LEAST_BLOCKS, ceil(size / BLOCK_BYTES))
    inner = [f"carried_{i}" for i in range(len(carry))]  # carried columns may have the names used here
    whole = docs.select(*own, *[F.col(f"`{x}`").alias(y) for x, y in zip(carry, inner)])
    whole = bucketed(whole.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "block", blocks, "blocks")
    dealt = whole.select("key", "no_id", "text", "block")

    # the first document of each text that occurs again, told to the blocks that hold it
    held = dealt.groupBy(F.md5(F.col("text").cast("binary")).alias("digest"), "block").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    held = held.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_set("block").alias("blocks")).where("n > 1")
    firsts = materialize(held.select(F.explode("blocks").alias("block"), "digest", "first"), "copies")

    copies = firsts.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.col("digest").cast("binary").alias("a"), F.col("first").cast("string").cast("binary").alias("b"))

    def send_keys(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _table([])
        key, row, _, _ = _Block(docs, _firsts(side)).runs(window, anchor)
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        start = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        documents = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else start
        first = np.flatnonzero(start)
        count = np.add.reduceat(documents.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
        bucket = _split(key, blocks)
        hot = np.minimum(count, 255).astype(np.uint8)
        b = int(docs["block"].iloc[0])
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(blocks + 1))
        return _table([(b, 1, i, key[order[lo:hi]].tobytes(), hot[order[lo:hi]].tobytes()) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo])

    def answer_keys(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        keys = [np.frombuffer(x, np.uint64) for x in rows["a"]]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["b"]]).astype(np.int64)
        size = [len(x) for x in keys]
        key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys)), size)
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        total = np.add.reduceat(counts[order], start)
        senders = np.diff(np.append(start, len(order)))
        shared = np.repeat(total >= 2, senders)
        hot = np.repeat(total >= HOT_DOCUMENTS, senders)
        out = []
        owner, key = owner[order], key[order]
        by = np.argsort(owner[shared], kind="stable")
        owner, key, hot = owner[shared][by], key[shared][by], hot[shared][by]
        edges = np.searchsorted(owner, np.arange(len(keys) + 1))
        for b, lo, hi in zip(rows["block"], edges[:-1], edges[1:]):
            if hi > lo:
                out.append((b, 2, rows["bucket"].iloc[0], key[lo:hi].tobytes(), hot[lo:hi].astype(np.uint8).tobytes()))
        return _table(out)

    def send_runs(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return _table([])
        block = _Block(docs, _firsts(side))
        told = side[side["kind"] == 2]
        if not len(told):
            return _table([])
        known = np.concatenate([np.frombuffer(x, np.uint64) for x in told["a"]])
        hot = np.concatenate([np.frombuffer(x, np.uint8) for x in told["b"]])
        order = np.argsort(known)
        known, hot = known[order], hot[order].astype(bool)
        key, row, first, length = block.runs(window, anchor)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        keep = known[at] == key
        key, row, first, length, hot = key[keep], row[keep], first[keep], length[keep], hot[at[keep]]
        if hot.any():  # one run for each window, under its own hash
            h, rest = np.flatnonzero(hot), ~hot
            r, f = np.repeat(row[h], length[h]), ragged(first[h], length[h])
            own = np.fromiter((hash_of(block.texts[i][a : a + window]) for i, a in zip(r.tolist(), f.tolist())), np.uint64, len(r))
            key, row, first, length = (np.concatenate(x) for x in ((key[rest], own), (row[rest], r), (first[rest], f), (length[rest], np.ones(len(r), np.int64))))
        # rows are in document order: the first document of each string asks, later ones are repeats
        order = np.lexsort((first, row))
        asked: dict[bytes, int] = {}
        sent, gone = [], []
        ids, texts = block.ids, block.texts
        for n, (i, a, w) in enumerate(zip(row[order].tolist(), first[order].tolist(), length[order].tolist())):
            s = texts[i][a : a + w + window - 1]
            d = asked.setdefault(s, ids[i])
            if d == ids[i]:
                sent.append((n, s))
            else:
                gone.append(n)
        b = int(docs["block"].iloc[0])
        out = []
        if gone:
            g = order[gone]
            out.append((b, 4, b, np.stack([row[g], first[g], first[g] + length[g] + window - 1]).astype("<i8").tobytes(), b""))
        pick = order[[n for n, _ in sent]]
        strings = [s for _, s in sent]
        bucket = _split(key[pick], blocks)
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(blocks + 1))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if hi > lo:
                p, some = pick[by[lo:hi]], by[lo:hi]
                # the key, the document, the row and first window of each run, then its bytes
                head = b"".join(x.astype(t).tobytes() for x, t in zip((key[p], ids[row[p]], row[p], first[p], length[p]), HEAD))
                out.append((b, 3, i, head, b"".join(map(strings.__getitem__, some.tolist()))))
        return _table(out)

    def answer_runs(rows: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(x) for x in rows[rows["kind"] == 4].itertuples(index=False)]
        rows = rows[rows["kind"] == 3].sort_values("block")
        if not len(rows):
            return _table(out)
        width = sum(np.dtype(t).itemsize for t in HEAD)
        counts = [len(x) // width for x in rows["a"]]
        owner = np.repeat(rows["block"].to_numpy(), counts)
        raw = b"".join([*rows["b"], bytes(RUN + window)])  # so that the last suffixes can be read at full width
        columns, at = [], [0] * len(counts)
        for t in HEAD:
            columns.append(np.concatenate([np.frombuffer(x, t, n, i) for x, n, i in zip(rows["a"], counts, at)]))
            at = [i + n * np.dtype(t).itemsize for i, n in zip(at, counts)]
        key, doc, row, first, length = columns[0], *(x.astype(np.int64) for x in columns[1:])
        size = length + window - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, key))
        group = np.concatenate([[True], np.diff(key[order]) != 0])
        edges = np.append(np.flatnonzero(group), len(order))
        mask_rows, mask_bits = [], []
        pending: list[np.ndarray] = []
        held = 0

        def resolve() -> None:
            """Suffix-sort the windows of whole groups of strings."""
            reps = np.concatenate(pending)
            n = length[reps]
            start, left = ragged(begin[reps], n), ragged(np.zeros(len(reps), np.int64), n)
            left = np.repeat(size[reps], n) - left
            rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), int(left.max()))[start]
            gone = longest_previous_factor(rows, left, np.repeat(doc[reps], n)) >= window
            mask_rows.append(reps)
            mask_bits.append(np.split(gone, np.cumsum(n)[:-1]))

        whole: list[int] = []
        same: list[tuple[int, int]] = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo < 2:
                continue
            members = order[lo:hi]
            leaders: dict[bytes, int] = {}
            reps = []
            for m in members.tolist():
                s = raw[begin[m] : begin[m] + size[m]]
                leader = leaders.setdefault(s, m)
                if leader == m:
                    reps.append(m)
                elif doc[leader] < doc[m]:
                    whole.append(m)
                else:
                    same.append((m, leader))  # again in the same document
            if len(reps) > 1:
                pending.append(np.array(reps))
                held += int(length[reps].sum())
                if held > SUFFIXES:
                    resolve()
                    pending, held = [], 0
        if pending:
            resolve()
        found: dict[int, np.ndarray] = {m: bits for rs, bs in zip(mask_rows, mask_bits) for m, bits in zip(rs.tolist(), bs) if bits.any()}
        for m, leader in same:
            if leader in found:
                found[m] = found[leader]
        spans: dict[int, list[np.ndarray]] = {}
        if whole:
            w = np.array(whole)
            for b in np.unique(owner[w]):
                some = w[owner[w] == b]
                spans.setdefault(int(b), []).append(np.stack([row[some], first[some], first[some] + size[some]]))
        for m, bits in found.items():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], bits.astype(np.int8), [0]])))
            a, z = edge[::2] + first[m], edge[1::2] + first[m] + window - 1
            spans.setdefault(int(owner[m]), []).append(np.stack([np.full(len(a), row[m]), a, z]))
        out.extend((b, 4, 0, np.concatenate(x, axis=1).astype("<i8").tobytes(), b"") for b, x in spans.items())
        return _table(out)

    def cut(docs: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({x: [] for x in fields.names})
        block = _Block(docs, _firsts(side))
        told = [np.frombuffer(x, "<i8").reshape(3, -1) for x in side.loc[side["kind"] == 4, "a"]]
        row, a, z = np.concatenate(told, axis=1) if told else np.zeros((3, 0), np.int64)
        order = np.lexsort((a, row))
        row, a, z = row[order], a[order], z[order]
        edges = np.searchsorted(row, np.arange(len(block.texts) + 1))
        starts, ends = [], []
        for i, text in enumerate(block.texts):
            x, y = (np.array([0]), np.array([len(text)])) if block.copy[i] and len(text) >= window else union(a[edges[i] : edges[i + 1]], z[edges[i] : edges[i + 1]])
            starts.append(x)
            ends.append(y)
        out = block.docs[inner].assign(**make(block.texts, starts, ends))
        return out.assign(doc_id=pd.arrays.IntegerArray(block.ids, block.null))[fields.names]

    made = _parse_datatype_string(schema)
    fields = StructType([StructField("doc_id", LongType()), *made, *[StructField(y, docs.schema[x].dataType) for x, y in zip(carry, inner)]])

    texts = dealt.groupBy("block")
    keys = texts.cogroup(copies.groupBy("block")).applyInPandas(send_keys, SIDE)
    # a partition for each bucket: none holds two of them, at any size
    by_bucket = lambda rows: rows.repartitionById(blocks, F.col("bucket")).groupBy("bucket")
    shared = by_bucket(keys).applyInPandas(answer_keys, SIDE)
    shared = materialize(shared, "shared-keys")
    runs = texts.cogroup(shared.unionByName(copies).groupBy("block")).applyInPandas(send_runs, SIDE)
    answers = materialize(by_bucket(runs).applyInPandas(answer_runs, SIDE), "repeats")
    return whole.groupBy("block").cogroup(answers.unionByName(copies).groupBy("block")).applyInPandas(cut, fields).toDF("doc_id", *made.names, *carry)


def hash_of(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")


def union(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of these spans, sorted by start; touching spans join."""
    if not len(a):
        return a, z
    reach = np.maximum.accumulate(z)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def kept_text(text: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the whole characters of these spans."""
    follows = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    a, z = starts.copy(), ends.copy()
    for i in range(len(a)):
        while follows(a[i]):
            a[i] += 1
        while follows(z[i]):
            z[i] -= 1
    return kept_bytes(text, a, z).decode()


def kept_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, out = 0, []
    for a, z in zip(starts.tolist(), ends.tolist()):
        out.append(text[at:a])
        at = z
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with repeated substrings cut from text, and n_chars, if there is such a column, set to what is left.

    Spans are narrowed to whole characters. Documents of which nothing but
    white space is left, though they had more, go.
    """
    def make(texts: list[bytes], starts: list[np.ndarray], ends: list[np.ndarray]) -> dict[str, list]:
        kept = [kept_text(t, a, z) if len(a) else t.decode() for t, a, z in zip(texts, starts, ends)]
        return {"kept": kept, "stays": [bool(k.strip()) or not t.strip() for k, t in zip(kept, texts)]}

    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    renamed = docs.toDF(*[f"other_{others.index(c)}" if c in others else c for c in docs.columns])
    found = repeated_substrings(renamed, window, anchor, tuple(f"other_{i}" for i in range(len(others))), make, "kept string, stays boolean").where("stays")
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            columns.append(F.length("kept").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("kept" if c == "text" else c if c == "doc_id" else f"other_{others.index(c)}").alias(c))
    return found.select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of documents; nulls, ties, long texts and empty tables as repeated_substrings() has them."""
    def digest(texts: list[bytes], starts: list[np.ndarray], ends: list[np.ndarray]) -> dict[str, list]:
        kept = [kept_bytes(*x) for x in zip(texts, starts, ends)]
        sizes = list(map(len, texts))
        return {"n_bytes": sizes, "n_removed": [n - len(k) for n, k in zip(sizes, kept)], "n_spans": list(map(len, starts)), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    return repeated_substrings(table(spark, sf_dir, "documents"), make=digest, schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string")
