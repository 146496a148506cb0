"""Cost-balanced packing of documents into fixed-capacity sequences (operator 3).

Estimated cost of a piece of n tokens is linear * n + quadratic * n * n.
Each task packs its own documents: documents in descending order go to the
cheapest sequence with room for them; a document for which no sequence has
room is cut over the sequences with most room, so that all sequences of a
task but the last few tokens are full. No shuffle: a task gathers documents
until they hold ``pack_tokens`` tokens, packs them, and goes on, so memory
is bounded whatever the number of rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, ids_of, table, text_column
from .vocabulary import chunk_encoder

CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def pack(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths; zero lengths give no piece.

    Uses the least number of sequences that can hold all tokens. Ties go to
    the earlier document and the lower sequence.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    used = np.zeros(n, np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    items: list[tuple[int, int, int]] = []  # (-length, document, start)
    sequence = 0
    for d, size in enumerate(lengths.tolist()):
        start = 0
        while size - start >= capacity:
            pieces.append((d, start, capacity, sequence, 0))
            used[sequence] = capacity
            sequence, start = sequence + 1, start + capacity
        if size > start:
            items.append((start - size, d, start))
    cost = lambda x: linear * x + quadratic * x * x
    costs = dict.fromkeys(range(sequence, n), 0.0)

    # sequences by room, each room's as a heap by cost; a segment tree over rooms holds the least of them
    leaves = 1 << capacity.bit_length()
    by_room: dict[int, list[tuple[float, int]]] = {capacity: [(0.0, s) for s in costs]}
    none = (float("inf"), -1)
    least = [none] * (2 * leaves)

    def renew(r: int) -> None:
        at = leaves + r
        least[at] = by_room[r][0] if by_room[r] else none
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def cheapest(size: int) -> int:
        """The cheapest sequence with that much room, -1 if there is none."""
        at = leaves + size
        found = least[at]
        while at > 1:
            if at % 2 == 0:
                found = min(found, least[at + 1])
            at >>= 1
        return found[1]

    renew(capacity)

    def put(d: int, start: int, size: int, s: int) -> None:
        pieces.append((d, start, size, s, int(used[s])))
        used[s] += size
        costs[s] += cost(size)

    items.sort()
    cut: list[tuple[int, int, int]] = []
    for minus, d, start in items:
        size = -minus
        s = cheapest(size)
        if s < 0:
            cut.append((d, start, size))
            continue
        r = capacity - int(used[s])
        heapq.heappop(by_room[r])
        renew(r)
        put(d, start, size, s)
        if r > size:
            heapq.heappush(by_room.setdefault(r - size, []), (costs[s], s))
            renew(r - size)
    room = [(int(used[s]) - capacity, s) for s in costs if used[s] < capacity]
    heapq.heapify(room)
    for d, start, size in cut:
        while size:
            left, s = heapq.heappop(room)
            take = min(size, -left)
            put(d, start, take, s)
            start, size = start + take, size - take
            if left + take < 0:
                heapq.heappush(room, (left + take, s))
    return pieces


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1, pack_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece; other columns of docs are ignored, whatever their names.

    Null and empty texts are documents of the end id alone; a null doc_id
    stays null. Repeated rows are packed each. Texts of more tokens than a
    sequence has are cut into whole sequences and a rest. No rows give no
    pieces. Sequence ids are unique: the task's number, then a count.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def flush(doc_ids: list, ids: list[np.ndarray], base: int) -> tuple[pd.DataFrame, int]:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        rows = pack(lengths, capacity)
        out = pd.DataFrame(rows, columns=["d", "start", "length", "sequence_id", "offset"])
        out["ids_crc32"] = [zlib.crc32(ids[d][s : s + n].tobytes()) for d, s, n, _, _ in rows]
        out["doc_tokens"] = lengths[out["d"].to_numpy()] if rows else []
        out["doc_id"] = pd.array([doc_ids[d] for d in out["d"]], dtype="Int64")
        n = out["length"].to_numpy(np.float64)
        out["cost"] = n + n * n / capacity
        out["sequence_id"] += base
        return out[[x.split()[0] for x in SCHEMA.split(", ")]], base + int(-(-lengths.sum() // capacity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = chunk_encoder(path, False)
        end = int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36
        doc_ids: list = []
        ids: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for key, text in zip(ids_of(batch["doc_id"]), batch["text"].tolist()):
                ids.append(np.frombuffer(encoder.encode(text) + end, "<u4"))
                doc_ids.append(key)
                held += len(ids[-1])
                if held >= pack_tokens:
                    out, base = flush(doc_ids, ids, base)
                    yield out
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield flush(doc_ids, ids, base)[0]

    return docs.select(id_column(), text_column().alias("text")).mapInPandas(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; nulls, ties, long texts and empty tables as pack_documents() has them."""
    return pack_documents(table(spark, sf_dir, "documents"))
