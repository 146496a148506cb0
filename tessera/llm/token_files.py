"""Token ids in Arrow files of fixed-size-list batches (operator 7).

Each range of doc_id becomes one Arrow IPC file: equal-length sequences of
ids beside their masks, uncompressed, so that any sequence and its mask are
slices of a memory map, without a copy. A table beside the files says where each
document lies. File names are new for each task attempt and only the rows
of finished tasks reach that table, so attempts that were lost leave
nothing that is read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, ids_of, materialize, shared_dir, table, text_column, written_folder
from .vocabulary import chunk_encoder

SEQUENCE, PER_BATCH = 2048, 64
INDEX = "doc_id long, path string, shard long, first long, n_tokens long"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class TokenFileWriter:
    """append(ids) as often as wanted, then close(); the last sequence is padded and masked."""

    def __init__(self, uri: str, dtype: str, sequence: int = SEQUENCE, per_batch: int = PER_BATCH):
        fs, path = _place(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.dtype, self.sequence, self.block = np.dtype(dtype), sequence, sequence * per_batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.written = 0

    def append(self, ids: np.ndarray) -> int:
        """The place of the first of these ids in the file."""
        at = self.written + self.size
        self.held.append(ids.astype(self.dtype))
        self.size += len(ids)
        while self.size >= self.block:
            flat = np.concatenate(self.held)
            self._write(flat[: self.block], self.block)
            self.held, self.size = [flat[self.block :]], len(flat) - self.block
        return at

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)], schema=self.schema))
        self.written += real

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            self._write(np.pad(ids, (0, -len(ids) % self.sequence)), len(ids))
        self.file.close()
        self.sink.close()


class TokenFile:
    """Random access: file[i] gives sequence i's ids (numpy) and mask (an Arrow boolean array), both views of the file; span(at, n) gives ids that may cross sequences."""

    def __init__(self, uri: str):
        fs, path = _place(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.held: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, i: int) -> pa.RecordBatch:
        """Batch i; the last one asked for is kept, as reading in order from a store without memory maps would fetch it again and again."""
        if self.held is None or self.held[0] != i:
            self.held = i, self.file.get_batch(i)
        return self.held[1]

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.per_batch + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        batch = self._batch(i // self.per_batch).slice(i % self.per_batch, 1)
        ids, mask = (batch.column(k).flatten() for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def span(self, at: int, n: int) -> np.ndarray:
        block, out = self.sequence * self.per_batch, []
        while n > 0:
            flat = self._batch(at // block).column(0).flatten().to_numpy()
            part = flat[at % block : at % block + n]
            out.append(part)
            at, n = at + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents in ascending doc_id order; returns doc_id, path, shard, first (place in the file), n_tokens, start.

    Null texts are empty; null doc_ids come first; repeated rows are written
    each, rows of one doc_id in no stated order. Long texts are rows like
    others, no rows give no files, and other columns of docs are ignored.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = chunk_encoder(path, True)
        end = int(end_id).to_bytes(4, "little")
        dtype = "uint16" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "uint32"
        shard = TaskContext.get().partitionId()
        uri, writer = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            rows = []
            for key, text in zip(ids_of(batch["doc_id"]), batch["text"].tolist()):
                writer = writer or TokenFileWriter(uri, dtype)
                ids = np.frombuffer(encoder.encode(text) + end, "<u4")
                rows.append((key, uri, shard, writer.append(ids), len(ids)))
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))
        if writer:
            writer.close()

    # ranges of (doc_id, hash, row): rows of one id, null or not, may lie in several
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    ordered = ordered.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    ordered = ordered.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select(id_column(), "text")
    written_folder(folder)
    index = materialize(ordered.mapInPandas(run, INDEX), "token-index")
    # one row per file: its number of ids, then the ids of all files before it
    sizes = sorted((r["shard"], r["n"]) for r in index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    spark = docs.sparkSession
    starts = spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, before)], "shard long, base long")
    return index.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_token_files(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files that this index names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for batch in batches:
            crc = np.zeros(len(batch), np.int64)
            for i, (uri, first, n) in enumerate(zip(batch["path"], batch["first"], batch["n_tokens"])):
                if uri != name:
                    name, file = uri, TokenFile(uri)
                crc[i] = zlib.crc32(file.span(int(first), int(n)).astype("<u4").tobytes())
            yield batch[["start", "n_tokens"]].assign(doc_id=pd.array(ids_of(batch["doc_id"]), dtype="Int64"), ids_crc32=crc)[["doc_id", "start", "n_tokens", "ids_crc32"]]

    return index.select(id_column(), "path", "first", "start", "n_tokens").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the files; nulls, repeated rows and empty tables as write_token_files() has them."""
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder))
