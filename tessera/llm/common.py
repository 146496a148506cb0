"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started; clusters get it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, one machine uses a temporary folder, and a cluster raises."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = getattr(spark, "_tessera_dir", None)
        if not where:
            where = spark._tessera_dir = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    return where.rstrip("/")


_held: dict = {}


def held_by_worker(key, make):
    """One object, with what it has cached, for all tasks of a Python worker; asking for another one lets the last go, so that stages don't pile up caches."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The shuffle files of the job that wrote it are given back at its end.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like materialize(), with the rows of a key in one of so many buckets: grouping the result by the key needs no shuffle."""
    spark = df.sparkSession
    ship(spark)
    name = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append(path)
    out = spark.table(name)
    out.schema  # resolved: the files stay, the catalog's entry isn't needed any more
    spark.sql(f"drop table {name}")
    return out


_written: list[str] = []


def written_folder(path: str) -> None:
    """Have release() delete this folder as well."""
    _written.append(path)


def release(spark: SparkSession) -> int:
    """Delete the tables and folders written in this process; for when their results have been used. How many went."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def id_column(name: str = "doc_id"):
    """Ids on their way to pandas, as text: beside nulls it would turn integers into floating point."""
    return F.col(name).cast("long").cast("string").alias(name)


def ids_of(column: pd.Series) -> list[int | None]:
    return [None if x is None else int(x) for x in column]


def text_column(name: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("string")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), concatenated."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int64)
    if total:
        out += np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by these keys, as frames that hold all rows of each of their groups.

    For mapInPandas after a repartition and sort by the keys: small groups
    come many to a frame, and no more than a batch and one group is held.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            v = batch[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        if held:
            new[0] = any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys)
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        first, last = starts[0], starts[-1]
        if held or first:
            yield pd.concat([*held, batch.iloc[:first]], ignore_index=True)
        if last > first:
            yield batch.iloc[first:last].reset_index(drop=True)
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def group_edges(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the groups of sorted rows begin, and their end."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(rows))


#: At most so many ids are broadcast; beyond that the join is shuffled.
BROADCAST_IDS = 500_000


def with_size_checked(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Hint a broadcast of a materialised table of narrow rows only when its counted size is within the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
