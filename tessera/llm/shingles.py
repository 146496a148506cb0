"""Near-duplicate documents by a MinHash LSH forest and exact verification (operator 2).

Each document's MinHash values are read in ``trees`` tries, ``depth`` values
deep. Documents of a trie lie sorted by their values, so that those that
share a prefix of k values are a run, and a pair's longest shared prefix is
the least one between neighbours. Documents meet first at the full depth;
then each one's prefixes are shortened until the candidates it has met are
``recall`` of those it should meet: a pair of similarity s shares a prefix
of k values in some trie with chance 1 - (1 - s^k)^trees, so every
likely link met at depth k stands for 1 / chance links, and one link at the
threshold is always supposed besides. A document among many close copies stops
at long prefixes; one that meets nobody goes on to the depth at which even
a pair at the threshold is met that often. A pair is a candidate if either
one's prefix reaches it, and candidates are verified on whole shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, group_edges, held_by_worker, materialize, table, text_column, whole_groups, with_size_checked
from .components import connected_components
from .vocabulary import slices

WORDS, THRESHOLD = 5, 0.8
#: Tries, their depth, and the wanted share of links that are met.
TREES, DEPTH, RECALL = 20, 8, 0.9995
#: Members and shingles of a trie node that are compared in one piece; larger ones are split into pairs of parts.
BLOCK, BLOCK_SHINGLES = 128, 1_000_000
#: Estimates by this much below the threshold are verified as well: over six standard errors of 160 values.
SLACK = 0.25
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)  # golden ratio, for mixing
_PAIRS = 20_000  # compared at once


def chance(similarity, k: int, trees: int):
    """How often a pair of this similarity shares a prefix of k values in some trie."""
    return 1 - (1 - similarity**k) ** trees


def prefix_length(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is met often enough; no document's prefixes need be shorter."""
    return next((k for k in range(longest, 0, -1) if chance(threshold, k, trees) >= recall), 1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _hashes() -> _Hashes:
    return held_by_worker("word hashes", _Hashes)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct runs of ``words`` words of each text.

    Words are runs of letters, digits and underscores, in lower case. A text
    of fewer words has one shingle of all of them; one without words none.
    """
    get = _hashes().__getitem__
    out = []
    for text in texts:
        found = _WORD.findall(text.lower())
        h = np.fromiter(map(get, found), np.uint64, len(found))
        k = min(words, len(h))
        if k:
            n = len(h) - k + 1
            s = h[:n].copy()
            for i in range(1, k):
                s = (s ^ (s >> np.uint64(29))) * _MIX + h[i : i + n]
            h = (s ^ (s >> np.uint64(32))) * _MIX
            h = np.unique(h ^ (h >> np.uint64(29)))
        out.append(h)
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """MinHash values (documents x hashes); empty sets give zeros."""
    rng = np.random.default_rng(1)
    mult = rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(sets), hashes), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    size = np.array([len(sets[i]) for i in some])
    flat = np.concatenate([sets[i] for i in some])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum(size) - size
    for j in range(hashes):
        x = (low + add[j]) * mult[j] ^ high * mult[-1 - j]
        out[some, j] = np.minimum.reduceat(x * mult[j], start)
    return out


def _least(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row of a symmetric boolean matrix reaches."""
    far = np.iinfo(np.int64).max
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(links, low[None, :], far).min(axis=1, initial=far))
        if (new == low).all():
            return low
        low = new


def _parted(rows: DataFrame) -> DataFrame:
    """Deal the members of a node to parts, and each part to the pairs (i, j) of parts that it is compared in."""
    return (
        rows.withColumn("parts", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingled") / BLOCK_SHINGLES)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("parts", "other", "members", "shingled")
    )


NODE = ["tree", "prefix", "i", "j"]


def _dealt(rows: DataFrame, pieces: int) -> DataFrame:
    """Pieces of nodes together, each sorted as the trie is."""
    return rows.repartition(pieces, *NODE).sortWithinPartitions(*NODE, "turn")


def _met(sign: np.ndarray, size: np.ndarray, part: np.ndarray, tree: int, across: bool, trees: int, floor: int, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, other row, longest prefix they share in any trie, estimated similarity) of the pairs that this node is to judge.

    Each pair belongs to the first trie in which it shares ``floor`` values;
    pairs whose sizes or estimates rule the threshold out are left out.
    """
    n = len(sign)
    depth = sign.shape[1] // trees
    values = sign.reshape(n, trees, depth)
    # the floor prefixes of the earlier tries, hashed
    mult = np.random.default_rng(2).integers(1, 1 << 62, floor, dtype=np.uint64) | np.uint64(1)
    early = ((values[:, :tree, :floor].astype(np.uint64) + np.uint64(1)) * mult).sum(axis=2, dtype=np.uint64)
    rows_at_once = max(1, _PAIRS // n)
    for a in range(0, n, rows_at_once):
        r, c = np.nonzero(np.arange(n)[None, :] > np.arange(a, min(a + rows_at_once, n))[:, None])
        r = r + a
        keep = (size[r] >= threshold * size[c]) & (size[c] >= threshold * size[r])
        if across:
            keep &= part[r] != part[c]
        r, c = r[keep], c[keep]
        for t in range(tree):
            if not len(r):
                break
            new = early[r, t] != early[c, t]
            r, c = r[new], c[new]
        if not len(r):
            continue
        same = sign[r] == sign[c]
        like = same.mean(axis=1)
        keep = like >= threshold - SLACK
        r, c, like, same = r[keep], c[keep], like[keep], same[keep]
        longest = np.logical_and.accumulate(same.reshape(len(r), trees, depth), axis=2).sum(axis=2).max(axis=1, initial=0)
        yield r, c, longest, like


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links: one row per doc_id.

    class_id is the smallest doc_id reachable by links of Jaccard similarity
    >= threshold; n_links counts the other documents linked directly, copies
    included. Null texts are empty; documents without words link with
    nothing. Rows of one doc_id count as one document (the one of the least
    shingle digest); null doc_ids take no part, no rows give none, other
    columns are ignored whatever their names. Equal shingle sets are one row
    with a weight, so copies, however many, are never compared with each
    other. Long texts count whole; nodes are split by their shingles, too.
    """
    spark = docs.sparkSession
    floor = prefix_length(threshold, trees, depth, recall)
    levels = list(range(depth, floor - 1, -1))
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], words)
                sign = signatures(sets, trees * depth)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b], "n": [len(s) for s in sets],
                    "digest": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "signature": [x.tobytes() for x in sign],
                })

    # in buckets by doc_id, so that no later step moves the signatures of documents that meet nobody
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = bucketed(plain.mapInPandas(describe, "doc_id long, n int, digest binary, signature binary"), "doc_id", buckets, "signatures")
    signed = described.groupBy("doc_id").agg(F.min(F.struct("digest", "n", "signature")).alias("x")).select(F.col("doc_id").alias("rep"), "x.*")
    known = described.groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("x")).select("doc_id", "x.*")
    known = materialize(known, "digests")
    classes = materialize(known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "equal-sets")
    starts = F.array(*[F.xxhash64(F.substring("signature", 1 + 4 * depth * t, 4 * floor)) for t in range(trees)])
    reps = materialize(signed.join(classes.select("rep", "weight"), "rep").select("rep", "n", "weight", starts.alias("prefixes")), "representatives")
    n = reps.count()
    pieces = max(buckets, ceil(n * trees / 200_000))

    # the tries below their nodes at the floor: those that several documents share
    prefixes = reps.select("rep", "n", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = prefixes.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingled")).where("members > 1")
    shared = materialize(shared, "shared-prefixes")
    nodes = prefixes.drop("n").join(shared, ["tree", "prefix"]).join(signed.select("rep", "signature", "n"), "rep")
    turn = F.substring("signature", 1 + 4 * depth * F.col("tree"), 4 * depth)
    nodes = _dealt(_parted(nodes).withColumn("turn", turn), pieces).drop("turn")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Which members of each node meet a candidate there, and how many likely links each depth finds and misses."""
        counts = [f"{x}_{k}" for x in ("found", "missed") for k in levels]
        for rows in whole_groups(batches, NODE):
            sign = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), -1)
            size, part, tree = rows["n"].to_numpy(np.float64), rows["part"].to_numpy(), rows["tree"].to_numpy()
            across = (rows["i"] != rows["j"]).to_numpy()
            hit, sums = np.zeros(len(rows), bool), np.zeros((len(rows), 2 * len(levels)))
            edges = group_edges(rows, NODE)
            for a, b in zip(edges[:-1], edges[1:]):
                for r, c, longest, like in _met(sign[a:b], size[a:b], part[a:b], int(tree[a]), bool(across[a]), trees, floor, threshold):
                    likely = like >= threshold
                    for x in (r, c):
                        hit[a + x] = True
                        for m, k in enumerate(levels):
                            some = likely & (longest >= k)
                            sums[a:b, m] += np.bincount(x[some], minlength=b - a)
                            sums[a:b, len(levels) + m] += np.bincount(x[some], 1 / chance(like[some], k, trees) - 1, b - a)
            if hit.any():
                yield pd.concat([rows.loc[hit, [*NODE, "part", "rep"]].reset_index(drop=True), pd.DataFrame(sums[hit], columns=counts)], axis=1)

    counted = ", ".join(f"{x}_{k} double" for x in ("found", "missed") for k in levels)
    met = materialize(nodes.mapInPandas(meet, f"tree int, prefix long, i int, j int, part int, rep long, {counted}"), "met")
    # each document's depth: the longest prefixes at which the links it misses are few among those it should meet
    sums = met.groupBy("rep").agg(*[F.sum(f"{x}_{k}").alias(f"{x}_{k}") for x in ("found", "missed") for k in levels])
    reach = F.lit(floor)
    for k in reversed(levels[:-1] if levels[-1] == floor else levels):
        found, missed = F.col(f"found_{k}") + chance(threshold, k, trees), F.col(f"missed_{k}") + 1 - chance(threshold, k, trees)
        reach = F.when(found >= recall * (found + missed), F.lit(k)).otherwise(reach)
    members = sums.select("rep", reach.alias("reach")).join(reps.select("rep", "weight"), "rep").join(signed.select("rep", "signature", "digest"), "rep")
    members = materialize(members, "members")

    # exact verification of the candidates, on the whole shingle sets
    found = plain.join(with_size_checked(members.select(F.col("rep").alias("doc_id"), F.col("digest"))), "doc_id")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts):
                some, sets = batch.iloc[a:b], shingle_sets(texts[a:b], words)
                fits = [blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, some["digest"])]
                yield pd.DataFrame({"rep": some["doc_id"], "shingles": [s.tobytes() for s in sets]})[fits]

    sets = found.select("doc_id", "text", "digest").mapInPandas(gather, "rep long, shingles binary").dropDuplicates(["rep"])
    candidates = met.select(*NODE, "part", "rep").join(sets.join(members.drop("digest"), "rep"), "rep").withColumn("turn", F.lit(0))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, NODE):
            out = []
            sign = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), -1)
            ids, weight, part, reach = (rows[x].to_numpy(np.int64) for x in ("rep", "weight", "part", "reach"))
            held = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
            size = np.array([len(x) for x in held])
            edges = group_edges(rows, NODE)
            for a, b in zip(edges[:-1], edges[1:]):
                wanted = np.zeros((b - a, b - a), bool)
                across = rows["i"].iat[a] != rows["j"].iat[a]
                for r, c, longest, _ in _met(sign[a:b], size[a:b], part[a:b], int(rows["tree"].iat[a]), bool(across), trees, floor, threshold):
                    keep = longest >= np.minimum(reach[a:b][r], reach[a:b][c])
                    wanted[r[keep], c[keep]] = True
                wanted |= wanted.T
                some = np.flatnonzero(wanted.any(axis=1))
                if len(some):
                    links = wanted[np.ix_(some, some)] & similar([held[a + x] for x in some], size[a + some], threshold)
                    own = ids[a + some]
                    out.append(pd.DataFrame({"rep": own, "links": links @ weight[a + some], "root": _least(links, own)})[links.any(axis=1)])
            if out:
                yield pd.concat(out)

    verified = materialize(_dealt(candidates, pieces).drop("turn").mapInPandas(verify, "rep long, links long, root long"), "verified")
    linked = connected_components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    told = materialize(told.select("digest", F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "classes")
    return known.join(told, "digest", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def similar(sets: list[np.ndarray], size: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have Jaccard similarity >= threshold, by products of incidence matrices over stretches of the shared shingles."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    value, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner = rank[column[keep]], owner[keep]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    stretch = 8192
    for lo in range(0, int(rank[-1]) + 1, stretch):
        a, b = np.searchsorted(column, [lo, lo + stretch])
        has = np.zeros((len(sets), min(stretch, int(rank[-1]) + 1 - lo)), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        both += has @ has.T
    both = both.astype(np.float64)
    return both >= threshold * (size[:, None] + size - both) - 1e-9


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of all documents; nulls, ties, long texts and empty tables as near_duplicate_classes() has them."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
