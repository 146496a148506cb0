"""Pivot-permutation near-duplicates (operator 5) and list search with an adaptive dimension scan (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_edges, materialize, table, whole_groups, with_size_checked
from .components import connected_components

#: Bounds of the sample, in rows and bytes, that pivots and centroids of all lengths come from: the index is fitted on it, and holds every row.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Greatest cosine of two pivots; they are chosen from so many times their number of sampled vectors.
PIVOT_COSINE, PIVOT_CHOICE = 0.8, 4
#: Numbers of one group of rows or queries that a task of operator 9 holds at once.
GROUP_NUMBERS = 2_000_000


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a vec_id whose vector is not null, not zero and all of finite numbers; embedding as doubles."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return vectors.where(good & F.col("vec_id").isNotNull()).withColumn("embedding", x.cast("array<double>"))


def _samples(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vectors its number of rows, and a sample: the same ones whatever the partitioning, of all lengths within the bounds."""
    counts = {r["d"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("d")).count().collect()}
    room = {d: max(32, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)) * n // max(1, sum(counts.values()))) for d, n in counts.items()}
    order = Window.partitionBy("d").orderBy(F.xxhash64("vec_id"), "vec_id")
    limit = F.lit(0)
    for d, n in room.items():
        limit = F.when(F.col("d") == d, F.lit(n)).otherwise(limit)
    got = rows.select("vec_id", "embedding", F.size("embedding").alias("d")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max([1, *room.values()])).where(F.col("k") <= limit)
    held: dict[int, list] = {d: [] for d in counts}
    for r in got.orderBy("d", "k").collect():
        held[r["d"]].append(r["embedding"])
    return {d: (counts[d], np.array(x, np.float64).reshape(len(x), d)) for d, x in held.items()}


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _well_apart(unit: np.ndarray, n: int, cosine: float) -> np.ndarray:
    """The first n of these unit vectors of which none has more than this cosine to one before it."""
    kept = np.empty((min(n, len(unit)), unit.shape[1]))
    count = 0
    for x in unit:
        if count == len(kept):
            break
        if not count or (kept[:count] @ x).max() <= cosine:
            kept[count] = x
            count += 1
    return kept[:count]


def _least(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row of a symmetric boolean matrix reaches."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(links, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return low
        low = new


def _nearest_pivots(unit: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int32)


def _description(sample: np.ndarray, pivots: np.ndarray, threshold: float, length: int, miss: float = 0.001) -> tuple[int, int]:
    """How many of the first pivots need lists, and how many a pair must share, so that of pairs at the threshold hardly any is missed.

    Found on sampled vectors and on copies turned to exactly the threshold, the weakest pairs there are.
    """
    r = np.random.default_rng(5)
    x = _unit(sample[np.arange(2000) % len(sample)])
    noise = r.standard_normal(x.shape)
    noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
    size = np.sqrt(np.einsum("ij,ij->i", noise, noise))[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * noise / np.where(size > 1e-9, size, 1)
    a, b = (_nearest_pivots(z, pivots, length) for z in (x, y))
    both = np.sort((a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1))
    shared = int(both[int(miss * len(both))])
    met = [(a[:, :k, None] == b[:, None, :k]).any(axis=(1, 2)).mean() for k in range(1, a.shape[1] + 1)]
    lists = next((k for k, m in enumerate(met, 1) if m >= 1 - miss), a.shape[1])
    return lists, max(1, min(shared, a.shape[1]))


LIST = ["label", "d", "pivot", "i", "j"]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, length: int = 12, block: int = 128, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row with a vec_id.

    Vectors of different lengths link with nothing of each other; each
    length has its own pivots, about twice the square root of its rows:
    sampled vectors of which no two have a cosine above PIVOT_COSINE (among
    pivots inside a group of noisy copies, noise alone would say which are
    near). A vector is described by its ``length`` nearest pivots in order,
    and its id stands in the inverted lists of the first of them. Ids of a
    list that share enough pivots, in the first list that holds both, are
    candidates; only then are the vectors of ids that have one fetched, and
    candidates compared exactly, in double precision. Equal vectors of a
    label count as one row with a weight, and lists longer than ``block``
    are split into pairs of parts, so no task holds a whole hot list. Rows
    of one vec_id collapse (the least label and vector stay). Null, zero
    and non-finite vectors and null labels link with nothing and are their
    own component; no rows give none; other columns are ignored.
    """
    spark = vectors.sparkSession
    everyone = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    again = materialize(everyone.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    twice = everyone.join(with_size_checked(again), "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.*")
    everyone = everyone.join(with_size_checked(again), "vec_id", "left_anti").unionByName(twice)
    rows = usable(everyone.where("label is not null")).withColumn("label", F.col("label").cast("string")).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    hashed = [F.xxhash64("label", "embedding", F.lit(k)).alias(f"same_{k}") for k in (1, 2)]
    rows = materialize(rows.select("vec_id", "label", "embedding", *hashed), "vectors")
    same = rows.groupBy("same_1", "same_2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")).where("weight > 1")
    same = materialize(same, "equal-vectors")
    copies = materialize(rows.select("vec_id", "same_1", "same_2").join(with_size_checked(same), ["same_1", "same_2"]).select("vec_id", "rep", "weight"), "copies")
    reps = rows.drop("same_1", "same_2").join(with_size_checked(copies), "vec_id", "left").where("rep is null or rep = vec_id").select("vec_id", "label", "embedding", F.coalesce("weight", F.lit(1)).alias("weight"))
    samples = _samples(reps)
    if not samples:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = {}
    for d, (n, sample) in samples.items():
        wanted = pivots or max(32, ceil(2 * sqrt(n)))
        centre = _well_apart(_unit(sample), min(wanted, ceil(len(sample) / PIVOT_CHOICE) if len(sample) > 128 else len(sample)), PIVOT_COSINE)
        index[d] = (centre, *_description(sample, centre, threshold, length))
    held = spark.sparkContext.broadcast(index)  # at most a quarter of the sample's rows, but for lengths of few

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, g in batch.groupby(batch["embedding"].map(len), sort=False):
                x = _matrix(g["embedding"])
                near = _nearest_pivots(_unit(x), held.value[d][0], length)
                yield pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "weight": g["weight"], "d": d, "near": [v.tobytes() for v in near], "lists": [v[: held.value[d][1]].tolist() for v in near], "vector": [v.tobytes() for v in x]})

    described = materialize(reps.mapInPandas(describe, "vec_id long, label string, weight long, d int, near binary, lists array<int>, vector binary"), "described")
    postings = described.select("vec_id", "label", "d", "near", F.explode("lists").alias("pivot"))
    hot = materialize(postings.groupBy("label", "d", "pivot").count().where(F.col("count") > block), "long-lists")
    postings = (
        postings.join(with_size_checked(hot), ["label", "d", "pivot"], "left")
        .withColumn("parts", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .select(*LIST, "part", "vec_id", "near")
    )
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(sum(n for n, _ in samples.values()) / 20_000))
    dealt = lambda df: df.repartition(pieces, *LIST).sortWithinPartitions(*LIST, "vec_id")

    def candidates(g: pd.DataFrame) -> np.ndarray:
        """Which members of one list share enough pivots, and meet in no earlier list."""
        _, lists, enough = held.value[int(g["d"].iat[0])]
        near = np.frombuffer(b"".join(g["near"]), np.int32).reshape(len(g), -1)
        present, at = np.unique(near, return_inverse=True)
        at = at.reshape(near.shape)
        has = np.zeros((len(g), len(present)), np.float32)
        np.put_along_axis(has, at, 1, axis=1)
        first = np.zeros_like(has)
        np.put_along_axis(first, at[:, :lists], 1, axis=1)
        met = has @ has.T >= enough
        before = first[:, present < g["pivot"].iat[0]]
        met &= before @ before.T == 0
        if g["i"].iat[0] != g["j"].iat[0]:
            part = g["part"].to_numpy()
            met &= part[:, None] != part
        np.fill_diagonal(met, False)
        return met

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, LIST):
            edges = group_edges(rows, LIST)
            hit = np.zeros(len(rows), bool)
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    hit[a:b] = candidates(rows.iloc[a:b]).any(axis=1)
            yield rows.loc[hit, [*LIST, "part", "vec_id"]]

    kinds = {"label": "string", "vec_id": "long"}
    met = materialize(dealt(postings).mapInPandas(meet, ", ".join(f"{c} {kinds.get(c, 'int')}" for c in [*LIST, "part", "vec_id"])), "met")
    fetched = met.join(described.select("vec_id", "weight", "near", "vector"), "vec_id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, LIST):
            edges, out = group_edges(rows, LIST), []
            for a, b in zip(edges[:-1], edges[1:]):
                g = rows.iloc[a:b]
                unit = _unit(np.frombuffer(b"".join(g["vector"]), np.float64).reshape(len(g), -1))
                links = candidates(g) & (unit @ unit.T >= threshold)
                some = links.any(axis=1)
                if some.any():
                    ids, weight = g["vec_id"].to_numpy(np.int64)[some], g["weight"].to_numpy(np.int64)[some]
                    links = links[np.ix_(some, some)]
                    out.append(pd.DataFrame({"vec_id": ids, "links": links @ weight, "root": _least(links, ids)}))
            if out:
                yield pd.concat(out)

    found = materialize(dealt(fetched).mapInPandas(compare, "vec_id long, links long, root long"), "vector-links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep")
    components = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    told = materialize(links.join(components, "rep", "full").select("rep", "links", "component"), "linked")
    known = (
        everyone.select("vec_id").join(with_size_checked(copies), "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id"))
        .join(with_size_checked(told), "rep", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return known.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centre = sample[:k].copy()
    for _ in range(rounds):
        at = np.argmax(sample @ centre.T - 0.5 * np.einsum("ij,ij->i", centre, centre), axis=1)
        count = np.bincount(at, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, at, sample)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def adaptive_scan(queries: np.ndarray, base: np.ndarray, best: np.ndarray, columns: int = 16, epsilon: float = 2.5) -> np.ndarray:
    """Which (query, base) pairs of rotated vectors may reach each query's best inner product so far.

    Column blocks are added up in turn. After k of d dimensions the squared
    distance is estimated as d / k times its part; the hypothesis that it
    lies within the distance that ``best`` stands for is rejected, and the
    pair abandoned, where the estimate exceeds that by (1 + epsilon / sqrt(k)) squared.
    """
    d = base.shape[1]
    qq, bb = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", base, base)
    limit = np.maximum(qq[:, None] + bb[None, :] - 2 * best[:, None], 0)
    alive, part = None, None
    for k in range(0, d, columns):
        q, b = queries[:, k : k + columns], base[:, k : k + columns]
        end = min(k + columns, d)
        bound = (1 + epsilon / sqrt(end)) ** 2 * end / d if end < d else 1 + 1e-9  # the whole distance is no estimate
        if alive is None:
            step = np.einsum("ij,ij->i", q, q)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (q @ b.T)
            part = step if part is None else part + step
            keep = part <= bound * limit + 1e-12
            if keep.mean() < 0.1 or end == d:
                alive = np.nonzero(keep)
                part = part[alive]
        else:
            r, c = alive
            part = part + np.einsum("ij,ij->i", q[r] - b[c], q[r] - b[c])
            keep = part <= bound * limit[r, c] + 1e-12
            alive, part = (r[keep], c[keep]), part[keep]
    return np.stack(alive)


def _top(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, best first, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.concatenate([[True], q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
    return order[rank < k]


def _fitted(n: int, sample: np.ndarray, k: int, recall: float) -> tuple[np.ndarray, int]:
    """Centroids of lists, about a quarter of the square root of the rows, and how many lists reach the recall on the sample."""
    centre = _centroids(sample, min(max(1, round(sqrt(n) / 4)), len(sample)))
    own = np.argmax(sample @ centre.T - 0.5 * np.einsum("ij,ij->i", centre, centre), axis=1)
    if len(sample) <= k:
        return centre, len(centre)
    tried = sample[:: max(1, len(sample) // 200)]
    best = np.argpartition(-(tried @ sample.T), k, axis=1)[:, : k + 1]
    order = np.argsort(np.argsort(-(tried @ centre.T), axis=1), axis=1)
    needed = np.take_along_axis(order, own[best], axis=1).ravel() + 1
    return centre, int(np.quantile(needed, recall, method="higher"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, rows_per_group: int | None = None, queries_per_group: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query, but itself; ties go to the smaller vec_id.

    Rows lie in lists around centroids of a sample; a query probes the lists
    nearest to it: as many as reach ``recall`` on the sample, and further
    ones until they hold k other rows, so that k come back where there are
    so many. Lists are dealt to groups, long ones to several, queries that
    begin alike to blocks; a group meets the blocks that probe it, in one
    task each. A query is answered by rows of its own length. Rows of one
    vec_id are each a candidate. Null, zero and non-finite vectors take no
    part; no rows give none; other columns are ignored.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = materialize(usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "usable")
    asked = usable(queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).withColumn("row", F.monotonically_increasing_id())
    asked = materialize(asked, "asked")
    samples = _samples(rows)
    index, first = {}, 0
    for d, (n, sample) in sorted(samples.items()):
        centre, probes = _fitted(n, sample, k, recall)
        index[d] = (first, centre, probes)
        first += len(centre)
    share = spark.sparkContext.broadcast(index)  # centroids: no more than the sample

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, g in batch.groupby(batch["embedding"].map(len), sort=False):
                at, c, _ = share.value[d]
                yield g.assign(list=(at + np.argmax(_matrix(g["embedding"]) @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)).astype(np.int32))

    placed = materialize(rows.mapInPandas(assign, "vec_id long, embedding array<double>, list int"), "lists")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row a list
    length_of = {at + i: d for d, (at, c, _) in index.items() for i in range(len(c))}
    deal, group, room, last = [], 0, 0, None
    for at in sorted(sizes):
        d = length_of[at]
        most = rows_per_group or max(256, min(16_384, GROUP_NUMBERS // d))
        parts = ceil(sizes[at] / most)
        if d != last or parts > 1 or sizes[at] > room:
            group, room, last = group + 1, most, d
        deal.append((at, group, parts))
        group, room = (group + parts - 1, 0) if parts > 1 else (group, room - sizes[at])
    if not deal:
        return spark.createDataFrame([], out)
    groups = spark.createDataFrame(deal, "list int, at int, parts int")
    held = spark.sparkContext.broadcast({d: np.array([sizes.get(at + i, 0) for i in range(len(c))]) for d, (at, c, _) in index.items()})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, g in batch.groupby(batch["embedding"].map(len), sort=False):
                if d in share.value:
                    at, c, probes = share.value[d]
                    order = np.argsort(-(_matrix(g["embedding"]) @ c.T), axis=1, kind="stable")
                    enough = (np.cumsum(held.value[d][order], axis=1) <= k).sum(axis=1) + 1  # lists until they hold k others
                    yield g.assign(lists=[(at + x[: max(probes, e)]).astype(np.int32) for x, e in zip(order, enough)])

    chosen = materialize(asked.mapInPandas(choose, "vec_id long, embedding array<double>, row long, lists array<int>"), "chosen")
    # blocks of queries that begin with the same list; large ones are split, small ones are put together
    per_list = {r["f"]: r["count"] for r in chosen.groupBy(F.element_at("lists", 1).alias("f")).count().collect()}
    blocks, block, room, last = [], 0, 0, None
    for at in sorted(per_list):
        d = length_of[at]
        most = queries_per_group or max(256, min(16_384, GROUP_NUMBERS // d))
        parts = ceil(per_list[at] / most)
        if d != last or parts > 1 or per_list[at] > room:
            block, room, last = block + 1, most, d
        blocks.append((at, block, parts))
        block, room = (block + parts - 1, 0) if parts > 1 else (block, room - per_list[at])
    if not blocks:
        return spark.createDataFrame([], out)
    named = spark.createDataFrame(blocks, "f int, b0 int, b_parts int")
    dealt = chosen.withColumn("f", F.element_at("lists", 1)).join(F.broadcast(named), "f").withColumn("b", (F.col("b0") + F.pmod(F.xxhash64("vec_id"), F.col("b_parts"))).cast("int"))
    probed = (
        dealt.select("b", "vec_id", "embedding", "row", F.explode("lists").alias("list"))
        .join(F.broadcast(groups), "list")
        .withColumn("g", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("parts") - 1)))
    )
    to = materialize(probed.groupBy("g", "b", "row", "vec_id").agg(F.first("embedding").alias("embedding"), F.collect_list("list").alias("lists")), "probes")
    pairs = materialize(to.select("g", "b").distinct(), "probed-groups")
    base = placed.join(F.broadcast(groups), "list").withColumn("g", (F.col("at") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
    base = base.join(with_size_checked(pairs), "g").select("g", "b", "list", "vec_id", "embedding")

    def scan(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype({"query_row": np.int64, "query_id": np.int64, "vec_id": np.int64})
        if not len(q) or not len(x):
            return none
        q, x = q.sort_values(["vec_id", "row"]), x.sort_values(["list", "vec_id"])
        qid, qv, xid, xv = q["vec_id"].to_numpy(np.int64), _matrix(q["embedding"]), x["vec_id"].to_numpy(np.int64), _matrix(x["embedding"])
        turn = _rotation(qv.shape[1])
        qr, xr, lists = qv @ turn, xv @ turn, x["list"].to_numpy()
        low_list = int(lists.min())
        probed = np.zeros((len(q), int(lists.max()) - low_list + 1), bool)
        for i, p in enumerate(q["lists"]):
            p = np.asarray(p) - low_list
            probed[i, p[(p >= 0) & (p < probed.shape[1])]] = True
        best = np.full(len(q), -np.inf)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        edges = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
        for a0, b0 in zip(edges[:-1], edges[1:]):
            mine = np.flatnonzero(probed[:, lists[a0] - low_list])
            for a in range(a0, b0, 512):
                b = min(a + 512, b0)
                for lo in range(0, len(mine), 512):
                    some = mine[lo : lo + 512]
                    known = np.isfinite(best[some])
                    pairs = [adaptive_scan(qr[some[known]], xr[a:b], best[some[known]])] if known.any() else []
                    fresh = some[~known]
                    r = np.concatenate([*(some[known][p[0]] for p in pairs), np.repeat(fresh, b - a)])
                    c = np.concatenate([*(p[1] for p in pairs), np.tile(np.arange(b - a), len(fresh))]) + a
                    keep = qid[r] != xid[c]
                    r, c = r[keep], c[keep]
                    held = [np.concatenate(z) for z in zip(held, (r, c, np.einsum("ij,ij->i", qv[r], xv[c])))]
                    if len(held[0]) > 200_000 or not known.all():
                        keep = _top(held[0], held[2], xid[held[1]], k)
                        held = [z[keep] for z in held]
                        full = np.bincount(held[0], minlength=len(q)) >= k
                        low = np.full(len(q), np.inf)
                        np.minimum.at(low, held[0], held[2])
                        best = np.where(full, low, -np.inf)
        keep = _top(held[0], held[2], xid[held[1]], k)
        r, c, s = (z[keep] for z in held)
        return pd.DataFrame({"query_row": q["row"].to_numpy(np.int64)[r], "query_id": qid[r], "vec_id": xid[c], "score": s})

    near = to.groupBy("g", "b").cogroup(base.groupBy("g", "b")).applyInPandas(scan, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all rows of embeddings; nulls, ties, repeated ids and empty tables as near_duplicates() has them."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vec_id divisible by 20; nulls, ties, repeated ids and few candidates as nearest() has them."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


ORACLE_VECTOR_DEDUP = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, r) as (select vec_id, vec_id from embeddings union select reach.vec_id, links.b from reach join links on reach.r = links.a),
counted as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept
from (select vec_id, min(r) as c from reach group by vec_id) left join counted using (vec_id)"""
