import numpy as np
import pandas as pd
import pytest

from tessera.llm.vectors import ORACLE_VECTOR_DEDUP, adaptive_scan, near_duplicates, nearest


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((500, 32))
    rows = [(i, x, i % 4) for i, x in enumerate(base)]
    rows += [(1000 + i, base[i] + 0.12 * r.standard_normal(32), i % 4) for i in range(150)]
    rows += [(2000 + i, base[0], 0) for i in range(300)] + [(3000 + i, 3 * base[1], 1) for i in range(5)] + [(3100, base[1], 2), (3101, base[1], None)]
    rows = [(a, [float(np.float32(v)) for v in x], label) for a, x, label in rows]
    rows += [(4000, None, 1), (4001, [0.0] * 32, 1), (4002, [float("nan")] * 32, 1), (4003, [None] * 32, 1), (4004, [float("inf")] * 32, 1), (4005, [], 1), (4006, [1.0, 2.0], 1)]
    rows += [(5000, [3.0, 4.0, 0.0], 1), (5001, [6.0, 8.0, 0.0], 1), (5002, [3.0, 4.01, 0.0], 1), (5003, [0.0, 0.0, 1.0], 1)]  # another length
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, weight string, near int"


def frame(spark, rows):
    return spark.createDataFrame([(*x, "w", 1) for x in rows], SCHEMA)


def usable(rows):
    return [(a, np.array(x), label) for a, x, label in rows if a < 4000]


@pytest.mark.parametrize("block", [128, 64])
def test_near_duplicates(spark, vectors, block):
    got = {r.vec_id: r for r in near_duplicates(frame(spark, vectors + vectors[:1]), block=block).collect()}
    good = [x for x in usable(vectors) if x[2] is not None]
    ids, x, label = np.array([a for a, _, _ in good]), np.stack([b for _, b, _ in good]), np.array([c for _, _, c in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    low = ids.copy()
    for _ in range(50):
        low = np.minimum(low, np.where(links, low, 10**9).min(axis=1))
    mine = np.array([got[i].n_links for i in ids.tolist()])
    assert links.sum() > 90_000 and (mine <= links.sum(axis=1)).all()
    assert mine.sum() >= 0.99 * links.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids.tolist(), low.tolist())]) >= 0.99
    for i in (3101, *range(4000, 4007)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert [(got[i].n_links, got[i].component_id) for i in range(5000, 5004)] == [(2, 5000), (2, 5000), (2, 5000), (0, 5003)]
    assert set(got) == {a for a, _, _ in vectors}


def test_same_as_sql(spark, vectors):
    import duckdb

    rows = [x for x in vectors if 1000 <= x[0] < 1020 or x[0] < 20 or 2000 <= x[0] < 2010 or x[0] >= 3000]
    c = duckdb.connect()
    c.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    c.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows)).collect())) == sorted(c.sql(ORACLE_VECTOR_DEDUP).fetchall())


def test_group_of_a_third_of_the_rows(spark):
    r = np.random.default_rng(3)
    n, d = 18_000, 64
    x = r.standard_normal((n, d))
    x[: n // 3] = r.standard_normal(d) + 0.1 * x[: n // 3]  # mean cosine 0.99
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": x.tolist(), "label": 1}), "vec_id long, embedding array<double>, label int")
    got = near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = np.concatenate([(x[a : a + 2000] @ x.T >= 0.98).sum(axis=1) - 1 for a in range(0, n, 2000)])
    assert want.sum() > 0.9 * (n // 3) ** 2 and (got <= want).all()
    assert got.sum() >= 0.99 * want.sum()


def test_no_vectors(spark, vectors):
    assert near_duplicates(frame(spark, [])).collect() == []
    assert [tuple(r) for r in near_duplicates(frame(spark, [x for x in vectors if x[0] == 4004])).collect()] == [(4004, 0, 4004, True)]
    empty = frame(spark, [])
    assert nearest(empty, empty).collect() == []


@pytest.mark.parametrize("rows_per_group", [16_384, 100])
def test_nearest(spark, vectors, rows_per_group):
    df = frame(spark, vectors)
    got = nearest(df, df.where("vec_id % 20 = 0 and vec_id < 4000"), recall=0.99, rows_per_group=rows_per_group, queries_per_group=30).toPandas().sort_values(["query_id", "rank"])
    good = usable(vectors)
    ids, x = np.array([a for a, _, _ in good]), np.stack([b for _, b, _ in good])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if i != q][:20]
        mine = got[got.query_id == ids[q]]
        assert mine["rank"].tolist() == list(range(1, 21)) and len(set(mine.vec_id)) == 20
        assert np.allclose(mine.score, [score[np.flatnonzero(ids == v)[0]] for v in mine.vec_id], rtol=1e-12)
        assert (np.diff(mine.score) <= 0).all()
        ties = mine[mine.score.diff() == 0]
        assert (mine.vec_id.diff()[ties.index] > 0).all()
        hit += len(set(mine.vec_id) & set(ids[order].tolist()))
        total += 20
    assert hit >= 0.95 * total


def test_few_candidates(spark):
    df = frame(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.0], 1)])
    assert [tuple(r) for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(0, [1.0, 0.0], 1)] + [(i, [0.5, float(i % 3)], 1) for i in range(60, 0, -1)]
    df = frame(spark, rows)
    got = nearest(df, df.where("vec_id = 0"), k=7).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, i, i, 0.5) for i in range(1, 8)]


def test_each_length_is_answered_by_its_own(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8 if i % 3 else 5).tolist(), 1) for i in range(300)]
    df, few = frame(spark, rows), frame(spark, [(1000, [1.0] * 5, 1), (1001, [1.0] * 7, 1), (0, rows[0][1], 1)])
    got = nearest(df, few, recall=1.0).toPandas()
    assert sorted(got["query_id"].unique()) == [0, 1000] and (got.groupby("query_id").size() == 20).all() and (got.vec_id % 3 == 0).all()
    score = {i: float(np.sum(x)) for i, x, _ in rows if i % 3 == 0}
    best = sorted(score, key=lambda i: (-score[i], i))[:20]
    assert got[got.query_id == 1000].sort_values("rank").vec_id.tolist() == best


def test_all_that_are_asked_for_come_back(spark):
    """Small lists: probing goes on until they hold enough rows."""
    r = np.random.default_rng(4)
    centres = 50 * r.standard_normal((40, 6))
    rows = [(i, (centres[i % 40] + r.standard_normal(6)).tolist(), 1) for i in range(800)]
    df = frame(spark, rows)
    got = nearest(df, df.where("vec_id < 40"), k=60, recall=0.01).toPandas()
    assert (got.groupby("query_id").size() == 60).all()


def test_scan_abandons_only_what_cannot_reach():
    r = np.random.default_rng(1)
    q, x = r.standard_normal((20, 64)), r.standard_normal((400, 64))
    score = q @ x.T
    best = np.sort(score, axis=1)[:, -20]
    a, b = adaptive_scan(q, x, best)
    kept = np.zeros(score.shape, bool)
    kept[a, b] = True
    wanted = score >= best[:, None]
    assert kept[wanted].mean() > 0.99 and kept.mean() < 0.3
