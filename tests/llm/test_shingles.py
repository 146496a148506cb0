import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

import tessera.llm.shingles as S


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    links, parent = defaultdict(int), {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, top(d), links[d]) for d in sets)


def made():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.randrange(30, 120))] for _ in range(12)]
    rows = []
    for i in range(200):
        w = list(r.choice(bases))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, "?!"), (303, "Two words"), (304, "two WORDS."), (305, "one"), (306, rows[0][1].upper()), (307, "long " * 5000), (308, "long " * 5000)]


@pytest.mark.parametrize("block", [128, 8])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = made()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows] + [(*rows[3], 1, 2), (None, rows[3][1], 1, 2)], "doc_id long, text string, rep int, digest int")
    assert sorted(map(tuple, S.near_duplicate_classes(docs).collect())) == brute(rows)


def test_empty(spark):
    assert S.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_family_larger_than_a_part(spark, monkeypatch):
    """Depths are shortened by what each document has met; close copies that stop early lose no link here."""
    monkeypatch.setattr(S, "BLOCK", 32)
    r = random.Random(7)
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(1, 3) if i % 3 else r.randrange(5)):
            w[r.randrange(300)] = f"new{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{r.randrange(900)}" for _ in range(80))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = sorted(map(tuple, S.near_duplicate_classes(docs).collect())), brute(rows)
    assert sum(x[2] for x in got) >= 0.999 * sum(x[2] for x in want) > 10_000
    assert [x[:2] for x in got] == [x[:2] for x in want]


def test_signatures_move_once(spark):
    """640 bytes of signature a document are shuffled once, not for each join."""

    def moved():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)  # the store is updated now and then
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"u{r.randrange(9999)}" for _ in range(30))) for i in range(3000)], "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        assert S.near_duplicate_classes(docs).count() == 3000
        assert 600 < (moved() - before) / 3000 < 1900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_pairs_are_met_once():
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = "x"
        texts.append(" ".join(w))
    sets = S.shingle_sets(texts)
    sign, size = S.signatures(sets, 160), np.array([len(x) for x in sets])
    values = sign.reshape(40, 20, 8)
    met = {}
    for t in range(20):
        nodes = {}
        for i in range(40):
            nodes.setdefault(values[i, t, :5].tobytes(), []).append(i)
        for rows in map(np.array, nodes.values()):
            for a, b, longest, like in S._met(sign[rows], size[rows], rows * 0, t, False, 20, 5, 0.8):
                for i, j, k, x in zip(rows[a].tolist(), rows[b].tolist(), longest.tolist(), like.tolist()):
                    assert (i, j) not in met
                    met[i, j] = k
                    assert x == (sign[i] == sign[j]).mean()
                    assert k == max(next((m for m in range(8) if u[m] != v[m]), 8) for u, v in zip(values[i], values[j]))
    assert len(met) > 300


def test_prefix_is_shortened_to_the_recall():
    assert S.prefix_length(0.8, 20, 8, 0.9995) == 5
    assert S.prefix_length(0.8, 20, 8, 0.5) == 8
    assert S.prefix_length(0.5, 2, 8, 0.9999) == 1


def test_signatures_estimate_similarity():
    a = S.shingle_sets([" ".join(f"x{i}" for i in range(1000))])[0]
    b = S.shingle_sets([" ".join(f"x{i}" for i in range(250, 1250))])[0]
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    sign = S.signatures([a, b], 400)
    assert abs((sign[0] == sign[1]).mean() - true) < 0.1
