import hashlib
import random

import numpy as np
import pytest

import tessera.llm.substrings as S

END = 2**63 - 1


def brute(rows):
    first = {}
    for d, t in rows:
        b, d = (t or "").encode(), END if d is None else d
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            if first.get(w, END + 1) > d:
                first[w] = d
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), END if d is None else d
        m = np.zeros(len(b) + 50, np.int8)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                m[i : i + 50] = 1
        m = m[: len(b)]
        out.append((d, len(b), int(m.sum()), int((np.diff(np.r_[0, m]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[m == 0])).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    base = "".join(r.choice("ab cé") for _ in range(3000))
    rows = []
    for i in range(120):
        a, b = r.randrange(2500), r.randrange(2900)
        rows.append((i, base[a : a + r.randrange(40, 700)] + r.choice(["", "x", "a" * 200, "\0" * 80]) + base[b : b + r.randrange(100)]))
    return rows + [(None, base), (5, None), (7, ""), (7, base[:300]), (7, base[:300]), (None, base), (1000, base + "z" * 50_000), (500, base[:49]), (501, base[:49]), (502, base[:50]), (503, base[:50]), (2**62 + 1, "large"), (2**62 + 3, "id")]


@pytest.mark.parametrize("hot", [4096, 20])
def test_same_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_DOCUMENTS", hot)
    rows = made(hot)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string")
    monkeypatch.setattr(S, "table", lambda *a: docs)
    got = sorted(map(tuple, S.op1_substring_dedup(spark, "").collect()), key=str)
    assert got == brute(rows)


def test_empty(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(S, "table", lambda *a: docs)
    assert S.op1_substring_dedup(spark, "").collect() == []


def test_stage_keeps_columns_and_whole_characters(spark):
    words = "é".join(str(i) for i in range(100))
    docs = spark.createDataFrame([(1, words, "k", 5, "a"), (2, "new é" + words[3:150] + "é end", "k", 5, "b"), (3, words, None, None, "c"), (4, None, "e", 0, "d"), (5, "", "e", 0, "d")], "doc_id long, text string, key string, n_chars long, starts string")
    got = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert set(got) == {1, 2, 4, 5}  # 3 is a copy
    assert got[1].text == words and got[1].starts == "a" and got[1].key == "k"
    assert got[2].text.startswith("new ") and got[2].text.endswith(" end") and len(got[2].text) < 20
    assert got[2].n_chars == len(got[2].text)
    assert S.without_repeats(docs).columns == docs.columns


def test_long_runs_and_stretches():
    text = ("a" * 500 + "b" * 77).encode()
    whole = S.window_runs(text, 50, 16)
    assert whole[2].sum() == len(text) - 49 and whole[2].max() <= S.RUN
    parts = S.window_runs(text, 50, 16, stretch=37)
    assert parts[2].sum() == len(text) - 49
    assert np.repeat(whole[0], whole[2]).tolist() == np.repeat(parts[0], parts[2]).tolist()
    assert S.window_runs(b"short", 50, 16)[0].size == 0


def test_nearest_smaller():
    r = np.random.default_rng(0)
    for v in (r.integers(0, 50, 300), np.arange(300), np.arange(300)[::-1], np.zeros(300, int)):
        common = r.integers(0, 9, 300)
        at, least = S.nearest_smaller(v, common)
        want = [next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1) for i in range(len(v))]
        assert at.tolist() == want
        assert least.tolist() == [0 if j < 0 else common[j + 1 : i + 1].min() for i, j in enumerate(want)]


def test_longest_previous_factor():
    r = random.Random(6)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 9))) for _ in range(60)]
        doc = np.array([r.randrange(12) for _ in texts])
        rows = np.array([list(t.ljust(8, b"x")) for t in texts], np.uint8)
        got = S.longest_previous_factor(rows, np.array([len(t) for t in texts]), doc)
        for i, t in enumerate(texts):
            same = [next((k for k in range(min(len(t), len(u))) if t[k] != u[k]), min(len(t), len(u))) for j, u in enumerate(texts) if doc[j] < doc[i]]
            assert got[i] == max(same, default=0)


def test_blocks_are_read_where_they_lie(spark):
    from tessera.llm.common import bucketed

    rows = bucketed(spark.createDataFrame([(i % 7, i) for i in range(100)], "block int, x int"), "block", 5, "some-blocks")
    grouped = rows.groupBy("block").applyInPandas(lambda g: g, rows.schema)
    assert grouped.count() == 100 and "Exchange hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_rolling_hash_is_by_content():
    raw = np.frombuffer(b"abcabcabcabc" * 5, np.uint8)
    for k in (1, 2, 3, 7, 16, 50):
        h = S.rolling_hash(raw, k)
        assert len(h) == len(raw) - k + 1 and len(set(h.tolist())) == 3
