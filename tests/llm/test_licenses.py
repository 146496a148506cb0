import random
import textwrap

import duckdb
import pytest

import tessera.llm.licenses as S


@pytest.fixture(scope="module")
def rows():
    mit, apache, gpl = (min((t for n, t in S.TEMPLATES if n == k), key=len) for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    long = S.TEMPLATES[-2][1]
    return [
        (1, f"some words\n{mit}\nmore words here", "x"), (2, apache.upper(), "x"), (3, gpl.replace("3", "2"), "x"), (4, "no licence at all", "x"),
        (5, None, "x"), (6, "", "x"), (7, "\n\n \n", "x"), (1, f"{apache}\n{gpl}\nand some more words that make the whole text too long for any notice", "x"), (None, mit, None), (8, "released under\nthe MIT License", "x"),
        (9, "word " * 50_000 + "\n" + mit, "x"), (10, long, "x"), (11, " ".join(long.split()[:20]), "x"), (12, "Released under the É MIT License", "x"),
    ]


def test_same_as_sql(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = sorted(map(tuple, S.license_scan(docs).collect()), key=str)
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    assert got == sorted(c.sql(S.ORACLE).fetchall(), key=str)
    by = {r[0]: r for r in got if r[0] not in (1, None)}
    assert by[2][2] == "Apache-2.0" and by[3][2] == "GPL-2.0" and by[4][1:] == (0, "", 0.0) and by[8][2] == "MIT" and by[9][1] == 2  # the line, and the whole, which has few distinct pairs
    assert sorted(r[2] for r in got if r[0] == 1) == ["Apache-2.0,GPL-3.0", "MIT"]
    assert S.license_scan(docs.limit(0)).collect() == []


def test_notices_that_are_no_line(spark):
    say = lambda n, k: " ".join(f"word{i * k % 97}" for i in range(n))
    mit = next(t for n, t in S.TEMPLATES if n == "MIT" and 100 < len(t) < 250)
    bsd = next(t for n, t in S.TEMPLATES if n == "BSD-3-Clause" and "Redistribution" in t and len(t) < 200)
    apache = max((t for n, t in S.TEMPLATES if n == "Apache-2.0"), key=len)
    full = {n: max((t for m, t in S.TEMPLATES if m == n), key=len) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")}
    wrap = lambda t, n=76: "\n".join(textwrap.wrap(t, n))
    file = f"MIT License\n\nCopyright (c) 2020 Someone\n\n{wrap(mit + ', including without limitation the rights to use, copy, modify, merge, publish')}\n\n{wrap(say(60, 3))}"
    rows = [
        (1, file, 1, "MIT"), (2, f"{say(300, 5)} {apache} {say(300, 7)}", 1, "Apache-2.0"), (3, "Released under the MIT License. " * 10, 1, "MIT"),
        (4, f"{say(30, 3)}\n{wrap(bsd, 40)}\n{say(30, 5)}\n{wrap(mit, 50)}\n{say(40, 7)}", 2, "BSD-3-Clause,MIT"),
        (5, f"{say(50, 3)} Released under {'the ' * 400} MIT License {say(50, 5)}", 1, "MIT"),  # few distinct pairs
        (6, "\n".join(["Released under the MIT License."] * 10), 11, "MIT"), (7, f"{say(50, 3)} the License of the MIT under free {say(50, 5)}", 0, ""),
        (8, f"{wrap(mit, 60)}\n" * 3 + say(50, 3), 3, "MIT"),
        *[(20 + i, f"Some Program\n\nCopyright (c) 2020 Someone\n\n{wrap(t)}\n\n{say(300, 3)}", 1, n) for i, (n, t) in enumerate(full.items())],
    ]
    got = {r.doc_id: r for r in S.license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [(r[0], got[r[0]].n_matches, got[r[0]].licenses) for r in rows] == [(r[0], *r[2:]) for r in rows]
    assert all(got[20 + i].best_dice == 1.0 for i in range(4))
    assert got[1].best_dice == got[2].best_dice == got[4].best_dice == 1.0


def test_windows_against_brute_force(spark):
    r = random.Random(4)
    kinds = [("A", "a b c d e f"), ("B", "c d e a b"), ("C", "f a c b d")]
    texts = ["".join(r.choice("abcdefxy") + r.choice("    \n") for _ in range(r.randrange(60))).strip() for _ in range(1200)]
    got = {x.doc_id: x for x in S.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=kinds).collect()}
    hits = 0
    for i, text in enumerate(texts):
        w = text.split()
        p = list(zip(w, w[1:]))
        best = 0.0
        for a in range(len(p)):
            for b in range(a + 1, len(p) + 1):
                mine = {f"{x} {y}" for x, y in p[a:b]}
                best = max(best, *(2 * len(mine & set(k)) / (len(mine) + len(k)) for k in (S.pairs_of(t) for _, t in kinds)))
        hits += best >= 0.8 - 1e-9
        assert (got[i].n_matches > 0) == (best >= 0.8 - 1e-9), text
    assert hits > 20


def test_size_bounds_lose_nothing():
    for n in range(1, 40):
        low, high = S.size_bounds(n, 0.8)
        for m in range(1, 80):
            if 2 * min(n, m) / (n + m) >= 0.8:
                assert low <= m <= high


def test_no_python_on_the_way(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    plan = S.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
