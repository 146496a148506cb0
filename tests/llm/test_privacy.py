import hashlib
import random
import re

import tessera.llm.privacy as S


def brute(t):
    luhn = lambda d: sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    o += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    o += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return o


def test_patterns():
    r = random.Random(1)
    alphabet = "0123456789.@+- ()ab%0٣é"
    for _ in range(20_000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert S.base_spans(t) == brute(t)
    assert S.base_spans("4111 1111 1111 1111 a@b.co 10.0.0.255 +1 (555) 123-4567") == [("email", 20, 26), ("ip", 27, 37), ("card", 0, 19), ("phone", 38, 55)]
    assert S.base_spans("9" * 200_000) == []
    assert S.base_spans("0" * 5000 + ".1.2.3") == [("ip", 0, 5006)]  # more digits than int() takes


def corpus():
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in ("aa", "oo", "uu") for c in "lmnpr"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, say(40), "x") for i in range(200)]
    # a nickname that stands beside one address in several wordings, and nowhere else
    rows += [(300 + i, f"{say(10)} ask zorblax {say(1)} {say(1)} at joe@mail.example.org {say(9)}", "x") for i in range(6)]
    return rows + [(400, None, None), (401, "", None), (None, "a@b.co", "x"), (300, rows[200][1], "x"), (402, "4111111111111111 " * 3000, "x"), (2**62 + 1, "large id", "x")]


SCHEMA = "doc_id long, text string, base string"


def test_terms_that_disclose(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = S.personal_data(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    texts = {d: t or "" for d, t, _ in corpus()}
    for i in range(6):
        at = texts[300 + i].index("zorblax")
        assert f"removed:{at}:{at + 7}:" in by[300 + i].terms
    assert all(not r.terms for r in got if r.doc_id is not None and r.doc_id < 200)
    assert by[402].n_card == len([x for x in brute(texts[402]) if x[0] == "card"])
    for r in got:
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
    assert set(by) == set(texts)
    assert S.personal_data(docs.limit(0)).collect() == []


def words(t):
    return {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}


def brute_terms(rows):
    """doc_id -> {(start, end): class, or None if removed}, straight from the definition."""
    import math

    texts = {t or "" for _, t, *_ in rows}
    held = {t: words(t) | {w[:k] + "*" for w in words(t) for k in (5, 4, 3) if len(w) > k} for t in texts}
    entities = {t: {e for k, a, b in brute(t) for e in S.entities(k, t[a:b])} for t in texts}
    near = {}
    for t in texts:
        spans = brute(t)
        found = [m.span() for m in re.finditer(r"[^\W\d_]{3,}", t)]
        out = [(a, b) for a, b in found if not any(a < z and b > y for _, y, z in spans)]
        for k, a, b in spans:
            before = [w for w in found if w[1] <= a][-5:]
            after = [w for w in found if w[0] >= b][:5]
            for w in before + after:
                for e in S.entities(k, t[a:b]) if w in out else ():
                    near.setdefault((e, t[w[0] : w[1]].lower()), set()).add((t, *w))

    def disclosure(e, w):
        n, df, de = (sum(x) for x in ((w in held[t] and e in entities[t] for t in texts), (w in held[t] for t in texts), (e in entities[t] for t in texts)))
        return math.log(n * len(texts) / (df * de)) / math.log(len(texts) / de) if de < len(texts) else 0.0

    told = {}
    for (e, w), places in near.items():
        if len({t for t, _, _ in places}) >= 2 and disclosure(e, w) >= 0.8:
            wide = [w[:k] + "*" for k in (5, 4, 3) if len(w) > k and disclosure(e, w[:k] + "*") < 0.8]
            for t, a, b in places:
                told.setdefault(t, {}).setdefault((a, b), []).append(wide[0] if wide else None)
    return {d: {k: None if None in v else min(v, key=len) for k, v in told.get(t or "", {}).items()} for d, t, *_ in rows}


def test_terms_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"{a}{b}{c}{d}" for a in ("ba", "be", "du", "ka") for b in "nrst" for c in ("a", "ok", "imi") for d in ("", "x", "lan")]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, say(12)) for i in range(150)]
    nicks = ["zorblax", "quuxly", "frobnic", "wibbles", "banimiq", "dutokq", "kasimilanq", "bersaq"]  # the last four begin like common words
    for i in range(40):
        who = f"p{i % 8}@mail.example.org"
        rows.append((200 + i, f"{say(r.randrange(9))} {nicks[i % 8]} {who} {say(r.randrange(9))} {['', '10.0.0.' + str(i % 5)][i % 2]} {vocabulary[i % 8]}"))
    rows += [(300, rows[160][1]), (301, rows[160][1])]  # copies are one text
    want = brute_terms(rows)
    got = {x.doc_id: {(int(a), int(b)): name or None for k, a, b, name in (y.split(":") for y in x.terms.split(",") if y)} for x in S.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    kinds = [name is None for v in want.values() for name in v.values()]
    assert sum(kinds) > 5 and len(kinds) - sum(kinds) > 5  # both kinds


def test_many_hits_in_one_text():
    import time

    text = " ".join(f"word{chr(97 + i % 26)} a{i}@b.co" for i in range(100_000))
    began = time.perf_counter()
    spans = S.base_spans(text)
    near = S.contexts(text, spans)
    spans = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert S.replaced(text, spans).count("[EMAIL]") == 100_000 and len(near) > 900_000
    assert time.perf_counter() - began < 20


def wide_corpus():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "elit", "sed"]) for _ in range(n))
    rows = [(i, say(30)) for i in range(300)]
    # in all documents of the address, but near it in three only; and one whose next words stand beyond numbers
    rows += [(1000 + i, f"zorblax {say(r.randrange(1, 3))} joe@mail.example.org" if i < 3 else f"zorblax {say(20)} joe@mail.example.org {say(20)}") for i in range(20)]
    rows += [(2000 + i, f"{say(3)} 10.1.2.3 {'12 34 ' * 100} {say(i)} quuxly {say(9)}") for i in range(3)]
    return rows


def test_whole_documents_are_counted(spark, monkeypatch):
    rows = wide_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (S.MOST_TERMS, 0):
        monkeypatch.setattr(S, "MOST_TERMS", most)
        got = {r.doc_id: r.terms for r in S.personal_data(docs).collect()}
        for i, text in rows:
            if 1000 <= i < 1003 or i >= 2000:
                at = text.index("zorblax" if i < 2000 else "quuxly")
                assert f"removed:{at}:" in got[i], (most, i)


def test_long_words_are_whole():
    long = "ж" * 300
    near = S.contexts(f"{long} a@b.co {long}", [("email", 301, 307)])
    assert near == [(e, long, a, b) for e in ("email:a@b.co", "domain:b.co") for a, b in ((0, 300), (308, 608))]


def test_all_words_counted_beyond_the_limit(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    want = sorted(map(tuple, S.personal_data(docs).select("doc_id", "terms").collect()), key=str)
    monkeypatch.setattr(S, "MOST_TERMS", 0)
    assert sorted(map(tuple, S.personal_data(docs).select("doc_id", "terms").collect()), key=str) == want


def test_sanitised_texts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = [tuple(r) for r in S.sanitise(docs).collect()]
    assert len(got) == docs.count()
    by = {r[0]: r for r in got}
    assert "joe@" not in by[300][1] and "[EMAIL]" in by[300][1] and "zorblax" not in by[300][1]
    assert by[None] == (None, "[EMAIL]", "x") and by[400] == (400, None, None) and by[5] == corpus()[5]


def test_query(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    monkeypatch.setattr(S, "table", lambda *a: docs)
    texts = {d: t or "" for d, t, _ in corpus()}
    for r in S.op6_personal_data(spark, "").collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base) and all(re.fullmatch("(generalised|removed):[0-9]+:[0-9]+", x) for x in r.spans[len(base) :].split(",") if x)


def test_overlaps_are_replaced_once():
    assert S.replaced("0123456789", "card:2:6,ip:4:8,removed:8:9:") == "01[CARD]9"
    assert S.replaced("0123456789", "generalised:2:6:abc*,email:7:8") == "01[abc*]6[EMAIL]89"


def test_no_tail_of_an_overlapping_span_stays(spark):
    rows = [(1, "call +1 212 555 1234.joe@x.com now"), (2, "at 10.0.0.4 111 1111 1111 1111 end")]
    got = {r.doc_id: r.text for r in S.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "call [PHONE] now", 2: "at [IP] end"}
