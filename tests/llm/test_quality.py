import random

import numpy as np
import pytest

import tessera.llm.quality as S


def corpus(n=400):
    r = random.Random(3)
    words = [a + b for a in ("ba", "du", "ke", "lo", "mi") for b in ("n", "r", "st", "x", "ll")]
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 1
        text = " ".join(r.choice(words) for _ in range(r.randrange(20, 60)))
        text = text.upper().replace(" ", "!! ") if bad else text
        text = text + " awfulword" if toxic else text
        docs.append((i, text, "spam" if bad and r.random() < 0.8 else "news", "en", len(text), "x"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
        elif i % 4 == 0:
            labels.append((i, int(not bad), None))
    return docs, labels


DOCS = "doc_id long, text string, source string, lang string, n_chars long, score string"


def test_held_out_accuracy_and_filter(spark, monkeypatch):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows + [(1000, None, None, None, None, None), (None, "ban dur", "news", "en", 7, None), (3, rows[3][1], "news", "en", 5, "x"), (1001, "ban dur " * 50_000, "news", "en", 1, "x")], DOCS)
    labels = spark.createDataFrame([*marks, (None, 1, 0), (5, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    scorer, features = S.fit_quality(docs, labels, confident=0.9)
    assert sum(n for r in scorer.taught for n in r["text"]) > 0 and sum(n for r in scorer.taught for n in r["metadata"]) > 0  # both ways
    assert (scorer.weights[:2] >= 0).all()
    got = S.score_quality(features, scorer).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    told = {m[0] for m in marks}
    unseen = [(r.score >= 0.5) == (r.doc_id % 5 != 0 and r.doc_id % 7 != 1) for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id not in told]
    assert np.mean(unseen) > 0.95
    monkeypatch.setattr(S, "CONFIDENT", 0.9)
    monkeypatch.setattr(S, "fit_quality", lambda *a: (scorer, features))
    kept = S.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score >= 0.5)
    assert S.score_quality(features.limit(0), scorer).collect() == []
    monkeypatch.setattr(S, "table", lambda spark, folder, name: docs if name == "documents" else labels)
    assert sorted((str(r.doc_id), r.score, r.accepted) for r in S.op8_quality(spark, "").collect()) == sorted((str(r.doc_id), r.score, r.score >= 0.5) for r in got)


@pytest.mark.parametrize("marks, score", [([], 0.5), ([(1, 1, 0)], 2 / 3), ([(1, 0, 0), (2, 0, 0)], 0.25)])
def test_labels_of_one_class_teach_nothing(spark, marks, score):
    """Every document has the smoothed share of accepted labels, and a warning is given."""
    rows, _ = corpus(20)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="both classes"):
        scorer, features = S.fit_quality(docs, labels)
    assert [round(r.score, 9) for r in S.score_quality(features, scorer).collect()] == [round(score, 9)] * 20
    with pytest.warns(UserWarning):
        assert S.filter_quality(docs, labels).count() == (20 if score >= 0.5 else 0)
    with pytest.warns(UserWarning):
        assert S.filter_quality(docs.limit(0), labels).count() == 0


def test_lessons_are_the_surest_of_all(spark):
    """Against brute force: each view's lessons are its best documents of the whole pool, beyond its level."""
    rows, marks = corpus(600)
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scorer, features = S.fit_quality(docs, labels, rounds=0)
    scorer.sure = {k: 1.0 for k in scorer.sure}
    free = features.where("doc_id % 2 = 0").repartition(5)
    got = S._taught(scorer, free, {0: 7, 1: 30})
    pool = free.toPandas()
    odds = scorer.odds(*S._matrices(scorer, pool))
    for v, name in enumerate(S.VIEWS):
        for y, n in ((0, 7), (1, 30)):
            mine = odds[:, v] if y else -odds[:, v]
            best = sorted((x for x in mine.round(9) if x >= 1.0), reverse=True)[:n]
            some = got[name][got[name]["y"] == y]
            assert sorted(some["sure"].round(9), reverse=True) == pytest.approx(best, abs=1e-6) and some["doc_id"].is_unique


def test_level():
    odds, right = np.array([3.0, 2.0, 2.0, 1.0, 0.5]), np.array([True, True, True, False, True])
    assert S._level(odds, right, 0.7) == 2.0 and S._level(odds, right, 0.9) == np.inf and S._level(odds, right, 0.4) == 0.5


def test_fit_is_the_least_loss():
    """Against plain gradient descent, and with weights kept from being negative."""
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 3))
    y = (x[:, 0] - x[:, 1] + r.standard_normal(300) > 0).astype(float)
    w = np.zeros(4)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
        w -= 0.005 * (np.append(x.T @ (p - y), (p - y).sum()) + np.append(w[:3], 0) * 1.0)
    assert np.allclose(S.fit_logistic(x, y, ridge=1.0, steps=500), w, atol=1e-3)
    assert S.fit_logistic(x, y, ridge=1.0, steps=500, least=0.0)[:3].min() == 0.0
