"""Quality classifier trained by co-training of a text-content view and a page-metadata view (operator 8).

Two logistic models, one on a document's words and characters and one on its
source, language, length and layout of lines, teach each other. In each
round both score every unlabelled document of the corpus; the ``taught``
documents of which a view is most confident, of each class its share, go to
the other view, which is fitted anew on the labelled documents and on
these. A view is confident beyond the log odds at which ``confident`` of the
documents held back are what it says, so that one that can't tell a class
from the other (metadata hardly show who is polite) doesn't teach it. In the end the calibrated log odds of both are
combined with weights that are never negative, and every document is scored.

The models are fitted on a bounded sample of LABELLED labelled documents and on
what the rounds pick from all unlabelled ones.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_column, ids_of, materialize, ship, table, text_column, with_size_checked

#: Greatest number of labelled documents that the models are fitted and calibrated on (those of least hash of doc_id).
LABELLED = 6000
#: Rounds of exchange, documents that a view teaches in the first one (in the second twice, and so on), and how often it must be right with such ones.
ROUNDS, TAUGHT, CONFIDENT = 2, 600, 0.98
#: Words count if the labels of documents that have them are so many standard errors from all labels.
DEVIATION, LEAST_DOCUMENTS = 3.5, 4
#: Longer words count by their first letters as well.
STEM = 4
#: Hashed places of sources, languages and steps of measures in the metadata view.
PLACES = 512
_WORD = re.compile(r"[^\W\d_]+")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_SHAPE, _LAYOUT = 17, 7


def _shape(text: str, raw: bytes, words: list[str], distinct: int, known: int) -> list[float]:
    n, w = max(1, len(raw)), max(1, len(words))
    gone = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    upper, punctuation = gone(_UPPER), gone(_PUNCTUATION)
    return [
        np.log1p(len(raw)), np.log1p(w), upper, upper**0.5, gone(_DIGIT), punctuation, punctuation**0.5,
        100 * raw.count(b"|") / n, 100 * raw.count(b"!") / n, 100 * raw.count(b"http") / n, n / w, distinct / w, np.log1p(w) * distinct / w, known / max(1, distinct), float(not words),
        *_repeats(text),
    ]


def _repeats(text: str) -> tuple[float, float]:
    lines = text.split("\n")
    repeated = 1 - len(set(lines)) / len(lines)
    return repeated, float(repeated > 0.3)


def _layout(text: str) -> list[float]:
    """How a page is laid out, without a look at its words."""
    lines = text.split("\n")
    size = [len(x) for x in lines]
    return [
        np.log1p(len(text)), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), np.log1p(max(size)),
        sum(x < 20 for x in size) / len(lines), sum(x.rstrip()[-1:] in ".!?" and x.strip() != "" for x in lines) / len(lines),
    ]


def _features(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Shape of each text, which words and beginnings of words (marked by *) of the vocabulary it has, and its layout."""
    shapes, has, layouts = [], [], []
    known = vocabulary.keys()
    for text in texts:
        words = _WORD.findall(text.lower())
        seen = set(words)
        mine = sorted(map(vocabulary.__getitem__, (seen & known) | ({w[:STEM] + "*" for w in seen if len(w) > STEM} & known)))
        shapes.append(_shape(text, text.encode(), words, len(seen), len(mine)))
        layouts.append(_layout(text))
        has.append(mine)
    return np.array(shapes, np.float32).reshape(len(has), _SHAPE), has, np.array(layouts, np.float32).reshape(len(has), _LAYOUT)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 200, least: float = -np.inf) -> np.ndarray:
    """Weights of at least ``least``, then the intercept, by accelerated projected gradient descent; columns should be standardised.

    Products are taken in the type of x, so that x is never copied.
    """
    along = lambda w: x @ w[:-1].astype(x.dtype) + w[-1]
    across = lambda r: np.append(x.T @ r.astype(x.dtype), r.sum()).astype(np.float64)
    v = np.ones(x.shape[1] + 1)
    for _ in range(8):  # the greatest curvature, by power iteration
        v = across(along(v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (0.25 * 1.1 * top + ridge)
    w = ahead = np.zeros(x.shape[1] + 1)
    keep, low = np.append(np.full(x.shape[1], ridge), 1e-6), np.append(np.full(x.shape[1], least), -np.inf)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(along(ahead), -30, 30)))
        new = np.maximum(ahead - rate * (across(p - y) + keep * ahead), low)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


class View:
    """A standardising logistic model with Platt calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean = x.mean(axis=0, dtype=np.float64).astype(np.float32)
        self.scale = np.ones(x.shape[1], np.float32)
        z = x - self.mean
        spread = np.sqrt(np.einsum("ij,ij->j", z, z) / len(z))
        del z
        self.scale[spread >= 1e-6] = spread[spread >= 1e-6]
        self.w = fit_logistic(self._z(x), y, ridge=0.02 * len(y) ** 0.5 + 1)
        self.a, self.b = 1.0, 0.0
        return self

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        z /= self.scale
        return np.clip(z, -6, 6, out=z)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * ((self._z(x) @ self.w[:-1].astype(np.float32)).astype(np.float64) + self.w[-1]) + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        s = self.logit(x)
        self.a, self.b = fit_logistic(s[:, None], y, ridge=1e-3, steps=400)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


VIEWS = ("text", "metadata")


def _level(odds: np.ndarray, right: np.ndarray, confident: float) -> float:
    """The least odds such that of the documents with these or more so large a share is right; infinite if there are none."""
    order = np.argsort(-odds, kind="stable")
    share = np.cumsum(right[order]) / np.arange(2, len(order) + 2)  # as if one more were wrong: few documents prove little
    last = np.flatnonzero((share >= confident) & (np.append(odds[order][1:], -np.inf) < odds[order]))
    return float(odds[order][last[-1]]) if len(last) else np.inf


class Scorer:
    """Scores texts and metadata with the fitted views; small enough to be sent to every task."""

    def __init__(self, vocabulary: dict[str, int], prior: float):
        self.vocabulary, self.prior = vocabulary, prior
        self.views: tuple[View, View] | None = None
        self.weights = np.array([0.0, 0.0, np.log(prior / (1 - prior))])
        #: Documents that each view has taught in each round, as (accepted, rejected).
        self.taught: list[dict[str, tuple[int, int]]] = []

    def text_matrix(self, shapes: np.ndarray, has: list) -> np.ndarray:
        out = np.zeros((len(has), _SHAPE + len(self.vocabulary)), np.float32)
        out[:, :_SHAPE] = shapes
        for i, k in enumerate(has):
            out[i, np.asarray(k, np.int64) + _SHAPE] = 1
        return out

    def meta_matrix(self, layouts: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
        """Measures, then hashed places of the source, the language and steps of the measures."""
        out = np.zeros((len(rows), PLACES + _LAYOUT + 1), np.float32)
        out[:, PLACES : PLACES + _LAYOUT] = layouts
        out[:, -1] = np.log1p(np.maximum(pd.to_numeric(rows["n_chars"]).fillna(0).to_numpy(np.float64), 0))
        steps = np.floor(out[:, PLACES:] * np.array([2, 2, 10, 2, 2, 10, 10, 2], np.float32)).astype(np.int64)
        names = [(f"{name}={x}" if isinstance(x, str) else name for x in rows[name]) for name in ("source", "lang")]
        for i, (told, mine) in enumerate(zip(zip(*names), steps.tolist())):
            out[i, [xxhash.xxh32_intdigest(x) % PLACES for x in (*told, *(f"{k}:{v}" for k, v in enumerate(mine)))]] = 1
        return out

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log odds of both views."""
        if self.views is None:
            return np.full((len(text), 2), np.log(self.prior / (1 - self.prior)))
        return np.clip(np.column_stack([v.logit(x) for v, x in zip(self.views, (text, meta))]), -10, 10)

    def combine(self, odds: np.ndarray) -> np.ndarray:
        return _sigmoid(odds @ self.weights[:2] + self.weights[2])

    def fit(self, fitted: list[tuple[np.ndarray, np.ndarray]], held: tuple[np.ndarray, np.ndarray], y: np.ndarray, confident: float) -> None:
        """Fit both views on their (features, labels), calibrate and combine them on the documents held back."""
        self.views = tuple(View().fit(x, told).calibrate(h, y) for (x, told), h in zip(fitted, held))
        odds = self.odds(*held)
        self.weights = fit_logistic(odds, y, ridge=1e-2, steps=400, least=0.0)
        self.sure = {(name, k): _level(odds[:, v] if k else -odds[:, v], y == k, confident) for v, name in enumerate(VIEWS) for k in (0, 1)}


KINDS = {"source": "string", "lang": "string", "n_chars": "double"}
FEATURES = "doc_id long, source string, lang string, n_chars double, shape binary, has binary, layout binary"


def _own(docs: DataFrame) -> list[Column]:
    """The columns that the metadata view uses; those that are missing are null."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in KINDS.items()]


def _matrices(scorer: Scorer, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows of the features' table."""
    unpack = lambda column, t: np.frombuffer(b"".join(rows[column]), t).reshape(len(rows), -1)
    return scorer.text_matrix(unpack("shape", np.float32), [np.frombuffer(x, np.int32) for x in rows["has"]]), scorer.meta_matrix(unpack("layout", np.float32), rows)


def _featured(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """FEATURES of every row, null ids included."""
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes, has, layouts = _features(batch.pop("text").tolist(), share.value)
            yield batch.assign(doc_id=pd.array(ids_of(batch["doc_id"]), dtype="Int64"), shape=[x.tobytes() for x in shapes], has=[np.array(x, np.int32).tobytes() for x in has], layout=[x.tobytes() for x in layouts])

    return docs.select(id_column(), *_own(docs), text_column().alias("text")).mapInPandas(run, FEATURES)


def _taught(scorer: Scorer, free: DataFrame, most: dict[int, int]) -> dict[str, pd.DataFrame]:
    """Of all unlabelled documents, the ``most`` of each class of which each view is surest; their features and the class."""
    share = free.sparkSession.sparkContext.broadcast(scorer)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = share.value
        for rows in batches:
            for a in range(0, len(rows), 2000):
                part = rows.iloc[a : a + 2000]
                odds = s.odds(*_matrices(s, part))
                for v, name in enumerate(VIEWS):
                    for y, n in most.items():
                        mine = odds[:, v] if y else -odds[:, v]
                        best = np.argsort(-mine, kind="stable")[:n]
                        best = best[mine[best] >= s.sure[name, y]]
                        yield part.iloc[best].assign(view=name, y=y, sure=mine[best])

    got = free.mapInPandas(pick, f"{FEATURES}, view string, y int, sure double").withColumn("tie", F.xxhash64("doc_id"))
    limit = F.when(F.col("y") == 1, most[1]).otherwise(most[0])
    # the best of parts, then of what is left: a few times as many rows as are wanted, whatever the number of documents
    rank = F.row_number().over(Window.partitionBy("view", "y", F.pmod("tie", F.lit(16))).orderBy(F.desc("sure"), "tie", "doc_id"))
    got = materialize(got.withColumn("rank", rank).where(F.col("rank") <= max(most.values())).where(F.col("rank") <= limit).drop("rank"), "surest")
    best = lambda name, y: got.where((F.col("view") == name) & (F.col("y") == y)).orderBy(F.desc("sure"), "tie", "doc_id").limit(most[y]).toPandas()
    return {name: pd.concat([best(name, y) for y in most]) for name in VIEWS}


def fit_quality(docs: DataFrame, labels: DataFrame, accepted: Column | None = None, rounds: int = ROUNDS, taught: int = TAUGHT, confident: float = CONFIDENT) -> tuple[Scorer, DataFrame]:
    """The scorer, and the features of every row of docs.

    A document is accepted if its quality label is 1 and it is not marked
    toxic, unless ``accepted`` says otherwise; rows with a null label or id
    are not used, the least label counts where an id has several, and a
    repeated id counts once among the labelled ones. Of very many labelled
    documents the LABELLED ones of least hash are used. Where the labels that
    documents have don't hold both classes, nothing can be learnt: every
    score is then the smoothed share of accepted labels (0.5 without any),
    and a warning says so. No rows, null, empty and very long texts are no
    special cases; other columns are ignored.
    """
    spark = docs.sparkSession
    accepted = accepted if accepted is not None else (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marked = labels.select(F.col("doc_id").cast("long").alias("marked_id"), accepted.cast("int").alias("y")).where("marked_id is not null and y is not null")
    marked = materialize(marked.groupBy("marked_id").agg(F.min("y").alias("y")), "labelled")
    chosen = materialize(marked.orderBy(F.xxhash64("marked_id"), "marked_id").limit(LABELLED), "chosen")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("marked_id"))  # at most LABELLED rows

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    words = materialize(own.select("y", F.array_distinct(F.concat(words, stems)).alias("words")), "labelled-words")
    total, good = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).collect()[0]
    vocabulary: dict[str, int] = {}
    if 0 < good < total:
        p = good / total
        counts = words.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
        far = F.abs(F.col("good") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
        vocabulary = {w: i for i, w in enumerate(sorted(r["word"] for r in counts.where((F.col("n") >= LEAST_DOCUMENTS) & (far >= DEVIATION)).select("word").collect()))}
    scorer = Scorer(vocabulary, (good + 1) / (total + 2))
    features = materialize(_featured(docs, vocabulary), "features")
    if not 0 < good < total:
        warnings.warn("quality: the labels don't hold both classes, so all documents get the same score", stacklevel=2)
        return scorer, features

    sample = features.join(F.broadcast(chosen), F.col("doc_id") == F.col("marked_id")).drop("marked_id").dropDuplicates(["doc_id"])
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    text, meta = _matrices(scorer, got)
    y, at = got["y"].to_numpy(), np.arange(len(got))
    held, fitted = at[::4], np.setdiff1d(at, at[::4])
    if len(set(y[held])) < 2 or len(set(y[fitted])) < 2:
        held = fitted = at
    kept = (text[held], meta[held]), y[held], confident
    scorer.fit([(text[fitted], y[fitted]), (meta[fitted], y[fitted])], *kept)
    free = features.where("doc_id is not null").join(with_size_checked(marked), F.col("doc_id") == F.col("marked_id"), "left_anti")
    for r in range(1, rounds + 1):
        most = {1: max(1, round(r * taught * scorer.prior)), 0: max(1, round(r * taught * (1 - scorer.prior)))}
        lessons = _taught(scorer, free, most)
        scorer.taught.append({name: (int((x["y"] == 1).sum()), int((x["y"] == 0).sum())) for name, x in lessons.items()})
        # each view learns what the other one is sure of
        more = [_matrices(scorer, lessons[other])[v] if len(lessons[other]) else m[:0] for v, (other, m) in enumerate((("metadata", text), ("text", meta)))]
        told = [lessons[other]["y"].to_numpy() for other in ("metadata", "text")]
        scorer.fit([(np.concatenate([m[fitted], x]), np.concatenate([y[fitted], t])) for m, x, t in zip((text, meta), more, told)], *kept)
    return scorer, features


def score_quality(features: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, text_score, metadata_score for each row of features, as it comes."""
    share = features.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = share.value
        for batch in batches:
            for a in range(0, len(batch), 2000):
                rows = batch.iloc[a : a + 2000]
                odds = s.odds(*_matrices(s, rows))
                yield pd.DataFrame({"doc_id": pd.array(ids_of(rows["doc_id"]), dtype="Int64"), "score": s.combine(odds), "text_score": _sigmoid(odds[:, 0]), "metadata_score": _sigmoid(odds[:, 1])})

    return features.withColumn("doc_id", id_column()).mapInPandas(run, "doc_id long, score double, text_score double, metadata_score double")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold; each row is scored where it lies."""
    ship(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels)[0])

    @F.pandas_udf("double")
    def score(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        s = share.value
        rows = pd.DataFrame({"text": text.fillna(""), "source": source, "lang": lang, "n_chars": n_chars})
        out = [np.zeros(0)]
        for a in range(0, len(rows), 2000):
            part = rows.iloc[a : a + 2000]
            shapes, has, layouts = _features(part["text"].tolist(), s.vocabulary)
            out.append(s.combine(s.odds(s.text_matrix(shapes, has), s.meta_matrix(layouts, part))))
        return pd.Series(np.concatenate(out))

    return docs.where(score(text_column(), *_own(docs)) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, text_score, metadata_score, accepted of each row of documents; fit_quality() says what happens to nulls, ties and too few labels."""
    scorer, features = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_quality(features, scorer).withColumn("accepted", F.col("score") >= 0.5)
