"""Personal data: patterns, and information-theoretic sanitisation of the terms around them (operator 6).

Patterns find e-mail addresses, IP addresses, card numbers and phone
numbers; their values and the domains of addresses are the protected entities. Terms within a few words
of an entity are measured on the whole corpus: with N documents, df(t) and
df(e) that hold the term and the entity, and n(t, e) that hold both,
wherever they stand, the term's disclosure is

    log(n(t, e) * N / (df(t) * df(e))) / log(N / df(e)),

the share of the entity's information that the term gives away: 1 where the
term occurs with that entity only. Documents of the same text are one, and
a pair that fewer than ``least_documents`` documents have is no estimate.
Terms whose disclosure reaches the threshold are generalised to the class of
all words that begin alike: to the longest beginning (of CLASSES letters)
whose own disclosure, counted over the corpus in the same way, lies below the
threshold. Where no class does, the term is removed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, ids_of, materialize, ship, table, text_column, with_size_checked

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
WINDOW, LEAST_DOCUMENTS, THRESHOLD = 5, 2, 0.8
#: Letters of the beginnings that name a broader class, longest first.
CLASSES = (5, 4, 3)
#: At most so many terms, and pairs of an entity and a term, are broadcast to be counted; beyond that all are counted and joined.
MOST_TERMS = 200_000
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": ""}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[^0-9]+")
_NONE: frozenset[str] = frozenset()
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern local@domain finds from left to right, looked up around each @."""
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all pattern matches that pass their checks, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (x.lstrip("0") for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entities(kind: str, value: str) -> list[str]:
    """What a found value protects: itself and, as the corpus links it to far more documents, the domain of an address."""
    own = f"{kind}:{value.lower() if kind in ('email', 'ip') else _DIGITS.sub('', value)}"
    return [own, f"domain:{value.lower().rsplit('@', 1)[1]}"] if kind == "email" else [own]


def contexts(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) for the terms within so many words of each span, but those in spans."""
    out = []
    words = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    lowered = [text[s:e].lower() for s, e in words]
    inside: set[int] = set()
    for _, y, z in spans:
        inside.update(range(bisect_right(ends, y), bisect_left(starts, z)))
    for kind, a, b in spans:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        near = [i for i in (*range(max(0, before - window), before), *range(after, min(after + window, len(words)))) if i not in inside]
        out += [(name, lowered[i], *words[i]) for name in entities(kind, text[a:b]) for i in near]
    return out


def words_of(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def classes_of(words: set[str]) -> set[str]:
    """The beginnings, marked by *, of longer words."""
    return {w[:k] + "*" for k in CLASSES for w in words if len(w) > k}


FOUND = (
    "row long, doc_id long, digest string, base string, n_email long, n_ip long, n_card long, n_phone long, entities array<string>,"
    " near array<struct<entity:string,term:string,start:int,stop:int>>"
)


def _find(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc, text in zip(ids_of(batch["doc_id"]), batch["text"].tolist()):
                spans = base_spans(text)
                count = Counter(k for k, _, _ in spans)
                near = []
                for name, term, a, b in contexts(text, spans, window) if spans else ():
                    near.append({"entity": name, "term": term, "start": a, "stop": b})
                rows.append((
                    row, doc, hashlib.md5(text.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans),
                    *(count[k] for k in KINDS[:4]), sorted({name for k, a, b in spans for name in entities(k, text[a:b])}), near,
                ))
                row += 1
            yield pd.DataFrame(rows, columns=["row", "doc_id", "digest", "base", "n_email", "n_ip", "n_card", "n_phone", "entities", "near"]).assign(doc_id=pd.array([r[1] for r in rows], dtype="Int64"))

    return materialize(docs.select(id_column(), text_column().alias("text")).mapInPandas(run, FOUND), "personal")


def _document_counts(docs: DataFrame, pairs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """term, df: in how many different texts each of these terms and classes occurs; entity, term, n: in how many each of these pairs does, wherever its two stand."""
    context = docs.sparkSession.sparkContext
    few = [r["term"] for r in terms.limit(MOST_TERMS + 1).collect()]
    few_pairs = pairs.select("entity", "term").limit(MOST_TERMS + 1).collect()
    of = defaultdict(set)
    for r in few_pairs:
        of[r["entity"]].add(r["term"])
    wanted = context.broadcast((frozenset(few) if len(few) <= MOST_TERMS else None, dict(of) if len(few_pairs) <= MOST_TERMS else None))

    def frame(count: Counter) -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in count.items()], columns=["entity", "term", "n"]).astype({"entity": object, "term": object, "n": np.int64})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (only, of), count = wanted.value, Counter()
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                words |= classes_of(words)
                if only is not None:
                    words &= only
                count.update((None, w) for w in words)
                for name in {name for k, a, b in base_spans(text) for name in entities(k, text[a:b])} if words else ():
                    count.update((name, w) for w in (words if of is None else words & of.get(name, _NONE)))
                    if len(count) > 200_000:
                        yield frame(count)
                        count = Counter()
            if len(count) > 200_000:
                yield frame(count)
                count = Counter()
        yield frame(count)

    counted = docs.select(text_column().alias("text")).mapInPandas(run, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "counts")
    frequency = counted.where("entity is null").select("term", F.col("n").alias("df"))
    return frequency, counted.where("entity is not null")


def disclosing_terms(docs: DataFrame, found: DataFrame, least_documents: int = LEAST_DOCUMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """entity, term, disclosure, class (null: none broad enough) of the pairs that reach the threshold; all different texts are counted."""
    # of texts that occur again only one row counts; few have to be known to leave out the others
    again = materialize(found.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first", "n"), "texts-again")
    copies = again.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).collect()[0][0]
    total = F.lit(float(found.count() - copies))
    once = found.join(with_size_checked(again.select("digest", "first")), "digest", "left").where("first is null or row = first")
    near = once.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term").distinct()
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("documents"))
    pairs = materialize(pairs.where(F.col("documents") >= least_documents).select("entity", "term"), "pairs")
    broader = F.array_compact(F.array(*[F.when(F.length("term") > k, F.concat(F.substring("term", 1, k), F.lit("*"))) for k in CLASSES]))
    asked = materialize(pairs.select("entity", F.explode(F.concat(F.array("term"), broader)).alias("term")).distinct(), "asked-pairs")
    terms = materialize(asked.select("term").distinct(), "terms")
    first = docs.select(F.md5(text_column().cast("binary")).alias("digest"), text_column().alias("text"))
    texts = first.join(with_size_checked(again.select("digest")), "digest", "left_anti").select("text").unionByName(
        first.join(with_size_checked(again.select("digest")), "digest", "left_semi").dropDuplicates(["digest"]).select("text")
    )
    frequency, together = _document_counts(texts, asked, terms)
    entities = once.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("de"))
    measured = (
        asked.join(together, ["entity", "term"]).join(frequency, "term").join(entities, "entity")
        .withColumn("disclosure", F.when(F.col("de") < total, F.log(F.col("n") * total / (F.col("df") * F.col("de"))) / F.log(total / F.col("de"))).otherwise(F.lit(0.0)))
    )
    measured = materialize(measured.select("entity", "term", "disclosure"), "measured")
    told = pairs.join(measured, ["entity", "term"]).where(F.col("disclosure") >= threshold)
    held = measured.select("entity", F.col("term").alias("class"), F.col("disclosure").alias("broad"))
    wide = told.select("entity", "term", F.explode(broader).alias("class")).join(held, ["entity", "class"]).where(F.col("broad") < threshold)
    wide = wide.groupBy("entity", "term").agg(F.max_by("class", F.length("class")).alias("class"))
    return materialize(told.join(wide, ["entity", "term"], "left"), "disclosing")


def personal_data(docs: DataFrame, window: int = WINDOW, least_documents: int = LEAST_DOCUMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, digest (md5 of the text), counts, base (spans as kind:start:end, comma-joined) and terms, for each row as it comes.

    terms has kind:start:end:class, of the kinds generalised and removed (no
    class). A word near several entities goes by the broadest class, or is
    removed if one of them asks for that. Offsets count code points. Null
    texts are empty; null ids stay null; repeated rows come each, with the
    spans of their text; no rows give none; long texts are searched whole.
    """
    found = _find(docs, window)
    told = disclosing_terms(docs, found, least_documents, threshold)
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.start", "x.stop")
    marked = near.join(with_size_checked(told), ["entity", "term"]).groupBy("row", "start", "stop").agg(
        F.max(F.col("class").isNull()).alias("gone"), F.min_by("class", F.length("class")).alias("class")
    )
    shown = F.when(F.col("gone"), F.concat(F.lit("removed:"), F.col("start"), F.lit(":"), F.col("stop"), F.lit(":"))).otherwise(F.concat(F.lit("generalised:"), F.col("start"), F.lit(":"), F.col("stop"), F.lit(":"), F.col("class")))
    added = marked.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", shown.alias("shown")))), lambda x: x["shown"]), ",").alias("terms"))
    added = materialize(added, "added")
    return found.drop("entities", "near").join(with_size_checked(added, 100_000), "row", "left").drop("row").withColumn("terms", F.coalesce("terms", F.lit("")))


def _spans(spans: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and class of each span, by start, then the longest."""
    rows = (x.split(":") for x in spans.split(",") if x)
    return sorted(((int(r[1]), int(r[2]), r[0], r[3] if len(r) > 3 else "") for r in rows), key=lambda r: (r[0], -r[1], r[2], r[3]))


def replaced(text: str, spans: str) -> str:
    """The text with each span replaced: base ones by their kind's mark, terms by their class or nothing.

    Spans that overlap are one, of the kind of the first and longest.
    """
    out: list[list] = []
    for a, b, kind, name in _spans(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, f"[{name}]" if kind == "generalised" else MARKS[kind]])
    at, parts = 0, []
    for a, b, mark in out:
        parts += [text[at:a], mark]
        at = b
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with personal data marked and disclosing terms generalised or removed; other columns stay, whatever their names; null texts stay null."""
    spark = docs.sparkSession
    ship(spark)
    spans = personal_data(docs, **options)
    every = F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "terms")])
    spans = spans.select(F.col("doc_id").alias("tessera_id"), F.col("digest").alias("tessera_digest"), every.alias("tessera_spans")).where("tessera_spans != ''").dropDuplicates(["tessera_id", "tessera_digest"])
    spans = with_size_checked(materialize(spans, "spans"), 50_000)

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([replaced(t, s) if s else t for t, s in zip(text, at)], dtype=object)

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("tessera_id")) & (F.md5(text_column().cast("binary")) == F.col("tessera_digest"))
    out = docs.join(spans, same, "left")
    # rows without spans pass Python by
    return out.select(*[(F.when(F.col("tessera_spans").isNull(), F.col(c)).otherwise(rewrite(text_column(), F.col("tessera_spans"))).alias(c) if c == "text" else F.col(c)) for c in docs.columns])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans as kind:start:end, of each row of documents; personal_data() says what happens to nulls, copies and long texts."""
    found = personal_data(table(spark, sf_dir, "documents"))
    terms = F.regexp_replace("terms", r"(:[0-9]+:[0-9]+):[^,]*", "$1")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", *[F.when(c != "", c) for c in (F.col("base"), terms)]).alias("spans"),
    )
