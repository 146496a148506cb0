"""Selection, projection, products, inner joins, sorting and grouping.

Relations are bags. Where two relations have a field of the same name, the
left one's is the one that can be named; the other is left out.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Field, Predicate, equals
from ..shared import shared_folder

#: Rows of one value on either side of a tile of spread_join(), and pairs of a task; fewer pairs than that need no tiles.
TILE, TASK_PAIRS = 2048, 8_000_000


def _needed(right: DataFrame, left: DataFrame) -> DataFrame:
    return right.drop(*[c for c in right.columns if c in left.columns])


def select(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows for which the predicate holds (null is not true)."""
    return df.where(predicate.column(df))


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """These fields in this order; one may come twice; rows stay as many."""
    for f in fields:
        if f not in df.columns:
            raise ValueError(f"no field {f} among {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{f}`") for f in fields])


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows. A product is as large as both sizes multiplied; give a join its condition instead where there is one."""
    return left.crossJoin(_needed(right, left))


def block_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, by pairing partitions of both sides; for a right side too large to send to every task."""
    return left.crossJoin(_needed(right, left).hint("shuffle_replicate_nl"))


def _joined(left: DataFrame, right: DataFrame, predicate: Predicate, hint: str | None) -> DataFrame:
    across = predicate.joining(left.columns, right.columns)
    # names that only the left side has are taken from it before the right side's are dropped
    right = _needed(right.where(predicate.within(right.columns).column(right)), left)
    left = left.where(predicate.within(left.columns).column(left))
    if hint:
        right = right.hint(hint)
    if not across.terms:
        return left.crossJoin(right)
    pair = left.crossJoin(right)  # its schema types the condition
    return left.join(right, across.column(pair), "inner")


def equi_join(left: DataFrame, right: DataFrame, predicate: Predicate) -> DataFrame:
    """Inner join; terms on one side go to that side's scan. Spark picks a broadcast, hash or sort-merge join by size and skew."""
    return _joined(left, right, predicate, None)


def merge_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """Sort-merge inner join of left_field = right_field."""
    return _joined(left, right, equals(Field(left_field), Field(right_field)), "merge")


def index_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """Inner join of left_field = right_field against an indexed table; Spark probes a hash table of it where its measured size allows, and merges otherwise."""
    return _joined(left, right, equals(Field(left_field), Field(right_field)), None)


def spread_join(left: DataFrame, right: DataFrame, predicate: Predicate) -> DataFrame:
    """equi_join() for values that many rows of both sides have, where a few tasks would form most pairs.

    The pairs of each value are counted first. Its rows on both sides are cut
    into parts of about TILE, every part meets every one of the other side,
    and these tiles are dealt to tasks in proportion to the pairs. What is
    moved and held is a small share of the rows that come out. Rows go to
    parts by a hash of all their fields, so that a task that is run again deals the
    same; rows alike in all fields stay together.
    """
    kinds = dict((*right.dtypes, *left.dtypes))  # of two fields of one name the left one counts
    across = predicate.joining(left.columns, right.columns)
    right = _needed(right.where(predicate.within(right.columns).column(right)), left)
    left = left.where(predicate.within(left.columns).column(left))
    keys = [sorted((t.left.name, t.right[0].name), key=lambda n: n not in left.columns) for t in across.terms]
    if not keys or any(kinds[a] != kinds[b] for a, b in keys):
        return _joined(left, right, predicate, None)

    names = [f"_key{i}" for i in range(len(keys))]
    counts = [
        df.groupBy(*[F.col(f"`{k[side]}`").alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias(f"_rows{side}"))
        for side, df in enumerate((left, right))
    ]
    sizes = counts[0].join(counts[1], names)
    pairs = int(sizes.agg(F.sum(F.col("_rows0").cast("double") * F.col("_rows1"))).first()[0] or 0)
    if pairs <= TASK_PAIRS:
        return _joined(left, right, predicate, None)
    pieces = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(pairs / TASK_PAIRS))
    parts = sizes.select(*names, *[F.ceil(F.col(f"_rows{side}") / TILE).cast("int").alias(f"_parts{side}") for side in (0, 1)])

    def dealt(df: DataFrame, side: int) -> DataFrame:
        hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        own = F.pmod(F.xxhash64(*hashed), F.col(f"_parts{side}")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(f"_parts{1 - side}") - 1))
        named = df.withColumns({n: F.col(f"`{k[side]}`") for k, n in zip(keys, names)})
        tiled = named.join(parts, names).withColumn(f"_part{side}", own).withColumn(f"_part{1 - side}", every)
        return tiled.drop("_parts0", "_parts1").repartition(pieces, *names, "_part0", "_part1")

    tile = [*names, "_part0", "_part1"]
    return dealt(left, 0).join(dealt(right, 1).hint("merge"), tile).drop(*tile)


def index_select(df: DataFrame, field: str, value: str | int | float | bool) -> DataFrame:
    """Rows with field = value; on a table sorted by its indexed field, row-group statistics skip the rest of the file."""
    return select(df, equals(Field(field), value))


def join_all(relations: list[DataFrame], predicate: Predicate | None = None, spread: list[str] | None = None) -> DataFrame:
    """Join relations, each term applied where its fields first meet, so that no product is formed where a term joins.

    Relations follow in the given order, except that one that its own terms
    narrow comes before others, and one that no term connects yet after
    them. Equal fields of one type are equal through others, too. Joins on a
    field named in ``spread`` are spread_join()s: for values that many rows of both sides have.
    """
    own = [relations[0]]  # a name that several have is the first one's
    for r in relations[1:]:
        own.append(r.drop(*[c for df in own for c in df.columns if c in r.columns]))
    order = [c for df in own for c in df.columns]
    rest = (predicate or Predicate()).closed({c: kind for df in own for c, kind in df.dtypes})
    first = rest.within(own[0].columns)
    out, rest, left = select(own[0], first), rest.without(first), own[1:]
    while left:
        if len(set(order)) < len(order):  # fields that can't be named can't be put back in order
            joined = left[:1]
        else:
            joined = [r for r in left if rest.joining(out.columns, r.columns).terms] or left
        r = next((r for r in joined if rest.within(r.columns).terms), joined[0])
        now = rest.within([*out.columns, *r.columns])
        if spread and any(t.fields & set(spread) for t in rest.joining(out.columns, r.columns).terms):
            out = spread_join(out, r, now)
        else:
            out = _joined(out, r, now, None)
        rest, left = rest.without(now), [x for x in left if x is not r]
    if rest.terms:
        rest.column(out)  # names the missing field
    return project(out, order) if out.columns != order else out


def sort_by(df: DataFrame, fields: list[str]) -> DataFrame:
    """All rows in ascending order of these fields, by ranges; spills."""
    return df.orderBy(*[F.col(f"`{f}`").asc() for f in fields])


def group_by(df: DataFrame, fields: list[str], aggregates: list[Column]) -> DataFrame:
    """Fields and aggregates of each group; no rows make no group, even without fields."""
    if fields:
        return df.groupBy(*fields).agg(*aggregates)
    out = df.agg(*aggregates, F.count(F.lit(1)).alias("_rows"))
    return out.where("_rows > 0").drop("_rows")


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and keep in a checkpoint, which outlives lost executors; on one machine without a folder for them, in a temporary one."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
