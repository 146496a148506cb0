"""Conjunctions of typed comparisons.

Values of different families (numbers, strings, booleans, others by their
type) are never equal and never an error; Spark alone would cast one to the
other. A predicate becomes one Column, so Catalyst pushes it to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column by its exact name."""

    name: str


Value = str | int | float | bool
Operand = Field | Value


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return kind.typeName()


def _family_of(x: Operand, schema: T.StructType) -> str:
    if isinstance(x, Field):
        names = [f for f in schema if f.name == x.name]
        if not names:
            raise ValueError(f"no field {x.name} among {', '.join(schema.names)}")
        return _family(names[0].dataType)
    return "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"


def _column(x: Operand, df: DataFrame) -> Column:
    return F.col(f"`{x.name}`") if isinstance(x, Field) else F.lit(x)


@dataclass(frozen=True)
class Term:
    """left = right, or left in values."""

    left: Operand
    right: tuple[Operand, ...]

    @property
    def fields(self) -> frozenset[str]:
        return frozenset(x.name for x in (self.left, *self.right) if isinstance(x, Field))

    def column(self, df: DataFrame) -> Column:
        family = _family_of(self.left, df.schema)
        same = [x for x in self.right if _family_of(x, df.schema) == family]
        if not same:
            return F.lit(False)
        left = _column(self.left, df)
        if len(same) == 1:
            return left == _column(same[0], df)
        return left.isin(*same)


@dataclass(frozen=True)
class Predicate:
    """All terms hold; without terms it is true."""

    terms: tuple[Term, ...] = ()

    def column(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [t.column(df) for t in self.terms], F.lit(True)) if self.terms else F.lit(True)

    def applies_to(self, fields: list[str]) -> bool:
        return all(t.fields <= set(fields) for t in self.terms)

    def within(self, fields: list[str]) -> Predicate:
        """The terms that these fields alone decide."""
        return Predicate(tuple(t for t in self.terms if t.fields <= set(fields)))

    def joining(self, left: list[str], right: list[str]) -> Predicate:
        """The terms that need fields of both sides."""
        both = set(left) | set(right)
        return Predicate(tuple(t for t in self.terms if t.fields <= both and not t.fields <= set(left) and not t.fields <= set(right)))

    def without(self, other: Predicate) -> Predicate:
        return Predicate(tuple(t for t in self.terms if t not in other.terms))

    def closed(self, kinds: dict[str, str]) -> Predicate:
        """With the equalities that follow from a = b and b = c; of fields of one type only, as casts may make unequal values equal."""
        terms = list(self.terms)
        pairs = [tuple(sorted((t.left.name, t.right[0].name))) for t in terms if len(t.right) == 1 and len(t.fields) == 2]
        pairs = [p for p in pairs if kinds.get(p[0]) == kinds.get(p[1])]
        seen = set(pairs)
        for a, b in pairs:  # grows on the way
            for x, y in list(seen):
                new = tuple(sorted({a, b} ^ {x, y}))
                if len(new) == 2 and new not in seen:
                    seen.add(new)
                    pairs.append(new)
                    terms.append(Term(Field(new[0]), (Field(new[1]),)))
        return Predicate(tuple(terms))

    def constant_of(self, field: str) -> Value | None:
        """c of the first term field = c."""
        for t in self.terms:
            for a, b in ((t.left, t.right), (t.right[0], (t.left,))):
                if len(t.right) == 1 and a == Field(field) and not isinstance(b[0], Field):
                    return b[0]
        return None

    def partner_of(self, field: str) -> str | None:
        """g of the first term field = g."""
        for t in self.terms:
            for a, b in ((t.left, t.right[0]), (t.right[0], t.left)):
                if len(t.right) == 1 and a == Field(field) and isinstance(b, Field):
                    return b.name
        return None


def equals(left: Operand, right: Operand) -> Predicate:
    return Predicate((Term(left, (right,)),))


def is_in(left: Operand, values: list[Value]) -> Predicate:
    """Constants only; those of another family never match."""
    if not values:
        raise ValueError("the list is empty")
    return Predicate((Term(left, tuple(values)),))


def all_of(*predicates: Predicate) -> Predicate:
    return Predicate(tuple(t for p in predicates for t in p.terms))
