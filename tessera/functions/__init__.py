"""Typed predicates and aggregate columns."""

from .aggregates import count_of, max_of
from .predicates import Field, Predicate, all_of, equals, is_in

__all__ = ["Field", "Predicate", "all_of", "count_of", "equals", "is_in", "max_of"]
