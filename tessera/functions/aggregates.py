"""The aggregates of grouping, as columns that Spark sums up map-side first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_of(field: str) -> Column:
    """Rows of the group as a long, nulls included; named countof_<field>."""
    return F.count(F.lit(1)).alias(f"countof_{field}")


def max_of(field: str) -> Column:
    """Greatest value, of the field's type (numbers, strings by bytes, false before true); named maxof_<field>."""
    return F.max(field).alias(f"maxof_{field}")
