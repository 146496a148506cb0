"""Table statistics; planning is left to Spark."""

from .statistics import table_statistics

__all__ = ["table_statistics"]
