"""Tables: external Parquet, and a database of versioned tables."""

from .database import Conflict, Database, Transaction
from .tables import Type, display_sizes, read_table, result_rows, typed

__all__ = ["Conflict", "Database", "Transaction", "Type", "display_sizes", "read_table", "result_rows", "typed"]
