"""Relational and training-data operators on PySpark."""
