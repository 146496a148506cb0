"""Relational operators: DataFrames in, a DataFrame out."""

from .relational import block_product, equi_join, group_by, index_join, index_select, join_all, materialize, merge_join, product, project, select, sort_by, spread_join

__all__ = ["block_product", "equi_join", "group_by", "index_join", "index_select", "join_all", "materialize", "merge_join", "product", "project", "select", "sort_by", "spread_join"]
