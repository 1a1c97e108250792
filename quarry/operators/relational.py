"""Projection, filters, distinct, sort / top-k and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def project_filter(df: DataFrame, columns: Sequence[Column | str], predicate: Column) -> DataFrame:
    """``where`` then ``select``: Catalyst pushes the predicate's column comparisons into
    the Parquet scan (PushedFilters, row-group skipping) and reads only the referenced
    columns (ReadSchema)."""
    return df.where(predicate).select(*columns)


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct on chosen columns: partial distinct per task, shuffle, final distinct."""
    return df.select(*cols).distinct()


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Global top-k. ``orderBy().limit(k)`` plans as TakeOrderedAndProject: every task
    keeps only its own k best rows, so at most ``k * tasks`` rows meet at the end.
    ``order`` must end in a unique column so ties are decided."""
    return df.orderBy(*order).limit(k)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def intersect_rows(a: DataFrame, b: DataFrame, keep_duplicates: bool = True) -> DataFrame:
    """INTERSECT [ALL]. The ALL form is an aggregate of per-side counts followed by a
    row replication, so no group is gathered in one place."""
    return a.intersectAll(b) if keep_duplicates else a.intersect(b)


def except_rows(a: DataFrame, b: DataFrame, keep_duplicates: bool = True) -> DataFrame:
    """EXCEPT [ALL] (``exceptAll`` keeps multiplicities; ``subtract`` is distinct)."""
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)
