"""Small DataFrame helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores appended until no column is called so (Spark compares
    column names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, also if that holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def tie_break(df: DataFrame, packed: str, but: Iterable[str]) -> Column:
    """A text that orders rows by their other columns (``packed`` is the struct of the row):
    which of several rows with one id and text stays does not depend on the run."""
    skip = set(but)
    rest = [F.col(packed).getField(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in skip]
    return F.to_json(F.struct(*rest)) if rest else F.lit("")


def map_arrow(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``mapInArrow``; ``make()`` runs once in each task and returns the batch function."""
    def run(batches):
        fn = make()
        for b in batches:
            if b.num_rows:
                yield from fn(b)
    return df.mapInArrow(run, schema)
