"""Broadcast only what is proven small.

``small_side`` runs a bounded probe over at most ``max_rows + 1`` rows (``limit``
stops reading there) that returns their count and their size in bytes (each row
rendered as JSON: a conservative proxy for its in-memory size, since field names are
counted too). The frame is broadcast only if both are within bounds; otherwise it is
returned untouched and the join stays a shuffle join, which AQE may still turn into a
broadcast from real runtime sizes. A row bound alone is not a size bound: a few
thousand rows of long text or arrays can exceed an executor's broadcast budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000
DEFAULT_MAX_BYTES = 64 << 20


def probe(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> tuple[int, int]:
    """``(rows, bytes)`` of the first ``max_rows + 1`` rows of ``df``."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    r = (df.limit(max_rows + 1)
           .agg(F.count(F.lit(1)).alias("n"),
                F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("b"))
           .first())
    return int(r["n"]), int(r["b"])


def fits(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS,
         max_bytes: int = DEFAULT_MAX_BYTES) -> bool:
    n, b = probe(df, max_rows)
    return n <= max_rows and b <= max_bytes


def small_side(df: DataFrame, what: str = "", max_rows: int = DEFAULT_MAX_ROWS,
               max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows of at most
    ``max_bytes`` together, else ``df`` as is (``what`` names the side in errors and
    logs only)."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df
