"""Python UDFs on the vectorised (Arrow) path: scalar pandas UDF, grouped map,
grouped aggregate and a table function. Python is a per-batch helper here; the
partitioning and shuffles stay Spark's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quarry.operators.windows import join_on

# Types are given as objects, not DDL strings: these decorators also run when a Python
# worker imports this module, and parsing a DDL string there would need a JVM.


@pandas_udf(DoubleType())
def charge(price: pd.Series, disc: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 - disc) * (1 + tax)


def line_charges(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber",
                           charge("l_extendedprice", "l_discount", "l_tax").alias("charge"))


def _share(pdf: pd.DataFrame) -> pd.DataFrame:
    """Shares for one batch of lines, each line carrying its order's total."""
    return pd.DataFrame({"l_orderkey": pdf["l_orderkey"], "l_linenumber": pdf["l_linenumber"],
                         "share": (pdf["l_extendedprice"] / pdf["_total"]).round(6)})


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _share(b)


def line_shares(lineitem: DataFrame) -> DataFrame:
    """Each line's share of its order's value, by a pandas function over batches of lines.

    One call per order would be slow, and an order holding a third of all lines would be
    one call. The order totals are therefore a Spark aggregate (partial per task), joined
    back to the lines null-safely (AQE splits a hot order's lines there); each line then
    carries all that pandas needs, so the batches need no shuffle of their own."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    totals = li.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("_total"))
    return join_on(li, totals, ["l_orderkey"]).mapInPandas(
        _shares, "l_orderkey long, l_linenumber int, share double")


def _spread_partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g = pa.Table.from_batches([b]).group_by("l_orderkey").aggregate([("l_quantity", "min"), ("l_quantity", "max")])
        yield from g.select(["l_orderkey", "l_quantity_min", "l_quantity_max"]).to_batches()


def quantity_spread(lineitem: DataFrame) -> DataFrame:
    """Largest minus smallest quantity per order, as an aggregate in two phases: Arrow
    computes a partial state (min, max) per key inside every batch (``mapInArrow``: no
    shuffle, one vectorised call per batch, integer keys stay exact beside nulls), then
    Spark merges the states with partially-aggregated built-ins. A key holding a third of
    the rows is split over every batch that holds it, and nothing gathers a whole group."""
    partial = lineitem.select("l_orderkey", "l_quantity").mapInArrow(
        _spread_partial, "l_orderkey long, q_min double, q_max double")
    return partial.groupBy("l_orderkey").agg((F.max("q_max") - F.min("q_min")).alias("qty_spread"))


@arrow_udtf(returnType=StructType([StructField("doc_id", LongType()), StructField("line_no", IntegerType()),
                                   StructField("line", StringType()), StructField("n_chars", IntegerType())]))
class TextLines:
    """Rows to many rows: the lines of the texts of one Arrow batch with their 1-based
    numbers, cut by Arrow. A null text has no lines."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        cut = pc.split_pattern(batch.column("text").cast(pa.large_string()), "\n")
        doc, lines = pc.list_parent_indices(cut), pc.list_flatten(cut)
        size = pc.fill_null(pc.list_value_length(cut), 0).to_numpy()
        before = np.cumsum(size) - size
        number = np.arange(1, len(lines) + 1) - np.repeat(before, size)
        yield pa.table({"doc_id": batch.column("doc_id").take(doc), "line_no": pa.array(number, pa.int32()),
                        "line": lines.cast(pa.string()), "n_chars": pc.utf8_length(lines).cast(pa.int32())})


def document_lines(documents: DataFrame) -> DataFrame:
    """``doc_id, line_no, line, n_chars`` of every line of every document, by a table
    function over the whole table that sees Arrow batches, not rows."""
    return TextLines(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").asTable())
