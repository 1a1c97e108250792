"""Concatenate-and-cut packing of documents into sequences of fixed length.

All token ids, an end id after each document, form one conceptual string that is cut
every ``length`` ids. Two passes, no shuffle:

1. each task tokenises its rows once and writes, per document, the ids (two or four
   bytes each) and the number of ids before it in the same task;
2. the totals of the tasks (one row per task) are summed up into global offsets, and each
   document is cut at the window borders that fall into it; a document over a border gives
   a boundary record on each side.

Only the last sequence can be short, so padding is below one sequence for any input.

Edge cases: a null or empty text is the end id alone; an empty table gives no piece;
repeated rows are packed as often as they occur; extra columns are ignored, whatever
their names; a text of any length is cut like any other (its ids are held by one task).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.frames import col, map_arrow
from quarry.llm.tokens import WordBpe
from quarry.session import materialize

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(task, before, doc_id, ids): the ids of each document with ``end_id``, as
    little-endian binary, and the ids before it in the same task."""
    def make() -> Callable:
        bpe = WordBpe(tokenizer_path)
        task = TaskContext.get().partitionId()
        before = 0

        def fn(batch: pa.RecordBatch):
            nonlocal before
            for first, flat, counts in bpe.encode_column(batch.column(1)):
                n = len(counts)
                ends = np.cumsum(counts)
                ids = np.insert(flat, ends, end_id)
                sizes = counts + 1
                stops = np.cumsum(sizes)
                offs = np.zeros(n + 1, dtype=np.int32)
                offs[1:] = stops * ids.itemsize
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, task, dtype=np.int32)),
                    pa.array(before + stops - sizes),
                    batch.column(0).slice(first, n),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(ids)]),
                ], names=["task", "before", "doc_id", "ids"])
                before += int(stops[-1]) if n else 0
        return fn
    return map_arrow(docs.select(col(id_col).cast("bigint").alias("doc_id"),
                                 col(text_col).alias("text")),
                     make, "task int, before long, doc_id long, ids binary")


def cut(tokens: DataFrame, length: int, id_bytes: int) -> DataFrame:
    """Cut (doc_id, at, ids), ``at`` being the global offset, into pieces."""
    def make() -> Callable:
        kind = np.dtype(f"<u{id_bytes}")

        def fn(batch: pa.RecordBatch):
            rows = []
            for doc, at, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(raw, dtype=kind).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(length - off, n - start)
                    rows.append((doc, start, size, zlib.crc32(ids[start:start + size]), n, seq, off))
                    start += size
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=[f.split()[0] for f in PIECES.split(", ")])
        return fn
    return map_arrow(tokens.select("doc_id", "at", "ids"), make, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers),
    ``doc_tokens``, ``sequence_id``, ``offset`` (place in the sequence)."""
    id_bytes = WordBpe.id_bytes(tokenizer_path)
    tokens = materialize(tokenise(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    totals = tokens.groupBy("task").agg(F.max(F.col("before") + F.expr(f"octet_length(ids) div {id_bytes}")).alias("n"))
    # one row per task of pass 1: a running sum over a few ten thousand rows at most
    base = totals.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    placed = (tokens.join(F.broadcast(base), "task")
                    .select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids"))
    return cut(placed, length, id_bytes)
