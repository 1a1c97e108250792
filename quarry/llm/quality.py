"""Quality rules with compression bands.

Text that repeats itself compresses far better than prose, noise far worse. The zstandard
ratio (compressed over raw bytes) of the whole text and of each fixed chunk must lie in a
band. Short texts compress badly whatever they say (frame header, empty window) and long
ones well, so the band of a whole text depends on its length. A document is kept if the
base rules pass, its whole-text ratio lies in the band of its length, and no more than
``MAX_BAD_CHUNKS`` of its full chunks lie outside the chunk band.

Counts are made with array operations on the bytes of a slice of rows. Equality of lines
and of 8-word windows is that of 64-bit hashes within one text.

Edge cases: a null or empty text has no words and fails the base rules; a text shorter
than a chunk is judged as a whole only; a single text of any length is read whole; rows
are independent, so ties, repeated rows and null ids need no rule; an empty table gives
an empty result; extra columns are ignored by ``measure`` and kept by ``keep``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quarry.llm.arrowtext import SPACE, Texts, mix, texts, windows, word_hashes
from quarry.llm.frames import col, map_arrow

# Fixed values of the contract: symbol characters, and the base limits.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

LEVEL = 3
CHUNK_BYTES = 1024
# (texts of at least so many bytes, lowest ratio, highest ratio). Ordinary prose, lists and
# code of any length stay above the low limits; only repetition goes below.
BANDS = ((0, 0.0, 9.9), (100, 0.45, 1.05), (200, 0.28, 0.92), (400, 0.22, 0.83), (800, 0.17, 0.78),
         (1600, 0.15, 0.74), (3200, 0.14, 0.72), (6400, 0.14, 0.70))
CHUNK_BAND = (0.15, 0.80)
MAX_BAD_CHUNKS = 0.25

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = COUNTS + ", base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def _per_text(t: Texts, at: np.ndarray) -> np.ndarray:
    """Number of the (sorted) byte positions ``at`` in each text."""
    return np.diff(np.searchsorted(at, t.offs))


def duplicate_lines(t: Texts, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    if not len(word_starts):
        return np.zeros(t.n, dtype=np.int64)
    newline = t.buf == 0x0A
    edge = t.breaks()
    edge[1:] |= newline[:-1]
    first = np.flatnonzero(edge & ~newline)  # lines of at least one byte
    border = np.append(np.flatnonzero(newline | t.breaks()), len(t.buf))
    stop = border[np.searchsorted(border, first, side="right")]
    has_word = np.searchsorted(word_starts, first) < np.searchsorted(word_starts, stop)
    first, stop = first[has_word], stop[has_word]
    row = np.searchsorted(t.offs, first, side="right") - 1
    key = mix(word_hashes(t.buf, first, stop) + mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    again = key[order[1:]] == key[order[:-1]]
    return np.bincount(row[order[1:][again]], minlength=t.n).astype(np.int64)


def repeated_words(t: Texts, doc: np.ndarray, hashes: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Words inside k-word windows that occur twice or more in their text."""
    at, h = windows(doc, hashes, k)
    if not len(at):
        return np.zeros(t.n, dtype=np.int64)
    key = mix(h + mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    delta = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + k, -1)
    covered = np.cumsum(delta[:-1]) > 0
    return np.bincount(doc[covered], minlength=t.n).astype(np.int64)


def band(n_bytes: int) -> tuple[float, float]:
    low, high = 0.0, 9.9
    for least, lo, hi in BANDS:
        if n_bytes >= least:
            low, high = lo, hi
    return low, high


def compression(raw: bytes, z: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """(ratio of the whole text, full chunks, chunks outside the chunk band)."""
    if not raw:
        return 0.0, 0, 0
    n = len(raw) // CHUNK_BYTES
    bad = 0
    for i in range(n):
        r = len(z.compress(raw[i * CHUNK_BYTES:(i + 1) * CHUNK_BYTES])) / CHUNK_BYTES
        bad += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    return len(z.compress(raw)) / len(raw), n, bad


def _measure(t: Texts, z) -> list[np.ndarray]:
    doc, starts, ends = t.words()
    hashes = word_hashes(t.buf, starts, ends)
    n_words = np.bincount(doc, minlength=t.n).astype(np.int64)
    code_points = np.flatnonzero((t.buf & 0xC0) != 0x80)
    spaces = np.flatnonzero(SPACE[t.buf])
    word_chars = _per_text(t, code_points) - _per_text(t, spaces)
    symbols = _per_text(t, np.flatnonzero(_IS_SYMBOL[t.buf]))
    lines = duplicate_lines(t, starts)
    repeats = repeated_words(t, doc, hashes)
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    ratio, chunks, bad = np.zeros(t.n), np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
    kept = np.zeros(t.n, dtype=bool)
    for i in range(t.n):
        raw = t.raw(i)
        ratio[i], chunks[i], bad[i] = compression(raw, z)
        low, high = band(len(raw))
        kept[i] = not failed[i] and low <= ratio[i] <= high and bad[i] <= MAX_BAD_CHUNKS * chunks[i]
    return [n_words, word_chars, symbols, lines, repeats, failed, kept, ratio, chunks, bad]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts, the base verdict, ``kept``, ``ratio``,
    ``n_chunks``, ``n_bad_chunks``."""
    names = [f.split()[0] for f in ("doc_id long, " + SCHEMA).split(", ")]

    def make() -> Callable:
        z = zstandard.ZstdCompressor(level=LEVEL)

        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                cols = [batch.column(0).slice(t.first, t.n), *(pa.array(c) for c in _measure(t, z))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        return fn
    return map_arrow(docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")),
                     make, "doc_id long, " + SCHEMA)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns: a filter inside one scan, no
    join and no shuffle."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any kind

    def make() -> Callable:
        z = zstandard.ZstdCompressor(level=LEVEL)

        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(at)):
                yield batch.slice(t.first, t.n).filter(pa.array(_measure(t, z)[6]))
        return fn
    return map_arrow(plain, make, plain.schema).toDF(*docs.columns)

