"""SHA-512 of files too large for one task: pieces in turn, the digest's state handed on."""

from __future__ import annotations

import ctypes
import functools
import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path

STATE_BYTES = 216   # sizeof(SHA512_CTX) in openssl/sha.h: numbers and a block buffer, no pointers
ROW_GROUP_BYTES = 16 << 20   # what a task holds in memory while it writes pieces
BOM = b"\xef\xbb\xbf"
STATES = "path string, state binary"


@functools.cache
def _crypto():
    """The OpenSSL that ``hashlib`` uses, or None. ``hashlib`` itself cannot hand on a state."""
    try:
        import _hashlib
        lib = ctypes.CDLL(_hashlib.__file__)
        for f, args in ((lib.SHA512_Init, [ctypes.c_char_p]), (lib.SHA512_Final, [ctypes.c_char_p] * 2),
                        (lib.SHA512_Update, [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t])):
            f.argtypes = args
        return lib
    except (ImportError, OSError, AttributeError):
        return None


class Sha512:
    """SHA-512 that goes on from the ``state`` of another one, in any process with the same OpenSSL."""

    def __init__(self, state: bytes | None = None):
        self._ctx = ctypes.create_string_buffer(state or b"", 2 * STATE_BYTES)
        if state is None:
            _crypto().SHA512_Init(self._ctx)

    def update(self, data: bytes) -> None:
        _crypto().SHA512_Update(self._ctx, data, len(data))

    def state(self) -> bytes:
        return self._ctx.raw[:STATE_BYTES]

    def hexdigest(self) -> str:
        end, digest = Sha512(self.state()), ctypes.create_string_buffer(64)
        _crypto().SHA512_Final(digest, end._ctx)
        return digest.raw.hex()


@functools.cache
def available() -> bool:
    """Whether states can be handed on here: a digest in two parts is compared with ``hashlib``'s."""
    if _crypto() is None:
        return False
    text = bytes(range(256)) * 3
    first = Sha512()
    first.update(text[:300])
    second = Sha512(first.state())
    second.update(text[300:])
    return second.hexdigest() == hashlib.sha512(text).hexdigest()


def _join_lines(batches):
    """A ``mapInArrow`` function: the lines of a batch that follow each other in a split as one row."""
    for batch in batches:
        ends = {e for c in ("path", "start") for e in pc.run_end_encode(batch.column(c)).run_ends.to_pylist()}
        rows, at = [], 0
        for end in sorted(ends):
            lines = batch.slice(at, end - at)
            rows.append((lines["path"][0].as_py(), lines["start"][0].as_py(), b"\n".join(lines["value"].to_pylist())))
            at = end
        if rows:
            path, start, value = zip(*rows)
            yield pa.RecordBatch.from_pydict({"path": path, "start": start, "value": pa.array(value, pa.binary())})


def _digest_on(states: dict[str, bytes], heads: dict[str, bytes]):
    """A ``mapInArrow`` function over lines in file order: takes each file's state on over them."""
    def run(batches):
        if not available():
            raise RuntimeError("no OpenSSL here that hands on the state of a SHA-512")
        path = sha = None
        for batch in batches:
            for name, value in zip(batch["path"].to_pylist(), batch["value"]):
                if name != path:
                    if path is not None:
                        yield _row(path, sha)
                    path, sha = name, Sha512(states.get(name))
                    sha.update(b"\n" if name in states else heads[name])
                else:
                    sha.update(b"\n")
                sha.update(value.as_py())
        if path is not None:
            yield _row(path, sha)
    return run


def _row(path, sha):
    return pa.RecordBatch.from_pydict({"path": [path], "state": pa.array([sha.state()], pa.binary())})


def chained_digests(lines: DataFrame, lengths: dict[str, int], piece: int) -> dict[str, str]:
    """SHA-512 (hex) by path of the files in ``lengths`` (path to bytes).

    ``lines`` are these files by the text source with ``lineSep`` ``\\n``, so Spark reads them in splits.
    The lines are joined to larger rows and written once, by the piece of the file in which their split begins. Round k digests the
    k-th piece of every file, one task a file, from the state of round k - 1. Between rounds only the states
    pass through the driver, 216 bytes a file. ``\\n`` goes before each row but the first; the text source drops a
    last ``\\n`` and a byte order mark, which the missing bytes tell.
    """
    spark, staged = lines.sparkSession, scratch_path(lines.sparkSession, "pieces")
    (lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                  F.col("value").cast("binary").alias("value"))
          .mapInArrow(_join_lines, "path string, start long, value binary")
          .select("*", F.monotonically_increasing_id().alias("seq"), F.octet_length("value").alias("n"), F.expr(f"start div {piece}").alias("round"))
          .write.partitionBy("round").option("compression", "none").option("parquet.block.size", ROW_GROUP_BYTES).parquet(staged))
    pieces = spark.read.schema("path string, start long, value binary, seq long, n int, round long").parquet(staged)
    read = {r.path: r.n for r in pieces.groupBy("path").agg(F.sum(F.col("n") + 1).alias("n")).collect()}
    missing = {p: n - (read.get(p, 0) - 1) for p, n in lengths.items()}
    changed = sorted(p for p, n in missing.items() if n not in (0, 1, 3, 4)) or sorted(set(read) - set(lengths))
    if changed:
        raise ValueError(f"{changed[0]}: not as long as listed")
    heads = {p: BOM if n >= 3 else b"" for p, n in missing.items()}
    states: dict[str, bytes] = {}
    for k in range(max(lengths.values()) // piece + 1):
        files = sum(n > k * piece for n in lengths.values())
        part = (pieces.where(F.col("round") == k).select("path", "start", "seq", "value")
                      .repartition(max(files, 1), "path").sortWithinPartitions("path", "start", "seq").select("path", "value"))
        states.update((r.path, bytes(r.state)) for r in part.mapInArrow(_digest_on(states, heads), STATES).collect())
    done = {}
    for path, n in missing.items():
        sha = Sha512(states[path])
        sha.update(b"\n" if n in (1, 4) else b"")
        done[path] = sha.hexdigest()
    return done
