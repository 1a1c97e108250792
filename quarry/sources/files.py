"""File-level jobs: landing text, listing files, and auditing file digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.chained import available, chained_digests


def text_landing(df: DataFrame, path: str, text_col: str = "value") -> DataFrame:
    """Write one text column into ``path`` (replacing what is there) and read it back
    as lines (``value string``). Like ``hdfs dfs -put -f``: the write is a plain
    parallel file write, one file per partition. Lines end at ``\\n`` alone, so other
    line-end characters inside a text stay what they are."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
    return df.sparkSession.read.option("lineSep", "\n").text(path)


def _file_name(path_col):
    return F.element_at(F.split(path_col, "/"), -1)


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, name, size, modified`` for every file under ``path`` (recursive).

    The ``binaryFile`` source lists files in parallel on executors for large folders;
    with ``content`` not selected the files are never opened."""
    return (spark.read.format("binaryFile")
                 .option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "true")
                 .load(path)
                 .select(F.col("path"), _file_name(F.col("path")).alias("name"),
                         F.col("length").alias("size"),
                         F.col("modificationTime").alias("modified")))


def _below(path_col, root: str):
    """The part of a file's path below ``root`` (both without scheme and host)."""
    def plain(p):
        return F.regexp_replace(F.regexp_replace(p, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")
    base = F.concat(F.rtrim(plain(F.lit(root)), F.lit("/")), F.lit("/"))
    path = plain(path_col)
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(_file_name(path))


# Bytes of a file that one task digests; a larger file is digested piece by piece.
PIECE_BYTES = 128 << 20
# Names the text source would decompress (Hadoop's codecs): these files are always read whole.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"


def _files_below(spark: SparkSession, source: str, path: str, glob: str) -> DataFrame:
    return (spark.read.format(source).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
                 .option("lineSep", "\n").load(path))


def file_digests(spark: SparkSession, path: str, glob: str = "*", piece: int = PIECE_BYTES) -> DataFrame:
    """``file, actual``: path below ``path`` and SHA-512 (hex) of every file. Files of one name in
    different folders are different files.

    Files up to ``piece`` bytes are one ``binaryFile`` row each. Larger ones are digested here, in
    pieces (``chained_digests``); compressed ones, and all where OpenSSL is missing, stay whole rows (below 2 GB)."""
    size, packed = F.col("_metadata.file_size"), F.col("_metadata.file_name").rlike(_PACKED)
    large = (size > piece) & ~packed if available() else F.lit(False)
    found = _files_below(spark, "binaryFile", path, glob)
    whole = (found.where(~large)   # on the file's metadata: the large ones are not opened
                  .select(_below(F.col("path"), path).alias("file"), F.sha2(F.col("content"), 512).alias("actual")))
    listed = found.where(large).select("path", F.col("_metadata.file_path").alias("uri"), "length").collect()
    if not listed:
        return whole
    digests = chained_digests(_files_below(spark, "text", path, glob).where(large), {r.uri: r.length for r in listed}, piece)
    done = spark.createDataFrame([(r.path, digests[r.uri]) for r in listed], "path string, actual string")
    return whole.unionByName(done.select(_below(F.col("path"), path).alias("file"), "actual"))


def write_manifest(digests: DataFrame, path: str) -> None:
    """Publish ``<sha512>  <file>`` lines (the ``sha512sum`` format)."""
    (digests.select(F.concat_ws("  ", "actual", "file").alias("value"))
            .write.mode("error").text(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, sha512`` from ``sha512sum``-style lines: the first field is the digest,
    the rest the file name (a leading ``*`` marks binary mode)."""
    line = F.trim(F.col("value"))   # a file name may hold blanks: all after the first gap
    return (spark.read.text(path).where(line != "")
                 .select(F.regexp_replace(F.regexp_replace(line, r"^\S+\s*", ""), r"^\*", "").alias("file"),
                         F.regexp_extract(line, r"^\S+", 0).alias("sha512")))


def checksum_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file, expected, actual, status`` per file named on either side.

    status: ``bad_manifest`` (no expected digest, or not 128 characters),
    ``missing`` (listed but no such file), ``valid`` (digests equal) or ``invalid``.
    Both sides have one row per file, so the full outer join is a plain shuffle join
    on the file name with no hot key.
    """
    m = manifest.select("file", F.lower(F.col("sha512")).alias("expected"))
    j = files.select("file", "actual").join(m, "file", "full")
    status = (F.when(F.col("expected").isNull() | (F.length("expected") != 128), F.lit("bad_manifest"))
               .when(F.col("actual").isNull(), F.lit("missing"))
               .when(F.col("actual") == F.col("expected"), F.lit("valid"))
               .otherwise(F.lit("invalid")))
    return j.select("file", "expected", "actual", status.alias("status"))
