"""WordCount, sinks and audits on the deployment's own golden inputs and planted faults."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.errors import AnalysisException

from quarry.operators import montecarlo, text
from quarry.sources import chained, files


def lines(spark, *ls):
    return spark.createDataFrame([(x,) for x in ls], "value string")


def counts_of(df):
    return {r["word"]: r["n"] for r in df.collect()}


def test_golden_smoke_wordcount(spark):
    # the smoke check's input line and expected output lines
    assert counts_of(text.word_count(lines(spark, "hadoop spark hadoop"))) == {"hadoop": 2, "spark": 1}


def test_golden_preflight_wordcount(spark):
    assert counts_of(text.word_count(lines(spark, "preflight test preflight"))) == {
        "preflight": 2, "test": 1}


def test_tokenizer_delimiters_case_and_punctuation(spark):
    c = counts_of(text.word_count(lines(spark, " a\tA  a,\r\nb\fb ", "", None, "\n")))
    assert c == {"a": 1, "A": 1, "a,": 1, "b": 2}


def test_empty_input(spark):
    assert text.word_count(lines(spark)).count() == 0


def test_sink_format_order_and_refusal(spark, tmp_dir):
    counts = text.word_count(lines(spark, "b a c a b a"))
    out = os.path.join(tmp_dir, "out")
    back = text.word_count_sink(counts, out)
    assert counts_of(back) == {"a": 3, "b": 2, "c": 1}
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    content = "".join(open(os.path.join(out, p)).read() for p in parts)
    assert content == "a\t3\nb\t2\nc\t1\n"
    with pytest.raises(AnalysisException):
        text.word_count_sink(counts, out)   # the output folder must be new


def test_expected_counts_statuses(spark):
    counts = text.word_count(lines(spark, "hadoop spark hadoop"))
    exp = spark.createDataFrame([("hadoop", 2), ("spark", 3), ("yarn", 1)], "word string, expected bigint")
    got = {r["word"]: (r["n"], r["status"]) for r in text.expected_counts(counts, exp).collect()}
    assert got == {"hadoop": (2, "ok"), "spark": (1, "mismatch"), "yarn": (None, "missing")}


def test_state_count_check(spark):
    nodes = spark.createDataFrame([("RUNNING",), ("RUNNING",), ("LOST",)], "state string")
    exp = spark.createDataFrame([("RUNNING", 2), ("DECOMMISSIONED", 0), ("LOST", 2)],
                                "state string, expected bigint")
    got = {r["state"]: (r["n"], r["ok"]) for r in text.state_count_check(nodes, "state", exp).collect()}
    assert got == {"RUNNING": (2, True), "DECOMMISSIONED": (0, True), "LOST": (1, False)}


def test_row_checksum_finds_copies(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "k long, v string")
    got = {r["h"]: (r["n"], r["first_key"]) for r in text.row_checksum(df, "k", "v").collect()}
    assert got[hashlib.sha256(b"x").hexdigest()] == (2, 1)
    assert got[hashlib.sha256(b"y").hexdigest()] == (1, 2)


def test_checksum_audit_planted_faults(spark, tmp_dir):
    data = os.path.join(tmp_dir, "files")
    os.makedirs(data)
    blobs = {"good.bin": b"abc", "bad.bin": b"def", "short.bin": b"ghi", "extra.bin": b"jkl"}
    for n, b in blobs.items():
        open(os.path.join(data, n), "wb").write(b)
    sha = {n: hashlib.sha512(b).hexdigest() for n, b in blobs.items()}
    manifest = os.path.join(tmp_dir, "manifest.txt")
    with open(manifest, "w") as f:
        f.write(f"{sha['good.bin']}  good.bin\n")
        f.write(f"{'0' * 128}  bad.bin\n")            # wrong digest
        f.write(f"{sha['short.bin'][:64]}  short.bin\n")  # not 128 characters
        f.write(f"{sha['good.bin']} *gone.bin\n")     # listed, file missing
    got = {r["file"]: r["status"] for r in files.checksum_audit(
        files.file_digests(spark, data), files.read_manifest(spark, manifest)).collect()}
    assert got == {"good.bin": "valid", "bad.bin": "invalid", "short.bin": "bad_manifest",
                   "gone.bin": "missing", "extra.bin": "bad_manifest"}


def test_large_files_are_digested_in_pieces(spark, tmp_dir):
    rng = random.Random(7)
    data = os.path.join(tmp_dir, "in")
    os.makedirs(os.path.join(data, "a b%20[c]"))
    noise = rng.randbytes(20_000)
    blobs = {"noise": noise, "a b%20[c]/noise": noise[::-1], "ends": noise + b"\n", "blank": b"\n" * 6000, "bom": b"\xef\xbb\xbf" + noise,
             "bom-ends": b"\xef\xbb\xbfa\r\n" * 1500, "one-line": b"x" * 15_000, "long then short": b"y" * 9_000 + b"\nz" * 4000,
             "at": noise[:5000], "over": noise[:5001], "small": b"abc", "packed.gz": gzip.compress(noise)}
    for n, b in blobs.items():
        with open(os.path.join(data, n), "wb") as f:
            f.write(b)
    want = {n: hashlib.sha512(b).hexdigest() for n, b in blobs.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")   # several splits a file
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    try:
        got = files.file_digests(spark, data, piece=5000)
        assert sorted((r.file, r.actual) for r in got.collect()) == sorted(want.items())
        # as with files over 2 GB: larger than a row of the binaryFile source may be
        os.remove(os.path.join(data, "packed.gz"))
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")
        got = files.file_digests(spark, data, piece=5000)
        assert {r.file: r.actual for r in got.collect()} == {n: d for n, d in want.items() if n != "packed.gz"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)


def test_a_digest_goes_on_from_a_state():
    data = bytes(range(256)) * 5
    for cut in (0, 1, 127, 128, 129, 1000, len(data)):
        a = chained.Sha512()
        a.update(data[:cut])
        b = chained.Sha512(a.state())
        b.update(data[cut:])
        assert a.hexdigest() == hashlib.sha512(data[:cut]).hexdigest()
        assert b.hexdigest() == b.hexdigest() == hashlib.sha512(data).hexdigest()


def test_file_inventory_matches_listing(spark):
    d = "/root/testdata/sf0.001"
    got = {r["name"]: r["size"] for r in files.file_inventory(spark, d, "*.parquet").collect()}
    want = {n: os.path.getsize(os.path.join(d, n)) for n in os.listdir(d) if n.endswith(".parquet")}
    assert got == want


def test_text_landing_replaces(spark, tmp_dir):
    out = os.path.join(tmp_dir, "landing")
    files.text_landing(lines(spark, "old line"), out)
    back = files.text_landing(lines(spark, "new\nlines"), out)
    assert sorted(r["value"] for r in back.collect()) == ["lines", "new"]


def test_pi_matches_brute_force(spark):
    r = montecarlo.pi_estimate(spark, slices=2).collect()[0]
    a, c, m, h = montecarlo.LCG_A, montecarlo.LCG_C, montecarlo.LCG_M, montecarlo.HALF
    inside = 0
    for i in range(1, 200_000):
        x = ((i % m) * a + c) % m
        y = (x * a + c) % m
        inside += (x - h) ** 2 + (y - h) ** 2 <= h * h
    assert (r["n"], r["inside"]) == (199_999, inside)
    assert abs(r["pi"] - 3.14159) < 0.01


def test_event_log_summary_of_a_wordcount(spark, tmp_dir):
    from quarry.plans import eventlog
    log = eventlog.child_log(spark, SF, os.path.join(tmp_dir, "log"))
    s = eventlog.event_log_summary(spark, log).collect()
    assert s and all(r["tasks"] > 0 and r["failed_tasks"] == 0 for r in s)
    # WordCount shuffles once: one stage writes shuffle bytes, a later one reads them
    assert any(r["shuffle_write_bytes"] > 0 for r in s)
    assert any(r["shuffle_read_bytes"] > 0 for r in s)


SF = "/root/testdata/sf0.001"
