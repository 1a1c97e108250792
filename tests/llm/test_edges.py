"""Every operator on the edge rows and on an empty table."""

import collections

import public_tokenizers
import pytest
from brute import counts
from fixtures import LONG, PROSE, SCHEMA, TEXTS, edge_docs, empty_docs

from quarry.llm import chat, exact_dedup, html_text, licenses, mixing, near_dedup, packing, pii, quality, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = [f.split()[0].strip("`") for f in SCHEMA.split(", ")]


def shapes(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_exact(spark):
    rows = exact_dedup.query(spark, edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    prose = [r for r in rows if r.keep_id == 1]
    assert {r.group_size for r in prose} == {4} == {len(prose)} and sum(r.kept for r in prose) == 1
    empty = [r for r in rows if r.doc_id in (3, 4, 6)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(3, 4)}
    assert next(r for r in rows if r.doc_id == 9).keep_id == 9  # equal to 10 after normalisation
    assert [r.doc_id for r in rows if r.group_size == 2 and r.kept] == [9]
    kept = exact_dedup.deduplicate(edge_docs(spark))
    assert kept.columns == COLUMNS
    got = shapes(kept.collect())
    assert got == collections.Counter({(1, PROSE): 1, (3, None): 1, (5, "  \n\t "): 1, (9, "one  two\nthree"): 1,
                                       **{(i, t): 1 for i, t in TEXTS if i in (7, 8, 11, 12, 13, 14)}})
    assert exact_dedup.query(spark, empty_docs(spark)).count() == 0
    assert exact_dedup.deduplicate(empty_docs(spark)).count() == 0


def test_near(spark):
    rows = near_dedup.classes(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    prose = [r for r in rows if r.class_id == 1]
    assert len(prose) == 5 and {r.class_size for r in prose} == {5} and sum(r.kept for r in prose) == 1
    assert all(r.kept and r.class_size == 1 for r in rows if r.doc_id in (3, 4, 5, 6, 7, 8, 11, 13, 14))
    assert {r.class_id for r in rows if r.doc_id in (9, 10)} == {9}
    kept = near_dedup.deduplicate(edge_docs(spark))
    assert kept.columns == COLUMNS
    got = shapes(kept.collect())
    assert (1, PROSE) in got and (7, LONG) in got and (2, PROSE) not in got and max(got.values()) == 1
    assert near_dedup.classes(empty_docs(spark)).count() == 0
    assert near_dedup.deduplicate(empty_docs(spark)).count() == 0


def test_quality(spark):
    rows = quality.measure(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    want = collections.Counter((i, *counts(t)) for i, t in TEXTS)
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    kept = quality.keep(edge_docs(spark))
    assert kept.columns == COLUMNS
    assert shapes(kept.collect())[2, PROSE] == 2 and (3, None) not in shapes(kept.collect())
    assert quality.measure(empty_docs(spark)).count() == 0 and quality.keep(empty_docs(spark)).count() == 0


def test_licenses(spark):
    rows = licenses.scan(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS) and all(r.license is None and r.n_notices == 0 and r.notices == "" for r in rows)
    assert licenses.scan(empty_docs(spark)).count() == 0


def test_packing(spark):
    rows = packing.pack(edge_docs(spark), WORD_BPE, length=64).collect()
    docs = collections.Counter(r.doc_id for r in rows if r.start == 0)
    assert docs == collections.Counter(i for i, _ in TEXTS)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert packing.pack(empty_docs(spark), WORD_BPE).count() == 0


def test_mixing(spark):
    mixed = mixing.mix(edge_docs(spark), factor=3.0)
    assert mixed.columns == [*COLUMNS, "copy_", "shuffle_key_"]
    rows = mixed.collect()
    known = {(i, t) for i, t in TEXTS}
    assert rows and all((r["doc_id"], r["text"]) in known for r in rows)
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_toxicity(spark):
    labels = spark.createDataFrame([(1, 0, 0), (14, 0, 1), (14, 1, None), (None, 1, 1), (12, None, 0), (8, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = toxicity.query(edge_docs(spark), labels).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    nothing = labels.limit(0)
    assert {r.score for r in toxicity.query(edge_docs(spark), nothing).collect()} == {0.0}
    assert toxicity.query(empty_docs(spark), labels).count() == 0


def test_pii(spark):
    rows = pii.detect(edge_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    hit = next(r for r in rows if r.doc_id == 14)
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone) == (1, 1, 1, 1)
    assert all(r.spans == "" for r in rows if r.doc_id != 14)
    assert pii.detect(empty_docs(spark)).count() == 0


CONV = "conv_id long, turn long, role string, text string, ids string, piece int"


def test_chat(spark):
    rows = [(1, 0, "user", "hi", None, None), (1, 1, "assistant", None, None, None), (None, 0, None, "x", None, None),
            (2, 0, "assistant", "b", "", 1), (2, 0, "assistant", "a", "", 1), (2, 0, "assistant", "a", "", 1), (2, None, "user", "", "", 1),
            (3, 0, "assistant", LONG, None, 0), (3, 1, "user", LONG, None, 0), (3, 2, "assistant", LONG + " end", None, 0)]
    got = {r.conv_id: r for r in chat.digest(spark.createDataFrame(rows, CONV), BYTE_BPE).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 4, 3: 3}
    assert got[2].loss_chars == 3 and got[1].loss_chars == 0 and got[3].loss_chars == 2 * len(LONG) + 4
    assert chat.digest(spark.createDataFrame([], CONV), BYTE_BPE).count() == 0
    pieces = chat.format_conversations(spark.createDataFrame(rows, CONV), BYTE_BPE).where("conv_id = 3").orderBy("piece").collect()
    assert [p.piece for p in pieces] == list(range(len(pieces))) and len(pieces) > 1
    assert sum(len(p.text) for p in pieces) == got[3].formatted_chars


PAGES = "page_id long, url string, html string, host string, blocks string, row long, text string"


def test_html(spark):
    rows = [(1, None, None, "h", "b", 1, "t"), (2, "http://h.example.com/a", "", None, None, None, None),
            (None, "http://h.example.com/b", "<p>x &amp; y", None, None, None, None),
            (3, "not a url", "<div><p>a<p>b</div>", None, None, None, None), (3, "not a url", "<div><p>a<p>b</div>", None, None, None, None),
            (4, "//h.example.com", "<p>" + LONG + "</p><" , None, None, None, None)]
    got = sorted(((r.page_id or 0), r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert got == sorted([(1, "", 0), (2, "", 0), (0, "x & y", 5), (3, "a\nb", 3), (3, "a\nb", 3), (4, LONG + "\n<", len(LONG) + 2)])
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("fn", [exact_dedup.deduplicate, near_dedup.deduplicate, quality.keep])
def test_filters_keep_the_schema(spark, fn):
    assert [(f.name, f.dataType) for f in fn(edge_docs(spark)).schema] == [(f.name, f.dataType) for f in edge_docs(spark).schema]


def test_deep_html(spark):
    deep = "<div>" * 3000 + "<p>deep "
    rows = [(i, "http://h.example.com/", (deep if i < 3 else "<blockquote>" * 3000) + f"text {i}") for i in range(5)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("deep " if i < 3 else "") + f"text {i}" for i in range(5)}
