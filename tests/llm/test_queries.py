"""The registered queries and the pipeline on small tables, against SQL or plain versions."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from brute import classes, counts, probability_jaccard
from compare import same
from conftest import SF_SMALL, duck_for
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import chat, exact_dedup, html_text, jobs, licenses, mixing, near_dedup, packing, pii, quality, toxicity
from quarry.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def duck():
    return duck_for(SF_SMALL)


@pytest.mark.parametrize("name", sorted(jobs.ORACLE))
def test_matches_oracle(spark, duck, name):
    same(jobs.QUERIES[name](spark, SF_SMALL), duck.sql(jobs.ORACLE[name]))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in jobs.QUERIES) == list(range(1, 14))


def copies(seed=1):
    """Prose, exact copies, edited copies of one text (a large group: most pairs of edited
    copies are below the threshold, all are linked over the original), unrelated texts
    with a shared passage, and texts with repeated lines."""
    r = random.Random(seed)

    def text(n):
        return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]
    docs, base, passage = [], text(150), text(60)
    for _ in range(60):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = text(1)[0]
        docs.append(" ".join(w))
    docs += [" ".join(base)] * 3 + [" ".join(passage + text(200)) for _ in range(40)]
    for _ in range(20):
        w = text(80)
        docs.append(" ".join(w))
        w[40] = text(1)[0]
        docs.append(" ".join(w))
    line = " ".join(text(12))
    docs += ["\n".join([line] * n) for n in (5, 6, 40)] + [" ".join(text(3))] * 2 + [None, "", "x"]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_near_duplicates_against_brute_force(spark):
    docs = copies()
    want = classes(docs)
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = collections.Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    kept = near_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_leaders_and_leftover_pairs(spark, monkeypatch):
    """A chain of texts, each near its neighbours only, in one bucket per band: the classes
    are complete whatever the leaders are."""
    r = random.Random(9)
    w = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(30):
        w = list(w)
        w[r.randrange(120)] = f"n{i}"
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "band_keys", lambda sig: np.tile(np.arange(near_dedup.BANDS, dtype=np.uint64), (len(sig), 1)))
    docs += [(100 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(10)]
    got = near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(docs)


def bag_rows(bags):
    """Rows (node, h, count, total) of weighted shingles as ``near_dedup.bags`` makes them."""
    for i, b in enumerate(bags):
        h, c = np.array(sorted(b), np.uint64), np.array([b[k] for k in sorted(b)], np.int64)
        yield i, h.tobytes(), c.tobytes() if c.max() > 1 else b"", int(c.sum())


def prefix_pairs(spark, bags, class_of=lambda i: i):
    bag = spark.createDataFrame([(i, bytearray(h), bytearray(c), n) for i, h, c, n in bag_rows(bags)],
                                "node long, h binary, count binary, total long")
    held = spark.createDataFrame([(7, i, class_of(i)) for i in range(len(bags))], "key long, node long, class long")
    return [tuple(sorted(r)) for r in near_dedup.prefix_pairs(held, bag).collect()]


@pytest.mark.parametrize("repeats", [0, 0.05, 0.5])
def test_prefix_join_loses_no_similar_pair(spark, repeats):
    """Weighted sets around the threshold: parts of a few bases with shingles added, removed and
    repeated. Every pair of different classes that is similar comes out."""
    r = random.Random(5)
    bags = []
    for _ in range(6):
        base = [r.getrandbits(54) for _ in range(r.randint(5, 60))]
        often = {s: r.randint(1, 4) if r.random() < repeats else 1 for s in base}
        for _ in range(40):
            part = r.sample(base, max(1, round(len(base) * r.uniform(0.75, 1))))
            part += [r.getrandbits(54) for _ in range(round(len(base) * r.uniform(0, 0.15)))]
            times = r.choice([1, 1, 2])
            bags.append(collections.Counter({s: times * often.get(s, 1) + (r.random() < repeats / 20) for s in part}))
    want = {(i, j) for j in range(len(bags)) for i in range(j)
            if i % 5 != j % 5 and probability_jaccard(bags[i], bags[j]) >= 0.8}
    got = set(prefix_pairs(spark, bags, lambda i: i % 5))
    assert len(want) > 100 and want <= got
    assert not any(i % 5 == j % 5 for i, j in got)


def test_prefix_join_grows_with_the_group(spark):
    """Edited copies of one text, each of its own class and all a little below the threshold to
    the others: candidates are no pairs of the group, but in proportion to it."""
    r = random.Random(6)
    base = [r.getrandbits(54) for _ in range(400)]
    rows = {}
    for n in (100, 200, 400):
        bags = []
        for _ in range(n):
            out = set(r.sample(range(400), 50))
            bags.append({s: 1 for s in [s for i, s in enumerate(base) if i not in out] + [r.getrandbits(54) for _ in out]})
        rows[n] = len(prefix_pairs(spark, bags))
    assert all(rows[n] <= n for n in rows), rows


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r["class"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("n", [20, 60])
def test_links_grow_with_the_group(spark, monkeypatch, n):
    """Texts all similar to each other, whose bucket leader and hub is similar to none: they are
    linked by the prefix join, through links in proportion to the group, not all its pairs."""
    r = random.Random(n)
    base = [r.getrandbits(54) for _ in range(200)]
    bags = [{r.getrandbits(54): 1 for _ in range(200)}]
    for _ in range(n):
        out = set(r.sample(range(200), 8))
        bags.append({s: 1 for s in [s for i, s in enumerate(base) if i not in out] + [r.getrandbits(54) for _ in out]})
    bag = spark.createDataFrame([(i, bytearray(h), bytearray(c), t) for i, h, c, t in bag_rows(bags)],
                                "node long, h binary, count binary, total long")
    members = spark.createDataFrame([(k, i, 0) for k in (7, 8) for i in range(n + 1)], "key long, node long, leader long")
    whole, seen = near_dedup.components, []
    monkeypatch.setattr(near_dedup, "components", lambda links: seen.append(links.count()) or whole(links))
    assert {x.node: x["class"] for x in near_dedup.link_classes(members, bag).collect()} == {i: 1 for i in range(1, n + 1)}
    assert 0 < sum(seen) <= 2 * n, seen


def test_merged_classes(spark):
    linked = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2), (9, 9), (10, 9)], "node long, class long")
    links = spark.createDataFrame([(4, 5), (1, 5), (1, 4), (5, 7), (20, 21), (30, 4)], "a long, b long")
    got = {r.node: r["class"] for r in near_dedup.merge(linked, links).collect()}
    assert got == {1: 1, 4: 1, 2: 1, 5: 1, 7: 1, 30: 1, 9: 9, 10: 9, 20: 20, 21: 20}


def test_index_is_persistent(spark):
    path = scratch_path(spark, "index-test")
    first = spark.createDataFrame([(5, "a b"), (6, "a  b"), (7, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a\tb"), (2, "d"), (3, "d "), (4, "d")], "doc_id long, text string")
    with exact_dedup.DigestIndex(spark, path, buckets=3) as index:
        exact_dedup.resolve(first, index)
    with exact_dedup.DigestIndex(spark, path, buckets=3) as index:  # opened again
        got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.resolve(second, index).collect()}
        assert got == {1: (5, 1, False), 2: (2, 2, True), 3: (3, 1, True), 4: (2, 2, False)}
        again = {r.id: (r.keep_id, r.kept) for r in exact_dedup.resolve(second, index).collect()}
        assert again == {1: (5, False), 2: (2, True), 3: (3, True), 4: (2, False)}
        assert index.table().count() == 4
        third = spark.createDataFrame([(8, "c"), (9, "e")], "doc_id long, text string")
        assert [r.doc_id for r in exact_dedup.deduplicate(third, index=index).collect()] == [9]
        assert index.table().count() == 5
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_quality_against_brute_force(spark, duck):
    want = {i: counts(t) for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    got = jobs.op2_compression_bands(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    kept = {r.doc_id: r.kept for r in quality.measure(docs).collect()}
    long_enough = {r.doc_id for r in quality.measure(docs).where("not base_failed").collect()}
    good = [kept[r.doc_id] for r in labels if r.quality == 1 and r.doc_id in long_enough]
    assert sum(good) >= 0.99 * len(good)
    # what the bands reject: texts that repeat themselves in parts, and noise
    rng = random.Random(4)
    def prose(n):
        return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    repeats = [prose(60) + " " + "".join(f"{c}{c}{c} " * 400 for c in "abcdefgh") + prose(60) for _ in range(5)]
    noise = [" ".join("".join(chr(rng.randrange(33, 127)) for _ in range(30)) for _ in range(60)) for _ in range(5)]
    planted = spark.createDataFrame([(i, t) for i, t in enumerate([prose(500)] + repeats + noise)], "doc_id long, text string")
    assert [r.doc_id for r in quality.measure(planted).where("kept").collect()] == [0]


def check_pieces(rows, texts, length):
    """``texts``: the documents as a bag; every id in one piece, sequences without gaps."""
    tok = Tokenizer.from_file(WORD_BPE)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for s, parts in places.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == length or s == max(places)
    whole = collections.defaultdict(list)
    for doc, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        whole[doc].append(ids)
    got = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for doc, copies_ in whole.items():
        n = len(copies_[0])
        mine = [(k, c) for k, c in got.items() if k[0] == doc]
        assert sum(k[2] * c for k, c in mine) == n * len(copies_)
        assert all(k[4] == n and zlib.crc32(copies_[0][k[1]:k[1] + k[2]].tobytes()) == k[3] for k, _ in mine)
    assert {k[0] for k in got} == set(whole)


def test_packing_against_brute_force(spark, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    check_pieces(jobs.op4_concat_and_cut(spark, SF_SMALL).collect(), docs, 4096)
    many = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(7)
    check_pieces(packing.pack(many, WORD_BPE, length=100).collect(), docs, 100)


def test_mixing_rates(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id < 3000 THEN 'big' WHEN id < 3990 THEN 'mid' END AS source")
    weights = spark.createDataFrame([("big", 1.0), ("mid", 1.0), (None, 2.0)], "source string, weight double")
    rows = mixing.mix(docs, weights=weights).collect()
    n = collections.Counter(r.source for r in rows)
    # Poisson totals with means 1000, 1000 and 2000 (200 copies of each of ten documents)
    assert all(abs(n[s] - m) < 5 * m ** 0.5 for s, m in (("big", 1000), ("mid", 1000), (None, 2000)))
    per_doc = collections.Counter(collections.Counter(r.doc_id for r in rows if r.source == "mid").values())
    assert abs(per_doc[2] / 990 - 0.186) < 0.05  # e^-m m^2/2 at m = 1.01
    keys = [r.shuffle_key for r in rows]
    assert len(set(keys)) == len(keys)
    again = mixing.mix(docs.repartition(5), weights=weights).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixing_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = mixing.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_whole_licence_texts(spark):
    mit = licenses.KNOWN["MIT"][0]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.upper().replace("\n", "   \n").replace("SUBLICENSE", "sub-licence")),
            (3, mit + "\nand one more word"), (4, "intro\n\n" + mit + "\n\nend"), (5, "© 1999 A\nMIT Licence"), (6, "x\nReleased under the MIT Licence!\ny")]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["MIT", "MIT", None, None, "MIT", None]
    assert got[6][1] == "MIT" and got[3][1] == ""


def test_toxicity_held_out(spark, duck):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.query(docs, labels).collect()}
    pairs = [(rows[r.doc_id], r.toxic) for r in labels.collect()]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x, _ in pairs)
    held = [(x.score, t) for x, t in pairs if x.held_out]
    pos, neg = ([s for s, t in held if t == y] for y in (1, 0))
    auc = np.mean([(p > np.array(neg)).mean() + (p == np.array(neg)).mean() / 2 for p in pos])
    assert auc > 0.95 and np.mean(np.array(neg) >= 0.5) < 0.02 and np.mean(np.array(pos) >= 0.5) > 0.85


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    held = toxicity.held_out(labels["doc_id"])
    changed = labels.withColumn("toxic", (labels["toxic"] + held.cast("int")) % 2)
    a, b = ({r.doc_id: r.score for r in toxicity.query(docs, x).collect()} for x in (labels, changed))
    assert a == b


def test_chat_against_brute_force(spark, duck):
    rows = duck.sql("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn").fetchall()
    convs = collections.defaultdict(list)
    for c, role, t in [*rows, *((c, r, t) for c, _, r, t in chat.PROBE)]:
        convs[c].append((role or "", t or ""))
    got = {r.conv_id: r for r in jobs.op8_offset_masks(spark, SF_SMALL).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest(), len(chat.render(turns)))


def page(i, article, extra=""):
    return (f'<html><body><div class="top-x"><b>My Site</b></div><div class="list"><a href="/1">item one {i}</a> <a href="/2">item two {i}</a></div>'
            f'<div class="content"><p>{article}</p><p>Read our terms before you go.</p>{extra}</div></body></html>')


def test_wrapper_drops_constant_and_link_slots(spark):
    rows = [(i, f"https://h.example.com/{i}", page(i, f"Story number {i} tells of day {i * i}.", "<blockquote>odd</blockquote>" if i == 3 else ""))
            for i in range(12)]
    rows += [(100 + i, f"http://copies.example.com/{i}", "<p>the same text on every page of this host</p>") for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Story number 1 tells of day 1." and got[3] == "Story number 3 tells of day 9.\nodd"
    assert got[100] == "the same text on every page of this host"


def test_pages_against_their_articles(spark, duck):
    import html
    import re
    for i, t in {r.page_id: r.text for r in jobs.op9_wrapper_induction(spark, SF_SMALL).collect()}.items():
        source = duck.sql(f"SELECT html FROM pages WHERE page_id = {i}").fetchall()[0][0]
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<b>", ""))]
        assert t == "\n".join(b for b in blocks if b)


def test_pii_against_brute_force(spark, duck):
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in jobs.op10_crf_pii(spark, SF_SMALL).collect():
        base = pii.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert set(map(tuple, spans)) >= {(k, str(a), str(b)) for k, a, b in base} and len(spans) == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_pipeline_against_brute_force(spark):
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in copies(seed=2)]
    path = scratch_path(spark, "pipeline-test")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(os.path.join(path, "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "exact_copies", "near_copies", "mix_sources", "pack"]
    now = spark.read.parquet(os.path.join(path, "documents.parquet"))
    texts = {i: t for i, t, *_ in docs}

    kept = {r.doc_id for r in quality.measure(now).where("kept").collect()}
    now = stage["quality_rules"](spark, now, path)
    assert now.columns == [f.split()[0] for f in schema.split(", ")] and {r.doc_id for r in now.collect()} == kept
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join(texts[i].split()), i)
    now = stage["exact_copies"](spark, now, path)
    assert sorted(r.doc_id for r in now.collect()) == sorted(first.values())
    want = set(classes([(i, texts[i]) for i in first.values()]).values())
    now = stage["near_copies"](spark, now, path)
    assert sorted(r.doc_id for r in now.collect()) == sorted(want)
    now = stage["mix_sources"](spark, now, path)
    mixed = [(r.doc_id, r.text) for r in now.collect()]
    assert {i for i, _ in mixed} <= want and len(mixed) > len(want) / 2
    pieces = corpus_pipeline.run(spark, path).collect()
    check_pieces(pieces, mixed, 4096)


def test_links_are_judged_per_block_and_names_per_host(spark):
    rows = [(i, f"https://a.example.com/{i}", "<article><ul>" + "".join(f"<li><a href=x>linked {i} {k}</a>" for k in range(9)) + f"<li>plain {i}</ul></article>")
            for i in range(8)]
    rows += [(20 + i, f"https://b.example.com/{i}", f"<ul><li><a href=x>a long menu entry {i}</a><li>plain {i}</ul>") for i in range(8)]
    rows += [(40 + i, f"https://c.example.com/{i}", f"<div class='x widget'><p>Story {i} of the day, all in one box.</p></div>") for i in range(8)]
    rows += [(60 + i, f"https://d.example.com/{i}", f"<p>Story {i} of the day.</p><div class=widget><p>box {i}</p></div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n".join([*(f"linked 1 {k}" for k in range(9)), "plain 1"]) and got[21] == "plain 1"
    assert got[41] == "Story 1 of the day, all in one box." and got[61] == "Story 1 of the day."


def test_constant_blocks_of_a_host_with_several_layouts(spark):
    rows = [(10 * k + i, url and f"{url}/{k}/{i}", f'<div class="{name}"><div class="top-{name}">All about {name}</div><p>{name} story {i}.</p></div>')
            for url in ("https://h.example.com", None) for k, name in enumerate(("news", "shop", "help"), 0 if url else 5) for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[10 * k + i] == f"{name} story {i}." for j in (0, 5) for k, name in enumerate(("news", "shop", "help"), j) for i in range(8))


def test_licence_files_with_titles_and_full_texts(spark):
    """The usual LICENSE file: title, copyright line, body; and full texts in other line breaks."""
    rows = [(name, f"{title}\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{licenses.KNOWN[name][0]}\n")
            for name, title in (("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"),
                                ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"))]
    rows.append(("BSD-3-Clause", rows[3][1].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")))
    folder = os.path.join(os.path.dirname(licenses.__file__), "known_licenses")
    for name, file in licenses.FULL_TEXTS.items():
        with open(f"{folder}/{file}.txt") as f:
            text = f.read()
        rows += [(name, text), (name, re.sub(r"(?<=\w) *\n *(?=[a-z])", " ", text))]
        if "Copyright [yyyy]" in text:
            rows.append((name, re.sub(r"Copyright \[yyyy\].*", "Copyright 2021 Someone Else", text)))
        if licenses.END_OF_TERMS in text:
            rows.append((name, text[:text.index(licenses.END_OF_TERMS)]))
    rows += [(None, f"{rows[0][1]} and more")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_licences_inside_documents(spark):
    """Known texts of several paragraphs between other text, under any copyright line; equal to the SQL."""
    mit, bsd = licenses.KNOWN["MIT"][0], licenses.KNOWN["BSD-3-Clause"][0]
    folder = os.path.join(os.path.dirname(licenses.__file__), "known_licenses")
    with open(f"{folder}/Apache-2.0.txt") as f:
        apache = f.read()
    terms = apache[:apache.index(licenses.END_OF_TERMS)]
    title = "MIT License (https://opensource.org/license/mit)"
    rows = [(0, f"{title}\n\nCopyright <2025> <SOME BODY>\n\n{mit}", "MIT", "MIT"),
            (1, f"Copyright Jane Doe 2020\n\n{mit}", "MIT", "MIT"),
            (2, f"before\n\n{mit}\n\nafter", None, "MIT"),
            (3, f"before\n\nThe MIT License\n\nCopyright Jane Doe, 2020-2021\n\n-----\n\n{mit}\n\nafter", None, "MIT,MIT"),
            (4, f"our parts\n\n{apache}\n\ntheir parts\n\n{bsd}\n\nend", None, "Apache-2.0,Apache-2.0,BSD-3-Clause"),
            (5, f"our parts\n\n{terms}\n\nend", None, "Apache-2.0"),
            (6, "\n\n".join([mit] * 50 + ["end"]), None, ",".join(["MIT"] * 50)),
            (7, mit.replace("\n\n", "\n\nand\n\n"), None, ""), (8, mit[:-20], None, ""), (9, None, None, ""), (10, "", None, ""),
            (11, "copyright holders of it\n\nMIT License", None, "MIT")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs).collect()}
    assert got == {i: (license, notices) for i, _, license, notices in rows}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: (r[1], r[3]) for r in con.sql(licenses.ORACLE).fetchall()} == got
    own = {"Mine": ["one thing\n\nanother thing"], "Yours": ["one thing"]}
    docs = spark.createDataFrame([(1, "x\n\nOne thing,\n\nanother thing!\n\ny"), (2, "One thing")], "doc_id long, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs, own).collect()} == {1: (None, "Mine,Yours"), 2: ("Yours", "Yours")}


def test_paragraphs_of_known_texts_as_spark_reads_them(spark):
    texts = [t for ts in licenses.KNOWN.values() for t in ts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("text", licenses.plain(F.col("text")))
    df = df.select("i", F.filter(F.transform(F.split("text", licenses.PARAGRAPH), licenses.words), lambda w: w != "").alias("words"))
    assert {r.i: r.words for r in df.collect()} == {i: licenses.paragraph_words(t) for i, t in enumerate(texts)}


def _extract(spark, rows, **kw):
    return {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **kw).collect()}


def test_wrapper_alone_removes_what_same_host_pages_share(spark):
    """Without the fixed lists: menus, headers, footers and forms go as template."""
    def shop(i, extra=""):
        return ('<html><body><header><a href="/">My Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
                f'<div class="body"><h1>Story {i}</h1><p>It tells of day {i * i}.</p>{extra}</div><form><label>Search</label></form>'
                '<footer><p>All rights reserved.</p></footer></body></html>')
    rows = [(i, f"https://h.example.com/{i}", shop(i, f'<div class="comments"><p>reader {i} says</p></div>')) for i in range(12)]
    rows += [(100 + i, f"https://few.example.com/{i}", shop(i)) for i in range(3)]
    alone, both = _extract(spark, rows, lists=False), _extract(spark, rows)
    assert {i: r.text for i, r in both.items()} == {i: f"Story {i % 100}\nIt tells of day {(i % 100) ** 2}." for i in both}
    for i in range(12):
        assert alone[i].text == both[i].text + f"\nreader {i} says" and (alone[i].n_template, alone[i].n_listed) == (5, 0)
        assert (both[i].n_template, both[i].n_listed) == (5, 1)
    # too few pages for a wrapper: the lists do it
    assert all((both[100 + i].n_template, both[100 + i].n_listed) == (0, 5) for i in range(3))
    assert "Search" in alone[100].text


def test_forms_and_noscript_around_pages(spark):
    page = "<article><h1>Title {i}</h1><p>Text {i} of the page.</p></article>"
    rows = [(1, "http://a.example.com/1", "<form id=aspnetForm><nav>menu</nav>" + page.format(i=1) + "<div class=comments><p>me too</div></form>"),
            (2, "http://b.example.com/1", "<p>enable scripts<noscript>" + page.format(i=2) + "</noscript>"),
            (3, "http://c.example.com/1", page.format(i=3) + "<form><p>your name, please</p></form><noscript>no script</noscript>"),
            (4, "http://d.example.com/1", page.format(i=4).replace("</article>", "<form><p>write a comment</p></form></article>"))]
    rows += [(10 + i, f"http://e.example.com/{i}", f"<form><div class=menu>menu</div><div><p>Text {i} of a page in a form, all of it.</div><div class=comments>me {i}</div></form>")
             for i in range(6)]
    rows += [(20 + i, f"http://f.example.com/{i}", f"<div><p>Text {i} of a page with a form.</div><form><p>field {i}</form>") for i in range(6)]
    got = {i: r.text for i, r in _extract(spark, rows).items()}
    assert [got[i] for i in range(1, 5)] == [f"Title {i}\nText {i} of the page." for i in range(1, 5)]
    assert [got[10 + i] for i in range(6)] == [f"Text {i} of a page in a form, all of it." for i in range(6)]
    assert [got[20 + i] for i in range(6)] == [f"Text {i} of a page with a form." for i in range(6)]
