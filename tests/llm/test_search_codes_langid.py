"""Lexical search, language identification and vector codes: brute force, edge rows, methods."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import same
from conftest import SF_CHECK, duck_for
from fixtures import LONG, PROSE, TEXTS, edge_docs, empty_docs

from quarry.llm import codes, jobs, langid, lexical
from quarry.llm.arrowtext import texts

# --- lexical search ------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    """[(item_id, rank, doc_id, score)] by the formulas alone."""
    def words(text):
        found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    rows = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in words(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return rows


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string, rank int, `a.b` int, score long")
    return [tuple(r) for r in lexical.search(lexical.build_index(d), i).collect()]


def test_search_against_sql(spark):
    con = duck_for(SF_CHECK)
    same(jobs.op11_stratified_search(spark, SF_CHECK), con.sql(lexical.ORACLE))


@pytest.mark.parametrize("slot,window", [(1 << 24, 1 << 22), (2000, 50)])
def test_search_against_brute_force(spark, monkeypatch, slot, window):
    """Strata of one slot and of many; windows of everything and of about one segment."""
    monkeypatch.setattr(lexical, "SLOT_BYTES", slot)
    monkeypatch.setattr(lexical, "WINDOW", window)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "日本", "ÀB"]
    docs = [(i, " ".join(r.choices(vocab, k=r.choice([3, 3, 8, 40, 400])))) for i in range(500)]
    docs += [(1000 + i, "Common-word common_WORD w1") for i in range(300)]  # one stratum with a third of all rows, all tied
    items = [(i, ", ".join(r.choices(vocab, k=r.choice([1, 5, 30]))), 0, 0, 0) for i in range(25)] + [(99, "common word", 0, 0, 0)]
    got = found(spark, docs, items)
    assert sorted(got) == sorted(brute_search(docs, [i[:2] for i in items]))


def test_search_edges(spark):
    items = [(1, "one TWO three", 1, 1, 1), (1, "one TWO three", 1, 1, 1), (2, None, 1, 1, 1), (3, "", 1, 1, 1), (None, "baker", 1, 1, 1),
             (4, "word1 the the the é", 1, 1, 1), (5, "nothere ?!", 1, 1, 1)]
    got = [tuple(r) for r in lexical.search(lexical.build_index(edge_docs(spark)), spark.createDataFrame(
        items, "item_id long, text string, rank int, `a.b` int, score long")).collect()]
    assert sorted(got, key=repr) == sorted(brute_search(TEXTS, [i[:2] for i in items]), key=repr)
    assert {r[2] for r in got if r[0] == 4} >= {None, 1, 2, 7}
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.query(docs, none).count() == 0
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.query(empty_docs(spark), asked).count() == 0
    assert [tuple(r) for r in lexical.query(docs, asked).collect()] == [tuple(x) for x in brute_search([(1, "a b")], [(1, "a")])]


def test_item_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} x") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i}") for i in range(7)], "item_id long, text string")
    index = lexical.build_index(docs)
    whole = sorted(map(tuple, lexical.search(index, items).collect()))
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    assert sorted(map(tuple, lexical.search(index, items).collect())) == whole and whole


def test_bounds_spare_segments():
    """Segments visited by falling bound: those below the k-th best score are not scored."""
    docs = ["rare " * 50] * 20 + ["common " * (n % 90 + 1) + "rare" for n in range(900)]
    n = [len(d.split()) for d in docs]
    order = sorted(range(len(docs)), key=lambda i: n[i])
    m = np.array([25 + (75 * n[i] * len(docs)) // sum(n) for i in order])
    t = next(texts(pa.array([docs[i] for i in order])))
    batch = lexical.segments(t, m[:t.n], pa.array(order[:t.n], pa.int64()))
    assert [s for x in batch.column("docs").to_pylist() for s in x] == order and batch.num_rows == len(set(m.tolist()))
    asked = lexical.Asked([(1, "rare")])
    window = [lexical.Segment({c: batch.column(c)[i] for c in batch.schema.names}, asked, np.array([7])) for i in range(batch.num_rows)]
    best = lexical.Best(asked, 10)
    best.visit(window)
    assert best.spared > 80 and best.visits + best.spared == batch.num_rows
    assert [x[2] for x in best.top[0]] == list(range(10))


# --- language identification ---------------------------------------------------------------


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rows = jobs.op12_nearest_centroid(spark, SF_CHECK).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert sum(r.accepted for r in held) >= 0.95 * len(held)


def test_nothing_is_learned_from_held_out_rows(spark):
    """Turning the labels of the held-out rows around changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(encode(string(doc_id), 'UTF-8')) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    a = {r.doc_id: r for r in langid.query(docs).collect()}
    assert a == {r.doc_id: r for r in langid.query(wrong).collect()} and "xx" not in {r.lang_pred for r in a.values()}


def test_counts_against_plain_ngrams():
    """Feature counts equal those of n-grams cut from each word by hand."""
    rows = ["Ab, ab!", "", "é", "x1y  Z", " -- "]
    t = next(langid.lowered(pa.array(rows)))
    got = langid.counts(t)
    for i, text in enumerate(rows):
        words = re.findall(rb"[a-z\x80-\xff]+", text.lower().encode())
        grams = collections.Counter()
        for w in words:
            for n in range(1, langid.LONGEST + 1):
                padded = w if n == 1 else b" " + w + b" "
                grams.update((n, padded[j:j + n]) for j in range(len(padded) - n + 1))
        want = collections.Counter()
        for (n, g), c in grams.items():
            h = langid.mix(np.array([int.from_bytes(g, "big")], np.uint64) + langid._SEED[n]) % np.uint64(langid.WIDTH)
            want[int(h[0])] += c
        assert {j: c for j, c in enumerate(got[i].tolist()) if c} == dict(want)


def test_rejection(spark):
    """Texts unlike anything learned are not accepted, though they get the nearest language."""
    r = random.Random(3)
    def prose(parts, n):
        return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))
    en, de = ["the", "ing", "tion", "and", "ou"], ["sch", "ung", "heit", "ein", "pf"]
    docs = [(i, prose(en if i % 2 else de, 60), "en" if i % 2 else "de") for i in range(300)]
    docs += [(1000 + i, "zzq xkw vvj qqx " * 20, None) for i in range(5)] + [(2000, "1234 -- 5", "en"), (2001, None, "en")]
    got = {x.doc_id: x for x in langid.query(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in docs if i < 300)
    assert sum(got[i].accepted for i in range(300)) > 285
    assert not any(got[1000 + i].accepted for i in range(5)) and got[1000].lang_pred in ("en", "de")
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (2000, 2001))


def test_language_edges(spark):
    rows = langid.query(edge_docs(spark)).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in TEXTS)
    assert {r.lang_pred for r in rows} <= {"en", "und"}
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (3, 4, 5, 6)) and not any(r.held_out for r in rows if r.doc_id is None)
    assert langid.query(empty_docs(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, PROSE, None), (2, LONG, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.query(unlabelled).collect()} == {("und", 0.0)}


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_PER_LANG", 20)
    rows = spark.range(5000).selectExpr("id", "IF(id % 100 = 0, 'fr', 'en') AS lang", "string(id) AS text")
    got = collections.Counter(r.lang for r in langid.sample(rows).collect())
    assert got == {"en": 20, "fr": 20}


# --- vector codes --------------------------------------------------------------------------


def brute_codes(rows):
    """{row: (code, error, label_error)} and the digest, with plain integers."""
    import hashlib
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    size = len(ints[0]) // 4
    cut = [[v[p * size:(p + 1) * size] for v in ints] for p in range(4)]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, ints[j]))[:256]
    books = [[cut[p][j] for j in order] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            mine = collections.defaultdict(list)
            for x in cut[p]:
                mine[nearest(x, books[p])[1]].append(x)
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    got = [[nearest(cut[p][j], books[p]) for p in range(4)] for j in range(len(kept))]
    error = [sum(d for d, _ in g) for g in got]
    by = collections.Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(kept[j][0], "".join(f"{k:02x}" for _, k in got[j]), error[j], by[kept[j][2]], sha) for j in range(len(kept))]


VECTORS = "vec_id long, embedding array<float>, label int, id string, code string, `x.y` int"


def test_codes_against_sql(spark):
    same(jobs.op13_cover_tree_codes(spark, SF_CHECK), duck_for(SF_CHECK).sql(codes.ORACLE))


def test_codes_against_brute_force(spark):
    r = random.Random(11)
    grid = [(i, [round(r.uniform(-1, 1), 1) for _ in range(8)], r.choice([None, 1, 2])) for i in range(400)]  # many ties and equal parts
    same_vector = [(1000 + i, [0.5] * 8, 3) for i in range(200)]  # a third of all rows
    bad = [(2000, None, 1), (2001, [], 1), (2002, [0.1] * 7 + [None], 1), (2003, [0.1] * 7 + [math.nan], 1), (2004, [math.inf] * 8, 1)]
    odd = [(None, [0.25] * 8, None), (5, [0.125] * 8, 2), (5, [0.125] * 8, 2)]
    rows = grid + same_vector + bad + odd
    df = spark.createDataFrame([(*x, "i", None, 0) for x in rows], VECTORS).repartition(3)
    got = [tuple(x) for x in codes.quantise(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_codes(rows), key=repr)
    assert codes.quantise(df.limit(0)).count() == 0
    few = spark.createDataFrame([(*x, "i", None, 0) for x in rows[:3] + bad], VECTORS)
    assert sorted(map(tuple, codes.quantise(few).collect())) == sorted(brute_codes(rows[:3]))


def test_codes_drop_what_does_not_fit(spark):
    rows = [(0, [0.5] * 5, 1), (1, [0.5] * 4, 1), (2, [1.0] * 8, 1), (3, [1e30] * 4, 1), (4, [-2.0] * 4, 1)]
    got = codes.quantise(spark.createDataFrame([(*x, "i", None, 0) for x in rows], VECTORS)).collect()
    assert {x.vec_id for x in got} == {1, 4}


def test_cover_tree():
    rng = np.random.default_rng(2)
    points = np.concatenate([c + rng.integers(-4, 5, (60, 6)) for c in rng.integers(-900, 900, (12, 6))] + [np.tile([7] * 6, (40, 1))])
    tree = codes.Tree(points)
    again = codes.Tree.unpack(tree.pack(), points)
    assert sorted(tree.row.tolist()) == list(range(len(points))) and (again.total == tree.total).all()
    for i in range(len(tree.centre)):
        rows = tree.row[tree.start[i]:tree.start[i] + tree.count[i]]
        d = np.sqrt(((points[rows] - points[tree.centre[i]]) ** 2).sum(1))
        assert d.max() == tree.radius[i] and (tree.total[i] == points[rows].sum(0)).all()
        kids = tree.centre[tree.child[i]:tree.child[i + 1]]
        if len(kids):
            apart = np.sqrt(((points[kids][:, None] - points[kids][None]) ** 2).sum(2)) + np.eye(len(kids)) * 1e9
            assert apart.min() > tree.radius[i] / 2 and tree.count[tree.child[i]:tree.child[i + 1]].sum() == tree.count[i]
    book = points[rng.choice(len(points), 50, replace=False)]
    nodes, entries, compared = tree.assign(points, book)
    assert (tree.entry_of_rows(nodes, entries) == codes.squares(points, book).argmin(axis=1)).all()
    assert tree.count[nodes].max() > 30 and compared < len(points) * len(book) / 2  # whole subtrees, few comparisons


def test_far_components_stay_exact():
    a = np.array([[2 ** 27, -(2 ** 27), 3], [1, 2, 3]])
    want = [[int(((x - y) ** 2).sum()) for y in a.astype(object)] for x in a.astype(object)]
    assert codes.squares(a, a).tolist() == want


def test_duckdb_sees_the_same_terms():
    text = "A-b_C ÉÀ é1²٣x\tNaïve"
    got = duckdb.sql("SELECT regexp_extract_all(translate($t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                     r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')", params={"t": text}).fetchall()[0][0]
    assert got == lexical.terms(text) == ["a", "b", "c", "ÉÀ", "é1²٣x", "naïve"]
