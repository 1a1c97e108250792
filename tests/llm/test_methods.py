"""The array kernels against plain versions (no Spark)."""

import itertools
import os
import pathlib
import random
import time
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from brute import bag, counts, probability_jaccard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import chat, html_text, pii, quality, toxicity
from quarry.llm.arrowtext import texts
from quarry.llm.near_dedup import BANDS, K, band_keys, shingles, signatures, similarity
from quarry.llm.pii_examples import labelled
from quarry.llm.tokens import WordBpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab1 \n\té日😀#'.|<>\\\x85\xa0\x00"
TEXT = st.text(alphabet=ALPHABET, max_size=60)


def column(xs):
    return pa.array(xs, pa.string())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_quality_counts(xs):
    z = zstandard.ZstdCompressor()
    got = [tuple(int(c[i]) for c in quality._measure(t, z)[:5]) for t in texts(column(xs)) for i in range(t.n)]
    assert got == [counts(x) for x in xs]


def test_slices_do_not_change_counts():
    r = random.Random(5)
    xs = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 80))) for _ in range(200)]
    z = zstandard.ZstdCompressor()
    got = [tuple(int(c[i]) for c in quality._measure(t, z)[:5]) for t in texts(column(xs), max_bytes=300, max_rows=7) for i in range(t.n)]
    assert got == [counts(x) for x in xs]


def test_compression_bands():
    r = random.Random(1)
    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    noise = bytes(r.randrange(33, 127) for _ in range(6000))
    low, high = quality.band(6000)
    assert quality.compression(noise, z)[0] > high
    assert quality.compression(b"the same line again\n" * 300, z)[0] < low
    assert [quality.band(n)[0] for n in (0, 99, 100, 1 << 30)] == [0.0, 0.0, 0.45, 0.14]


def in_bands(raw, z):
    ratio, n, bad = quality.compression(raw, z)
    low, high = quality.band(len(raw))
    return low <= ratio <= high and bad <= quality.MAX_BAD_CHUNKS * n


def test_bands_keep_real_text():
    """Source code, prose and lists pass at every length; repetition of any length fails."""
    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    code = [p.read_bytes() for p in pathlib.Path(os.__file__).parent.glob("*.py")]
    prose = [p.read_bytes() for p in pathlib.Path(__file__).parents[2].glob("*.md")]
    names = sorted(set(re.findall(rb"[A-Za-z_]{3,}", b" ".join(code))))
    lists = [b"\n".join(b"- " + w for w in names), b"\n".join(b"%d. %s" % x for x in enumerate(names))]
    assert all(in_bands(t, z) for t in prose + lists)
    long = [t for t in code if len(t) >= 1024]
    assert sum(in_bands(t, z) for t in long) >= 0.97 * len(long)
    for n in (400, 800, 1600, 6400, 25600):
        cut = [t[:n] for t in prose + code + lists if len(t) >= n]
        assert sum(in_bands(t, z) for t in cut) >= 0.97 * len(cut), n
        assert not in_bands((b"the same line again\n" * n)[:n], z)



@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT, st.text(max_size=20)), max_size=5))
def test_ids_are_the_tokenizers(xs):
    tok = Tokenizer.from_file(WORD_BPE)
    flat, n = [], []
    for _, f, c in WordBpe_shared.encode_column(column(xs)):
        flat += f.tolist()
        n += c.tolist()
    stops = list(itertools.accumulate(n))
    assert [flat[b - k:b] for b, k in zip(stops, n, strict=True)] == [tok.encode(x or "", add_special_tokens=False).ids for x in xs]


WordBpe_shared = WordBpe(WORD_BPE)


def test_ids_with_a_small_table():
    class Small(WordBpe):
        SLOTS, POOL = 8, 64
    tok, small = Tokenizer.from_file(WORD_BPE), Small(WORD_BPE)
    r = random.Random(2)
    xs = [" ".join("".join(r.choice("abcdefgh1!") for _ in range(r.randint(1, 20))) for _ in range(30)) for _ in range(40)]
    got = [f.tolist() for x in xs for _, f, _ in small.encode_column(column([x]))]
    assert got == [tok.encode(x, add_special_tokens=False).ids for x in xs]


def test_shingles_and_similarity():
    r = random.Random(3)
    xs = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(60)]
    parts = list(texts(column(xs)))
    doc, h, n = shingles(parts[0])
    for i, x in enumerate(xs):
        assert sorted(n[doc == i].tolist()) == sorted(bag(x).values())
    for i, j in itertools.combinations(range(0, 60, 4), 2):
        a, b = doc == i, doc == j
        if a.any() and b.any():
            assert abs(similarity(h[a], n[a], h[b], n[b]) - probability_jaccard(bag(xs[i]), bag(xs[j]))) < 1e-9


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        base = np.unique(r.integers(0, 1 << 54, 200).astype(np.uint64))
        m = int(r.integers(1, 80))
        other = np.unique(np.concatenate([base[m:], r.integers(0, 1 << 54, m).astype(np.uint64)]))
        ca, cb = r.integers(1, 4, len(base)), r.integers(1, 4, len(other))
        sig = signatures(np.repeat([0, 1], [len(base), len(other)]), np.concatenate([base, other]), np.concatenate([ca, cb]), 2)
        errors.append((sig[0] == sig[1]).mean() - similarity(base, ca, other, cb))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 1.5 * 0.5 / K ** 0.5


def test_signature_does_not_depend_on_the_slice():
    r = np.random.default_rng(6)
    h = np.sort(r.integers(0, 1 << 54, 50).astype(np.uint64))
    one = signatures(np.zeros(50, np.int64), h, np.ones(50, np.int64), 1)
    many = signatures(np.repeat([0, 1, 2], [50, 1, 50]), np.concatenate([h, h[:1], h]), np.ones(101, np.int64), 4)
    assert (many[0] == one[0]).all() and (many[2] == one[0]).all() and (many[1] == h[0]).all() and not many[3].any()
    assert band_keys(one).shape == (1, BANDS)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_is_the_nearest_term():
    m = toxicity.Automaton([(b"idiot", False), (b"worthless", False), (b"scum", False), (b"achlich", True)])
    r, xs = random.Random(7), []
    for _ in range(1500):
        w = list(r.choice(["idiot", "worthless", "scum", "achlichung", "xyz"]))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i:i + r.randint(0, 1)] = r.choice(["", "a", "i", "t"])
        xs.append("".join(w) or "x")
    ends = np.cumsum([len(x) for x in xs])
    hit, term, n = m.run(np.frombuffer("".join(xs).encode(), np.uint8), ends - [len(x) for x in xs], ends)
    got = {int(i): (int(a), int(b)) for i, a, b in zip(hit, term, n, strict=True)}
    for i, x in enumerate(xs):
        near = [(edits(x, w.decode()), j) for j, (w, stem) in enumerate(m.terms) if not stem and edits(x, w.decode()) <= m.limit[j]]
        assert got.get(i) == (min(near)[::-1] if near else (3, 0) if x.startswith("achlich") else None)


def test_context_tells_quotation_from_abuse():
    m = toxicity.Automaton([(b"idiot", False)])
    xs = ["you are an idiot, go", 'the word "idiot" comes from greek', "“idi0t” was what it meant", "he called the man an idiot once",
          "you said: idiot", "Idiot!!"]
    (row, _, n), weight, _ = next((h for t in texts(column(xs)) for h in [toxicity.hits(t, m)]))
    assert row.tolist() == [0, 1, 2, 3, 4, 5]
    assert (weight < 1).tolist() == [False, True, True, True, False, False]
    assert n.tolist() == [0, 0, 1, 0, 0, 0]


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    n = len(pii.LABELS)
    for k in range(120):
        size = int(r.integers(1, 5))
        e, move = r.normal(size=(size, n)) * 3, r.normal(size=(n, n))
        e[:, 0] += r.integers(0, 25, size) * (k % 2)
        best = max(itertools.product(range(n), repeat=size), key=lambda p: move[0, p[0]] + move[p[-1], 0] + sum(
            e[i, y] for i, y in enumerate(p)) + sum(move[p[i], p[i + 1]] for i in range(size - 1)))
        assert pii.viterbi(e, move, np.zeros(size, int)).tolist() == list(best)


def test_crf_on_unseen_rows():
    crf, rows = pii.train(), labelled(seed=99, copies=4)
    want = got = both = 0
    for t in texts(column([x for x, _ in rows]), max_rows=5000):
        for (base, more), (text, spans) in zip(pii.find(t, crf), rows[t.first:t.first + t.n], strict=True):
            a = {(k, text[x:y].strip("\"'")) for k, x, y in spans}
            b = {(k, text[x:y]) for k, x, y in base + more}
            want, got, both = want + len(a), got + len(b), both + len(a & b)
    assert both >= 0.95 * want and both >= 0.95 * got


def test_base_patterns():
    text = "a.b@c.de x@y 1.2.3.4 999.1.1.1 and 4111 1111 1111 1111, 4111111111111112 +49 (170) 555-1234 é +1 2"
    found = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in found] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"),
                                                     ("phone", "+49 (170) 555-1234")]
    # a match that fails its check is dropped whole: the card inside is not tried again
    assert pii.base_spans("7 4111 1111 1111 1111") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|end|>"]),
                          st.text(alphabet="a <>|/s\\[INST]endtur日😀\n", max_size=25)), max_size=6))
def test_chat_round_trip(turns):
    p = chat.format_piece(turns, Encoder_shared)
    assert p["turns"] == turns
    assert "".join(p["loss"]) == "".join(t for r, t in turns if r == "assistant")
    apart = [i for t in turns for i in chat.format_piece([t], Encoder_shared)["ids"].tolist()]
    assert p["ids"].tolist() == apart


Encoder_shared = chat.Encoder(BYTE_BPE)


def brute_match(a, b, i=0, j=0):
    """Size of the largest top-down ordered mapping."""
    if a[i][1] != b[j][1]:
        return 0
    x, y = html_text._tree(a)[i], html_text._tree(b)[j]

    def best(p, q):
        if p == len(x) or q == len(y):
            return 0
        w = brute_match(a, b, x[p], y[q])
        return max(best(p + 1, q), best(p, q + 1), (w + best(p + 1, q + 1)) if w else 0)
    return 1 + best(0, 0)


def test_simple_tree_matching():
    r = random.Random(8)

    def tree():
        out = [(0, "r")]
        for _ in range(r.randint(0, 7)):
            out.append((r.randint(1, out[-1][0] + 1), r.choice("abc")))
        return out
    for _ in range(200):
        a, b = tree(), tree()
        found = html_text.match_trees(a, b)
        assert len(found) == brute_match(a, b)
        assert all(a[i][1] == b[j][1] and a[i][0] == b[j][0] for i, j in found.items())
        assert sorted(found.values()) == [found[i] for i in sorted(found)]


def test_page_parts():
    page = html_text.Page(
        '<html><head><title>t</title></head><body><header>site</header><nav><ul><li><a href=x>menu</a></ul></nav>'
        '<div class="cookie-notice">ok</div><main><article><header><h1>T &amp; x</h1></header><p>one<br>two <a href="a>b">link</a>'
        '<ul><li>a<li>b</ul><section id="comments"><p>reader</p></section>3 < 4 &eacute;&#233;<script>if (a</b) x</script>'
        '<form>f <button>go</button></form><p>end</article></main><aside>side</aside><footer>foot')
    assert [t for _, t, _, dropped, main in page.blocks if main and not dropped] == ["T & x", "one two link", "a", "b", "3 < 4 éé", "end"]
    assert {t for _, t, _, dropped, _ in page.blocks if dropped} == {"site", "menu", "ok", "reader", "f", "go", "side", "foot"}


def kept(source):
    page = html_text.Page(source)
    return [t for (_, t, _, dropped, _), a in zip(page.blocks, page.around, strict=True) if not dropped and a < 0]


def test_names_are_whole_classes_and_never_around_the_main_text():
    for own in ('class="layout no-sidebar"', 'class="post has-comments"', 'class="share-enabled"', 'id="page-alert"', 'class="content with-banner"'):
        assert kept(f"<div {own}><p>text</p></div>") == ["text"]
        assert kept(f"<article {own}><p>text</p><div class=comments>reader</div></article>") == ["text"]
    assert kept('<div class="x sidebar"><p>menu</p><article><p>the main text</p></article></div>') == ["the main text"]
    assert kept('<main class="banner"><p>a</p><div class="x share">b</div></main><div class=sidebar><article>c</article></div>') == ["a"]
    assert kept('<p>post</p><div class=comments><article>a comment longer than the post</article></div>') == ["post"]
    assert kept('<div class="site_footer cookie-notice">x</div>') == []


def test_deep_pages_are_matched():
    for tag in ("div", "blockquote"):
        a = html_text.Page("<html><body>" + f"<{tag}>" * 5000 + "text")
        b = html_text.Page("<html><body>" + f"<{tag}>" * 4000 + "<ul><li>other" + f"<{tag} class=x>" * 3000 + "end")
        assert len(html_text.match_trees(a.outline, a.outline)) == len(a.outline)
        assert len(html_text.match_trees(b.outline, a.outline)) == 4003
        assert len("".join(html_text.slots(b.outline, a.outline))) < 30 * len(b.outline)
        assert [t for _, t, *_ in a.blocks] == ["text"] and [t for _, t, *_ in b.blocks] == ["other", "end"]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """The contract's patterns and conditions, word for word."""
    def fits(kind, s):
        d = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            doubled = [2 * x - 9 * (x > 4) for x in d[-2::-2]]
            return 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(doubled)) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15
    return [(k, *m.span()) for k, pattern in PLAIN.items() for m in re.finditer(pattern, text) if fits(k, m[0])]


def test_base_spans_are_the_plain_patterns():
    r = random.Random(8)
    pieces = ["a", "b1", "@", ".", "-", "_", "%", " ", "1", "25", "255", "256", "0", "00", "+", "(", ")", "4111111111111111", "\n", "é", "x.y", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(r.choices(pieces, k=r.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_of_very_long_runs():
    n = 1_000_000
    began = time.process_time()
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    assert pii.base_spans("7" * n) == [] and pii.base_spans("1." * n)[:1] == [("ip", 0, 7)]
    assert pii.base_spans("x" * n) == [] and pii.base_spans("x" * n + "@") == []
    assert pii.base_spans("x" * n + "@y.z") == [("email", 0, n + 4)]
    assert pii.base_spans("@" * n) == [] and pii.base_spans("a@" * (n // 10)) == [] and pii.base_spans("+1" * (n // 10)) == []
    assert time.process_time() - began < 20


@pytest.mark.parametrize(("source", "texts"), [
    ("<p data-t=it's>First one.</p><p>She's here</p>", ["First one.", "She's here"]),
    ('<p a=x"y>one</p><p>say "so"</p>', ["one", 'say "so"']),
    ('<p "stray>one</p><p>two "x"</p>', ["one", 'two "x"']),
    ('<p title="a > b">one</p><p title=\'c > d\'>two</p>', ["one", "two"]),
    ('<p title = "a > b" hidden2>one<br/>more</p><p/>two', ["one more", "two"]),
    ('<p title="never closed>one</p><p>two', ["one", "two"]),
    ("<p =x='>'>one</p>", ["one"]), ("<p>1 < 2 and a<b </p><p>end", ["1 < 2 and a", "end"]),
])
def test_quote_marks_in_markup(source, texts):
    assert [b[1] for b in html_text.Page(source).blocks] == texts


def test_attributes_of_any_length_are_read_in_linear_time():
    t0 = time.perf_counter()
    for source in ("<p " + "a='" * 300_000 + ">x", '<p x="' + "y " * 500_000, "<p " + "a=b " * 300_000 + ">x", "<p" + " " * 1_000_000 + "=", "<a<" * 100_000):
        html_text.Page(source)
    assert time.perf_counter() - t0 < 20
