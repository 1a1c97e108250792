"""Personal data by a linear-chain CRF over word shapes, added to exact base patterns.

*Base*: leftmost non-overlapping matches of four patterns, with checks; these always stay.

*Model*: words carry features of their shape (runs of upper case, lower case, digits and
each other character), length, digits, a small vocabulary, and the same of both
neighbours. A linear-chain conditional random field over the labels none, email, ip,
card, phone and secret is trained on a small labelled table (``pii_examples``, or any
table of that form up to ``MAX_EXAMPLES`` rows) by gradient ascent on the exact
log-likelihood. Every word of every text is scored.

*Decoding*: Viterbi in numpy batches. Where the label none leads by more than any two
transitions can make up, the best path must pass through none, so the chain falls apart
there into independent stretches between two none labels; these are decoded together,
batched by length. The result is that of Viterbi over the whole text.

A decoded span is trimmed, must pass the check of its kind and must not overlap a base
span.

Edge cases: a null text is empty and has no spans; texts of any length are read whole;
rows are independent (ties, repeated rows and null ids need no rule); an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.arrowtext import Texts, mix, powers, texts
from quarry.llm.frames import col, map_arrow
from quarry.llm.pii_examples import PRIVATE, labelled, luhn

# Fixed values of the contract: the base patterns, in order of kinds.
# The contract's patterns, written so that a long run of digits or letters is read once:
# email is [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ (see ``_emails``),
# ip is [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), whose matches begin where a run of digits does
USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

KINDS = PRIVATE
LABELS = ("none", *KINDS)
MAX_EXAMPLES = 5000


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches. An address has one ``@`` and nothing before it that
    belongs to the match before, so each ``@`` is tried once: back over its user name, then
    on over its host."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in USER:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        free = host.end() if host else at + 1
        if host:
            found.append(("email", start, free))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    found = []
    if "@" in text:
        found += _emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if _is_ip(m[0])]
    found += [("card", *m.span()) for m in CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# -- features ------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("0"):ord("9") + 1] = ord("9")
_CLASS[ord("A"):ord("Z") + 1] = ord("X")
_CLASS[ord("a"):ord("z") + 1] = ord("x")
_CLASS[128:] = ord("x")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefABCDEF", np.uint8))
_LENGTHS = np.array([0, 3, 6, 10, 16, 24, 40, 80])
_COUNTS = np.array([0, 1, 2, 3, 4, 7, 10, 12, 13, 16, 20])
_POWERS = powers(np.uint64(0x9E3779B97F4A7C15), 1 << 12)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, values.dtype)


def word_features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(row, start, end) of the words and their own features: ``shape`` and ``word`` as
    hashes, the others as small integers."""
    doc, starts, ends = t.words()
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)  # place in the word
    raw = t.buf[np.repeat(starts, lens) + at]
    kind = _CLASS[raw]
    run = np.append(True, kind[1:] != kind[:-1])
    run[first] = True
    order = np.cumsum(run)
    order -= np.repeat(order[first], lens) if len(first) else 0
    wrap = len(_POWERS) - 1  # very long words: places repeat, which only blurs a hash
    shape = _sums(np.where(run, (kind + np.uint64(1)) * _POWERS[order & wrap], np.uint64(0)), first)
    letter = (kind == ord("x")) | (kind == ord("X"))
    place = np.cumsum(letter)
    place -= np.repeat(place[first] - letter[first], lens) if len(first) else 0
    word = _sums(np.where(letter, (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _POWERS[place & wrap], np.uint64(0)), first)
    digits = _sums((kind == ord("9")).astype(np.int64), first)
    hexa = _sums(_HEX[raw].astype(np.int64), first)
    signs = [_sums((raw == ord(c)).astype(np.int64), first) for c in "@.:-("]
    letters = _sums(letter.astype(np.int64), first)
    flags = sum((np.minimum(s, 1) << i for i, s in enumerate(signs)), np.zeros(len(starts), np.int64))
    return doc, starts, ends, {
        "shape": mix(shape), "word": np.where(letters > 0, mix(word), np.uint64(0)),
        "length": np.searchsorted(_LENGTHS, lens, side="right"),
        "digits": np.searchsorted(_COUNTS, digits, side="right"),
        "signs": flags, "dots": np.minimum(signs[1], 4), "colons": np.minimum(signs[2], 4),
        "mixed": (digits > 0).astype(np.int64) + 2 * (letters > 0) + 4 * (hexa >= 0.9 * lens) + 8 * (lens >= 20)}


OWN = ("shape", "word", "length", "digits", "signs", "dots", "colons", "mixed")
NEAR = ("shape", "word", "digits", "signs", "length")


class Crf:
    """Weights, and the ids of the shapes and words they know."""

    def __init__(self, shapes: np.ndarray, words: np.ndarray):
        self.known = {"shape": shapes, "word": words}
        self.sizes = {"shape": len(shapes) + 1, "word": len(words) + 1, "length": 9, "digits": 12, "signs": 32,
                      "dots": 5, "colons": 5, "mixed": 16}
        self.slots = [(name, 0) for name in OWN] + [(name, d) for d in (-1, 1) for name in NEAR]
        n = sum(self.sizes[name] + 1 for name, _ in self.slots)
        self.weight = np.zeros((n, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))

    def ids(self, doc: np.ndarray, f: dict[str, np.ndarray]) -> np.ndarray:
        """(words, slots): the row of ``weight`` for every feature of every word."""
        own = {}
        for name in OWN:
            v = f[name]
            if name in self.known:
                known = self.known[name]
                at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                v = np.where(known[at] == v, at + 1, 0)
            own[name] = v.astype(np.int32)
        out = np.empty((len(doc), len(self.slots)), dtype=np.int32)
        base = 0
        for j, (name, d) in enumerate(self.slots):
            v = own[name]
            if d:
                near = np.full(len(doc), self.sizes[name], dtype=np.int32)  # no neighbour
                if len(doc) > 1:
                    same = doc[1:] == doc[:-1]
                    if d < 0:
                        near[1:] = np.where(same, v[:-1], near[1:])
                    else:
                        near[:-1] = np.where(same, v[1:], near[:-1])
                v = near
            out[:, j] = v + base
            base += self.sizes[name] + 1
        return out

    def scores(self, ids: np.ndarray) -> np.ndarray:
        s = np.zeros((len(ids), len(LABELS)))
        for j in range(ids.shape[1]):
            s += self.weight[ids[:, j]]
        return s


def _padded(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """(chains, longest) word indices; -1 beyond the end of a chain."""
    p = np.arange(lens.max())
    return np.where(p[None, :] < lens[:, None], first[:, None] + p[None, :], -1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[str, list[tuple[str, int, int]]]] | None = None, steps: int = 150, rate: float = 0.15,
          penalty: float = 0.02) -> Crf:
    """Fit the CRF (each chain stands between two none labels) with Adam on all rows."""
    rows = labelled() if rows is None else rows
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"at most {MAX_EXAMPLES} labelled rows")
    parts = list(texts(pa.array([r[0] for r in rows]), max_rows=MAX_EXAMPLES, max_bytes=1 << 30))
    t = parts[0]
    doc, starts, ends, f = word_features(t)
    gold = np.zeros(len(doc), dtype=np.int64)
    for i, (text, spans) in enumerate(rows):
        for kind, a, b in spans:
            a, b = (t.offs[i] + len(text[:x].encode()) for x in (a, b))
            gold[(doc == i) & (starts < b) & (ends > a)] = LABELS.index(kind)
    words, n = np.unique(f["word"], return_counts=True)
    crf = Crf(np.unique(f["shape"]), words[(n >= 3) & (words > 0)])
    ids = crf.ids(doc, f)
    lens = np.bincount(doc, minlength=t.n)
    lens, first = lens[lens > 0], np.searchsorted(doc, np.flatnonzero(lens > 0))
    pad = _padded(first, lens)
    live, y = pad >= 0, np.where(pad >= 0, gold[pad], 0)
    n_l, (n_c, n_t) = len(LABELS), pad.shape
    want_move = np.zeros((n_l, n_l))
    before = np.concatenate([np.zeros((n_c, 1), np.int64), y[:, :-1]], axis=1)
    np.add.at(want_move, (before[live], y[live]), 1)
    np.add.at(want_move, (y[np.arange(n_c), lens - 1], np.zeros(n_c, np.int64)), 1)
    want = np.zeros_like(crf.weight)
    for j in range(ids.shape[1]):
        np.add.at(want, (ids[:, j], gold), 1)
    m1, v1, m2, v2 = (np.zeros_like(x) for x in (crf.weight, crf.weight, crf.move, crf.move))
    for step in range(1, steps + 1):
        e = np.where(live[..., None], crf.scores(ids)[pad], 0.0)
        fw, bw = np.empty((n_t, n_c, n_l)), np.empty((n_t, n_c, n_l))
        fw[0] = crf.move[0] + e[:, 0]
        for i in range(1, n_t):
            step_on = _lse(fw[i - 1][:, :, None] + crf.move[None], 1) + e[:, i]
            fw[i] = np.where(live[:, i, None], step_on, fw[i - 1])
        bw[n_t - 1] = crf.move[:, 0]
        for i in range(n_t - 2, -1, -1):
            back = _lse(crf.move[None] + (e[:, i + 1] + bw[i + 1])[:, None, :], 2)
            bw[i] = np.where(live[:, i + 1, None], back, crf.move[:, 0])
        z = _lse(fw[n_t - 1] + crf.move[:, 0], 1)
        mass = np.exp(fw + bw - z[None, :, None]).transpose(1, 0, 2)
        got_word = np.zeros((len(doc), n_l))
        got_word[pad[live]] = mass[live]
        got = np.zeros_like(crf.weight)
        for j in range(ids.shape[1]):
            np.add.at(got, ids[:, j], got_word)
        got_move = np.zeros((n_l, n_l))
        got_move[0] += mass[:, 0].sum(axis=0)
        got_move[:, 0] += mass[np.arange(n_c), lens - 1].sum(axis=0)
        for i in range(1, n_t):
            on = live[:, i]
            p = fw[i - 1][on][:, :, None] + crf.move[None] + (e[on, i] + bw[i][on])[:, None, :] - z[on][:, None, None]
            got_move += np.exp(p).sum(axis=0)
        for w, g, m, v in ((crf.weight, want - got - penalty * crf.weight, m1, v1),
                           (crf.move, want_move - got_move - penalty * crf.move, m2, v2)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return crf


def viterbi(e: np.ndarray, move: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Best label of every word; the words of a text (equal ``doc``) are a chain between
    two none labels."""
    best = np.zeros(len(e), dtype=np.int64)
    if not len(e):
        return best
    sure = e[:, 0] - e[:, 1:].max(axis=1) > 2 * (move.max() - move.min())
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return best
    split = np.append(True, (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]]))
    first = open_[split]
    lens = np.diff(np.append(np.flatnonzero(split), len(open_)))
    order = np.argsort(-lens, kind="stable")
    first, lens = first[order], lens[order]
    score = move[0] + e[first]
    back = []
    for i in range(1, int(lens[0])):
        n = int(np.searchsorted(-lens, -i, side="left"))  # chains longer than i
        step = score[:n, :, None] + move[None]
        back.append(step.argmax(axis=1))
        score[:n] = step.max(axis=1) + e[first[:n] + i]
    label = (score + move[:, 0]).argmax(axis=1)
    best[first + lens - 1] = label
    for i in range(int(lens[0]) - 1, 0, -1):
        n = len(back[i - 1])
        label[:n] = back[i - 1][np.arange(n), label[:n]]
        best[first[:n] + i - 1] = label[:n]
    return best


# -- spans ---------------------------------------------------------------------

_TRIM = " \t\n\x0b\x0c\r\"'`.,;:!?*#$%&|<>()[]{}=+-/\\"
_AT = re.compile(r"@|\[at\]|\(at\)", re.IGNORECASE)
_SIX = re.compile(r"[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}")
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


def _valid(kind: str, s: str) -> bool:
    d = _digits(s)
    if kind == "email":
        user, at, host = (lambda m: (s[:m.start()], m, s[m.end():]) if m else ("", None, ""))(_AT.search(s))
        return bool(at and user.strip() and re.fullmatch(r"\s*[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", host))
    if kind == "ip":
        return bool(IP.fullmatch(s) and _is_ip(s) or _SIX.fullmatch(s) and sum(map(str.isdigit, s)) >= 2 and s.count(":") >= 3)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search("[A-Za-z]", s)
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(re.fullmatch(r"[0-9() .+-]+", s)) and bool(re.search(r"[ .()-]", s))
    return bool(_SECRET.fullmatch(s)) and len(d) >= 3 and bool(re.search("[A-Za-z]", s))


def _shrink(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    if kind == "secret":  # key=value in one word
        m = re.match(r"[^=:]*[=:][\"']?", text[a:b])
        if m and b - a - m.end() >= 16:
            a += m.end()
    keep = "(+" if kind == "phone" else ""
    while a < b and text[a] in _TRIM and text[a] not in keep:
        a += 1
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    return a, b


def find(t: Texts, crf: Crf) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text of the slice."""
    doc, starts, ends, f = word_features(t)
    label = viterbi(crf.scores(crf.ids(doc, f)), crf.move, doc)
    hit = np.flatnonzero(label > 0)
    added: dict[int, list] = {}
    if len(hit):
        split = np.append(True, (np.diff(hit) > 1) | (doc[hit[1:]] != doc[hit[:-1]]) | (label[hit[1:]] != label[hit[:-1]]))
        for i, j in zip(hit[split], hit[np.append(split[1:], True)], strict=True):
            added.setdefault(int(doc[i]), []).append((LABELS[label[i]], int(starts[i]), int(ends[j])))
    digit = (t.buf >= ord("0")) & (t.buf <= ord("9")) | (t.buf == ord("@"))
    some = np.diff(np.searchsorted(np.flatnonzero(digit), t.offs)) > 0
    out = []
    for i in range(t.n):
        if not some[i] and i not in added:
            out.append(([], []))
            continue
        raw = t.raw(i)
        text = raw.decode("utf-8", "replace")
        base = base_spans(text)
        more = []
        for kind, a, b in added.get(i, ()):
            a, b = (len(raw[:x - int(t.offs[i])].decode("utf-8", "replace")) for x in (a, b))
            a, b = _shrink(kind, text, a, b)
            if _valid(kind, text[a:b]) and not any(a < y and x < b for _, x, y in base):
                more.append((kind, a, b))
        out.append((base, more))
    return out


def _join(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def detect(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans as
    ``kind:start:end`` (code points), ``n_added``."""
    crf = crf or train()

    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                found = find(t, crf)
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in KINDS[:4]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.n), *(pa.array(c, pa.int64()) for c in counts),
                     pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found]),
                     pa.array([_join(base + more) for base, more in found]),
                     pa.array([len(more) for _, more in found], pa.int64())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])
        return fn
    return map_arrow(docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")), make, SCHEMA)
