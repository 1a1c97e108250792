"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

*Lexicon*: a fixed list of abusive words and terms learned from labelled rows: whole words
and word stems that are far more frequent in toxic texts.

*Automaton*: the Levenshtein automata of all terms are intersected with the trie of the
lexicon and made deterministic: one table that reads a word letter by letter and ends in
the nearest term within its number of edits (none below 5 letters and for stems, one
below 9, else two). All words of a slice of texts run through it side by side.

*Context*: a hit in a window of ``WINDOW`` words with quotation marks or verbs of saying
and no form of address counts as quoted and weighs ``QUOTED``; otherwise it is abuse.

*Score*: logistic regression on the hits per term, misspelled hits and the length of the
text, fitted on at most ``MAX_LABELLED`` labelled rows (those with the smallest hash of
their id, so any such bound gives the same kind of sample). Only the text is scored.

Edge cases: a null or empty text has no hits and gets the score of such a text; of
repeated labels for an id the highest counts, null labels are left out; without both
kinds of labels every score is the share of toxic labels (0 without any); rows are
independent; a null id is not held out; an empty table gives an empty result; extra
columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import Texts, mix, texts, word_hashes
from quarry.llm.frames import col, map_arrow
from quarry.session import materialize

MAX_LABELLED = 20_000
MAX_TERMS, MIN_DOCS, MIN_Z = 60, 3, 3.0
STEMS = (4, 5, 6, 7, 8)
WINDOW, QUOTED = 5, 0.25
PENALTY = 1.0

# Common English words of abuse; verbs of saying and forms of address in
# the languages of the corpus.
SEED_TERMS = ("idiot moron stupid loser trash scum clown pathetic worthless disgusting imbecile dumbass "
              "asshole bastard bitch cretin freak vermin filth degenerate coward liar pig dirtbag "
              "scumbag lowlife numbskull halfwit dimwit").split()
SAYING = ("said says say wrote writes called calls quote quoted word term phrase insult insulted sagte schrieb nannte "
          "zitat wort dit écrit appelé citation mot dijo escribió llamó cita palabra").split()
ADDRESS = "you your yours youre u du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes tuyo".split()
QUOTE_MARKS = b"\"\xab\xbb"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[ord("0"):ord("9") + 1] = True
_LETTER[0xC0:] = True
_IS_QUOTE = np.isin(np.arange(256), np.frombuffer(QUOTE_MARKS, np.uint8))


def plain(t: Texts) -> Texts:
    """The slice in lower case with one byte per Latin-1 letter (so that an edit is an
    edit of one letter); curly and low quotation marks become straight ones. Other
    characters keep their UTF-8 bytes."""
    b = t.buf.copy()
    if not len(b):
        return t
    nxt = np.append(b[1:], 0)
    lead = (b == 0xC2) | (b == 0xC3)
    # U+2018..U+201F: E2 80 98..9F
    curly = np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80) & (b[2:] >= 0x98) & (b[2:] <= 0x9F)) if len(b) > 2 else np.zeros(0, int)
    second = np.append(False, b[:-1] == 0xC3)
    b[second] = nxt[np.flatnonzero(second) - 1] + 0x40
    up = (b >= ord("A")) & (b <= ord("Z"))
    b[up] += 32
    high = second & (b >= 0xC0) & (b <= 0xDE) & (b != 0xD7)
    b[high] += 32
    drop = lead.copy()
    b[curly + 2] = ord('"')
    drop[curly] = True
    drop[curly + 1] = True
    kept = ~drop
    at = np.append(0, np.cumsum(kept))
    return Texts(t.first, b[kept], at[t.offs])


def cores(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, start, end, words per row): words without outer punctuation."""
    doc, starts, ends = t.words()
    n_words = np.bincount(doc, minlength=t.n)
    if not len(doc):
        return doc, doc, starts, ends, n_words
    letters = np.append(np.flatnonzero(_LETTER[t.buf]), len(t.buf) + 1)
    first = letters[np.searchsorted(letters, starts)]
    last = letters[np.searchsorted(letters, ends) - 1] + 1
    ok = np.flatnonzero(first < ends)
    return doc[ok], ok, first[ok], last[ok], n_words


def latin(term: str) -> bytes:
    return term.lower().encode("latin-1", "ignore")


class Automaton:
    """``terms``: (bytes, is a stem). ``table[state, class]`` is the next state (0: dead),
    state 1 the start; ``ends``/``edits`` give the term a whole word in that state is, and
    ``stems`` the stem a word has begun with when it reaches the state (-1: none)."""

    def __init__(self, terms: list[tuple[bytes, bool]]):
        self.terms = terms
        self.limit = [0 if stem or len(w) < 5 else 1 if len(w) < 9 else 2 for w, stem in terms]
        children, self._end, reach = self._trie()
        letters = sorted({c for w, _ in terms for c in w})
        self.classes = np.full(256, len(letters), dtype=np.int64)
        self.classes[letters] = np.arange(len(letters))
        self._build(children, reach, letters)

    def _trie(self):
        children, end, reach = [{}], [[]], [0]
        for i, (word, _) in enumerate(self.terms):
            node = 0
            reach[0] = max(reach[0], self.limit[i])
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    end.append([])
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], self.limit[i])
            end[node].append(i)
        return children, end, reach

    def _closed(self, state: dict, children, reach) -> frozenset:
        """With letters of the term left out; only the fewest edits per trie node."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if state.get(node) != e:
                continue
            for child in children[node].values():
                if e + 1 <= reach[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(state.items())

    def _build(self, children, reach, letters) -> None:
        start = self._closed({0: 0}, children, reach)
        number, queue, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(letters) + 1)]
        for state in queue:
            row = []
            for c in [*letters, None]:
                new: dict[int, int] = {}
                for node, e in state:
                    if e + 1 <= reach[node] and e + 1 < new.get(node, 99):
                        new[node] = e + 1  # a letter too many
                    for letter, child in children[node].items():
                        cost = e + (letter != c)
                        if cost <= reach[child] and cost < new.get(child, 99):
                            new[child] = cost
                key = self._closed(new, children, reach)
                if key not in number:
                    number[key] = len(number)
                    queue.append(key)
                row.append(number[key])
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        n = len(number)
        self.ends, self.edits, self.stems = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        for state, k in number.items():
            found = [(e, i) for node, e in state for i in self._end[node] if e <= self.limit[i]]
            whole = [x for x in found if not self.terms[x[1]][1]]
            stem = [x for x in found if self.terms[x[1]][1]]
            if whole:
                self.edits[k], self.ends[k] = min(whole)
            if stem:
                self.stems[k] = max(i for _, i in stem)

    def run(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(index of the word, term, edits) of every hit; a stem counts where no whole
        term fits."""
        state = np.ones(len(starts), dtype=np.int32)
        term, edits = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        live, i = np.arange(len(starts)), 0
        while len(live):
            state_l = self.table[state[live], self.classes[buf[starts[live] + i]]]
            state[live] = state_l
            stem = self.stems[state_l]
            term[live[stem >= 0]] = stem[stem >= 0]
            i += 1
            done = starts[live] + i >= ends[live]
            at, s = live[done], state_l[done]
            whole = self.ends[s] >= 0
            term[at[whole]], edits[at[whole]] = self.ends[s[whole]], self.edits[s[whole]]
            live = live[~done & (state_l > 0)]
        hit = np.flatnonzero(term >= 0)
        return hit, term[hit], edits[hit]


def _hashes(words: list[str]) -> np.ndarray:
    raw = [latin(w) for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends))


def quoted(t: Texts, doc, word, starts, ends, hit: np.ndarray) -> np.ndarray:
    """True for the hits that are quoted rather than meant."""
    saying, address = _hashes(SAYING), _hashes(ADDRESS)
    marks = np.append(0, np.cumsum(_IS_QUOTE[t.buf]))
    quote, meant = np.zeros(len(hit), dtype=bool), np.zeros(len(hit), dtype=bool)
    for d in range(-WINDOW, WINDOW + 1):
        j = hit + d
        ok = np.flatnonzero((j >= 0) & (j < len(doc)))
        ok = ok[(doc[j[ok]] == doc[hit[ok]]) & (np.abs(word[j[ok]] - word[hit[ok]]) <= WINDOW)]
        if not len(ok):
            continue
        a, b = starts[j[ok]], ends[j[ok]]
        h = word_hashes_of(t.buf, a, b)
        quote[ok] |= np.isin(h, saying) & (d != 0)
        meant[ok] |= np.isin(h, address) & (d != 0)
        if abs(d) <= 1:  # a mark just before or after this word
            lo, hi = np.maximum(a - 1, 0), np.minimum(b + 1, len(t.buf))
            quote[ok] |= marks[hi] > marks[lo]
    return quote & ~meant


def word_hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``word_hashes`` for ranges in any order, repeats allowed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    joined = buf[np.repeat(starts, lens) + at]
    return word_hashes(joined, first, first + lens)


def hits(t: Texts, machine: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, edits, weight) of all hits, and the words per row."""
    t = plain(t)
    doc, word, starts, ends, n_words = cores(t)
    hit, term, edits = machine.run(t.buf, starts, ends)
    weight = np.where(quoted(t, doc, word, starts, ends, hit), QUOTED, 1.0)
    return np.stack([doc[hit], term, edits]), weight, n_words


def features(t: Texts, machine: Automaton) -> np.ndarray:
    """(rows, 2 * terms + 3): log hits and hits per hundred words of each term, log
    misspelled hits, log quoted weight, log words."""
    (doc, term, edits), weight, n_words = hits(t, machine)
    m = len(machine.terms)
    exact = np.zeros((t.n, m))
    np.add.at(exact, (doc, term), weight)
    near, soft = np.zeros(t.n), np.zeros(t.n)
    np.add.at(near, doc[edits > 0], weight[edits > 0])
    np.add.at(soft, doc[weight < 1], 1.0)
    rate = 100.0 * exact / (n_words[:, None] + 50.0)
    return np.concatenate([np.log1p(exact), np.minimum(rate, 3.0), np.log1p(near)[:, None], np.log1p(soft)[:, None],
                           np.log1p(n_words)[:, None] / 5.0], axis=1)


# -- learning ------------------------------------------------------------------

def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(doc_id, text, toxic) of at most ``MAX_LABELLED`` rows, copies of a text folded."""
    key = col(id_col).cast("bigint")
    known = (labels.where(key.isNotNull() & col(label_col).isNotNull()).where(~held_out(key))
                   .groupBy(key.alias("doc_id")).agg(F.max(col(label_col).cast("int")).alias("toxic"))
                   .orderBy(F.md5(F.encode(F.col("doc_id").cast("string"), "UTF-8")), "doc_id").limit(MAX_LABELLED))
    rows = docs.select(key.alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(materialize(known, "toxic-labels")), "doc_id")  # MAX_LABELLED ids at most
    return materialize(found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxic-rows")


def held_out(key):
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _terms(t: Texts):
    """Words and stems of a slice: (row, hash, start, end, is a stem), each once a row."""
    doc, _, starts, ends, _ = cores(t)
    out = []
    for n in (0, *STEMS):
        ok = ends - starts > n if n else (ends - starts >= 3) & (ends - starts <= 24)
        a = starts[ok]
        b = a + n if n else ends[ok]
        h = mix(word_hashes_of(t.buf, a, b) + np.uint64(n > 0))
        out.append(np.stack([doc[ok].astype(np.uint64), h, a.astype(np.uint64), b.astype(np.uint64), np.full(len(a), n > 0, np.uint64)]))
    all_ = np.concatenate(out, axis=1)
    order = np.lexsort((all_[1], all_[0]))
    all_ = all_[:, order]
    keep = np.append(True, (np.diff(all_[0]) != 0) | (np.diff(all_[1]) != 0)) if all_.shape[1] else np.zeros(0, bool)
    return all_[:, keep]


def candidates(rows: DataFrame) -> list:
    """Terms in at least ``MIN_DOCS`` toxic rows (counted per slice, then by Spark)."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(0)):
                t = plain(t)
                _, h, a, b, stem = _terms(t)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                words = [t.buf[int(x):int(y)].tobytes() for x, y in zip(a[at], b[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(words, pa.binary()),
                                                  pa.array(stem[at] == 1), pa.array(n.astype(np.int64))],
                                                 names=["h", "term", "stem", "n"])
        return fn
    found = map_arrow(rows.where("toxic = 1").select("text"), make, "h long, term binary, stem boolean, n long")
    return (found.groupBy("h").agg(F.first("term").alias("term"), F.first("stem").alias("stem"), F.sum("n").alias("n"))
                 .where(F.col("n") >= MIN_DOCS).collect())


def learn_terms(rows: DataFrame) -> list[tuple[bytes, bool]]:
    """Terms that mark toxic rows: log-odds z-score of at least ``MIN_Z``, best first, each
    adding rows that no better term covers."""
    found = sorted(candidates(rows), key=lambda r: (bytes(r.term), r.stem))
    known = np.array([r.h for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(known)
    sorted_known = known[order]

    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                doc, h, *_ = _terms(plain(t))
                at = np.minimum(np.searchsorted(sorted_known, h), len(sorted_known) - 1)
                ok = sorted_known[at] == h
                doc, which = doc[ok].astype(np.int64), order[at[ok]]
                toxic = batch.column(0).slice(t.first, t.n).to_numpy(zero_copy_only=False) == 1
                n = np.bincount(which, minlength=len(found))
                n_tox = np.bincount(which[toxic[doc]], minlength=len(found))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(n_tox[some])], names=["i", "n", "toxic"])
        return fn
    if not found:
        return []
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    counts = map_arrow(rows.select("toxic", "text"), make, "i long, n long, toxic long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).collect()
    a, b = np.zeros(len(found)), np.zeros(len(found))
    for r in counts:
        a[r.i], b[r.i] = r.toxic, r.n - r.toxic
    n1, n0 = total.t, total.n - total.t
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = [i for i in np.lexsort((np.arange(len(found)), -z)) if z[i] >= MIN_Z][:40 * MAX_TERMS]
    fixed = [(latin(w), False) for w in SEED_TERMS]
    covers = _coverage(rows, list(dict.fromkeys(fixed + [(bytes(found[i].term), bool(found[i].stem)) for i in best])))
    chosen, done = [], set().union(*(covers.get(w, set()) for w in fixed))
    for i in best:
        term = (bytes(found[i].term), bool(found[i].stem))
        mine = covers.get(term, set())
        if len(mine - done) >= max(2, 0.2 * len(mine)) and len(chosen) < MAX_TERMS:
            chosen.append(term)
            done |= mine
    return chosen


def _coverage(rows: DataFrame, terms: list[tuple[bytes, bool]]) -> dict:
    """The toxic rows (at most ``MAX_LABELLED``) that hold each term."""
    if not terms:
        return {}
    key = mix(np.concatenate([word_hashes_of(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) + np.uint64(s)
                              for w, s in terms]))
    order = np.argsort(key)
    ranked = key[order]

    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                doc, h, *_ = _terms(plain(t))
                at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
                ok = ranked[at] == h
                ids = batch.column(0).slice(t.first, t.n).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc[ok].astype(np.int64)]), pa.array(order[at[ok]])], names=["doc_id", "i"])
        return fn
    covers: dict = {}
    for r in map_arrow(rows.where("toxic = 1").select("doc_id", "text"), make, "doc_id long, i long").collect():
        covers.setdefault(terms[r.i], set()).add(r.doc_id)
    return covers


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (the intercept last, not penalised), by Newton."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), PENALTY)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, machine: Automaton | None, weights: np.ndarray, share: float):
        self.machine, self.weights, self.share = machine, weights, share

    def score(self, t: Texts) -> np.ndarray:
        if self.machine is None:
            return np.full(t.n, self.share)
        x = features(t, self.machine)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    rows = labelled_rows(docs, labels, id_col, text_col, label_col)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    if not total.n or not 0 < total.t < total.n:
        return Model(None, np.zeros(0), float(total.t or 0) / max(1, total.n))
    fixed = [(latin(w), False) for w in SEED_TERMS]
    machine = Automaton(list(dict.fromkeys(fixed + learn_terms(rows))))

    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                x = features(t, machine)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.n), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))],
                                                 names=["toxic", "x"])
        return fn
    got = map_arrow(rows.select("toxic", "text"), make, "toxic int, x array<float>").toArrow()
    x = np.array(got.column("x").combine_chunks().values.to_numpy()).reshape(got.num_rows, -1).astype(float)
    return Model(machine, fit(x, got.column("toxic").to_numpy().astype(float)), float(total.t) / total.n)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                s = model.score(t)
                ids = batch.column(0).slice(t.first, t.n)
                out = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])
        return fn
    return map_arrow(docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")), make, SCHEMA)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
