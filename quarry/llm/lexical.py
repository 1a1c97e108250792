"""Ranked lexical search over a length-stratified index.

A term is a maximal run of letters, digits and characters beyond ASCII; only A-Z are
lower-cased. Over a collection of N documents with L terms, a document of n terms has the
length normaliser m = 25 + (75 * n * N) div L, and a term that occurs tf times in it adds
w * ((1000000000 * tf) div (1000 * tf + 8 * m)) to its score, with the weight
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).

*Index* (``build_index``). Length enters a score through m alone, so documents of equal m
form a stratum. The documents are shuffled by (m, slot): a stratum has as many slots as its
bytes need, so one that holds a third of all documents is spread over many tasks. A row of
the index is a segment: documents of one stratum (at most ``arrowtext.SLICE_ROWS``, or
``SLICE_BYTES`` of text) with their dictionary and, per term, postings grouped by tf. All
terms of all documents are indexed.

*Search* (``search``). A task reads its segments in windows of ``WINDOW`` postings. All
postings of one term and tf in a segment have the same impact, so it is computed once per
tf, not once per posting. The impacts at each term's highest tf add up to the segment's
bound for an item; each item visits the segments by falling bound and stops below the score
of its k-th best document so far. A task hands on at most k rows an item, and Spark ranks
these, first within groups of tasks.

Items are held against the index in blocks of at most ``BLOCK_BYTES`` of text (one longer
item is a block), which are sent to the tasks, so any number of items can be asked.

Edge cases: a null or empty text has no terms: such a document is never found and does not
count in N, and such an item has no rows. Documents with a null id come after others of equal
score; repeated rows are documents (or items) of their own. An empty table gives an empty
result; extra columns are ignored, whatever their names; texts of any length are read whole
(one text is held by one task). Terms of one slice of text are told apart by 64-bit hashes,
terms of items are looked up by hash and compared as strings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.arrowtext import Texts, texts, word_hashes
from quarry.llm.frames import col, map_arrow
from quarry.plans.broadcast import small_side
from quarry.session import materialize

K = 10
#: Text of one slot of a stratum, text of one block of items, postings of one window.
SLOT_BYTES, BLOCK_BYTES, WINDOW = 16 << 20, 8 << 20, 1 << 22
#: Groups of tasks whose results are ranked before all are.
GROUPS = 64

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
BLANK = np.array([not TERM.match(chr(b)) if b < 0x80 else False for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE = 0x20

SEGMENT = "m long, docs array<long>, spelled binary, groups binary, tf binary, size binary, post binary"


def terms(text: str | None) -> list[str]:
    """Terms of a text in order, with repeats."""
    return [t.translate({c: c + 0x20 for c in range(0x41, 0x5B)}) for t in TERM.findall(text or "")]


def lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, n): n is the number of terms."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            n = [np.bincount(t.words(BLANK)[0], minlength=t.n) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n).astype(np.int64))],
                                             names=["doc_id", "text", "n"])
        return fn
    return map_arrow(docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")),
                     make, "doc_id long, text string, n long")


def strata(counted: DataFrame) -> tuple[DataFrame, int, int]:
    """((n, m, slots) of every length n that occurs, N, L)."""
    by_n = materialize(counted.where("n > 0").groupBy("n").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")), "lengths")
    total = by_n.agg(F.sum("docs").alias("N"), F.sum(F.col("n") * F.col("docs")).alias("L")).first()
    n_docs, n_terms = int(total.N or 0), int(total.L or 0)
    m = F.expr(f"25 + CAST((CAST(n AS DECIMAL(19, 0)) * 75 * {n_docs}) div {max(n_terms, 1)} AS BIGINT)")
    by_n = by_n.withColumn("m", m)
    slots = by_n.groupBy("m").agg(F.ceil(F.sum("bytes") / SLOT_BYTES).cast("bigint").alias("slots"))
    return by_n.join(slots, "m").select("n", "m", "slots"), n_docs, n_terms


def _binary(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value per range of ``flat``; ``starts`` has the ranges' borders."""
    offs = (starts * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))])


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of all ranges [start, start + size), one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def segments(t: Texts, m: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """The segments of a slice of texts that are sorted by m."""
    buf = LOWER[t.buf]
    doc, starts, ends = t.words(BLANK)
    cut = np.flatnonzero(np.append(True, m[1:] != m[:-1]))  # first text of each segment
    seg_of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, t.n)))
    _, at, term = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    # occurrences -> postings (segment, term, text) with tf
    key = np.sort((seg_of[doc].astype(np.uint64) << np.uint64(48)) | (term.astype(np.uint64) << np.uint64(16))
                  | (doc - cut[seg_of[doc]]).astype(np.uint64))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    post, owner = (key & np.uint64(0xFFFF)).astype(np.uint16), key >> np.uint64(16)
    order = np.lexsort((tf, owner))  # stable: texts stay in order within a tf
    post, owner, tf = post[order], owner[order], tf[order]
    # postings -> groups of one tf -> terms -> segments
    new_term = np.append(True, owner[1:] != owner[:-1])
    group = np.flatnonzero(new_term | np.append(True, tf[1:] != tf[:-1]))
    size = np.diff(np.append(group, len(post)))
    entry = np.flatnonzero(new_term[group])  # first group of each dictionary entry
    groups = np.diff(np.append(entry, len(group)))
    owner = owner[group[entry]]
    each = np.arange(len(cut) + 1)
    entry_at = np.searchsorted((owner >> np.uint64(32)).astype(np.int64), each)
    group_at = np.append(entry, len(group))[entry_at]
    post_at = np.append(group, len(post))[group_at]
    token = at[(owner & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    sizes = ends[token] - starts[token]
    spelled = np.full(int(sizes.sum()) + len(sizes), SPACE, dtype=np.uint8)  # terms, a blank after each
    to = np.cumsum(sizes + 1) - sizes - 1
    spelled[spans(to, sizes)] = buf[spans(starts[token], sizes)]
    return pa.RecordBatch.from_arrays(
        [pa.array(m[cut]), pa.ListArray.from_arrays(pa.array(np.append(cut, t.n).astype(np.int32)), ids),
         _binary(spelled, np.append(to, len(spelled))[entry_at]), _binary(groups.astype(np.int32), entry_at),
         _binary(tf[group].astype(np.int32), group_at), _binary(size.astype(np.int32), group_at), _binary(post, post_at)],
        names=[f.split()[0] for f in SEGMENT.split(", ")])


class Index:
    """The segments (a DataFrame over Parquet files), N and L."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    counted = lengths(docs, id_col, text_col)
    by_n, n_docs, n_terms = strata(counted)

    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            m, ids = batch.column(0).to_numpy(), batch.column(1)
            for t in texts(batch.column(2)):
                yield segments(t, m[t.first:t.first + t.n], ids.slice(t.first, t.n))
        return fn
    dealt = (counted.where("n > 0").join(small_side(by_n), "n")
                    .select("m", F.pmod(F.xxhash64("doc_id"), F.col("slots")).alias("slot"), "doc_id", "text")
                    .repartition("m", "slot").sortWithinPartitions("m", "slot").select("m", "doc_id", "text"))
    return Index(materialize(map_arrow(dealt, make, SEGMENT), "segments"), n_docs, n_terms)


class Asked:
    """A block of items: ``ids``, and of every item its distinct terms (``term[ptr[i]:ptr[i + 1]]``)
    with repeats (``times``); ``words`` and ``hashes`` of the terms, in the order of the hashes."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        found = [(i, terms(text)) for i, text in items]
        found = [(i, ts) for i, ts in found if ts]
        words = sorted({t.encode() for _, ts in found for t in ts})
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        hashes = word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - sizes, ends)
        order = np.argsort(hashes, kind="stable")
        place = {words[j].decode(): k for k, j in enumerate(order)}
        self.ids = [i for i, _ in found]
        self.words, self.hashes = [words[j] for j in order], hashes[order]
        pairs = [np.unique([place[t] for t in ts], return_counts=True) for _, ts in found]
        self.ptr = np.append(0, np.cumsum([len(p[0]) for p in pairs])).astype(np.int64)
        self.term = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        self.times = np.concatenate([p[1] for p in pairs]).astype(np.int64) if pairs else np.zeros(0, np.int64)

    def find(self, spelled: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(term of the block, entry) for each entry of a segment's dictionary that is asked."""
        flat = np.frombuffer(spelled, np.uint8)
        ends = np.flatnonzero(flat == SPACE)
        starts = np.append(0, ends[:-1] + 1)
        h = word_hashes(flat, starts, ends)
        lo, hi = np.searchsorted(h, self.hashes), np.searchsorted(h, self.hashes, side="right")
        which = np.flatnonzero(hi > lo)
        hit = [(q, e) for q in which.tolist() for e in range(lo[q], hi[q]) if spelled[starts[e]:ends[e]] == self.words[q]]
        hit = np.array(hit, dtype=np.int64).reshape(-1, 2)
        return hit[:, 0], hit[:, 1]


def document_counts(index: Index, asked: Asked) -> np.ndarray:
    """df of each term of the block: one small row per task and term, summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]):
        df = np.zeros(len(asked.words), dtype=np.int64)
        for batch in batches:
            for spelled, groups, size in zip(*(batch.column(i) for i in range(3)), strict=True):
                q, e = asked.find(spelled.as_py())
                ends = np.cumsum(np.frombuffer(groups.as_buffer(), np.int32))
                total = np.append(0, np.cumsum(np.frombuffer(size.as_buffer(), np.int32)))[np.append(0, ends)]
                np.add.at(df, q, np.diff(total)[e])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])
    found = index.rows.select("spelled", "groups", "size").mapInArrow(run, "term long, df long")
    df = np.zeros(len(asked.words), dtype=np.int64)
    for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return df


class Segment:
    """One segment's postings of the asked terms: of term ``q[j]`` the texts
    ``post[ptr[j]:ptr[j + 1]]`` with their impacts, and its highest impact ``bound[j]``."""

    def __init__(self, row: dict, asked: Asked, weight: np.ndarray):
        m = row["m"].as_py()
        ids = row["docs"].values
        self.none = np.array(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.q, entry = asked.find(row["spelled"].as_py())
        groups, tf, size = (np.frombuffer(row[c].as_buffer(), np.int32).astype(np.int64) for c in ("groups", "tf", "size"))
        first = np.append(0, np.cumsum(groups))[entry]
        at = spans(first, groups[entry])  # groups of the asked terms
        tf, size, start = tf[at], size[at], (np.cumsum(size) - size)[at]
        of = np.repeat(np.arange(len(entry)), groups[entry])
        impact = weight[self.q][of] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        self.post = np.frombuffer(row["post"].as_buffer(), np.uint16)[spans(start, size)]
        self.impact = np.repeat(impact, size)
        self.ptr = np.append(0, np.cumsum(np.bincount(of, weights=size, minlength=len(entry)).astype(np.int64)))
        self.bound = impact[np.cumsum(groups[entry]) - 1] if len(entry) else impact  # impacts grow with tf

    def scores(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.q, term), len(self.q) - 1)
        held = self.q[at] == term
        at, times = at[held], times[held]
        size = self.ptr[at + 1] - self.ptr[at]
        hits = spans(self.ptr[at], size)
        out = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(out, self.post[hits], self.impact[hits] * np.repeat(times, size))
        return out


class Best:
    """The k best documents of each item so far, and the visits made and spared."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k, self.visits, self.spared = asked, k, 0, 0
        self.top: list[list[tuple]] = [[] for _ in asked.ids]

    def visit(self, window: list[Segment]) -> None:
        a = self.asked
        bounds = np.zeros((len(window), len(a.ids)), dtype=np.int64)
        for s, seg in enumerate(window):
            of_term = np.zeros(len(a.words), dtype=np.int64)
            of_term[seg.q] = seg.bound
            bounds[s] = np.add.reduceat(of_term[a.term] * a.times, a.ptr[:-1])
        for i in range(len(a.ids)):
            term, times = a.term[a.ptr[i]:a.ptr[i + 1]], a.times[a.ptr[i]:a.ptr[i + 1]]
            order = np.argsort(-bounds[:, i], kind="stable")
            for n, s in enumerate(order.tolist()):
                least = -self.top[i][-1][0] if len(self.top[i]) == self.k else 1
                if bounds[s, i] < least:
                    self.spared += len(order) - n
                    break
                self.visits += 1
                self._add(i, window[s], window[s].scores(term, times), least)

    def _add(self, i: int, seg: Segment, scores: np.ndarray, least: int) -> None:
        at = np.flatnonzero(scores >= least)
        if len(at) > self.k:
            at = at[np.lexsort((seg.ids[at], seg.none[at], -scores[at]))[:self.k]]
        if len(at):
            new = [(-int(scores[j]), bool(seg.none[j]), int(seg.ids[j])) for j in at]
            self.top[i] = sorted(self.top[i] + new)[:self.k]


def _search(index: Index, asked: Asked, k: int) -> DataFrame:
    df = document_counts(index, asked)
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]):
        best, window, held = Best(asked, k), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment({c: batch.column(c)[i] for c in batch.schema.names}, asked, weight)
                if len(seg.q):
                    window.append(seg)
                    held += len(seg.post)
                if held >= WINDOW:
                    best.visit(window)
                    window, held = [], 0
        if window:
            best.visit(window)
        rows = [(i, asked.ids[i], None if none else doc, -minus) for i, top in enumerate(best.top) for minus, none, doc in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "item_id", "doc_id", "score"])
    found = index.rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return (found.withColumn("task", F.spark_partition_id() % GROUPS)
                 .withColumn("rank", F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))).where(F.col("rank") <= k)
                 .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
                 .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of each item."""
    spark: SparkSession = items.sparkSession
    asked = items.select(col(id_col).cast("bigint").alias("item_id"), col(text_col).alias("text")).where(F.octet_length("text") > 0)
    n_bytes = asked.agg(F.sum(F.octet_length("text") + 100).alias("b")).first().b or 0
    n_blocks = -(-n_bytes // BLOCK_BYTES)
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        block = Asked([(r.item_id, r.text) for r in rows])
        if block.ids and index.n_docs:
            found = _search(index, block, k)
            result = found if n_blocks == 1 else result.unionByName(materialize(found, "ranked"))
    return result


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build_index(docs), items)


ORACLE = r"""
WITH words AS (
  SELECT rowid AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
held AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM held GROUP BY row),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
normal AS (SELECT row, 100 - 75 + ((75 * n * n_docs) // n_terms) AS m FROM sizes, total),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
           FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total),
asked AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
scored AS (
  SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN held USING (term) JOIN normal USING (row) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
