"""Vector codes (product quantisation) by Lloyd's method over partition-local cover trees.

Vectors of integers are cut into ``PARTS`` equal consecutive parts, and each part position has
a codebook of at most ``ENTRIES`` entries. Each of ``ROUNDS`` rounds assigns every part to the
nearest entry of its codebook (squared Euclidean distance, ties to the lower index) and moves
each entry to the floor of the mean of its parts; unused entries stay.

*Trees* (``Tree``). Vectors are taken in blocks of ``BLOCK``; per part position a block has one
cover tree: every child lies within its parent's radius, children of one node are further apart
than half of it, and equal parts are one leaf. A node carries the exact distance to its furthest
descendant, the number of vectors below it and their sum. The trees do not depend on the
codebooks: they are built once and written to the shared folder.

*Rounds.* A tree is walked level by level. If the nearest entry of a node's centre is nearer than
any other by more than twice the node's radius, then by the triangle inequality it is the nearest
of every vector below, and the node's count and sum are added as a whole. Entries that are further
by more than twice the radius cannot be nearest to anything below, and are left out there. Only
ambiguous nodes hand their children down; at leaves, distances are compared as exact integers.
A task returns at most one row per part and entry, whatever its number of vectors, and Spark adds
these up. Only codebooks pass through the driver.

Components are floor(1024 * x). Edge cases: rows whose vector is null, empty or has null or
non-finite components are dropped, and so are those with a component of 2**18 or more in
magnitude (their squared distances do not fit 64 bits). All vectors need one length, a multiple
of ``PARTS``: that of the kept row with the least id rules, others are dropped. Rows with a null id
sort after all others; repeated rows are rows of their own; of fewer than ``ENTRIES`` rows each
is an entry; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import col, map_arrow
from quarry.plans.broadcast import small_side
from quarry.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one block; a component's magnitude before scaling.
BLOCK, LARGEST = 1024, 2.0 ** 18
#: Slack of a comparison of square roots, which are rounded.
SLACK = 1e-9

FOREST = "ids array<long>, labels array<long>, points binary, trees array<binary>"


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    if not a.size or max(np.abs(a).max(), np.abs(b).max()) ** 2 * 4 * a.shape[1] < 2 ** 53:
        x, y = a.astype(float), b.astype(float)  # every sum below fits a double's 53 bits
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    return np.stack([((a - e) ** 2).sum(1) for e in b], axis=1)


class Tree:
    """A cover tree over the rows of ``points``. Nodes are numbered by level: ``centre`` (a row
    of ``points``), ``radius``, ``count``, ``total`` (of the rows below), ``child`` (the children of
    node i are ``child[i]`` up to ``child[i + 1]``) and ``start``: the rows below are
    ``row[start[i]:start[i] + count[i]]``."""

    FIELDS = (("centre", np.int32), ("radius", np.float64), ("count", np.int64), ("child", np.int32), ("start", np.int32), ("row", np.int32))

    def __init__(self, points: np.ndarray):
        level = [np.arange(len(points))]  # rows below each node of a level, the centre first
        nodes, kids = [], []
        while level:
            below = []
            for rows in level:
                d = ((points[rows] - points[rows[0]]) ** 2).sum(1)
                nodes.append((rows, d.max()))
                found = self._split(points, rows, d) if d.max() else []
                kids.append(len(found))
                below += found
            level = below
        self.centre = np.array([rows[0] for rows, _ in nodes], np.int32)
        self.radius = np.sqrt(np.array([r for _, r in nodes], float))
        self.count = np.array([len(rows) for rows, _ in nodes], np.int64)
        self.child = np.append(1, 1 + np.cumsum(kids)).astype(np.int32)
        # rows in the order of the leaves, so that each subtree's rows are one range
        self.start = np.zeros(len(nodes), np.int32)
        for i, (rows, _) in enumerate(nodes):
            at = self.start[i]
            for c in range(self.child[i], self.child[i + 1]):
                self.start[c] = at
                at += len(nodes[c][0])
        self.row = np.empty(len(points), np.int32)
        for i, (rows, _) in enumerate(nodes):
            if not kids[i]:
                self.row[self.start[i]:self.start[i] + len(rows)] = rows
        self._sum(points)

    @staticmethod
    def _split(points: np.ndarray, rows: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Children of a node: the first is its own centre; each takes the rows within half the
        radius of it that no earlier child took, so centres are further apart than that."""
        near, found = d.max() / 4, []  # squared
        while True:
            mine = d <= near
            found.append(rows[mine])
            rows = rows[~mine]
            if not len(rows):
                return found
            d = ((points[rows] - points[rows[0]]) ** 2).sum(1)

    def _sum(self, points: np.ndarray) -> None:
        run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[self.row], axis=0)])
        self.total = run[self.start + self.count] - run[self.start]

    def pack(self) -> bytes:
        head = np.array([len(self.centre), len(self.row)], np.int64)
        return head.tobytes() + b"".join(getattr(self, f).tobytes() for f, _ in self.FIELDS)

    @classmethod
    def unpack(cls, raw: bytes, points: np.ndarray) -> Tree:
        tree = cls.__new__(cls)
        n, rows = np.frombuffer(raw, np.int64, 2)
        at = 16
        for f, kind in cls.FIELDS:
            size = {"child": n + 1, "row": rows}.get(f, n)
            setattr(tree, f, np.frombuffer(raw, kind, size, at))
            at += int(size) * np.dtype(kind).itemsize
        tree._sum(points)
        return tree

    def assign(self, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nodes, entries, comparisons): subtrees that together hold every row once, and the
        entry nearest to all rows of each."""
        nodes, entries, compared = [], [], 0
        level = np.zeros(1, np.int64)
        open_ = np.ones((1, len(book)), bool)  # entries that can be nearest to a row below
        while len(level):
            d2 = squares(points[self.centre[level]], book)
            compared += int(open_.sum())
            d2 = np.where(open_, d2, np.iinfo(np.int64).max)
            best = d2.argmin(axis=1)  # the first of equals
            d = np.sqrt(d2.astype(float))
            reach = d[np.arange(len(level)), best] + 2 * self.radius[level]
            can = d <= (reach * (1 + SLACK) + SLACK)[:, None]
            done = (can.sum(axis=1) == 1) | (self.child[level] == self.child[level + 1])
            nodes.append(level[done])
            entries.append(best[done])
            rest = level[~done]
            kids = self.child[rest + 1] - self.child[rest]
            ends = np.cumsum(kids)
            level = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.child[rest] - ends + kids, kids)
            open_ = np.repeat(can[~done], kids, axis=0)
        return np.concatenate(nodes), np.concatenate(entries), compared

    def entry_of_rows(self, nodes: np.ndarray, entries: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.row), np.int64)
        for i, e in zip(nodes.tolist(), entries.tolist(), strict=True):
            out[self.row[self.start[i]:self.start[i] + self.count[i]]] = e
        return out


def parts_of(points: np.ndarray) -> list[np.ndarray]:
    return np.split(points, PARTS, axis=1)


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, v): the usable rows, with integer components."""
    x = F.col("x")
    label = col(label_col).cast("bigint") if label_col else F.lit(None).cast("bigint")
    usable = F.coalesce(F.size(x) > 0, F.lit(False)) & F.forall(x, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return (vectors.select(col(id_col).cast("bigint").alias("id"), label.alias("label"), col(vector_col).cast("array<double>").alias("x"))
                   .where(usable).select("id", "label", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v")))


def plant(rows: DataFrame, width: int) -> DataFrame:
    """The forest: one row per block of vectors with its cover trees."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                points = part.column(2).flatten().to_numpy().reshape(-1, width)
                trees = [Tree(p).pack() for p in parts_of(points)]
                offs = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(offs, part.column(0)), pa.ListArray.from_arrays(offs, part.column(1)),
                     pa.array([points.astype(np.int32).tobytes()]), pa.array([trees], pa.list_(pa.binary()))],
                    names=[f.split()[0] for f in FOREST.split(", ")])
        return fn
    return map_arrow(rows.select("id", "label", "v"), make, FOREST)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[Tree, np.ndarray]]]]:
    """Row, points, and per part its (tree, points), of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            points = np.frombuffer(row.column("points")[0].as_buffer(), np.int32).reshape(-1, width).astype(np.int64)
            cut = parts_of(points)
            yield row, points, [(Tree.unpack(t.as_py(), p), p) for t, p in zip(row.column("trees")[0].values, cut, strict=True)]


def improve(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round."""
    n, size = len(books[0]), books[0].shape[1]
    width = size * PARTS

    def run(batches):
        count, total = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n, size), np.int64)
        for _, _, trees in _blocks(batches, width):
            for p, (tree, points) in enumerate(trees):
                nodes, entries, _ = tree.assign(points, books[p])
                np.add.at(count[p], entries, tree.count[nodes])
                np.add.at(total[p], entries, tree.total[nodes])
        some = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(count.ravel()[some]), pa.array(list(total.reshape(-1, size)[some]), pa.list_(pa.int64()))],
            names=["slot", "n", "total"])
    found = forest.select("points", "trees").mapInArrow(run, "slot long, n long, total array<long>")
    sums = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"s{j}") for j in range(size)])
    new = [b.copy() for b in books]
    for r in sums.collect():
        new[r.slot // n][r.slot % n] = [r[f"s{j}"] // r.n for j in range(size)]
    return new


def encode(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every vector."""
    width = books[0].shape[1] * PARTS

    def run(batches):
        for row, points, trees in _blocks(batches, width):
            codes, error = [], np.zeros(len(points), np.int64)
            for p, (tree, part) in enumerate(trees):
                entry = tree.entry_of_rows(*tree.assign(part, books[p])[:2])
                codes.append(entry)
                error += ((part - books[p][entry]) ** 2).sum(1)
            text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), pa.array(text), pa.array(error)],
                                             names=["id", "label", "code", "error"])
    return forest.mapInArrow(run, "id long, label long, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (error summed over equal labels) and
    ``codebooks_sha256`` of every usable vector."""
    rows = kept(vectors, id_col, vector_col, label_col)
    order: list[Column] = [F.asc_nulls_last("id"), F.asc("v")]
    fitting = rows.where(F.size("v") % PARTS == 0)
    first = fitting.orderBy(*order).limit(1).collect()
    width = len(first[0].v) if first else PARTS
    rows = rows.where(F.size("v") == width)
    forest = materialize(plant(rows, width), "forest")
    start = np.array([r.v for r in rows.orderBy(*order).limit(ENTRIES).collect()], np.int64).reshape(-1, width)
    books = parts_of(start)
    for _ in range(ROUNDS if len(start) else 0):
        books = improve(forest, books)
    coded = materialize(encode(forest, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (coded.join(small_side(by_label), F.col("label").eqNullSafe(F.col("of")))
                 .select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _oracle() -> str:
    """The rounds as common table expressions."""
    sql = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT row, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, x FROM cut JOIN (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept) USING (row) WHERE entry < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        sql.append(f"""near{r} AS MATERIALIZED (
  SELECT row, part, min({{'d': list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': entry}}) AS best
  FROM cut c JOIN book{r} b USING (part) GROUP BY row, part)""")
        if r < ROUNDS:
            sql.append(f"""mean{r} AS (
  SELECT part, best.entry AS entry, i, floor(sum(x[i]) / count(*))::BIGINT AS y
  FROM near{r} JOIN cut USING (row, part), unnest(range(1, len(x) + 1)) u(i) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS x FROM mean{r} GROUP BY ALL) m USING (part, entry))""")
    sql.append(f"""digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near{ROUNDS} JOIN kept USING (row) GROUP BY row, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest""")
    return ",\n".join(sql)


ORACLE = _oracle()
