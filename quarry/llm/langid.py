"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is lower-cased and cut into words of letters (every byte beyond ASCII counts as one);
its features are all runs of 1 to ``LONGEST`` bytes of the words with a blank on either side,
hashed to ``WIDTH`` columns. The vector holds (1 + ln tf) * idf per column, scaled to length 1.

*Learning.* Only from texts with a language whose crc32(id as text) mod ``FOLDS`` is not
``HELD_OUT``. The document counts behind the idf are taken over all of them. Centroids are
fitted on at most ``MAX_PER_LANG`` of them per language, the first by a hash of the id:
spherical k-means with ``CLUSTERS`` centroids per language, started from the texts furthest
apart. Each centroid has a reach: the cosine that all but ``OUTSIDE`` of its own texts come up
to, less ``MARGIN``.

*Prediction.* The language of the centroid with the highest cosine. A text that is nearer
than its reach to no centroid is far from everything learned: ``accepted`` is false then, and
``lang_pred`` still names the nearest language.

Edge cases: a text that is null or has no letter is ``und`` with score 0, not accepted, and is
never learned from; so is every text if nothing was learned. A null id is neither learned from nor
held out; repeated rows are learned from as often as they occur (at most ``MAX_PER_LANG`` times)
and each is predicted; equal cosines go to the first language by name; an empty table gives an
empty result; extra columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.arrowtext import SLICE_BYTES, Texts, mix, texts
from quarry.llm.frames import col, map_arrow
from quarry.plans.broadcast import small_side

FOLDS, HELD_OUT = 3, 1
LONGEST, WIDTH = 4, 1 << 13
MAX_PER_LANG, CLUSTERS, STEPS = 400, 4, 10
OUTSIDE, MARGIN = 0.01, 0.05
#: Rows whose counts are held at once (``WIDTH`` numbers each).
ROWS = 256

UNKNOWN = "und"
_SEED = np.uint64(0x9E3779B97F4A7C15) * np.arange(LONGEST + 1, dtype=np.uint64)
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def counts(t: Texts) -> np.ndarray:
    """Feature counts (texts x ``WIDTH``) of at most ``ROWS`` lower-cased texts."""
    # every text gets a blank before and after it, and every byte that is no letter is one
    size = np.diff(t.offs)
    doc = np.repeat(np.arange(t.n), size + 2)
    flat = np.full(len(doc), 0x20, np.uint8)
    place = np.arange(len(t.buf)) + np.repeat(2 * np.arange(t.n) + 1, size)
    flat[place] = np.where(_LETTER[t.buf], t.buf, 0x20)
    blank = flat == 0x20
    keep = ~(blank & np.append(False, blank[:-1] & (doc[1:] == doc[:-1]))) if len(doc) else blank  # one blank between words
    flat, doc, blank = flat[keep].astype(np.uint32), doc[keep], blank[keep]
    out = np.zeros(t.n * WIDTH, np.int64)
    gram = np.zeros(len(flat), np.uint32)
    inner = np.zeros(len(flat), bool)  # a blank inside the run
    for n in range(1, LONGEST + 1):
        end = len(flat) - n + 1
        if end <= 0:
            break
        gram = (gram[:end] << np.uint32(8)) | flat[n - 1:]
        inner = inner[:end] | blank[n - 2:n - 2 + end] if n > 2 else inner[:end]
        ok = ~inner & (doc[:end] == doc[n - 1:])
        if n == 1:
            ok &= ~blank[:end]
        column = mix(gram[ok].astype(np.uint64) + _SEED[n]) % np.uint64(WIDTH)
        out += np.bincount(doc[:end][ok] * WIDTH + column.astype(np.int64), minlength=len(out))
    return out.reshape(t.n, WIDTH)


def lowered(column: pa.Array) -> Iterator[Texts]:
    yield from texts(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), SLICE_BYTES, ROWS)


def vectors(t: Texts, idf: np.ndarray) -> np.ndarray:
    tf = counts(t)
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0.0) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """idf of every column over all rows (id, lang, text): a task returns one row per column."""
    def run(batches):
        df, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for t in lowered(batch.column(0)):
                df += (counts(t) > 0).sum(axis=0)
                n += t.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(np.append(df, n))], names=["i", "n"])
    got = rows.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(WIDTH + 1)
    for r in got:
        total[r.i] = r.n
    return np.log((1 + total[-1]) / (1 + total[:-1])) + 1


def learned_from(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, text) of all rows that may be learned from."""
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"))
    fold = F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % FOLDS
    return rows.where(F.col("lang").isNotNull() & (fold != HELD_OUT) & F.col("text").rlike(r"\p{L}"))


def sample(rows: DataFrame) -> DataFrame:
    """At most ``MAX_PER_LANG`` rows of each language, the first by a hash of the id. Rows whose
    hash cannot be among these go before the shuffle."""
    draw = F.xxhash64("id")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # the share of hashes that holds twice the wanted number, or all rows of a small language
    share = F.least(F.lit(1.0), F.lit(2.0 * MAX_PER_LANG + 100) / F.col("n"))
    near = (rows.join(small_side(sizes), "lang")
                .where((draw.cast("double") / 2.0 ** 64 + 0.5) <= share).select("id", "lang", "text"))
    first = Window.partitionBy("lang").orderBy(draw, "id")
    return near.withColumn("at", F.row_number().over(first)).where(F.col("at") <= MAX_PER_LANG).drop("at")


def cluster(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, reach) of the unit vectors of one language by spherical k-means."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < min(CLUSTERS, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start]
    for _ in range(STEPS):
        mine = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[mine == j].sum(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
        c = sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    cos = x @ c.T
    mine = cos.argmax(axis=1)
    reach = [np.quantile(cos[mine == j, j], OUTSIDE) - MARGIN if (mine == j).any() else 1.0 for j in range(len(c))]
    return c.astype(np.float32), np.array(reach)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, reach: np.ndarray):
        self.langs, self.idf, self.centroids, self.reach = langs, idf, centroids, reach

    def predict(self, t: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, accepted) of each text."""
        cos = vectors(t, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)  # centroids are in order of the languages' names
        top = cos[np.arange(t.n), best].astype(float)
        return [self.langs[b] for b in best], np.clip(top, 0.0, 1.0), (cos >= self.reach).any(axis=1)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model, or None if there is nothing to learn from."""
    rows = learned_from(docs, id_col, text_col, lang_col)
    idf = inverse_frequencies(rows)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        x = np.concatenate([vectors(t, idf) for t in lowered(pa.array(rows["text"], pa.large_string()))])
        c, reach = cluster(x)
        return pd.DataFrame({"lang": key[0], "j": np.arange(len(c)), "centroid": [v.tobytes() for v in c], "reach": reach})
    found = sample(rows).groupBy("lang").applyInPandas(fit, "lang string, j int, centroid binary, reach double")
    got = sorted(found.collect(), key=lambda r: (r.lang, r.j))
    if not got:
        return None
    return Model([r.lang for r in got], idf, np.stack([np.frombuffer(r.centroid, np.float32) for r in got]), np.array([r.reach for r in got]))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` (cosine with the nearest centroid) and
    ``accepted`` of every document."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            known = has_letter(batch.column(1)) & (model is not None)
            for t in lowered(batch.column(1)):
                ids, ok = batch.column(0).slice(t.first, t.n), known[t.first:t.first + t.n]
                lang, score, accepted = model.predict(t) if model is not None else ([""] * t.n, np.zeros(t.n), ok)
                held = [x is not None and zlib.crc32(str(x).encode()) % FOLDS == HELD_OUT for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held), pa.array([x if k else UNKNOWN for x, k in zip(lang, ok, strict=True)]),
                     pa.array(np.where(ok, score, 0.0)), pa.array(accepted & ok)], names=[f.split()[0] for f in SCHEMA.split(", ")])
        return fn
    return map_arrow(docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")), make, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
