"""Mixing sources to target weights by Poisson replication.

Every source has a target repetition rate: how often each of its documents should occur
on average so that the mixture has the wanted size and shares. The count of a document is
the Poisson quantile of a uniform number hashed from a seed and its id, so it depends on
nothing else: the same on every run, executor and retry, with no state to share. Each
document is exploded by its count and the copies are dealt out and sorted by a hash of
(seed, id, copy), which is a global shuffle in one exchange. DataFrame functions only.

Rates above ``CHUNK`` are split into equal parts with a draw each (a sum of independent
Poisson variables is Poisson), so the table of quantiles per source has bounded length.

Edge cases: a null source is a source of its own; a null id hashes as the empty string;
repeated rows draw the same count; an empty table gives an empty mixture; the added
columns ``copy`` and ``shuffle_key`` get a trailing underscore if the input has such a
name; all columns of the input are kept, whatever their names; texts are carried whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import col, free_name
from quarry.plans.broadcast import small_side
from quarry.session import materialize

CHUNK = 32.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, from an MD5 hash of the parts."""
    h = F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str, alpha: float, factor: float,
          weights: DataFrame | None) -> DataFrame:
    """(source, rate): mean repetitions per document. ``weights`` (source, weight) gives
    the target shares (a source without one is left out); without it the share of a
    source is its document count to the power ``alpha``. The mixture has ``factor`` times
    as many documents as the input."""
    n = materialize(docs.groupBy(col(source_col).alias("source")).count(), "source-counts")
    if weights is None:
        n = n.withColumn("weight", F.pow("count", F.lit(float(alpha))))
    else:
        w = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double"))
        n = n.join(w, n["source"].eqNullSafe(w["w_source"])).drop("w_source")
    whole = n.agg(F.sum("count").alias("n"), F.sum("weight").alias("w")).first()
    if not whole["n"] or not whole["w"]:
        return n.select("source", F.lit(0.0).alias("rate"))
    return n.select("source", (F.lit(float(factor)) * F.lit(float(whole["n"])) * F.col("weight")
                               / F.lit(float(whole["w"])) / F.col("count")).alias("rate"))


def quantiles(rate: DataFrame) -> DataFrame:
    """(source, rate, parts, cdf): ``parts`` draws with mean rate/parts each, and the
    distribution function of one of them up to a tail below 2**-52."""
    r = rate.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int"))
    r = r.withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 20).cast("int")
    first = F.exp(-F.col("mean"))
    steps = F.aggregate(
        F.sequence(F.lit(1), last), F.struct(first.alias("p"), F.array(first).alias("c")),
        lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"),
                              F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * F.col("mean") / k)).alias("c")))
    return r.select("source", "rate", "parts", steps["c"].alias("cdf"))


def mix(docs: DataFrame, seed: int = 7, alpha: float = 0.5, factor: float = 1.0,
        weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` replicated to the target weights and shuffled: its columns, ``copy``
    (0, 1, ...) and ``shuffle_key`` (the order of the mixture)."""
    table = materialize(quantiles(rates(docs, source_col, alpha, factor, weights)), "mixing-rates")
    row = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"))
    key = F.col("doc").getField(source_col)
    id_ = F.coalesce(F.col("doc").getField(id_col).cast("string"), F.lit(""))
    # one row per source: broadcast when counted and small, else a shuffle join
    joined = row.join(small_side(table, "mixing rates"), key.eqNullSafe(F.col("source")))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(str(seed)), id_, j.cast("string")))))
    copies = (joined.withColumn("n", drawn).where("n > 0")
                    .select("doc", id_.alias("id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")))
    keyed = copies.select("doc", "copy", F.md5(F.encode(F.concat_ws(":", F.lit(f"{seed}:order"), "id", F.col("copy").cast("string")),
                                                        "UTF-8")).alias("shuffle_key"))
    keyed = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    a = free_name(docs.columns, "copy")
    b = free_name([*docs.columns, a], "shuffle_key")
    return keyed.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns],
                        F.col("copy").alias(a), F.col("shuffle_key").alias(b))


#: The mixture the registered query makes: square-root weights, the size of the input.
SEED, ALPHA, FACTOR = 7, 0.5, 1.0

ORACLE = f"""
  WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*), {ALPHA}) AS w FROM documents GROUP BY 1),
  r AS (SELECT source, {FACTOR}::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE * w / (SELECT sum(w) FROM n) / n AS rate FROM n),
  m AS (SELECT source, greatest(1, ceil(rate / {CHUNK}))::INT AS parts, rate / greatest(1, ceil(rate / {CHUNK}))::INT AS mean FROM r),
  p AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM m
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM p
    WHERE k < ceil(mean + 12 * sqrt(mean) + 20)
  ),
  q AS (SELECT m.source, any_value(m.parts) AS parts, list(p.c ORDER BY p.k) AS cdf
        FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source GROUP BY m.source),
  u AS (
    SELECT d.doc_id, q.source, cdf, unnest(range(parts)) AS j,
           ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT::DOUBLE / {1 << 52}.0 AS u
    FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  ),
  c AS (SELECT doc_id, sum(len(list_filter(cdf, lambda x: x <= u)))::BIGINT AS n FROM u GROUP BY 1),
  e AS (SELECT doc_id, unnest(range(n)) AS copy FROM c)
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, e.copy::INT AS copy,
         md5('{SEED}:order:' || d.doc_id || ':' || e.copy) AS shuffle_key
  FROM e JOIN documents d USING (doc_id)
"""


def query(docs: DataFrame) -> DataFrame:
    return mix(docs, SEED, ALPHA, FACTOR)
