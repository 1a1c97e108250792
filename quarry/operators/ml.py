"""MLlib jobs: feature scaling, k-means, linear and logistic regression.
MLlib fits by distributed tree-aggregation of per-partition statistics; nothing is
gathered to the driver except the fitted model's coefficients."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def feature_scale(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Standardise ``cols`` (mean 0, sample std 1) -> ``z_<col>`` columns."""
    va = VectorAssembler(inputCols=cols, outputCol="_f")
    sc = StandardScaler(inputCol="_f", outputCol="_z", withMean=True, withStd=True)
    model = Pipeline(stages=[va, sc]).fit(df)
    out = model.transform(df).withColumn("_za", vector_to_array("_z"))
    return out.select(*keys, *[F.col("_za")[i].alias("z_" + c) for i, c in enumerate(cols)])


def kmeans(df: DataFrame, key: str, array_col: str, k: int = 8, seed: int = 42) -> DataFrame:
    """``key, cluster, nearest``: the cluster of each vector, and whether no centre is
    nearer than its own (up to rounding)."""
    v = df.select(key, array_to_vector(array_col).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]   # k vectors
    at = vector_to_array("features")

    def distance(c):
        return F.aggregate(F.zip_with(at, F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda s, x: s + x)
    d = F.array(*[distance(c) for c in centres])
    own = F.element_at(d, F.col("cluster") + 1)
    return model.transform(v).select(key, "cluster", (own <= F.array_min(d) * (1 + 1e-9) + 1e-12).alias("nearest"))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ordinary least squares ``y = slope * x + intercept`` (normal equations: one
    aggregation pass) -> one row ``slope, intercept, r2``."""
    v = VectorAssembler(inputCols=[x], outputCol="features").transform(df.select(x, y))
    m = LinearRegression(featuresCol="features", labelCol=y, solver="normal",
                         regParam=0.0, standardization=False).fit(v)
    spark = df.sparkSession
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept),
                                   float(m.summary.r2))], "slope double, intercept double, r2 double")


def logistic_quality(docs: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """Document quality from length features: assemble -> scale -> logistic regression,
    fitted on the labelled documents and scored on all. ``auc`` is that of a fifth of the
    labelled documents, chosen by a hash of the id, which the fit does not see (null if it
    has labels of one kind only)."""
    feats = docs.select(
        "doc_id",
        F.log1p(F.coalesce(F.col("n_chars"), F.lit(0)).cast("double")).alias("log_chars"),
        F.log1p(F.size(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f]+")).cast("double")).alias("log_words"),
        (F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("double")).alias("lines"))
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("label"))
    data = feats.join(known, "doc_id", "left").withColumn(
        "held_out", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0)
    # the fit makes several passes (scaler, each optimiser iteration, scoring): write the
    # small feature table (four numbers per document) once into the shared folder instead
    # of re-splitting every text per pass; this also cuts lineage
    data = materialize(data, "logistic-features")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=["log_chars", "log_words", "lines"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=50)])
    model = pipe.fit(data.where("label IS NOT NULL AND NOT held_out"))
    pred = model.transform(data)
    test = pred.where("label IS NOT NULL AND held_out")
    kinds = test.select("label").distinct().count()
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(test) if kinds > 1 else None
    return pred.select("doc_id", "label", F.col("prediction"), vector_to_array("probability")[1].alias("p_good"),
                       F.lit(auc).cast("double").alias("auc"))
