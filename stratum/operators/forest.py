"""Random forest of histogram trees as a pipeline stage (two classes).

Features are binned by quantiles (32 bins, as Spark ML's forest has), rows that share
all bins and the class are counted as one cell, and all trees grow side by side on the
cells (``operators.trees``): Gini impurity, a Poisson bootstrap of the rows and sqrt(d)
features per node.  A missing value counts as the largest, as in Spark ML's forest.  The trees
come to the driver as arrays (16 bytes and the two class weights per node) and go out
again to score rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stratum.operators import trees as T

BINS = 32


def codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) bins; NaN is in the last one."""
    return np.column_stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)]).astype(np.int64).reshape(len(x), len(edges))


class ForestClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasSeed):
    """features, label 0/1 -> rawPrediction, probability, prediction."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most splits on a way from the root", typeConverter=TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", numTrees=200, maxDepth=30, minInstancesPerNode=1, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", numTrees=200, maxDepth=30, minInstancesPerNode=1, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        get = self.getOrDefault
        rows = dataset.select(vector_to_array(get(self.featuresCol)).alias("_x"), F.col(get(self.labelCol)).cast("double").alias("_y")).persist()
        n, d, bad = rows.agg(F.count(F.lit(1)), F.max(F.size("_x")), F.sum((~F.coalesce(F.col("_y").isin(0.0, 1.0), F.lit(False))).cast("long"))).first()
        if bad:
            raise ValueError(f"{bad} of {n} labels are not 0 or 1")
        d = d or 0
        feats = [f"x{i}" for i in range(d)]
        rows = rows.select(F.col("_y").cast("int").alias("_y"), *[F.col("_x")[i].alias(f) for i, f in enumerate(feats)])
        edges = T.bin_edges(rows, feats, BINS)
        last = {f: float(e[-1]) if len(e) else 0.0 for f, e in zip(feats, edges)}
        # a value above all edges, whatever it is, stands for a missing one
        filled = rows.select(F.lit(0).alias("_id"), "_y", *[F.when(F.isnan(f) | F.col(f).isNull(), F.lit(np.nextafter(last[f], np.inf))).otherwise(F.col(f)).alias(f) for f in feats])
        cells = T.laid_out(T.cell_rows(T.bin_rows(filled, feats, edges, "_id", ["_y"])))
        grown = T.grow_forests(cells, d, ["forest"], get(self.numTrees), get(self.maxDepth), get(self.minInstancesPerNode), bins=BINS, seed=get(self.seed))
        cells.unpersist()
        rows.unpersist()
        return ForestModel(get(self.featuresCol), edges, get(self.numTrees), grown.feature, grown.bin, grown.left, grown.stats)


class ForestModel(Model, MLWritable, MLReadable):
    """A tree's root is the node of its number; a split's right child follows the left one."""

    ARRAYS = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "stats": np.float64}

    def __init__(self, features="features", edges=(), n_trees=0, feature=None, bin=None, left=None, stats=None):  # noqa: A002
        super().__init__()
        self.features, self.edges, self.n_trees = features, [np.asarray(e, np.float64) for e in edges], n_trees
        self.feature, self.bin, self.left, self.stats = feature, bin, left, stats

    @property
    def totalNumNodes(self) -> int:
        return len(self.feature)

    @property
    def featureImportances(self) -> DenseVector:
        """Per feature the decrease of impurity by its splits, in shares of a tree, averaged over trees."""
        d, inner = len(self.edges), np.flatnonzero(self.feature >= 0)
        owner = np.arange(len(self.feature))
        owner[self.n_trees:] = -1
        for at in T.levels(self.feature, self.left, self.n_trees):
            owner[self.left[at]] = owner[self.left[at] + 1] = owner[at]
        gain = T.gini_gain(self.stats[self.left[inner]], self.stats[inner])
        per = np.bincount(owner[inner] * d + self.feature[inner], weights=gain, minlength=self.n_trees * d).reshape(self.n_trees, d)
        total = per.sum(axis=1, keepdims=True)
        mean = np.divide(per, total, out=np.zeros_like(per), where=total > 0).sum(axis=0)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ways = T.Trees(self.feature, self.bin, np.zeros(len(self.feature), bool), self.left, *[np.empty(0)] * 3)
        shared = dataset.sparkSession.sparkContext.broadcast((ways, T.class_share(self.stats), self.edges, self.n_trees))

        @pandas_udf("double")
        def score(x):
            t, leaf, edges, n = shared.value
            code = codes(np.stack(x.to_numpy()).astype(np.float64).reshape(len(x), -1), edges) if len(x) else np.empty((0, len(edges)), np.int64)
            p = x.map(len).astype(float) * 0
            for a in range(0, len(code), step := max(1, T._CELLS // max(1, n))):
                p.iloc[a:a + step] = leaf[t.route(code[a:a + step], np.arange(n), BINS)].mean(axis=1)
            return p

        p = F.col("_p")
        return (dataset.withColumn("_p", score(vector_to_array(self.features)))
                .withColumn("rawPrediction", array_to_vector(F.array((F.lit(1.0) - p) * self.n_trees, p * self.n_trees)))
                .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("_p"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={
            "features": m.features, "n_trees": m.n_trees, "edges": [e.tolist() for e in m.edges]})
        size = 1 << 20  # nodes a row
        parts = [(k // size, *[getattr(m, n)[k:k + size].astype(t).tobytes() for n, t in m.ARRAYS.items()]) for k in range(0, len(m.feature), size)]
        table = pa.table({"part": pa.array([p[0] for p in parts], pa.int64()),
                          **{n: pa.array([p[i] for p in parts], pa.binary()) for i, n in enumerate(m.ARRAYS, 1)}})
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/nodes").toArrow().sort_by("part")
        arrays = {n: np.concatenate([np.frombuffer(v, t) for v in rows[n].to_pylist()]) for n, t in ForestModel.ARRAYS.items()}
        arrays["stats"] = arrays["stats"].reshape(-1, 2)
        out = ForestModel(meta["features"], meta["edges"], meta["n_trees"], **arrays)
        out._resetUid(meta["uid"])
        return out
