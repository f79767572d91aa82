"""k-nearest-neighbour classifier (M3): over the exact neighbour join, or over a probing index whose
probes are calibrated to a share of the true neighbours."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sieveline.operators import neighbors, probing
from sieveline.session import scratch_path


class _KnnParams(Params):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row key", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "exact or approximate", TypeConverters.toString)
    recall = Param(Params._dummy(), "recall", "share of true neighbours to meet in approximate mode", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(
            k=5, weights="uniform", idCol="row_id", featuresCol="features", labelCol="label", mode="exact", recall=0.95
        )

    def search(self):
        """The module that builds and searches the index of this mode."""
        modes = {"exact": neighbors, "approximate": probing}
        if self.getOrDefault("mode") not in modes:
            raise ValueError(f"mode must be exact or approximate, got {self.getOrDefault('mode')!r}")
        return modes[self.getOrDefault("mode")]


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path):
        super().saveImpl(path)
        self.instance.index().save(f"{path}/index")


class _Reader(DefaultParamsReader):
    def load(self, path):
        return super().load(path)._set(indexPath=f"{path}/index")


class KnnModel(Model, _KnnParams, MLReadable, MLWritable):
    """Holds the path of its index; saving copies the index next to the model."""

    indexPath = Param(Params._dummy(), "indexPath", "index over the training rows", TypeConverters.toString)

    def index(self) -> neighbors.Index | probing.ProbeIndex:
        kind = neighbors.Index if self.getOrDefault("mode") == "exact" else probing.ProbeIndex
        return kind.load(SparkSession.getActiveSession(), self.getOrDefault("indexPath"))

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def _transform(self, df):
        get = self.getOrDefault
        key = get("idCol")
        asked = df.select(F.col(key), vector_to_array(get("featuresCol")).alias("v"))
        found = self.search().search(asked, self.index(), k=get("k"), query_id=key, vector="v")
        p = neighbors.vote(found, query_id=key, label="y", weights=get("weights"), out="__p")
        s = F.col("__p")
        return (
            df.join(p, key)
            .withColumn("probability", array_to_vector(F.array(1.0 - s, s)))
            .withColumn("prediction", F.when(s > 0.5, 1.0).otherwise(0.0))
            .drop("__p")
        )


class KnnClassifier(Estimator, _KnnParams):
    """Fitting builds the index over the training rows once, in the shared folder."""

    @keyword_only
    def __init__(
        self, *, k=5, weights="uniform", idCol="row_id", featuresCol="features", labelCol="label", mode="exact", recall=0.95
    ):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df):
        get = self.getOrDefault
        path = scratch_path(df.sparkSession, "knn-index")
        rows = df.select(
            F.col(get("idCol")).alias("t_key"),
            vector_to_array(get("featuresCol")).alias("v"),
            F.col(get("labelCol")).cast("int").alias("y"),
        )
        more = {"recall": get("recall")} if get("mode") == "approximate" else {}
        index = self.search().build_index(rows, want=get("k"), train_id="t_key", vector="v", payload=["y"], **more)
        index.save(path)
        copied = {n: get(n) for n in ("k", "weights", "idCol", "featuresCol", "labelCol", "mode", "recall")}
        return KnnModel()._set(indexPath=path, **copied)
