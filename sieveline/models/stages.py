"""Preprocessing as Spark ML stages.

Every stage emits one `select`; fitted state is plain JSON and is saved with the stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import config as C
from sieveline.functions.exprs import number_of, replace_columns
from sieveline.operators import screen
from sieveline.operators.harmonize import require_columns
from sieveline.operators.quantiles import exact_quantiles


class _Settings(Params):
    """Columns of a stage and the strictness of its column check."""

    columns = Param(Params._dummy(), "columns", "columns the stage works on", TypeConverters.toListString)
    strict = Param(Params._dummy(), "strict", "fail on absent columns", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(columns=[], strict=True)

    def get(self, name):
        return self.getOrDefault(name)

    def _present(self, df: DataFrame, what: str) -> list[str]:
        columns = self.get("columns")
        if self.get("strict"):
            require_columns(df, columns, what)
        return [c for c in columns if c in df.columns]


class _Stage(_Settings, DefaultParamsReadable, DefaultParamsWritable):
    pass


class ColumnDropper(_Stage, Transformer):
    """Drop columns; absent ones are ignored unless strict."""

    @keyword_only
    def __init__(self, *, columns=None, strict=False):
        super().__init__()
        self._setDefault(strict=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def absent(self, df: DataFrame) -> list[str]:
        return [c for c in self.get("columns") if c not in df.columns]

    def _transform(self, df):
        return df.drop(*self._present(df, "columns to drop"))


class FeatureSelector(_Stage, Transformer):
    """Keep key columns and the requested features in their order."""

    keep = Param(Params._dummy(), "keep", "key and label columns to pass on", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None, keep=None, strict=True):
        super().__init__()
        self._setDefault(keep=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df):
        kept = [c for c in self.get("keep") if c in df.columns]
        features = self._present(df, "required feature columns")
        return df.select(*kept, *[number_of(df, c).alias(c) for c in features])


class PhysicalScreener(_Stage, Transformer):
    """Values outside their physical interval become missing."""

    intervals = Param(Params._dummy(), "intervals", "feature -> [lower, upper]")
    replaceWith = Param(Params._dummy(), "replaceWith", "replacement; unset means missing")

    @keyword_only
    def __init__(self, *, intervals=None, replaceWith=None):
        super().__init__()
        self._setDefault(intervals={k: list(v) for k, v in C.PHYSICAL_INTERVALS.items()}, replaceWith=None)
        if intervals is not None:
            self._set(intervals={k: list(v) for k, v in intervals.items()})
        if replaceWith is not None:
            self._set(replaceWith=float(replaceWith))

    def summary(self, df: DataFrame) -> DataFrame:
        return screen.screen_summary(df, self.get("intervals"))

    def _transform(self, df):
        return screen.screen_physical(df, self.get("intervals"), replace_with=self.get("replaceWith"))


class RightSkewLog(_Stage, Transformer):
    """log1p of values floored at zero."""

    @keyword_only
    def __init__(self, *, columns=None, strict=True):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df):
        return screen.right_log(df, self._present(df, "right-skew columns"))


class _Fitted(_Settings):
    state = Param(Params._dummy(), "state", "fitted values by column")

    def __init__(self):
        super().__init__()
        self._setDefault(state={})


class LeftSkewReflectLogModel(_Fitted, Model, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df):
        columns = self._present(df, "left-skew columns")
        return screen.left_reflect_log(df, columns, reflection_max=self.get("state"))[0]


class LeftSkewReflectLog(_Stage, Estimator):
    """Reflect at the training maximum, then log1p (C8); given maxima are used as they are."""

    reflectionMax = Param(Params._dummy(), "reflectionMax", "feature -> maximum, where given")
    eps = Param(Params._dummy(), "eps", "added to a fitted maximum", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns=None, reflectionMax=None, eps=C.REFLECT_EPS, strict=True):
        super().__init__()
        self._setDefault(reflectionMax=None, eps=C.REFLECT_EPS)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df):
        columns = self._present(df, "left-skew columns")
        state = {k: float(v) for k, v in (self.get("reflectionMax") or {}).items()}
        open_ = [c for c in columns if c not in state]
        state.update(screen.fit_reflection_max(df, open_, eps=self.get("eps")))
        return LeftSkewReflectLogModel()._set(columns=columns, strict=True, state=state)


class IqrClipperModel(_Fitted, Model, DefaultParamsReadable, DefaultParamsWritable):
    """`state` maps a column to [q1, q3, lower, upper], or [lower, upper] where fences were given."""

    @property
    def fences(self) -> dict:
        return screen.fences_only(self.get("state"))

    def summary(self, df: DataFrame) -> DataFrame:
        """Outlier counts on `df`; given fences report zero counts (they were not fitted)."""
        state = self.get("state")
        if all(len(v) == 4 for v in state.values()):
            return screen.iqr_summary(df, {k: tuple(v) for k, v in state.items()})
        rows = [(c, float(v[-2]), float(v[-1]), 0, 0.0) for c, v in state.items()]
        return df.sparkSession.createDataFrame(
            rows, "feature string, lower_fence double, upper_fence double, outlier_n long, outlier_pct double"
        )

    def _transform(self, df):
        return screen.clip_to_fences(df, self.fences)


class IqrClipper(_Stage, Estimator):
    """Clip to IQR fences of the training data."""

    whisker = Param(Params._dummy(), "whisker", "fence distance in IQRs", TypeConverters.toFloat)
    fences = Param(Params._dummy(), "fences", "feature -> [lower, upper], where given")
    mode = Param(Params._dummy(), "mode", "exact or approx quantiles", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, whisker=C.WHISKER, fences=None, mode="exact"):
        super().__init__()
        self._setDefault(whisker=C.WHISKER, fences=None, mode="exact")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df):
        given = self.get("fences")
        if given is not None:
            state = {k: [float(a), float(b)] for k, (a, b) in given.items()}
        else:
            columns = self.get("columns") or None
            fitted = screen.fit_iqr_fences(
                df, columns=columns, whisker=self.get("whisker"), mode=self.get("mode")
            )
            state = {k: list(v) for k, v in fitted.items()}
        return IqrClipperModel()._set(columns=list(state), strict=False, state=state)


class ImputerModel(_Fitted, Model, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df):
        state = self.get("state")
        return replace_columns(
            df, {c: F.coalesce(number_of(df, c), F.lit(state[c]).cast("double")) for c in state if c in df.columns}
        )


class MedianImputer(_Stage, Estimator):
    """Fill missing values with a training statistic (C14).

    Strategies: median (interpolated), mean, most_frequent (smallest on ties), constant.
    """

    strategy = Param(Params._dummy(), "strategy", "fill statistic", TypeConverters.toString)
    fillValue = Param(Params._dummy(), "fillValue", "value for constant", TypeConverters.toFloat)
    mode = Param(Params._dummy(), "mode", "exact or approx quantiles", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, strategy="median", fillValue=0.0, mode="exact", strict=True):
        super().__init__()
        self._setDefault(strategy="median", fillValue=0.0, mode="exact")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df):
        columns = self._present(df, "columns to impute")
        kind = self.get("strategy")
        if kind == "constant":
            state = {c: self.get("fillValue") for c in columns}
        elif kind == "mean":
            row = df.agg(*[F.avg(number_of(df, c)).alias(c) for c in columns]).first()
            state = row.asDict()
        elif kind == "most_frequent":
            from sieveline.operators.profile import unpivot

            freq = unpivot(df, columns).where(F.col("value").isNotNull()).groupBy("feature", "value").count()
            top = freq.groupBy("feature").agg(
                F.max_by("value", F.struct(F.col("count"), -F.col("value"))).alias("v")
            )
            state = {r["feature"]: r["v"] for r in top.collect()}
        elif kind == "median":
            found = exact_quantiles(df, columns, (0.5,), mode=self.get("mode"))
            state = {c: None if q is None else q[0] for c, q in found.items()}
        else:
            raise ValueError(f"unknown imputation strategy {kind!r}")
        empty = [c for c in columns if state.get(c) is None]
        if empty:
            raise ValueError(f"no value to impute from in: {', '.join(empty)}")
        return ImputerModel()._set(columns=columns, state=state)


class StandardizerModel(_Fitted, Model, DefaultParamsReadable, DefaultParamsWritable):
    """`state` maps a column to [mean, scale]."""

    def _transform(self, df):
        state = self.get("state")
        return replace_columns(
            df,
            {c: (number_of(df, c) - F.lit(m)) / F.lit(s) for c, (m, s) in state.items() if c in df.columns},
        )


class Standardizer(_Stage, Estimator):
    """(x - mean) / population standard deviation; a constant column is only centred."""

    @keyword_only
    def __init__(self, *, columns=None, strict=True):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df):
        columns = self._present(df, "columns to scale")
        aggs = [f(number_of(df, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = df.agg(*aggs).first()
        state = {
            c: [float(row[f"m{i}"]), float(row[f"s{i}"]) or 1.0] for i, c in enumerate(columns)
        }
        return StandardizerModel()._set(columns=columns, state=state)


def preprocessing_stages(
    spec: C.FeatureSpec | None = None, *, keep: Iterable[str] = (), vector: str | None = "features", mode: str = "exact"
) -> list:
    """select, physical screen, right log, left log, IQR clip, impute, scale."""
    spec = spec or C.FeatureSpec()
    features = list(spec.features)
    stages = [
        FeatureSelector(columns=features, keep=list(keep)),
        PhysicalScreener(intervals=spec.intervals),
        RightSkewLog(columns=list(spec.right_skewed)),
        LeftSkewReflectLog(columns=list(spec.left_skewed), reflectionMax=spec.reflection_max, eps=spec.eps),
        IqrClipper(columns=features, whisker=spec.whisker, fences=spec.fences, mode=mode),
        MedianImputer(columns=features, strategy=spec.imputation, mode=mode),
    ]
    if spec.scale:
        stages.append(Standardizer(columns=features))
    if vector:
        stages.append(VectorAssembler(inputCols=features, outputCol=vector, handleInvalid="error"))
    return stages


def preprocessing_pipeline(spec: C.FeatureSpec | None = None, **kw) -> Pipeline:
    return Pipeline(stages=preprocessing_stages(spec, **kw))


def exploratory_pipeline(
    *, drop=C.DROP_CONSTANT, intervals: Mapping | None = None, right_skewed=C.RIGHT_SKEWED_EXPLORATORY,
    left_skewed=C.LEFT_SKEWED, reflection_max: Mapping | None = None, columns=None,
) -> Pipeline:
    """drop constants, screen, logs with a fixed reflection maximum, clip (C17)."""
    if reflection_max is None:
        reflection_max = {"inclination_deg": 90.0 + C.REFLECT_EPS}
    return Pipeline(
        stages=[
            ColumnDropper(columns=list(drop)),
            PhysicalScreener(intervals=intervals),
            RightSkewLog(columns=list(right_skewed)),
            LeftSkewReflectLog(columns=list(left_skewed), reflectionMax=dict(reflection_max)),
            IqrClipper(columns=columns),
        ]
    )


def fit_preprocessing(
    df: DataFrame, spec: C.FeatureSpec | None = None, *, keep: Iterable[str] = (), vector: str | None = "features",
    mode: str = "exact",
) -> PipelineModel:
    """Same fitted model as `preprocessing_pipeline(...).fit`, with fewer scans.

    Clipping moves no value between the quartiles, so fences and medians come from one
    quantile pass over the transformed columns.
    """
    spec = spec or C.FeatureSpec()
    if spec.imputation != "median" or spec.fences is not None or spec.whisker < 0:
        return preprocessing_pipeline(spec, keep=keep, vector=vector, mode=mode).fit(df)
    features = list(spec.features)
    stages = preprocessing_stages(spec, keep=keep, vector=vector, mode=mode)
    fixed, left = stages[:3], stages[3]
    at = df
    for stage in fixed:
        at = stage.transform(at)
    left = left.fit(at)
    at = left.transform(at)
    found = exact_quantiles(at, features, (0.25, 0.5, 0.75), mode=mode)
    state, medians = {}, {}
    for c, q in found.items():
        if q is None:
            raise ValueError(f"no value to impute from in: {c}")
        reach = spec.whisker * (q[2] - q[0])
        state[c] = [q[0], q[2], q[0] - reach, q[2] + reach]
        medians[c] = q[1]
    clipper = IqrClipperModel()._set(columns=features, strict=False, state=state)
    imputer = ImputerModel()._set(columns=features, state=medians)
    fitted = [*fixed, left, clipper, imputer]
    if spec.scale:
        fitted.append(Standardizer(columns=features).fit(imputer.transform(clipper.transform(at))))
    if vector:
        fitted.append(stages[-1])
    return PipelineModel(stages=fitted)
