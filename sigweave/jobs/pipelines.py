"""Feature steps, scaler and classifiers as pyspark.ml stages, and the factory that puts them together.

Every allowed combination of features and model is a ``Pipeline`` that is fitted, saved, loaded and
applied as one; training runs use the same pipelines. A fitted stage writes its arrays as a Parquet table beside its parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators import models

FEATURES, MODELS = ("none", "bandpower"), ("logreg", "lsvm", "csp_lda", "lda")
#: Combinations of features and model that make no sense: spatial patterns take raw epochs only.
REFUSED = {("bandpower", "csp_lda")}


def check(features: str, model: str, fs: float | None) -> None:
    if features not in FEATURES or model not in MODELS or (features, model) in REFUSED:
        raise ValueError(f"no such combination: {features}, {model}")
    if features == "bandpower" and not fs:
        raise ValueError("band power takes a sampling frequency")


class BandPower(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Log band powers of each channel's array; ``edges``: low and high of each band, end to end."""

    fs = Param(Params._dummy(), "fs", "samples a second", TypeConverters.toFloat)
    edges = Param(Params._dummy(), "edges", "low and high of each band", TypeConverters.toListFloat)
    nperseg = Param(Params._dummy(), "nperseg", "samples of a segment", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="x", outputCol="x", fs=300.0, edges=None, nperseg=256):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="x", fs=300.0, edges=[float(v) for b in feats.BANDS for v in b], nperseg=256)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def bands(self) -> tuple[tuple[float, float], ...]:
        e = self.getOrDefault(self.edges)
        return tuple(zip(e[::2], e[1::2]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.nperseg)
        power = feats.log_band_power(self.getOrDefault(self.fs), self.bands(), n, n // 2)
        return dataset.withColumn(self.getOutputCol(), power(self.getInputCol()).cast("array<double>"))


class Flatten(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A row for each epoch, with ``features``: its channels' arrays end to end."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return feats.flattened(dataset)


class Stack(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A row for each epoch, with ``x``: the array of its channels' arrays."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.channels_array(dataset)


class _ArraysWriter(MLWriter):
    """Parameters as usual; arrays as rows of (name, row, values) in Parquet."""

    def __init__(self, instance: Fitted):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        rows = [(k, i, [float(v) for v in row]) for k, x in self.instance.arrays.items() for i, row in enumerate(np.atleast_2d(x))]
        spark.createDataFrame(rows, "name string, row int, values array<double>").coalesce(1).write.parquet(f"{path}/data")


class _ArraysReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        held: dict[str, list] = {}
        for r in self.sparkSession.read.parquet(f"{path}/data").orderBy("name", "row").collect():  # a fitted model's numbers
            held.setdefault(r["name"], []).append(r["values"])
        out = self.kind({k: np.array(v) for k, v in held.items()})
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class Fitted(Model, MLReadable, MLWritable):
    """A fitted stage: named arrays of two dimensions at most."""

    def __init__(self, arrays: dict[str, np.ndarray] | None = None):
        super().__init__()
        self.arrays = {k: np.atleast_2d(np.asarray(v, float)) for k, v in (arrays or {}).items()}

    def write(self) -> MLWriter:
        return _ArraysWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ArraysReader(cls)


class SpatialPatternsModel(Fitted):
    """``features`` in place of x: log mean power of each component."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.CSP.of(self.arrays["filters"]).transform(dataset)


class SpatialPatterns(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Common spatial patterns of two classes, of rows (label, x: the array of channels' arrays)."""

    components = Param(Params._dummy(), "components", "number of components", TypeConverters.toInt)

    @keyword_only
    def __init__(self, components=4):
        super().__init__()
        self._setDefault(components=4)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SpatialPatternsModel:
        return SpatialPatternsModel({"filters": models.CSP(dataset, self.getOrDefault(self.components)).filters})


class StandardizerModel(Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.scaled(dataset, self.arrays["mean"][0].tolist(), self.arrays["std"][0].tolist())


class Standardizer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``features`` less their mean, by their population deviation."""

    def _fit(self, dataset: DataFrame) -> StandardizerModel:
        mean, std = models.scaler(dataset)
        return StandardizerModel({"mean": mean, "std": std})


class LinearModel(Fitted):
    """``prediction`` (int): the label of the highest score, of one row of weights and an offset each."""

    def scores(self):
        return models.class_scores(self.arrays["weights"], self.arrays["offsets"][0])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.best_label(dataset, self.arrays["labels"][0].astype(int).tolist(), self.scores())


class LinearClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A linear model of scaled ``features`` and ``label``: ``logreg`` and ``lsvm`` with balanced class weights, or ``lda``."""

    kind = Param(Params._dummy(), "kind", "logreg, lsvm or lda", TypeConverters.toString)
    c = Param(Params._dummy(), "c", "inverse strength of the penalty", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, kind="logreg", c=1.0, maxIter=500):
        super().__init__()
        self._setDefault(kind="logreg", c=1.0, maxIter=500)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearModel:
        kind, c, n = (self.getOrDefault(p) for p in (self.kind, self.c, self.maxIter))
        if kind == "lda":
            fitted = models.LDA(dataset)
            return LinearModel({"weights": fitted.coef, "offsets": fitted.offset, "labels": fitted.labels})
        labels, weights, offsets = (models.logistic_weights if kind == "logreg" else models.squared_hinge)(dataset, c, n)
        return LinearModel({"weights": weights, "offsets": offsets, "labels": labels})


def pipeline(features: str, model: str, fs: float | None = None, bands=feats.BANDS, nperseg: int = 256, c: float = 1.0, components: int = 4, max_iter: int = 500) -> Pipeline:
    """Features, scaler and classifier of long epochs (epoch_id, group_id, label, channel, x); transformed, one row an epoch with prediction."""
    check(features, model, fs)
    if model == "csp_lda":
        first = [Stack(), SpatialPatterns(components=components)]
    else:
        power = [BandPower(fs=float(fs), edges=[float(v) for b in bands for v in b], nperseg=nperseg)] if features == "bandpower" else []
        first = [*power, Flatten()]
    return Pipeline(stages=[*first, Standardizer(), LinearClassifier(kind=model.removeprefix("csp_"), c=float(c), maxIter=max_iter)])


def names_of(fitted, channels: int) -> list[str] | None:
    """Names of a fitted pipeline's features, where they are band powers."""
    power = next((s for s in fitted.stages if isinstance(s, BandPower)), None)
    return feats.feature_names(channels, power.bands()) if power else None
