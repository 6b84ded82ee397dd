"""Training runs and comparisons: load, split, fit, predict, measure, store."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators import labels, metrics, split
from ..sources import io
from . import pipelines
from .pipelines import FEATURES, REFUSED

def feature_rows(epochs: DataFrame, features: str, fs: float, bands=feats.BANDS, nperseg: int = 256) -> DataFrame:
    """One row per epoch: epoch_id, group_id, label, features."""
    if features == "bandpower":
        power = feats.log_band_power(fs, bands, nperseg, nperseg // 2)
        epochs = epochs.withColumn("x", power("x").cast("array<double>"))
    return feats.flattened(epochs)


def fit_predict(train: DataFrame, test: DataFrame, features: str, model: str, fs: float, **options) -> DataFrame:
    """Predictions (epoch_id, label, prediction) for the test epochs of a pipeline fitted to the training epochs."""
    return pipelines.pipeline(features, model, fs, **options).fit(train).transform(test).select("epoch_id", "label", "prediction")


def with_split(epochs: DataFrame, cv: int = 0, ignore_groups: bool = False, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, int]:
    """Ids with ``fold`` (1 for test in the only fold 0, else the number of the fold that tests the row): groups first, then k folds, then a hold-out."""
    ids = epochs.select("epoch_id", "group_id", "label").distinct()
    if not ignore_groups and ids.select("group_id").distinct().count() >= 2:
        return split.group_split(ids, "group_id", test_size, seed).select("epoch_id", (F.col("is_test").cast("int") - 1).alias("fold")), 1
    if cv >= 2:
        return split.stratified_folds(ids, "label", "epoch_id", cv, seed).select("epoch_id", "fold"), cv
    return split.stratified_split(ids, "label", "epoch_id", test_size, seed).select("epoch_id", (F.col("is_test").cast("int") - 1).alias("fold")), 1


def prepared(epochs: DataFrame, features: str, model: str, fs: float, **options) -> tuple[list, list, DataFrame]:
    """Stages that learn nothing, the others, and the rows of ``epochs`` (one each) behind the former."""
    stages = pipelines.pipeline(features, model, fs, **options).getStages()
    n = next(i for i, s in enumerate(stages) if isinstance(s, Estimator))
    for stage in stages[:n]:
        epochs = stage.transform(epochs)
    return stages[:n], stages[n:], epochs


def run(epochs: DataFrame, features: str, model: str, fs: float, cv: int = 0, ignore_groups: bool = False, outdir: str | None = None, seed: int = 42, rows: DataFrame | None = None, **options) -> DataFrame:
    """Metrics of each fold; with ``outdir``, also written as JSON with the run's settings, the names of its
    features, and each fold's fitted pipeline (``model/fold=k``; read with ``PipelineModel.load``). ``rows``: what
    ``prepared`` gives for the epochs, where runs share it."""
    first, rest, made = prepared(epochs, features, model, fs, **options)
    folds, n = with_split(made if rows is None else rows, cv, ignore_groups, seed=seed)
    dealt, out = (made if rows is None else rows).join(folds, "epoch_id").cache(), None
    try:
        for k in range(n):
            train, test = dealt.filter(F.col("fold") != k).drop("fold"), dealt.filter(F.col("fold") == k).drop("fold")
            if train.isEmpty() or test.isEmpty():
                raise ValueError("an empty side of the split")
            fitted = Pipeline(stages=rest).fit(train)
            if outdir:
                PipelineModel([*first, *fitted.stages]).write().overwrite().save(f"{outdir}/model/fold={k}")
            row = metrics.scores(fitted.transform(test).select("epoch_id", "label", "prediction")).withColumn("fold", F.lit(k))
            out = row if out is None else out.unionByName(row)
        spark = epochs.sparkSession
        out = spark.createDataFrame(out.collect(), out.schema)  # a row a fold
        if outdir:
            out.write.mode("overwrite").json(f"{outdir}/metrics")
            held = {r["fold"]: r["count"] for r in dealt.groupBy("fold").count().collect()}
            whole = sum(held.values())
            tests = {k: held.get(k, 0) for k in range(n)}
            config = {"features": features, "model": model, "fs": fs, "cv": cv, "seed": seed, "n_samples": whole, "n_test": tests, "n_train": {k: whole - v for k, v in tests.items()}, **options}
            names = pipelines.names_of(PipelineModel(first), epochs.select("channel").distinct().count())
            for name, value in (("config", config), *((("feature_names", names),) if names else ())):
                spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{outdir}/{name}")
        return out
    finally:
        dealt.unpersist()


#: Models of the comparison grid.
COMPARED = ("logreg", "lsvm", "csp_lda")


def compare(epochs: DataFrame, modes: DataFrame, fs: float, cv: int = 0, ignore_groups: bool = False, outdir: str | None = None, compared: tuple[str, ...] = COMPARED, parallelism: int = 4, **options) -> DataFrame:
    """All label modes x configurations: mode, model, features, status and mean metrics; a run that fails keeps a row with nulls.
    Runs of one mode share their feature rows and go side by side. With ``outdir``, each mode's rows are also written as CSV."""
    spark: SparkSession = epochs.sparkSession
    relabelled = labels.simplify_labels(epochs, modes).drop("name").cache()

    def one(mode: str, mine: DataFrame, model: str, features: str, rows: DataFrame) -> tuple:
        try:
            m = run(mine, features, model, fs, cv, ignore_groups, rows=rows, **options).agg(F.avg("accuracy"), F.avg("balanced_accuracy"), F.avg("f1_macro")).first()
            return (mode, model, features, "ok", *m)
        except Exception as e:  # a failed run, whatever its cause, keeps a row and doesn't end the others
            print(f"{mode}, {model}, {features}: {e}")
            return (mode, model, features, "failed", None, None, None)

    tasks, shared = [], []
    for mode in [r[0] for r in modes.select("mode").distinct().orderBy("mode").collect()]:
        mine = relabelled.filter(F.col("mode") == mode).drop("mode")
        made: dict[tuple[str, bool], DataFrame] = {}
        for model in compared:
            for features in FEATURES:
                if (features, model) in REFUSED:
                    continue
                key = (features, model == "csp_lda")
                if key not in made:
                    made[key] = prepared(mine, features, model, fs, **options)[2].cache()
                tasks.append((mode, mine, model, features, made[key]))
        shared += made.values()
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(lambda t: one(*t), tasks))
    for df in (relabelled, *shared):
        df.unpersist()
    out = spark.createDataFrame(found, "mode string, model string, features string, status string, accuracy double, balanced_accuracy double, f1_macro double")
    if outdir:
        io.write_summaries(out, outdir)
    return out
