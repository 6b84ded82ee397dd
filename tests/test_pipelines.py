import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sigweave.jobs import pipelines, training
from sigweave.operators import models

OPTIONS = {"bands": ((4, 8), (8, 12)), "nperseg": 32}


def epochs_of(spark, classes=2, n=60):
    rng = np.random.default_rng(2)
    rows = [(e, e // classes % 4, e % classes, f"c{c}", (rng.standard_normal(64) * (1 + 2 * (e % classes) * (c + 1) / 2) + (e % classes) * 0.6).tolist()) for e in range(n) for c in range(2)]
    return spark.createDataFrame(rows, "epoch_id long, group_id int, label int, channel string, x array<double>")


def predictions(rows):
    return {r["epoch_id"]: r["prediction"] for r in rows.collect()}


@pytest.mark.parametrize("features, model", [(f, m) for f in pipelines.FEATURES for m in pipelines.MODELS if (f, m) not in pipelines.REFUSED])
def test_every_combination_is_fitted_saved_and_loaded(spark, tmp_path, features, model):
    epochs = epochs_of(spark)
    train, test = epochs.filter("group_id <> 1"), epochs.filter("group_id = 1")
    fitted = pipelines.pipeline(features, model, 64, **OPTIONS).fit(train)
    fitted.write().overwrite().save(f"{tmp_path}/p")
    want = predictions(fitted.transform(test))
    assert predictions(PipelineModel.load(f"{tmp_path}/p").transform(test)) == want
    assert predictions(training.fit_predict(train, test, features, model, 64, **OPTIONS)) == want
    assert len(want) == test.select("epoch_id").distinct().count() and sum(want[e] == e % 2 for e in want) > 0.7 * len(want)


def test_three_classes(spark, tmp_path):
    epochs = epochs_of(spark, 3)
    for model in ("logreg", "lsvm", "lda"):
        fitted = pipelines.pipeline("bandpower", model, 64, **OPTIONS).fit(epochs)
        fitted.write().save(f"{tmp_path}/{model}")
        got = predictions(PipelineModel.load(f"{tmp_path}/{model}").transform(epochs))
        assert sum(got[e] == e % 3 for e in got) > 40
    with pytest.raises(ValueError):
        pipelines.pipeline("none", "csp_lda").fit(epochs)
    for bad in (("bandpower", "csp_lda", 64), ("none", "tree", 64), ("bandpower", "lda", None)):
        with pytest.raises(ValueError):
            pipelines.pipeline(*bad)


def newton(x, y, s, c):
    """Squared hinge with a penalised offset, by full Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(200):
        gap = np.maximum(0, 1 - y * (x @ w))
        on = gap > 0
        grad = w - 2 * c * (x.T @ (s * y * gap))
        if np.linalg.norm(grad) < 1e-10:
            break
        w = w - np.linalg.solve(np.eye(len(w)) + 2 * c * (x[on].T * s[on]) @ x[on], grad)
    return w


@pytest.mark.parametrize("classes, newtons", [(2, 512), (3, 512), (2, 0)])
def test_squared_hinge_equals_a_dense_solve(spark, monkeypatch, classes, newtons):
    monkeypatch.setattr(models, "NEWTON", newtons)
    rng = np.random.default_rng(4)
    y = np.array([[0, 0, 1, 2][i % 4] % classes for i in range(120)]) * 10 + 3
    x = rng.standard_normal((120, 5)) + y[:, None] * np.linspace(-0.05, 0.08, 5)
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "label int, features array<double>").repartition(5)
    labels, weights, offsets = models.squared_hinge(rows, c=0.7, tol=1e-8)
    assert labels == sorted(set(y.tolist()))
    s = len(y) / (classes * np.array([(y == k).sum() for k in y]))
    for k, w, b in zip(labels, weights, offsets):
        assert np.allclose(newton(x, np.where(y == k, 1.0, -1.0), s, 0.7), [*w, b], atol=1e-5)


def test_runs_store_their_models(spark, tmp_path):
    epochs = epochs_of(spark)
    out = training.run(epochs, "bandpower", "lda", 64, cv=2, ignore_groups=True, outdir=f"{tmp_path}/run", **OPTIONS)
    assert sorted(r["fold"] for r in out.collect()) == [0, 1]
    folds, _ = training.with_split(epochs, 2, True)
    for k in (0, 1):
        test = epochs.join(folds, "epoch_id").filter(F.col("fold") == k).drop("fold")
        got = PipelineModel.load(f"{tmp_path}/run/model/fold={k}").transform(test)
        share = got.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
        assert share == pytest.approx(out.filter(F.col("fold") == k).first()["accuracy"])
    names = json.loads(spark.read.text(f"{tmp_path}/run/feature_names").first()[0])
    assert names == ["ch0_bp_4-8Hz", "ch0_bp_8-12Hz", "ch1_bp_4-8Hz", "ch1_bp_8-12Hz"]
    config = json.loads(spark.read.text(f"{tmp_path}/run/config").first()[0])
    assert config["n_samples"] == 60 and sum(config["n_test"].values()) == 60
