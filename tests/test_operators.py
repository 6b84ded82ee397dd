import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import align, clean, erp, features, labels, metrics, models, split, windows
from sigweave.sources import io


def samples(spark, values, rec=1):
    return spark.createDataFrame([(rec, i, float(i), float(v)) for i, v in enumerate(values)], "recording_id long, sample_idx long, t double, value double")


def test_align_ties_and_ends(spark):
    s = samples(spark, range(5))
    m = spark.createDataFrame([(1, 0, -1.0, 1), (1, 1, 2.0, 1), (1, 2, 2.5, 1), (1, 3, 99.0, 1), (2, 4, 1.0, 1)], "recording_id long, marker_id long, t double, code int")
    got = {r["marker_id"]: r["sample_idx"] for r in align.align_markers(m, s, 2.0).collect()}
    assert got == {0: 0, 1: 2, 2: 3, 3: 5, 4: 0}


def test_sample_index_is_the_same_for_any_bucket(spark):
    s = samples(spark, range(20)).drop("sample_idx")
    for bucket in (1.0, 3.0, 1000.0):
        assert all(r["sample_idx"] == r["t"] for r in align.sample_index(s, bucket).collect())


def test_epochs_at_edges_and_double_markers(spark):
    s = samples(spark, range(10))
    e = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 1, 2), (1, 2, 2, 2), (1, 3, 1, 9)], "recording_id long, marker_id long, label int, sample_idx long")
    got = align.baseline(align.epochs(e, s, -1, 1)).collect()
    assert {r["epoch_id"] for r in got} == {1}
    assert sorted(r["value"] for r in got) == [-0.5, 0.5, 1.5]


def test_trigger_codes(spark):
    codes = [9701, 8888, 9999, 31007, 32108, 30011, 30014, 30009, 20001]
    df = spark.createDataFrame([(c,) for c in codes], "code int")
    assert [r[0] for r in df.select(labels.decode_trigger(F.col("code"))).collect()] == [-1, -1, -1, 1, 2, 3, 4, -1, -1]


def test_frames(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([0, 130, 5, 200, 201, 7, 129])], "buffer long, pos long, byte int")
    assert sorted(r["frame"] for r in windows.decode_frames(df).collect()) == [261, 9417]


@pytest.mark.parametrize("n,expected", [(7, 0), (8, 1), (12, 2)])
def test_windows(spark, n, expected):
    rows = samples(spark, range(n)).withColumn("label", F.when(F.col("sample_idx") < 3, "a").otherwise("b"))
    for out in (windows.sliding_windows(rows, 8, 4, ("value",)), windows.pane_features(rows, 8, 4, ("value",))):
        got = out.orderBy("window_id").collect()
        assert len(got) == expected
        assert [r["label"] for r in got] == ["a", "b"][:expected]


def test_pane_features_equal_array_features(spark):
    x = np.random.default_rng(1).standard_normal(40)
    rows = samples(spark, x).withColumn("label", F.lit("a"))
    pane = {r["window_id"]: r for r in windows.pane_features(rows, 16, 4, ("value",)).collect()}
    arrays = features.extract(windows.sliding_windows(rows, 16, 4, ("value",)), ["mav", "std", "var", "maxav", "rms"], ["value"]).collect()
    for r in arrays:
        own = x[4 * r["window_id"] :][:16]
        assert r["value_std"] == pytest.approx(own.std()) and pane[r["window_id"]]["std"] == pytest.approx(own.std())
        assert pane[r["window_id"]]["rms"] == pytest.approx(r["value_rms"]) and r["value_mav"] == pytest.approx(np.abs(own).mean())


def test_feature_rules(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, -1.0, 2.0],), ([1.0, 2.0, 4.0, 8.0, 16.0],), ([1.0, 0.0, 3.0, 1.0, 1.0],)], "x array<double>")
    got = features.extract(df, ["wl", "ssc", "zc", "log_det", "wamp"], ["x"]).collect()
    assert got[0]["x_zc"] == 4 and got[0]["x_wl"] == 6 and got[0]["x_ssc"] == 2 and np.isnan(got[0]["x_log_det"])
    assert got[1]["x_log_det"] == pytest.approx(4) and got[2]["x_log_det"] == 0
    x = np.array([1.0, 2, 4, 8, 16])
    assert got[1]["x_wamp"] == (x > 0.2 * x.std()).sum()


def test_user_callable(spark):
    df = spark.createDataFrame([([1.0, 5.0],)], "x array<double>")
    assert features.extract(df, [np.ptp], ["x"]).first()["x_ptp"] == 4


def test_hampel_spike_and_edges(spark):
    x = [float(i % 3) for i in range(30)]
    x[0], x[15] = 50.0, 100.0
    got = [r["cleaned"] for r in clean.hampel(samples(spark, x).drop("t")).orderBy("sample_idx").collect()]
    assert got[15] != 100 and got[0] == 50
    assert got[:6] == x[:6] and got[-6:] == x[-6:]


def test_fir_chunks_equal_whole(spark):
    x = np.random.default_rng(2).standard_normal(500)
    rows = samples(spark, x).withColumn("channel", F.lit("c"))
    taps = np.hamming(31) / np.hamming(31).sum()
    whole = [r["value"] for r in clean.fir_filter(rows, taps, 10_000).orderBy("sample_idx").collect()]
    cut = [r["value"] for r in clean.fir_filter(rows, taps, 64).orderBy("sample_idx").collect()]
    assert len(whole) == 500 and np.allclose(whole, cut)
    assert np.allclose(whole[15:-15], np.convolve(x, taps, "same")[15:-15])


def test_macro_scores_count_predicted_only_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 2), (1, 1)], "label int, prediction int")
    r = metrics.scores(df).first()
    assert r["accuracy"] == 0.75 and r["balanced_accuracy"] == 0.75 and r["f1_macro"] == pytest.approx((1 + 2 / 3 + 0) / 3)
    assert metrics.confusion(df).count() == 9


def test_group_split(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, g int")
    got = split.group_split(rows, "g").groupBy("g", "is_test").count().collect()
    assert len(got) == 5 and sum(r["is_test"] for r in got) == 1
    with pytest.raises(ValueError):
        split.group_split(rows.filter("g = 0"), "g")


def test_folds_are_even(spark):
    rows = spark.createDataFrame([(i, int(i > 12)) for i in range(30)], "id long, label int")
    counts = split.stratified_folds(rows, "label", "id", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_contrast_without_a_side(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (2, 0, 1.0), (4, 0, 1.0)], "label int, rel_idx int, value double")
    got = erp.contrasts(df).collect()
    assert len(got) == 1 and got[0]["value"] == 2


def test_lda_separates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), (rng.standard_normal(4) + 3 * (i % 2)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "epoch_id long, label int, features array<double>")
    assert metrics.scores(models.LDA(df).predict(df)).first()["accuracy"] > 0.95


def test_bundles(spark, tmp_path):
    np.savez(tmp_path / "a_run-003.npz", X=np.ones((3, 2, 4)), y=np.array([1, 2, 1]), groups=np.array([7, 7, 8]))
    np.savez(tmp_path / "b.npz", X=np.zeros((2, 5)), y=np.array([0, 1]))
    rows = io.read_bundles(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and {r["group_id"] for r in rows} == {7, 8, 1}
    found = io.identity(io.find_recordings(spark, str(tmp_path), ".npz"))
    assert {r["run"] for r in found.collect()} == {0, 3}
