import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.jobs import decoding, training
from sigweave.operators import clean, decoder, features, labels, models, split, windows
from sigweave.sources import io
from sigweave.streaming import streams


def signal(spark, n=400, rec=3):
    """Two labels in turn, the second one louder."""
    rng = np.random.default_rng(1)
    rows = [(r, i, i / 100, float(rng.standard_normal() * (1 + 4 * (i // 50 % 2))), f"k{i // 50 % 2}") for r in range(rec) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, sample_idx long, t double, value double, label string")


@pytest.mark.parametrize("fit", [decoder.nearest_mean, decoder.logistic])
def test_offline_decoding_and_saved_decoder(spark, tmp_path, fit):
    s = signal(spark)
    assert decoding.measured_rate(s) == pytest.approx(100)
    rows = decoding.window_features(s, ["mav", "std"], 250, 250)
    names = ["value_mav", "value_std"]
    made, predictions, scores = decoding.offline_decoding(rows, F.col("recording_id") == 2, lambda r: fit(r, names))
    assert scores.first()["accuracy"] > 0.9 and predictions.count() == 16
    made.save(spark, f"{tmp_path}/decoder")
    again = decoder.Decoder.load(spark, f"{tmp_path}/decoder")
    assert again == made
    plain = [r.asDict() for r in rows.collect()]
    for r, got in zip(plain, again.predict(spark.createDataFrame(plain, rows.schema)).collect()):
        x = (np.array([r[n] for n in names]) - made.mean) / made.std
        assert got["prediction"] == made.labels[int(np.argmax(np.array(made.weights) @ x + made.bias))]


def test_failed_runs_keep_a_row_and_summaries_are_written(spark, tmp_path):
    epochs = spark.createDataFrame([(e, 0, 1, "c0", [1.0] * 16) for e in range(6)], "epoch_id long, group_id int, label int, channel string, x array<double>")
    modes = labels.modes_table(spark, {"hand_dir": labels.MODES["hand_dir"]})
    out = training.compare(epochs, modes, 64.0, outdir=f"{tmp_path}/out", nperseg=8, bands=((4, 8),)).collect()
    assert len(out) == 5 and any(r["status"] == "failed" and r["accuracy"] is None for r in out)
    back = io.read_summaries(spark, f"{tmp_path}/out/mode=*").collect()
    assert sorted((r["mode"], r["model"], r["features"], r["status"]) for r in back) == sorted((r["mode"], r["model"], r["features"], r["status"]) for r in out)


def test_files(spark, tmp_path):
    (tmp_path / "anna_left_ch2_seq3_2024.csv").write_text("Timestamp,Channel1,Channel2,Action1,Action2\n0.5,1,2,rest,\n0.6,3,4,,fist\n")
    rows = io.read_emg(spark, str(tmp_path), 2, contains="seq3").orderBy("Timestamp").collect()
    assert [(r["Channel2"], r["Action1"], r["Action2"]) for r in rows] == [(2.0, "rest", None), (4.0, None, "fist")]
    names = spark.createDataFrame([("/d/anna_left_ch2_seq3_2024.csv",), ("/d/other.csv",)], "path string")
    got = [tuple(r)[1:] for r in io.emg_identity(names).orderBy("path").collect()]
    assert got == [("anna", "left", 2, 3, "2024"), (None,) * 5]
    assert features.feature_names(1, ((0.5, 4.0), (8, 13))) == ["ch0_bp_0.5-4Hz", "ch0_bp_8-13Hz"]


def test_chunks_change_nothing(spark, monkeypatch):
    s = signal(spark, 90, 2).select("recording_id", "sample_idx", "value")
    want = [[tuple(r) for r in f.orderBy("recording_id", "sample_idx").collect()] for f in (clean.hampel(s), windows.running_mean(s, 10))]
    monkeypatch.setattr(windows, "CHUNK", 13)
    assert [[tuple(r) for r in f.orderBy("recording_id", "sample_idx").collect()] for f in (clean.hampel(s), windows.running_mean(s, 10))] == want


def test_first_rows_are_those_of_a_sort(spark):
    rows = spark.range(3000).withColumn("label", F.col("id") % 3)
    for n in (0, 1, 700, 3000, 4000):
        want = {r["id"] for r in rows.orderBy(split.order_key(42, "id"), "id").limit(n).collect()}
        assert {r["id"] for r in split.first_rows(rows, "id", n, 42).collect()} == want


def test_partial_sums_are_merged(spark):
    rows = spark.createDataFrame([(i, 0, i % 2, [float(i), float(i * i % 7)]) for i in range(50)], "epoch_id long, group_id int, label int, features array<double>").repartition(9)
    sums = models._sums(rows, None, None)
    x = np.array([[i, i * i % 7] for i in range(0, 50, 2)], float)
    assert sums[0][0] == 25 and np.allclose(sums[0][1], x.sum(0)) and np.allclose(sums[0][2], x.T @ x)


def test_late_rows_make_no_label_change(spark, tmp_path):
    hour = 3600
    for k, t in enumerate((0, 10, 20, 1, 21)):  # a file a batch; the fourth comes after the watermark has passed it
        df = spark.createDataFrame([(1, t * hour, 0.0, "ab"[k == 3])], "recording_id long, s long, value double, kind string")
        df.select("recording_id", F.timestamp_seconds("s").alias("ts"), "value", "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema("recording_id long, ts timestamp, value double, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.drained(streams.label_changes(raw), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert [r["label"] for r in out.collect()] == ["a"]


@pytest.mark.parametrize("chunk", [37, 500, 65_536])
def test_filtering_in_chunks_equals_the_sequential_filter(spark, chunk):
    from sigweave.functions import kernels
    from tests.test_kernels import sequential

    rng = np.random.default_rng(5)
    signals = {(1, "a"): rng.standard_normal(700) + 50, (1, "b"): rng.standard_normal(11), (2, "a"): np.array([3.0])}
    rows = [(r, c, i, float(v)) for (r, c), x in signals.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "recording_id long, channel string, sample_idx long, value double").repartition(3)
    got = {(r["recording_id"], r["channel"], r["sample_idx"]): r["value"] for r in clean.iir_filter(df, 300, 2, 45, 4, chunk).collect()}
    sections = kernels.butterworth_sections(300, 2, 45, 4)
    rest = np.array([-sections[0][0]] * 2 + [0.0] * 6)
    for (r, c), x in signals.items():
        pad = min(len(x) - 1, 450)
        y = kernels.reflect(x, pad, pad)
        for _ in range(2):
            y = sequential(sections, y, rest * y[0])[0][::-1]
        assert np.allclose([got.pop((r, c, i)) for i in range(len(x))], y[pad : pad + len(x)], atol=1e-9)
    assert not got


def test_online_decoding_of_odd_baselines_equals_its_sql(spark, tmp_path):
    """Recordings with one view, with equal views and without any; the last has the latest events. One value is null."""
    import duckdb

    from sigweave.jobs import model_queries

    rng = np.random.default_rng(8)
    rows = [(r, 600.0 * i + r, ["view", "click", "error", "purchase"][i % 4], float(rng.integers(1, 9000)) / 100) for r in range(1, 8) for i in range(60)]
    rows += [(8, 600.0 * i + 8, ["view", "click"][min(i, 1)], 5.0 + i) for i in range(20)]
    rows += [(9, 600.0 * i + 9, ["view", "click"][i % 2], 5.0 + i % 2 * i) for i in range(20)]
    rows += [(10, 600.0 * i + 40_000, "click", 1.0) for i in range(20)] + [(3, 7000.5, "click", None), (11, 40_001.0, "signup", 1.0)]
    rows += [(1, 36_010.0, "click", None)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    df = spark.createDataFrame(rows, "user_id long, s double, event_type string, value double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")).cast("timestamp_ntz"))
    path = f"{tmp_path}/table"
    df.selectExpr("monotonically_increasing_id() AS event_id", "ts", "user_id", "event_type", "value", "'k1' AS props").to(spark.createDataFrame([], schema).schema).coalesce(1).write.parquet(path)
    (tmp_path / "in").mkdir()
    next((tmp_path / "table").glob("*.parquet")).rename(tmp_path / "in" / "events.parquet")
    got = [tuple(r) for r in model_queries.QUERIES["t1_online_decoding"](spark, f"{tmp_path}/in").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/in/events.parquet'")
    want = con.execute(model_queries.ORACLE["t1_online_decoding"]).fetchall()
    order = lambda found: sorted(found, key=lambda r: r[:2])
    assert order(got) == order(want) and {r[5] for r in want if r[1] in (8, 9)} == {None}
    assert max(r[0] for r in want) > 40_000 - 7200
