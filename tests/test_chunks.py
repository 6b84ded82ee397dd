"""Operators over chunks and time buckets against plain loops over whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.functions import kernels
from sigweave.operators import clean, features, windows


def signals(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(r, i, float(v)) for r, n in enumerate(sizes) for i, v in enumerate(rng.standard_normal(n))]
    return spark.createDataFrame(rows, "recording_id long, sample_idx long, value double")


def changes(rows):
    """Of (recording, t, label) rows, by a loop over each recording."""
    out, last = [], {}
    for rec, t, label in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "")):
        before = last.get(rec)
        if before is not None and label is not None and before != label:
            out.append((rec, t, before, label))
        last[rec] = label
    return sorted(out)


@pytest.mark.parametrize("bucket", [1.0, 2.5, 1e6])
def test_transitions_over_buckets(spark, bucket):
    rng = np.random.default_rng(5)
    rows = [(int(r), float(t), [None, "a", "b", "c"][k]) for r, t, k in zip(rng.integers(0, 3, 150), rng.integers(0, 40, 150), rng.integers(0, 4, 150))]
    rows += [(7, float(t), "a" if t < 30 else "b") for t in range(0, 60, 10)]  # empty buckets between
    df = spark.createDataFrame(rows, "recording_id long, t double, label string").withColumn("end", F.lit(1))
    got = windows.transitions(df, bucket_seconds=bucket)
    assert got.columns == ["recording_id", "t", "label", "end", "before"]
    assert sorted((r["recording_id"], r["t"], r["before"], r["label"]) for r in got.collect()) == changes(rows)
    rising = windows.transitions(df, rising=("a", "b"), bucket_seconds=bucket).collect()
    assert sorted((r["recording_id"], r["t"]) for r in rising) == [c[:2] for c in changes(rows) if c[2:] == ("a", "b")]
    assert windows.transitions(df.limit(0), bucket_seconds=bucket).count() == 0


def frames(data):
    """Of one buffer's bytes, by a scan."""
    out, at = [], 1
    while at < len(data) - 1:
        if data[at] > 127:
            out.append((data[at] & 127) * 128 + data[at + 1])
            at += 1
        at += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_frames_over_chunks(spark, chunk):
    rng = np.random.default_rng(9)
    # Mixed bytes, mostly high ones, nothing but high ones, and buffers of one and two bytes.
    buffers = [rng.integers(0, 256, 60), rng.integers(100, 256, 61), np.full(23, 200), np.full(24, 255), np.array([200]), np.array([200, 200]), np.append(np.full(14, 180), 5)]
    rows = [(b, i, int(v)) for b, data in enumerate(buffers) for i, v in enumerate(data)]
    got = windows.decode_frames(spark.createDataFrame(rows, "buffer long, pos long, byte int"), chunk).orderBy("buffer", "pos").collect()
    for b, data in enumerate(buffers):
        assert [r["frame"] for r in got if r["buffer"] == b] == frames([int(v) for v in data])


def test_refractory_steps_give_the_last_accepted():
    rng = np.random.default_rng(1)
    for _ in range(300):
        times = np.sort(rng.integers(0, 30, rng.integers(1, 25)) / 2.0)
        gap = float(rng.choice([0.0, 0.5, 1.5, 4.0, 50.0]))
        upto, last = kernels.refractory_steps(times, gap)
        for before in (-np.inf, *(times[0] - rng.random(8) * 6)):
            accepted = times[kernels.refractory(times, gap, before)]
            k = int(np.searchsorted(upto, before + gap, side="right"))
            assert (last[k] if k < len(upto) else None) == (accepted[-1] if len(accepted) else None)


@pytest.mark.parametrize("bucket", [0.5, 4.0, 1e6])
def test_hits_over_buckets(spark, bucket):
    rng = np.random.default_rng(2)
    rows = [(int(r), float(t) / 4, bool(h)) for r, t, h in zip(rng.integers(0, 3, 400), rng.integers(-200, 400, 400), rng.integers(0, 4, 400))]
    rows += [(9, t / 10, True) for t in range(300)] + [(9, None, True), (9, float("nan"), True)]  # a chain through all buckets
    df = spark.createDataFrame(rows, "recording_id long, t double, hit boolean")
    got = windows.accepted_hits(df, 1.5, bucket).collect()
    for rec in (0, 1, 2, 9):
        times = np.sort([t for r, t, h in rows if r == rec and h and t is not None and t == t])
        assert sorted(r["t"] for r in got if r["recording_id"] == rec) == times[kernels.refractory(times, 1.5)].tolist()


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_stretched_over_chunks(spark, chunk):
    run = windows.running_mean(signals(spark, [50, 12, 4]), 5)
    got = windows.stretched(run, chunk).orderBy("recording_id", "sample_idx").collect()
    for rec, n in ((0, 50), (1, 12)):
        means = [r["running"] for r in run.filter(F.col("recording_id") == rec).orderBy("sample_idx").collect()][4:]
        want = np.interp(np.arange(n) * (len(means) - 1) / (n - 1), np.arange(len(means)), means)
        assert np.allclose([r["stretched"] for r in got if r["recording_id"] == rec], want)
    assert {r["recording_id"] for r in got} == {0, 1}  # four samples have no full mean


def test_wide_hampel_equals_sql_frames(spark):
    rows = signals(spark, [300, 90, 20]).withColumn("tag", F.lit("x"))
    odd = F.when(F.col("sample_idx") % 37 == 5, 40.0).when((F.col("recording_id") == 1) & (F.col("sample_idx") == 8), None)
    rows = rows.withColumn("value", F.when(F.col("sample_idx") == 250, float("inf")).when(odd.isNotNull() | (F.col("sample_idx") == 8), odd).otherwise(F.col("value")))
    by = lambda df: df.select("recording_id", "sample_idx", "value", "tag", "cleaned").orderBy("recording_id", "sample_idx").collect()
    want = by(clean.hampel(rows, 12, narrow=99))
    assert sum(r["value"] == 40.0 and r["cleaned"] < 3 for r in want) > 3
    for chunk in (16, 100_000):
        assert by(clean.hampel(rows, 12, chunk=chunk, narrow=3)) == want


def test_psd_calibration(spark):
    x = np.random.default_rng(4).standard_normal((6, 64))
    df = spark.createDataFrame([("ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "channel string, x array<double>")
    got = {r["channel"]: r for r in windows.psd_calibration(df, features.mean_psd(64, 1, 15, 64)("x"), "channel").collect()}
    freqs, psd = kernels.welch(x, 64, 64, 32, window=kernels.hamming)
    power = psd[:, (freqs >= 1) & (freqs <= 15)].mean(axis=1)
    for i, c in enumerate("ab"):
        assert got[c]["mean"] == pytest.approx(power[i::2].mean()) and got[c]["threshold"] == pytest.approx(power[i::2].mean() + 4 * power[i::2].std())


@pytest.mark.parametrize("chunk", [4, 16, 64, 1 << 16])
def test_resampling_over_chunks(spark, chunk):
    sizes = (1, 2, 7, 30, 64, 211)
    rows = signals(spark, sizes).withColumn("channel", F.lit("v")).withColumn("t", F.col("sample_idx").cast("double"))
    kept = {r: [] for r in range(len(sizes))}
    for r in rows.orderBy("recording_id", "sample_idx").collect():
        kept[r["recording_id"]].append(r["value"])
    for rate in (0.1, 0.5, 1.0, 1.3, 3.0):
        found = {(r["recording_id"], r["sample_idx"]): r["value"] for r in clean.resample(rows, rate, chunk).collect()}
        want = {}
        for k, x in kept.items():
            n = max(1, int((len(x) - 1) * rate))
            want |= {(k, j): v for j, v in enumerate(kernels.fourier_resample(np.array(x)[None, :], n)[0])}
        assert found.keys() == want.keys()
        assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_chirp_grid_equals_the_transform_at_large_places():
    rng = np.random.default_rng(1)
    for period, chunk in ((40_009, 1 << 10), (65_537, 1 << 8)):
        x = rng.standard_normal(period)
        grid = kernels.ChirpGrid(period, period, period // 2 + 1, chunk)
        at = np.arange(period)
        cols = [grid.columns(b, at[(s := at % grid.n2 // grid.broad == b)], x[s]) for b in range(grid.n2 // grid.broad)]
        a, b = (np.hstack([c[i] for c in cols]) for i in (0, 1))
        c = np.vstack([grid.lines(i, a[i * grid.tall : (i + 1) * grid.tall], b[i * grid.tall : (i + 1) * grid.tall]) for i in range(grid.n1 // grid.tall)])
        out = np.empty(grid.want, complex)
        for i in range(grid.n2 // grid.broad):
            q, y = grid.ends(i, c[:, i * grid.broad : (i + 1) * grid.broad])
            out[q] = y
        assert np.abs(out - np.fft.rfft(x)).max() < 1e-9 * period


def test_resampling_nulls_and_empty_tables(spark):
    rows = signals(spark, (20, 20)).withColumn("channel", F.lit("v")).withColumn("t", F.col("sample_idx").cast("double"))
    holed = rows.withColumn("value", F.when((F.col("recording_id") == 0) | (F.col("sample_idx") != 3), F.col("value")))
    for chunk in (4, 64):
        found = clean.resample(holed, 0.5, chunk).collect()
        assert len(found) == 18
        assert all((r["value"] is None) == (r["recording_id"] == 1) for r in found)
        assert clean.resample(rows.limit(0), 0.5, chunk).count() == 0


@pytest.mark.parametrize("chunk", [40, 10_000])
def test_wide_filters_equal_those_of_each_channel(spark, chunk):
    """Many recordings go through numpy together, whatever their lengths."""
    rng = np.random.default_rng(6)
    sizes = [1, 2, 30, 39, 40, 41, 80, 81, 130] + [int(n) for n in rng.integers(1, 130, 30)]
    x = {r: rng.standard_normal((2, n)) + 20 for r, n in enumerate(sizes)}
    rows = [(r, i, float(v[0, i]), float(v[1, i])) for r, v in x.items() for i in range(v.shape[1])]
    wide = spark.createDataFrame(rows, "recording_id long, sample_idx long, a double, b double").repartition(5)
    taps = kernels.fir_taps(100, 20, None)
    made = kernels.SectionFilter(kernels.butterworth_sections(100, 10, 30, 2))
    by_fir, by_iir = clean.fir_filter_wide(wide, ["a", "b"], taps, chunk), clean.iir_filter_wide(wide, ["a", "b"], 100, 10, 30, 2, chunk)
    for found, want in (
        (by_fir, lambda v: kernels.fft_convolve(kernels.reflect(v, len(taps) // 2, len(taps) // 2), taps)[:, len(taps) // 2 : -(len(taps) // 2)]),
        (by_iir, lambda v: made.there_and_back(kernels.reflect(v, p := min(v.shape[1] - 1, 30), p))[:, p : p + v.shape[1]]),
    ):
        got = {(r["recording_id"], r["sample_idx"]): (r["a"], r["b"]) for r in found.collect()}
        assert len(got) == len(rows) == found.count()
        for r, v in x.items():
            assert np.allclose([got[r, i] for i in range(v.shape[1])], want(v).T, atol=1e-9)
    long = wide.unpivot(["recording_id", "sample_idx"], ["a", "b"], "channel", "value")
    each = clean.iir_filter(long, 100, 10, 30, 2, chunk).groupBy("recording_id", "sample_idx").pivot("channel", ["a", "b"]).agg(F.first("value"))
    assert each.join(by_iir, ["recording_id", "sample_idx"]).filter(F.greatest(F.abs(each["a"] - by_iir["a"]), F.abs(each["b"] - by_iir["b"])) < 1e-9).count() == len(rows)


def test_chirp_grid_takes_many_signals_together():
    """Signals of one length give in one call what each gives by itself."""
    x = np.random.default_rng(2).standard_normal((3, 50))
    grid, at = kernels.ChirpGrid(50, 50, 26, 16), np.arange(50)
    for block in range(grid.n2 // grid.broad):
        own = at[at % grid.n2 // grid.broad == block]
        together, chirp = grid.columns(block, np.tile(own, 3), x[:, own].ravel(), np.repeat(np.arange(3), len(own)), 3)
        for k in range(3):
            a, b = grid.columns(block, own, x[k, own])
            assert np.allclose(together[k], a) and np.allclose(chirp, b)
            assert np.allclose(grid.ends(block, together)[1][k], grid.ends(block, a)[1])
