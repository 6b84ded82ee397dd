"""Features of arrays (windows or epoch channels): built-in columns, and spectra by numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import kernels

#: The bands, in Hz, of the log band power features.
BANDS = ((4, 8), (8, 12), (13, 30), (30, 45))


def _sum(x: Column, f: Callable = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def _pairs(x: Column, f: Callable) -> Column:
    """f(previous, next) over neighbours."""
    n = F.size(x)
    return F.zip_with(F.slice(x, 1, F.greatest(n - 1, F.lit(0))), F.slice(x, 2, F.greatest(n - 1, F.lit(0))), f)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, not once for each element of a lambda."""
    return F.transform(F.array(value), f)[0]


def mav(x: Column) -> Column:
    return _sum(x, F.abs) / F.size(x)


def var(x: Column) -> Column:
    return _let(_sum(x) / F.size(x), lambda mean: _sum(x, lambda v: (v - mean) * (v - mean)) / F.size(x))


def std(x: Column) -> Column:
    return F.sqrt(var(x))


def maxav(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def rms(x: Column) -> Column:
    return F.sqrt(_sum(x, lambda v: v * v) / F.size(x))


def wl(x: Column) -> Column:
    return _sum(_pairs(x, lambda a, b: F.abs(b - a)))


def ssc(x: Column) -> Column:
    slopes = _pairs(x, lambda a, b: b - a)
    return F.size(F.filter(_pairs(slopes, lambda a, b: a * b), lambda v: v < 0))


def zc(x: Column) -> Column:
    """Changes of sign; 0 is a sign of its own."""
    return F.size(F.filter(_pairs(x, lambda a, b: F.signum(a) != F.signum(b)), lambda v: v))


def log_det(x: Column) -> Column:
    """exp(mean(log x)): NaN with a negative value, 0 with a zero."""
    low = F.array_min(x)
    logs = F.exp(_sum(F.transform(x, lambda v: F.when(v > 0, v).otherwise(1.0)), F.ln) / F.size(x))
    return F.when(low < 0, F.lit(float("nan"))).when(low == 0, 0.0).otherwise(logs)


def wamp(x: Column) -> Column:
    """Values above a fifth of the deviation."""
    return _let(F.lit(0.2) * std(x), lambda limit: F.size(F.filter(x, lambda v: v > limit)))


def total_power(x: Column) -> Column:
    """Sum of the two-sided power spectrum, by Parseval."""
    return _sum(x, lambda v: v * v) * F.size(x)


def mean_freq(fs: float) -> Callable[[Column], Column]:
    """Two-sided mean frequency in closed form: for an even length only the bin at -fs / 2 has no partner."""

    def build(x: Column) -> Column:
        n = F.size(x)
        turned = F.transform(x, lambda v, i: F.when(i % 2 == 0, v).otherwise(-v))
        alone = F.pow(_sum(turned), 2.0)
        return F.when(n % 2 == 0, F.try_divide(F.lit(-fs / 2) * alone, total_power(x))).otherwise(F.lit(0.0))

    return build


#: Feature name to column builder; ``extract`` also takes numpy callables.
BUILT_IN: dict[str, Callable[[Column], Column]] = {"mav": mav, "std": std, "var": var, "maxav": maxav, "rms": rms, "wl": wl, "ssc": ssc, "zc": zc, "log_det": log_det, "wamp": wamp, "total_power": total_power}


def from_numpy(f: Callable[[np.ndarray], float]) -> Callable[[Column], Column]:
    """A column builder for a user's callable of one array."""

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([float(f(np.asarray(v))) for v in x])

    return run


def extract(windows: DataFrame, features: Sequence[str | Callable], channels: Sequence[str]) -> DataFrame:
    """``windows`` with a column for each channel and feature, channel by channel."""
    keys = [c for c in windows.columns if c not in channels]
    cols = []
    for c in channels:
        for f in features:
            name = f if isinstance(f, str) else f.__name__
            build = BUILT_IN[f] if isinstance(f, str) else from_numpy(f)
            cols.append(build(F.col(c)).cast("double").alias(f"{c}_{name}"))
    return windows.select(*keys, *cols)


def _by_length(x: pd.Series, f: Callable[[np.ndarray], np.ndarray]) -> list:
    """``f`` over batches of arrays of one length each."""
    out: list = [None] * len(x)
    lengths = x.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i, row in zip(at, f(np.stack(x.iloc[at].to_numpy()).astype(float))):
            out[i] = row
    return out


def log_band_power(fs: float, bands=BANDS, nperseg: int = 256, overlap: int = 128, eps: float = 1e-12):
    """array<double> -> array<float>: log of Welch band power, a trapezoid over lo <= f < hi."""

    @pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(_by_length(x, lambda m: np.log(kernels.band_integral(*kernels.welch(m, fs, nperseg, overlap), bands) + eps).astype(np.float32)))

    return run


def band_mean(fs: float, bands, nperseg: int = 256, overlap: int = 128):
    """array<double> -> array<double>: mean Welch density over lo <= f <= hi by band, Hamming window."""

    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        def f(m):
            freqs, psd = kernels.welch(m, fs, nperseg, overlap, window=kernels.hamming)
            return np.stack([psd[:, (freqs >= lo) & (freqs <= hi)].mean(axis=1) if ((freqs >= lo) & (freqs <= hi)).any() else np.full(len(m), np.nan) for lo, hi in bands], axis=1)

        return pd.Series(_by_length(x, f))

    return run


def periodogram_power(fs: float, low: float = 8.0, high: float = 13.0):
    """array<double> -> double: Simpson's integral of the periodogram over low <= f <= high."""

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        def f(m):
            freqs, psd = kernels.welch(m, fs, m.shape[1], 0, window=np.ones)
            at = (freqs >= low) & (freqs <= high)
            return kernels.simpson(psd[:, at], freqs[1] - freqs[0])

        return pd.Series(_by_length(x, f)).astype(float)

    return run


def mean_psd(fs: float, low: float = 1.0, high: float = 15.0, n_fft: int = 256):
    """array<double> -> double: mean Welch density over low <= f <= high."""

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        def f(m):
            freqs, psd = kernels.welch(m, fs, n_fft, n_fft // 2, window=kernels.hamming)
            return psd[:, (freqs >= low) & (freqs <= high)].mean(axis=1)

        return pd.Series(_by_length(x, f)).astype(float)

    return run


def fft_feature(fs: float, name: str):
    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(_by_length(x, lambda m: kernels.fft_features(m, fs)[name])).astype(float)

    return run


def envelope(x: Column | str) -> Column:
    """Modulus of the analytic signal."""

    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(_by_length(x, kernels.analytic_envelope))

    return run(x)


def averaged_psd(samples: DataFrame, fs: float, n_fft: int = 4096, top: float = 100.0) -> DataFrame:
    """Mean spectrum of each channel up to ``top`` Hz: segments are cut by index, so a recording spreads over tasks."""
    segment = F.floor(F.col("sample_idx") / n_fft)
    cut = samples.groupBy("recording_id", "channel", segment.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("rows")).filter(F.size("rows") == n_fft)

    @pandas_udf("array<double>")
    def spectrum(x: pd.Series) -> pd.Series:
        return pd.Series(_by_length(x, lambda m: kernels.welch(m, fs, n_fft, 0)[1]))

    bins = cut.select("channel", F.posexplode(spectrum(F.col("rows.value"))).alias("bin", "power")).withColumn("freq", F.col("bin") * (fs / n_fft))
    return bins.filter(F.col("freq") <= top).groupBy("channel", "freq").agg(F.avg("power").alias("power"))


def time_frequency(epochs: DataFrame, fs: float, freqs: Sequence[float], bands: Sequence[tuple[float, float]], bin_seconds: float = 0.2) -> DataFrame:
    """task, channel, band, time_bin, power: mean multitaper power of rows (task, channel, x)."""
    freqs = np.asarray(freqs, float)

    @pandas_udf("array<array<double>>")
    def power(x: pd.Series) -> pd.Series:
        def f(m):
            p = kernels.multitaper_power(m, fs, freqs)
            size = max(1, int(bin_seconds * fs))
            n = m.shape[1] // size
            binned = p[:, :, : n * size].reshape(len(m), len(freqs), n, size).mean(axis=3)
            return [[binned[i, (freqs >= lo) & (freqs < hi)].mean(axis=0).tolist() for lo, hi in bands] for i in range(len(m))]

        return pd.Series(_by_length(x, f))

    rows = epochs.select("task", "channel", F.posexplode(power("x")).alias("band", "bins"))
    return rows.select("task", "channel", "band", F.posexplode("bins").alias("time_bin", "power")).groupBy("task", "channel", "band", "time_bin").agg(F.avg("power").alias("power"))


def feature_frame(power: DataFrame | None, corr: DataFrame | None, segments: DataFrame | None) -> DataFrame:
    """section, item, task, values: the union of the given parts, each with columns (item, task, values)."""
    parts = [df.select(F.lit(name).alias("section"), "item", "task", "values") for name, df in (("freq", power), ("corr", corr), ("mstd", segments)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flattened(epochs: DataFrame) -> DataFrame:
    """One row per epoch with ``features``: its channels' arrays end to end, in order of channel."""
    rows = F.array_sort(F.collect_list(F.struct("channel", "x")))
    return epochs.groupBy("epoch_id", "group_id", "label").agg(F.flatten(F.transform(rows, lambda r: r["x"])).alias("features"))


def feature_names(channels: int, bands=BANDS) -> list[str]:
    """Channel-major names of band power features."""
    return [f"ch{c}_bp_{lo:g}-{hi:g}Hz" for c in range(channels) for lo, hi in bands]
