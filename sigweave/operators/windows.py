"""Sliding windows, running means, transitions, thresholds, refractory hits, byte frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .align import BUCKET_SECONDS


#: Samples of a recording that one window task orders; a halo of its neighbours' samples is added.
CHUNK = 1 << 16


def haloed(samples: DataFrame, chunk: int, halo: int) -> DataFrame:
    """Each sample in its own ``chunk`` and, near an edge, in its neighbours' halo."""
    at = F.col("sample_idx")
    first, last = F.floor((at - halo) / chunk), F.floor((at + halo) / chunk)
    return samples.select("*", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)).alias("chunk"))


def own_rows(cut: DataFrame, chunk: int) -> DataFrame:
    """The rows of ``haloed`` samples in their own chunks."""
    return cut.filter(F.col("chunk") == F.floor(F.col("sample_idx") / chunk)).drop("chunk")


def window_samples(milliseconds: float, fs: float) -> int:
    return int(milliseconds / 1000 * fs)


def sampling_freq(samples: DataFrame, *keys: str) -> DataFrame:
    """fs = 1 / mean interval, and the mean interval, of each key; from its first and last time and its count."""
    span = F.try_divide(F.max("t") - F.min("t"), F.count("t") - 1)
    return samples.groupBy(*keys).agg(span.alias("interval")).withColumn("fs", F.try_divide(F.lit(1.0), F.col("interval")))


def exploded_windows(samples: DataFrame, window: int, step: int) -> DataFrame:
    """Each sample (recording_id, sample_idx, ...) once for each window that holds it."""
    low = F.greatest(F.ceil((F.col("sample_idx") - (window - 1)) / step), F.lit(0).cast("long"))
    return samples.withColumn("window_id", F.explode(F.sequence(low, F.floor(F.col("sample_idx") / step))))


def sliding_windows(samples: DataFrame, window: int, step: int, channels: tuple[str, ...], label: str = "label") -> DataFrame:
    """Full windows with their first sample's label and an array of each channel's values in order."""
    at = exploded_windows(samples, window, step)
    rows = F.array_sort(F.collect_list(F.struct("sample_idx", *channels))).alias("rows")
    full = at.groupBy("recording_id", "window_id").agg(rows, F.min_by(label, "sample_idx").alias(label)).filter(F.size("rows") == window)
    return full.select("recording_id", "window_id", label, *[F.col(f"rows.{c}").alias(c) for c in channels])


def pane_features(samples: DataFrame, window: int, step: int, channels: tuple[str, ...], label: str = "label") -> DataFrame:
    """mav, std, var, maxav and rms of full windows, for a ``step`` that divides ``window``: sums are taken once
    per pane of ``step`` samples, and only panes are repeated. Long output: recording_id, window_id, label, channel, features."""
    if window % step:
        raise ValueError("step must divide window")
    per = window // step
    sums = []
    for c in channels:
        x = F.col(c)
        sums += [F.sum(F.abs(x)).alias(f"{c}_a"), F.sum(x).alias(f"{c}_s"), F.sum(x * x).alias(f"{c}_q"), F.max(F.abs(x)).alias(f"{c}_m")]
    panes = samples.groupBy("recording_id", F.floor(F.col("sample_idx") / step).alias("pane")).agg(F.count("*").alias("n"), F.min_by(label, "sample_idx").alias(label), *sums)
    spread = panes.withColumn("window_id", F.explode(F.sequence(F.greatest(F.col("pane") - (per - 1), F.lit(0).cast("long")), F.col("pane"))))
    wide = spread.groupBy("recording_id", "window_id").agg(
        F.sum("n").alias("n"), F.min_by(label, "pane").alias(label), *[(F.max if k == "m" else F.sum)(f"{c}_{k}").alias(f"{c}_{k}") for c in channels for k in "asqm"]
    ).filter(F.col("n") == window)
    n = F.lit(float(window))
    one = []
    for c in channels:
        a, s, q, m = (F.col(f"{c}_{k}") for k in "asqm")
        var = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
        one.append(F.struct(F.lit(c).alias("channel"), (a / n).alias("mav"), F.sqrt(var).alias("std"), var.alias("var"), m.alias("maxav"), F.sqrt(q / n).alias("rms")))
    return wide.select("recording_id", "window_id", label, F.explode(F.array(*one)).alias("f")).select("recording_id", "window_id", label, "f.*")


def running_mean(samples: DataFrame, window: int) -> DataFrame:
    """``samples`` plus ``running``: mean of the last ``window`` values, null until there are as many."""
    w = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx").rowsBetween(-(window - 1), 0)
    cut = haloed(samples, max(CHUNK, window), window - 1)
    out = cut.withColumn("running", F.when(F.count("*").over(w) == window, F.avg("value").over(w)))
    return own_rows(out, max(CHUNK, window))


def _numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` (recording_id, sample_idx, ...) plus ``k``, from 0 in order of sample_idx: ranks inside chunks, offset by the chunks' counts."""
    cut = rows.withColumn("chunk", F.floor(F.col("sample_idx") / chunk))
    rank = F.row_number().over(Window.partitionBy("recording_id", "chunk").orderBy("sample_idx"))
    earlier = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("recording_id", "chunk").agg(F.count("*").alias("size"))
    starts = sizes.select("recording_id", "chunk", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    joined = cut.withColumn("rank", rank).join(starts, ["recording_id", "chunk"])
    return joined.withColumn("k", F.col("before") + F.col("rank") - 1).drop("chunk", "rank", "before")


def stretched(running: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The full running means of each recording stretched to its length by linear interpolation: recording_id,
    sample_idx, stretched. Means are numbered by chunks, so no task orders a recording."""
    sizes = running.groupBy("recording_id").agg(F.count("*").alias("n"), F.count("running").alias("m"))
    means = _numbered(running.filter("running is not null").select("recording_id", "sample_idx", "running"), chunk)
    place = (F.col("sample_idx") * (F.col("m") - 1)) / F.greatest(F.col("n") - 1, F.lit(1))
    at = running.join(sizes.filter("m > 0"), "recording_id").select("recording_id", "sample_idx", place.alias("place"))
    at = at.withColumn("low", F.floor("place")).withColumn("high", F.ceil("place"))
    one = means.select("recording_id", F.col("k").alias("low"), F.col("running").alias("a"))
    two = means.select("recording_id", F.col("k").alias("high"), F.col("running").alias("b"))
    both = at.join(one, ["recording_id", "low"]).join(two, ["recording_id", "high"])
    return both.select("recording_id", "sample_idx", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("low"))).alias("stretched"))


def running_state(running: DataFrame) -> DataFrame:
    """Whether each running mean is above its recording's threshold, mean + population deviation of the running means."""
    limits = running.groupBy("recording_id").agg((F.avg("running") + F.stddev_pop("running")).alias("threshold"))
    return running.join(limits, "recording_id").withColumn("above", F.col("running") > F.col("threshold"))


def transitions(samples: DataFrame, label: str = "label", rising: tuple[str, str] | None = None, bucket_seconds: float = BUCKET_SECONDS) -> DataFrame:
    """Samples whose label differs from the one before, as ``before``; with ``rising``, only changes from the first to
    the second. Of samples at one time the least label comes first; a null label is no change, on either side; samples
    without a recording or a time are left out.

    Labels are compared inside time buckets; only a bucket's first sample looks at an earlier bucket, by its last label."""
    bucket = F.floor(F.col("t") / bucket_seconds).alias("bucket")
    cut = samples.select("recording_id", bucket, "t", F.col(label).alias("own"), F.struct(*samples.columns).alias("row"))
    inside = Window.partitionBy("recording_id", "bucket").orderBy("t", "own")
    ends = cut.groupBy("recording_id", "bucket").agg(F.max_by("own", F.struct("t", "own")).alias("end"))
    earlier = ends.select("recording_id", "bucket", F.lag("end").over(Window.partitionBy("recording_id").orderBy("bucket")).alias("end"))
    ranked = cut.withColumn("before", F.lag("own").over(inside)).withColumn("rank", F.row_number().over(inside)).join(earlier, ["recording_id", "bucket"])
    found = ranked.select("row", "own", F.when(F.col("rank") == 1, F.col("end")).otherwise(F.col("before")).alias("before"))
    changed = found.filter(F.col("before").isNotNull() & (F.col("before") != F.col("own"))).select("row.*", "before")
    return changed if rising is None else changed.filter((F.col("before") == rising[0]) & (F.col(label) == rising[1]))


def calibration(samples: DataFrame, seconds: float, sigmas: float = 4.0) -> DataFrame:
    """mean, std and threshold of each recording over its first ``seconds``; each sample counts once."""
    start = samples.groupBy("recording_id").agg(F.min("t").alias("t0"))
    early = samples.join(start, "recording_id").filter(F.col("t") < F.col("t0") + seconds)
    return early.groupBy("recording_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("threshold", F.col("mean") + sigmas * F.col("std"))


def psd_calibration(windows: DataFrame, power: Column, *keys: str, sigmas: float = 4.0) -> DataFrame:
    """mean, std and threshold of each key (a recording's channel, say) over its calibration windows' ``power``, such as
    ``features.mean_psd(fs)("x")``."""
    means = windows.select(*keys, power.alias("power")).groupBy(*keys).agg(F.avg("power").alias("mean"), F.stddev_pop("power").alias("std"))
    return means.withColumn("threshold", F.col("mean") + sigmas * F.col("std"))


def crossings(samples: DataFrame, limits: DataFrame, two_sided: bool = False) -> DataFrame:
    """``samples`` plus ``hit``: value - mean above the calibrated threshold - mean (or beyond it on either side)."""
    joined = samples.join(limits, "recording_id")
    off = F.col("value") - F.col("mean")
    reach = F.col("threshold") - F.col("mean")
    return joined.withColumn("hit", (F.abs(off) if two_sided else off) > reach).drop("mean", "std", "threshold")


def window_hits(hits: DataFrame, seconds: float) -> DataFrame:
    """Whether any sample of each tumbling window is a hit."""
    return hits.groupBy("recording_id", F.floor(F.col("t") / seconds).alias("window")).agg(F.bool_or("hit").alias("any_hit"))


def accepted_hits(hits: DataFrame, gap: float, bucket_seconds: float = BUCKET_SECONDS) -> DataFrame:
    """Hits of each recording more than ``gap`` seconds after the last accepted one; a hit without a time is none.

    Hits go in time buckets no shorter than the gap. What a bucket does depends on its first accepted hit alone,
    and that lies within a gap of the bucket's first hit: the few hits that may be it give the bucket's step function from the last
    accepted hit before it to the last one in it. A task composes these functions for a recording, and the buckets are then taken apart."""
    size = max(bucket_seconds, gap)
    times = hits.filter("hit and t is not null and not isnan(t)").select("recording_id", F.col("t").cast("double").alias("t"), F.floor(F.col("t") / size).alias("bucket"))

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        upto, last = kernels.refractory_steps(np.sort(pdf["t"].to_numpy()), gap)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "bucket": pdf["bucket"].iloc[0], "upto": upto, "last": last})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        at, buckets, entries = -np.inf, [], []
        for bucket, own in pdf.sort_values(["bucket", "upto"]).groupby("bucket"):
            buckets.append(bucket)
            entries.append(at)
            k = int(np.searchsorted(own["upto"].to_numpy(), at + gap, side="right"))
            at = own["last"].iloc[k] if k < len(own) else at
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "bucket": buckets, "entry": entries})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "t": t[kernels.refractory(t, gap, pdf["entry"].iloc[0])]})

    keys = ["recording_id", "bucket"]
    maps = times.groupBy(*keys).applyInPandas(steps, "recording_id long, bucket long, upto double, last double")
    entries = maps.groupBy("recording_id").applyInPandas(compose, "recording_id long, bucket long, entry double")
    return times.join(entries, keys).groupBy(*keys).applyInPandas(run, "recording_id long, t double")


def rectify(x: Column, offset: float = 496.0) -> Column:
    return F.abs(x - F.lit(offset))


def decode_frames(data: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Values of two-byte frames in ``data`` (buffer, pos, byte): a byte above 127 starts a frame with the byte
    after it, which is not looked at again; the scan starts at position 1 and stops before the last. In a run of
    high bytes only those at odd places start one.

    Chunks of a buffer are scanned apart. A chunk passes on one bit, whether its last byte started a frame: the parity
    of the high bytes at its end, and where it is all high, of those before it too. One row for each chunk gives all of them theirs."""
    inside = Window.partitionBy("buffer", "chunk").orderBy("pos")
    high = F.col("byte") > 127
    cut = data.filter("pos >= 1").withColumn("chunk", F.floor(F.col("pos") / chunk))
    rows = cut.withColumn("rank", F.row_number().over(inside)).withColumn("next", F.lead("byte").over(inside))
    rows = rows.withColumn("low", F.coalesce(F.max(F.when(~high, F.col("rank"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    chunks = rows.groupBy("buffer", "chunk").agg(F.max("low").alias("mixed"), (F.max("rank") - F.max("low")).alias("tail"), F.min_by("byte", "rank").alias("head"))
    order = Window.partitionBy("buffer").orderBy("chunk")
    chunks = chunks.withColumn("group", F.sum(F.when(F.col("mixed") > 0, 1).otherwise(0)).over(order))
    chunks = chunks.withColumn("after", F.sum("tail").over(Window.partitionBy("buffer", "group").orderBy("chunk")) % 2)
    chunks = chunks.select("buffer", "chunk", F.coalesce(F.lag("after").over(order), F.lit(0)).alias("taken"), F.lead("head").over(order).alias("following"))
    joined = rows.join(chunks, ["buffer", "chunk"])
    place = F.col("rank") - F.col("low") + F.when(F.col("low") == 0, F.col("taken")).otherwise(0)
    following = F.coalesce("next", "following")
    return joined.filter(high & (place % 2 == 1) & following.isNotNull()).select("buffer", "pos", (F.col("byte").bitwiseAND(127) * 128 + following).alias("frame"))
