"""Sample indices, marker alignment, epochs, baselines and stream roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: At 1 kHz, 3.6 million samples.
BUCKET_SECONDS = 3_600.0


def _offsets(samples: DataFrame, bucket_seconds: float) -> DataFrame:
    """Samples before each time bucket of a recording; one small row per (recording, bucket)."""
    bucket = F.floor(F.col("t") / bucket_seconds).alias("bucket")
    counts = samples.groupBy("recording_id", bucket).agg(F.count("*").alias("n"))
    w = Window.partitionBy("recording_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("recording_id", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), "n")


def sample_index(samples: DataFrame, bucket_seconds: float = BUCKET_SECONDS) -> DataFrame:
    """``samples`` plus ``sample_idx``, from 0 in order of time. Ranks are taken inside time buckets, so
    that no task holds a whole recording; the buckets' offsets come from their counts."""
    bucketed = samples.withColumn("bucket", F.floor(F.col("t") / bucket_seconds))
    w = Window.partitionBy("recording_id", "bucket").orderBy("t")
    ranked = bucketed.withColumn("rank", F.row_number().over(w))
    offsets = _offsets(samples, bucket_seconds).drop("n")
    joined = ranked.join(offsets, ["recording_id", "bucket"])
    return joined.withColumn("sample_idx", F.col("before") + F.col("rank") - 1).drop("bucket", "rank", "before")


def align_markers(markers: DataFrame, samples: DataFrame, bucket_seconds: float = BUCKET_SECONDS) -> DataFrame:
    """``markers`` plus ``sample_idx``: the number of samples of the recording before the marker's time,
    so the first sample at or after it, or the sample count for a marker after the end."""
    columns = markers.columns
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in markers.schema if f.name not in ("recording_id", "t")]
    both = samples.select("recording_id", "t", *none, F.lit(1).alias("is_sample")).unionByName(markers.withColumn("is_sample", F.lit(0)))
    both = both.withColumn("bucket", F.floor(F.col("t") / bucket_seconds))
    w = Window.partitionBy("recording_id", "bucket").orderBy("t", "is_sample").rowsBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("within", F.coalesce(F.sum("is_sample").over(w), F.lit(0))).filter("is_sample = 0")
    # A marker's bucket may hold no sample: count the samples of all earlier buckets by a running sum over both.
    counts = both.groupBy("recording_id", "bucket").agg(F.sum("is_sample").alias("n"))
    up = Window.partitionBy("recording_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("recording_id", "bucket", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("before"))
    return within.join(before, ["recording_id", "bucket"]).select(*columns, (F.col("before") + F.col("within")).alias("sample_idx"))


def epochs(events: DataFrame, samples: DataFrame, first: int, last: int) -> DataFrame:
    """One row per epoch and sample: recording_id, epoch_id, label, rel_idx, value. Of events on one sample the
    first is kept; epochs that leave the recording are dropped. Events are exploded, never theta-joined."""
    one = Window.partitionBy("recording_id", "sample_idx").orderBy("marker_id")
    kept = events.withColumn("turn", F.row_number().over(one)).filter("turn = 1").drop("turn")
    wanted = kept.select("recording_id", F.col("marker_id").alias("epoch_id"), "label", F.col("sample_idx").alias("at"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("rel_idx"))
    wanted = wanted.withColumn("sample_idx", F.col("at") + F.col("rel_idx")).drop("at")
    cut = wanted.join(samples.select("recording_id", "sample_idx", "value"), ["recording_id", "sample_idx"])
    whole = Window.partitionBy("recording_id", "epoch_id")
    return cut.withColumn("n", F.count("*").over(whole)).filter(F.col("n") == last - first + 1).select("recording_id", "epoch_id", "label", "rel_idx", "value")


def baseline(cut: DataFrame, low: int | None = None, high: int = 0) -> DataFrame:
    """Subtract each epoch's mean over rel_idx ``low`` (or its start) to ``high``, both included."""
    inside = F.col("rel_idx") <= high
    if low is not None:
        inside &= F.col("rel_idx") >= low
    mean = F.avg(F.when(inside, F.col("value"))).over(Window.partitionBy("recording_id", "epoch_id"))
    return cut.withColumn("value", F.col("value") - mean)


def stream_roles(streams: DataFrame) -> DataFrame:
    """recording_id, signal_stream (most channels, first wins), trigger_stream (fewest channels, then most samples, first wins)."""
    most = F.max_by("stream_id", F.struct("channel_count", -F.col("stream_id"))).alias("signal_stream")
    least = F.min_by("stream_id", F.struct("channel_count", -F.col("n_samples"), "stream_id")).alias("trigger_stream")
    return streams.groupBy("recording_id").agg(most, least)


def streams_by_name(streams: DataFrame, signal: str, trigger: str) -> DataFrame:
    """recording_id, signal_stream, trigger_stream: the first stream of each recording whose ``name`` is as given; null if none is."""
    of = lambda name: F.min(F.when(F.col("name") == name, F.col("stream_id")))
    return streams.groupBy("recording_id").agg(of(signal).alias("signal_stream"), of(trigger).alias("trigger_stream"))


def streams_with_channels(streams: DataFrame, expected: int) -> DataFrame:
    """The first stream of each recording with exactly ``expected`` channels."""
    return streams.filter(F.col("channel_count") == expected).groupBy("recording_id").agg(F.min("stream_id").alias("stream_id"))


def split_files(rows: DataFrame, test_files: DataFrame, key: str = "recording_id") -> DataFrame:
    """``rows`` plus ``is_test``: whether the row's file is in ``test_files``."""
    named = test_files.select(key).distinct().withColumn("is_test", F.lit(True))
    return rows.join(named, key, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
