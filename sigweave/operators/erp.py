"""Event-related averages, their spread, contrasts and connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contrasts, as pairs of class labels (hand open, close; wrist extension, flexion).
CONTRASTS = ((1, 2), (4, 3))


def exploded(epochs: DataFrame) -> DataFrame:
    """Array epochs as rows with rel_idx and value."""
    return epochs.select("epoch_id", "label", "channel", F.posexplode("x").alias("rel_idx", "value"))


def mean_response(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean value per key (usually label, channel, rel_idx), partial sums before the shuffle."""
    return rows.groupBy(*keys).agg(F.avg("value").alias("value"))


def response_spread(rows: DataFrame) -> DataFrame:
    """label, rel_idx, mean, sem of the channel means over epochs; sem = population deviation / sqrt(epochs)."""
    per_epoch = rows.groupBy("epoch_id", "label", "rel_idx").agg(F.avg("value").alias("value"))
    return per_epoch.groupBy("label", "rel_idx").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("sem"))


def spread_summary(spread: DataFrame) -> DataFrame:
    return spread.groupBy("label").agg(F.avg("sem").alias("mean_sem"), F.max("sem").alias("max_sem"))


def at_times(response: DataFrame, times: tuple[float, ...], fs: float, first: int = 0) -> DataFrame:
    """The response at the samples nearest to ``times`` (seconds from the event); rel_idx counts from ``first``."""
    spark = response.sparkSession
    wanted = spark.createDataFrame([(t, round(t * fs) + first) for t in times], "time double, rel_idx int")
    return response.join(F.broadcast(wanted), "rel_idx")


def contrasts(response: DataFrame, pairs=CONTRASTS, keys: tuple[str, ...] = ("rel_idx",)) -> DataFrame:
    """Difference of two classes' responses for each pair; pairs that lack a side are left out."""
    spark: SparkSession = response.sparkSession
    table = F.broadcast(spark.createDataFrame([(a, b) for a, b in pairs], "label_1 int, label_2 int"))
    one = response.withColumnRenamed("label", "label_1").withColumnRenamed("value", "value_1").join(table, "label_1")
    two = response.withColumnRenamed("label", "label_2").withColumnRenamed("value", "value_2")
    return one.join(two, ["label_2", *keys]).select("label_1", "label_2", *keys, (F.col("value_1") - F.col("value_2")).alias("value"))


def connectivity(samples: DataFrame, channels: tuple[str, ...], task: str = "task") -> DataFrame:
    """Pearson r of each unordered channel pair and task, in one pass over wide samples: task, a, b, r."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    wide = samples.groupBy(task).agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(task, F.explode(rows).alias("p")).select(task, "p.*")


def channel_pairs(samples: DataFrame) -> DataFrame:
    """Long samples (task, rel_idx, channel, value) joined with themselves over unordered channel pairs."""
    one = samples.select("task", "rel_idx", F.col("channel").alias("a"), F.col("value").alias("x"))
    two = samples.select("task", "rel_idx", F.col("channel").alias("b"), F.col("value").alias("y"))
    return one.join(two, ["task", "rel_idx"]).filter("a < b")


def pair_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("task", "a", "b").agg(F.corr("x", "y").alias("r"))


def symmetric(pairs: DataFrame, task: str = "task") -> DataFrame:
    """The matrix: every pair both ways."""
    return pairs.unionByName(pairs.select(task, F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def segment_features(rows: DataFrame, n_times: int, segment: int) -> DataFrame:
    """Mean and population deviation of each full segment of rows (task, channel, rel_idx, value)."""
    number: Column = F.floor(F.col("rel_idx") / segment).cast("int")
    cut = rows.withColumn("segment", number).filter(F.col("segment") < n_times // segment)
    return cut.groupBy("task", "channel", "segment").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
