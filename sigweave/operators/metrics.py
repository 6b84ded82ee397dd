"""Confusion tables and classification metrics of (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, *keys: str) -> DataFrame:
    """label, prediction, n, share (of the label's rows), with zero cells for all pairs of the classes seen."""
    cells = predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))
    seen = cells.select(*keys, F.explode(F.array("label", "prediction")).alias("c")).groupBy(*keys).agg(F.collect_set("c").alias("classes"))
    grid = seen.select(*keys, F.explode("classes").alias("label"), "classes").select(*keys, "label", F.explode("classes").alias("prediction"))
    full = grid.join(cells, [*keys, "label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*keys, "label"))))


def scores(predictions: DataFrame, *keys: str) -> DataFrame:
    """accuracy, balanced_accuracy (mean recall of true classes), f1_macro (over true and predicted classes, 0 where undefined)."""
    cells = predictions.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))
    side = lambda c, other: cells.select(*keys, F.col(c).alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias(other))
    both = side("label", "true").unionByName(side("prediction", "said"), allowMissingColumns=True)
    per = both.groupBy(*keys, "class").agg(F.max("tp").alias("tp"), F.coalesce(F.sum("true"), F.lit(0)).alias("true"), F.coalesce(F.sum("said"), F.lit(0)).alias("said"))
    recall = F.try_divide(F.col("tp"), F.col("true"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("true") + F.col("said")), F.lit(0.0))
    return per.groupBy(*keys).agg((F.sum("tp") / F.sum("true")).alias("accuracy"), F.avg(F.when(F.col("true") > 0, recall)).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"))


def binary_scores(predictions: DataFrame, positive: int = 1) -> DataFrame:
    """precision, recall, f1 of the positive class."""
    tp = F.count_if((F.col("label") == positive) & (F.col("prediction") == positive))
    return predictions.agg(tp.alias("tp"), F.count_if(F.col("prediction") == positive).alias("said"), F.count_if(F.col("label") == positive).alias("true")).select(
        F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("tp", "true"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("said") + F.col("true")), F.lit(0.0)).alias("f1")
    )


def fold_means(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("accuracy", "balanced_accuracy", "f1_macro")], F.count("*").alias("folds"))
