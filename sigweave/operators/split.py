"""Splits, folds, balancing, top-1, unions: seeded by md5, so that they are the same on any engine."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def _bucket(seed: int, key: str) -> Column:
    """The first three digits of the order key: 4096 buckets, in its order."""
    return F.substring(order_key(seed, key), 1, 3)


def first_rows(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows that come first by the order key: whole buckets up to the one in which the n-th lies, and of
    that one the first, so no task sorts more than a bucket."""
    counts = rows.groupBy(_bucket(seed, key).alias("b")).count().orderBy("b").collect()  # at most 4096 rows
    left, edge = n, None
    for r in counts:
        if r["count"] > left:
            edge = r["b"]
            break
        left -= r["count"]
    if edge is None:
        return rows
    own = _bucket(seed, key)
    return rows.filter(own < edge).unionByName(rows.filter(own == edge).orderBy(order_key(seed, key), key).limit(left))


def group_split(rows: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` plus ``is_test``: whole groups, ceil(test_size * groups) of them. Fewer than two groups can't be split."""
    groups = rows.select(group).distinct()
    n = groups.count()
    if n < 2:
        raise ValueError("a group split takes two groups at least")
    first = first_rows(groups, group, math.ceil(test_size * n), seed).withColumn("is_test", F.lit(True))
    return rows.join(first, group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def _ranked(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Ranks within labels, over ids only: in buckets of the order key, behind the counts of all earlier buckets."""
    dealt = rows.select(key, label, _bucket(seed, key).alias("_b"))
    counts = dealt.groupBy(label, "_b").agg(F.count("*").alias("_n"))  # at most 4096 rows a label
    over = Window.partitionBy(label)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), before.alias("_before"), F.sum("_n").over(over).alias("of"))
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy(order_key(seed, key), key))
    joined = dealt.withColumn("_place", place).join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return joined.select(key, label, (F.col("_before") + F.col("_place")).alias("rank"), "of")


def stratified_split(rows: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` plus ``is_test``: the first floor(test_size * n + 0.5) of each label."""
    ranked = _ranked(rows, label, key, seed).select(key, (F.col("rank") <= F.floor(F.col("of") * test_size + 0.5)).alias("is_test"))
    return rows.join(ranked, key)


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` plus ``fold``: labels are dealt in turn, so fold sizes of a label differ by one at most."""
    return rows.join(_ranked(rows, label, key, seed).select(key, ((F.col("rank") - 1) % folds).cast("int").alias("fold")), key)


def balance_rest(rows: DataFrame, rest: Column, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """All gesture rows and int(gestures * ratio / (1 - ratio)) rest rows; all rest rows if there are fewer."""
    n = rows.agg(F.count_if(~rest)).first()[0]
    keep = int(n * ratio / (1 - ratio))
    few = first_rows(rows.filter(rest), key, keep, seed)
    return rows.filter(~rest).unionByName(few)


def best(rows: DataFrame, score: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(score).desc_nulls_last(), *ties).limit(1)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All parts' rows, each with its group."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
