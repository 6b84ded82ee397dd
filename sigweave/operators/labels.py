"""Trigger codes, gesture labels, label modes and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trigger codes without a movement, and movement numbers of each class.
SPECIAL_CODES = (9701, 9702, 8888, 8899, 9999)
MOVEMENT_LABELS = {1: (1, 2, 7), 2: (3, 4, 5, 6, 8), 3: (11, 12), 4: (13, 14)}
#: Label modes; each lists its classes in order, with the old labels that they join.
MODES = {
    "wrist_dir": {"flexion": (3,), "extension": (4,)},
    "hand_dir": {"open": (1,), "close": (2,)},
    "fine_type": {"fine_open": (5,), "fine_closed": (6,)},
}
MOVE_PHASE = 3


def decode_trigger(code: Column) -> Column:
    """Class of a trigger code of digits phase, arm, baseline, movement (two); -1 if it has none."""
    label = F.lit(-1)
    movement = code % 100
    for k, numbers in MOVEMENT_LABELS.items():
        label = F.when(movement.isin(*numbers), k).otherwise(label)
    moving = F.floor(code / 10000) == MOVE_PHASE
    return F.when(~code.isin(*SPECIAL_CODES) & moving, label).otherwise(-1).cast("int")


def trigger_parts(events: DataFrame) -> DataFrame:
    """``events`` plus phase, arm, baseline, movement and label."""
    code = F.col("code")
    return events.select(
        "*", F.floor(code / 10000).cast("int").alias("phase"), (F.floor(code / 1000) % 10).cast("int").alias("arm"), (F.floor(code / 100) % 10).cast("int").alias("baseline"), (code % 100).cast("int").alias("movement"), decode_trigger(code).alias("label")
    )


def remap_events(events: DataFrame) -> DataFrame:
    """Events with a class, with their ``label``."""
    return events.withColumn("label", decode_trigger(F.col("code"))).filter("label > 0")


def flat_label(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``gesture``: action2 if present (an empty one counts as none), else action1."""
    return rows.withColumn("gesture", F.coalesce(F.nullif(F.col("action2"), F.lit("")), "action1"))


def gesture_ids(rows: DataFrame, ids: dict[str, int], wanted: tuple[str, ...]) -> DataFrame:
    """``rows`` plus ``gesture_id``: the id of a wanted gesture, else null. The map is a parameter, so it is a literal."""
    pairs = [F.lit(x) for name in wanted for x in (name, ids[name])]
    return rows.withColumn("gesture_id", F.element_at(F.create_map(*pairs), F.col("gesture")) if pairs else F.lit(None).cast("int"))


def modes_table(spark: SparkSession, modes: dict = MODES) -> DataFrame:
    rows = [(mode, old, new, name) for mode, classes in modes.items() for new, (name, olds) in enumerate(classes.items()) for old in olds]
    return spark.createDataFrame(rows, "mode string, old_label int, new_label int, name string")


def simplify_labels(epochs: DataFrame, modes: DataFrame) -> DataFrame:
    """Epochs of all modes in one pass, relabelled; labels outside a mode's map drop out of it."""
    return epochs.join(F.broadcast(modes), epochs["label"] == modes["old_label"]).drop("label", "old_label").withColumnRenamed("new_label", "label")


def class_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))
