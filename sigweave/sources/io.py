"""Reading and writing recordings, bundles, registries, metrics and summaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bundles

EMG_SCHEMA = "Timestamp double, {channels}, Action1 string, Action2 string"


def find_recordings(spark: SparkSession, base: str, suffix: str = ".xdf") -> DataFrame:
    """path, length of all files with the suffix below ``base``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(base)
    return files.select("path", "length")


def run_group(path: Column) -> Column:
    """Number after ``run-`` in a file name, else 0."""
    found = F.regexp_extract(path, r"run-(\d+)", 1)
    return F.when(found == "", 0).otherwise(F.try_to_number(found, F.lit("999999999")).cast("int"))


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; a temporary one only where they are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sigweave-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def emg_identity(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` plus what names like ``participant_hand_ch4_seq2_stamp`` say: participant, hand, channels, sequence, stamp; nulls for other names."""
    part = lambda i: F.nullif(F.regexp_extract("path", r"([^/_]+)_([^/_]+)_ch(\d+)_seq(\d+)_([^/.]+)[^/]*$", i), F.lit(""))
    number = lambda i: F.try_to_number(part(i), F.lit("999999999")).cast("int")
    return files.select("*", part(1).alias("participant"), part(2).alias("hand"), number(3).alias("channels"), number(4).alias("sequence"), part(5).alias("stamp"))


def identity(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` plus subject, session, task, run and the label mode of the name, ``default`` if none."""
    part = lambda k: F.nullif(F.regexp_extract("path", rf"{k}-([^_/]+)", 1), F.lit(""))
    mode = F.nullif(F.regexp_extract("path", r"(hand_dir|fine_type|wrist_dir)", 1), F.lit(""))
    return files.select("*", part("sub").alias("subject"), part("ses").alias("session"), part("task").alias("task"), run_group(F.col("path")).alias("run"), F.coalesce(mode, F.lit("default")).alias("mode"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Epochs of ``.npz`` bundles (X, y and maybe groups) in a folder or file; without groups, a file's place in order of path."""
    spark.dataSource.register(bundles.EpochBundles)
    return spark.read.format("epoch_bundles").load(path)


def read_emg(spark: SparkSession, path: str, channels: int, contains: str | None = None) -> DataFrame:
    """Raw EMG CSV files, with the file's name; only files whose name holds ``contains``."""
    schema = EMG_SCHEMA.format(channels=", ".join(f"Channel{i + 1} double" for i in range(channels)))
    rows = spark.read.schema(schema).option("header", True).csv(path).select("*", F.col("_metadata.file_name").alias("file"))
    return rows if contains is None else rows.filter(F.col("file").contains(contains))


def write_by_recording(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Epochs, cleaned signals or feature frames, one folder per recording. Rows are dealt by recording first, so a folder
    gets one file and not one from every task; a recording streams through the task that writes it."""
    rows.repartition("recording_id").write.partitionBy("recording_id").mode("overwrite").format(fmt).save(path)


def registry(samples: DataFrame, markers: DataFrame, streams: DataFrame, output: str) -> DataFrame:
    """recording_id, sfreq, n_channels, n_events, output_path; recordings with fewer than two streams are left out."""
    enough = streams.groupBy("recording_id").agg(F.count("*").alias("k")).filter("k >= 2").select("recording_id")
    per = samples.groupBy("recording_id").agg(F.try_divide(F.count_distinct("t") - 1, F.max("t") - F.min("t")).alias("sfreq"), F.count_distinct("channel").alias("n_channels"))
    events = markers.groupBy("recording_id").agg(F.count("*").alias("n_events"))
    out = per.join(enough, "recording_id", "left_semi").join(events, "recording_id", "left")
    return out.select("recording_id", "sfreq", "n_channels", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.concat(F.lit(output + "/recording_id="), F.col("recording_id").cast("string")).alias("output_path"))


def write_feature_frame(frame: DataFrame, path: str) -> None:
    """A feature frame (section, item, task, values), one folder for each section."""
    frame.write.partitionBy("section").mode("overwrite").parquet(path)


def write_summaries(rows: DataFrame, path: str) -> None:
    """A comparison's rows as CSV, one folder for each label mode; ``read_summaries`` of the folders gives the combined table."""
    rows.repartition("mode").write.partitionBy("mode").mode("overwrite").option("header", True).csv(path)


def read_summaries(spark: SparkSession, pattern: str, latest: bool = False) -> DataFrame:
    """All summary CSV files of a glob; a missing mode comes from the folder. ``latest``: the last file's row of each run."""
    rows = spark.read.option("header", True).option("mergeSchema", True).csv(pattern).select("*", F.col("_metadata.file_path").alias("_file"))
    folder = F.regexp_extract("_file", r"(?:mode=)?([^/]+)/[^/]+$", 1)
    rows = rows.withColumn("mode", F.coalesce("mode", folder) if "mode" in rows.columns else folder)
    if latest:
        w = Window.partitionBy("mode", "model", "features").orderBy(F.col("_file").desc())
        rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return rows.drop("_file")
