"""Signal tables in the library's schemas, derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("quantity", "extendedprice", "discount", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str):
    """Seconds since 1970 of a timestamp without time zone, read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, t, value, kind: events as an irregular one-channel signal per user."""
    ev = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    return ev.select(F.col("user_id").alias("recording_id"), seconds("ts").alias("t"), "value", F.col("event_type").alias("kind"))


def event_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, marker_id, t, code: sign-ups as coded markers."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    ev = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return ev.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("marker_id"), seconds("ts").alias("t"), (F.lit(30000) + k % 28).alias("code"))


def supplier_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, sort columns, four channels, action1, action2: line items as wide samples per supplier."""
    li = table(spark, sf_dir, "lineitem")
    channels = [F.col(f"l_{c}").alias(c) for c in CHANNELS]
    return li.select(F.col("l_suppkey").alias("recording_id"), "l_shipdate", "l_orderkey", "l_linenumber", *channels, F.col("l_returnflag").alias("action1"), F.when(F.col("l_linenumber") == 1, F.col("l_linestatus")).alias("action2"))


SAMPLE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber")


def embedding_epochs(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """epoch_id, group_id, label, channel, x: vectors as epochs of 64 samples, or of several shorter channels."""
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("epoch_id"), (F.col("vec_id") % 5).cast("int").alias("group_id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    n = 64 // channels
    parts = F.array(*[F.struct(F.lit(f"c{i}").alias("channel"), F.slice("x", i * n + 1, n).alias("x")) for i in range(channels)])
    return emb.select("epoch_id", "group_id", "label", F.explode(parts).alias("p")).select("epoch_id", "group_id", "label", "p.channel", "p.x")


def order_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, stream_id, channel_count, n_samples: orders as streams of a customer's recording."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("stream_id"), F.length("o_orderpriority").alias("channel_count"), F.col("o_totalprice").alias("n_samples"))


def length_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, prediction: labelled quality against a rule on length."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("prediction"))
