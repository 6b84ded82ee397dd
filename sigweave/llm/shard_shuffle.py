"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters rows into memory-sized buckets by a seeded hash of the key, the whole row and its
number among equal rows, so a null or repeated key has no bucket of its own; pass 2 shuffles
each bucket with Spark's Fisher-Yates ``shuffle`` and lays the buckets end to end. The global
order is then cut into shards whose row counts differ by one at most (law ``rows``).

Nulls: a null key is hashed with its row, a null text counts as no bytes. Repeated rows stay, each
with a slot of its own. A text longer than a bucket lies in one bucket, beside the others dealt to it.
An empty table gives empty shards. Extra columns are carried; one that is named ``shard`` or ``slot``
is carried as ``shard_`` or ``slot_``, as the output adds columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import buckets_for, materialize, new_path, partitions_for, small, utf8_size

LAW = "rows"
#: Bytes of text that one bucket is meant to hold; a task shuffles its buckets one by one in memory.
BUCKET_BYTES = 8 << 20
#: More buckets are made while one of several rows holds more than so many times that; buckets below 1 MB are let be.
FULLEST, MIN_CHECKED = 4, 1 << 20
#: Copies of a row are made again in runs of so many.
RUN = 1_024
#: Buckets are numbered in groups of so many for their prefix sums.
GROUP = 4_096


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """``rows(row)`` with ``copy``: 0, or the number of a row among rows alike in all columns.

    Copies are counted and made again, in two levels, so that no retry changes which row has which
    number. Only rows whose hash occurs twice are shuffled for that.
    """
    marked = rows.withColumn("h", F.xxhash64(F.lit(seed), "row"))
    twice = materialize(marked.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h"), "repeated")
    n = twice.count()
    if not n:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    once = marked.join(small(twice, n), "h", "left_anti").select("row", F.lit(0).cast("long").alias("copy"))
    alike = marked.join(small(twice, n), "h", "left_semi").groupBy("row").agg(F.count("*").alias("times"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {RUN}"))))
    runs = runs.repartition("run", F.xxhash64("row"))
    first = F.col("run") * RUN
    again = runs.withColumn("copy", F.explode(F.sequence(first, F.least(first + RUN, F.col("times")) - 1)))
    return once.unionByName(again.select("row", "copy"))


def external_shuffle(docs: DataFrame, n_shards: int = 8, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in a shard).

    The same rows and seed give the same result, however the input is partitioned and whatever task runs again.
    Maps are neither hashed nor compared, so a map column travels as its sorted entries; maps inside other columns are refused by Spark.
    """
    taken = {c.lower() for c in docs.columns}
    columns, back = [], []
    for c in docs.columns:
        name = c
        while name.lower() in ("shard", "slot") or (name != c and name.lower() in taken):
            name += "_"
        is_map = isinstance(docs.schema[c].dataType, MapType)
        columns.append((F.array_sort(F.map_entries(f"`{c}`")) if is_map else F.col(f"`{c}`")).alias(name))
        own = F.col(f"row.`{name}`")
        back.append((F.map_from_entries(own) if is_map else own).alias(name))
    size = utf8_size(F.col(f"row.`{text}`")) + 1
    rows = docs.select(F.struct(*columns).alias("row"))
    total = rows.agg(F.sum(size).alias("b"), F.count("*").alias("n")).first()
    n_rows, n_buckets = total["n"], buckets_for(total["b"], bucket_bytes)
    rows = numbered(rows, seed)
    most = FULLEST * max(bucket_bytes, MIN_CHECKED)
    while True:
        bucket = F.pmod(F.xxhash64(F.lit(seed), "row", "copy"), F.lit(n_buckets)).cast("int")
        # A longer text has to lie in some bucket whatever their number, so it doesn't count here.
        held = F.sum(F.when(size <= most, size))
        fullest = rows.groupBy(bucket).agg(held.alias("b"), F.count("*").alias("n")).filter("n > 1").agg(F.max("b")).first()[0] or 0
        if fullest <= most or n_buckets >= n_rows:
            break
        n_buckets *= 2

    # Where each bucket begins in the global order: prefix sums over groups of buckets, then in each group.
    before = (Window.unboundedPreceding, -1)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("group", F.expr(f"bucket div {GROUP}"))
    counts = materialize(counts, "buckets")
    groups = counts.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(*before)), F.lit(0)).alias("p"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(*before)), F.lit(0))
    offsets = counts.select("bucket", "group", inside.alias("q")).join(groups, "group").select("bucket", (F.col("p") + F.col("q")).alias("first"))

    scattered = rows.select(bucket.alias("bucket"), F.xxhash64(F.lit(seed + 1), "row", "copy").alias("mixed"), "copy", "row")
    scattered = scattered.repartition(partitions_for(docs.sparkSession, total["b"]), "bucket")
    # Rows are sorted in their bucket, and buckets in their task, so the seeded shuffle meets the same arrays in the same order each time.
    full = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("mixed", "copy", "row"))).alias("rows"))
    mixed = full.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    placed = (
        mixed.join(small(offsets, n_buckets), "bucket")
        .select("first", F.posexplode("rows").alias("pos", "item"))
        .select((F.col("first") + F.col("pos")).alias("at"), F.col("item.row").alias("row"))
    )
    shard = F.expr(f"((at + 1) * {n_shards} - 1) div {max(n_rows, 1)}").cast("int")
    placed = placed.select("at", shard.alias("own"), "row")
    slot = F.col("at") - F.expr(f"(own * {n_rows}L) div {n_shards}")
    return placed.select(*back, F.col("own").alias("shard"), slot.alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> str:
    """Write one folder of Parquet files for each shard; rows keep their ``slot``."""
    shuffled.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def op2_external_shuffle(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shuffle and write ``docs``, read the shards back and describe each stored row."""
    spark = docs.sparkSession
    shuffled = external_shuffle(docs, n_shards)
    path = write_shards(shuffled, new_path(spark, "shards"))
    kept = spark.read.schema(shuffled.schema).parquet(path)
    return kept.select(
        "doc_id",
        (utf8_size("text") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
