"""Token-id output: documents in key order, encoded by a public tokenizer, stored in Simple-8b frames.

A file row is a frame: the keys and lengths of some documents in a row, and their ids (with the
end id) as Simple-8b words with block offsets. Frames of a partition are numbered, partitions are
ranges of the key, so file order is key order.

A null or empty text is its end id alone. Repeated keys keep a row each, in order of key, a hash of
the text, and place in the input, so a key that many rows have is split over partitions. A null key
sorts first. A very long text is encoded in parts and makes a frame of its own. An empty table gives
no frames. Extra columns pass by; only the key and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .bpe import encoder
from .common import materialize, new_path, partitions_for, slices, small, utf8_size

#: Partitions are numbered in groups of so many for their prefix sums.
GROUP = 4096
#: A frame is closed once it holds so many ids.
FRAME_IDS = 1 << 20
FRAME = "part int, frame int, n_docs int, n_ids int, keys binary, lengths binary, words binary, first_word binary, escapes binary, first_escape binary"


def append_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by ``end_id``."""
    total = counts + 1
    ends = np.cumsum(total)
    out = np.full(int(total.sum()), end_id, "<u4")
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = ids
    return out, total


def _frames(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, frame = TaskContext.get().partitionId(), 0
    for batch in slices(batches, 1):
        ids, counts = append_end(*encoder(path).encode(batch.column(1)), end_id)
        keys = batch.column(0)
        missing = np.array(keys.is_null())
        keys = keys.fill_null(0).to_numpy().astype("<i8")
        ends = np.cumsum(counts)
        a = 0
        while a < len(keys):
            base = ends[a] - counts[a]
            b = max(a + 1, int(np.searchsorted(ends, base + FRAME_IDS, side="right")))
            words, first_word, escapes, first_escape = simple8b.encode(ids[base : ends[b - 1]])
            stored_keys = np.stack([keys[a:b], missing[a:b].astype("<i8")], axis=1)
            row = [part, frame, b - a, int(ends[b - 1] - base), stored_keys.tobytes(), counts[a:b].astype("<i4").tobytes(), words.astype("<u8").tobytes(), first_word.astype("<i4").tobytes(), escapes.astype("<u8").tobytes(), first_escape.astype("<i4").tobytes()]
            kinds = [pa.int32()] * 4 + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[f.split()[0] for f in FRAME.split(", ")])
            a, frame = b, frame + 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> str:
    total = docs.agg(F.sum(utf8_size(text) + 1)).first()[0]
    order = ["key", "mixed", "place"]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("mixed"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(partitions_for(docs.sparkSession, total), *order).sortWithinPartitions(*order).select("key", "text")
    ordered.mapInArrow(lambda it: _frames(it, tokenizer, end_id), FRAME).write.option("compression", "zstd").parquet(path)
    return path


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "frame", "key", "rel", "n_tokens", "ids_crc32"]
    for batch in batches:
        for i in range(batch.num_rows):
            (r,) = batch.slice(i, 1).to_pylist()
            words, escapes = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["escapes"], "<u8")
            ids = simple8b.decode(words, np.frombuffer(r["first_word"], "<i4"), escapes, r["n_ids"]).astype("<u4")
            lengths = np.frombuffer(r["lengths"], "<i4").astype(np.int64)
            keys, missing = np.frombuffer(r["keys"], "<i8").reshape(-1, 2).T
            ends = np.cumsum(lengths)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["frame"], np.int32)), pa.array(keys, mask=missing.astype(bool)), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=names
            )


def read_token_files(frames: DataFrame) -> DataFrame:
    """A row per document from its files: key, start (ids before it), n_tokens, ids_crc32."""
    sizes = frames.select("part", "frame", "n_ids")
    before, zero = (Window.unboundedPreceding, -1), F.lit(0).cast("long")
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(*before)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("group", F.expr(f"part div {GROUP}"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(*before)), zero).alias("before_group"))
    over = Window.partitionBy("group").orderBy("part").rowsBetween(*before)
    parts = parts.select("part", "group", F.coalesce(F.sum("n").over(over), zero).alias("before_own")).join(groups, "group").select("part", (F.col("before_group") + F.col("before_own")).alias("before_part"))
    first = sizes.select("part", "frame", F.coalesce(F.sum("n_ids").over(inside), zero).alias("before_frame")).join(parts, "part")
    first = materialize(first, "frame-starts")
    rows = frames.mapInArrow(_decoded, "part int, frame int, key long, rel long, n_tokens long, ids_crc32 long")
    start = (F.col("before_part") + F.col("before_frame") + F.col("rel")).alias("start")
    return rows.join(small(first, first.count()), ["part", "frame"]).select("key", start, "n_tokens", "ids_crc32")


def op10_simple8b(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = write_token_files(docs, new_path(spark, "tokens"), tokenizer)
    return read_token_files(spark.read.schema(FRAME).parquet(path)).withColumnRenamed("key", "doc_id")
