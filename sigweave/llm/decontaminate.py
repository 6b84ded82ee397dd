"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact similarity.

Every benchmark item of n words is sought in windows of n words. A window and its item share at
least one shingle if they are similar at all, so windows are only made where a document holds a
shingle of an item of that size. A window's 64-bit SimHash is cut into ``BLOCKS`` bytes; by the
pigeonhole principle each fingerprint within the radius differs by at most ``radius // BLOCKS`` bits from
the item's in some byte. The index holds each item under all such bytes, so the equi-join on
(size, block, value) finds them all. Candidates are then verified by exact Jaccard similarity of
weighted word shingles.

Shingles have five words, or all of a shorter item's. They weigh ``1 + ln((1 + items) / (1 + items
with it))``. Nulls: a null text counts as empty and is clean; items without words match nothing.
Repeated rows and items are compared each; of windows that are equally similar the first counts. A very
long text is worked on in stretches of ``STRETCH`` words. Empty tables give no rows. Extra columns pass
by, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, slices, small
from .shingling import shingle_hashes, word_hashes

SIZE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 8
#: At most so many distinct benchmark shingles are held by each task (16 MB); a larger benchmark goes in several passes.
HELD_SHINGLES = 1_000_000
#: Windows of one batch, and words whose bits are summed at once.
PIECE, STRETCH = 2_000, 20_000
#: Bytes of text of a slice, and of an index or item table that may be broadcast.
SLICE, BROADCAST_BYTES = 2 << 20, 16 << 20
SIEVE_BITS = 22


def simhash(words: np.ndarray, weights: np.ndarray | None = None) -> np.uint64:
    """64-bit SimHash of hashed words."""
    spread = words * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    total = bits.sum(axis=0) if weights is None else (bits * weights[:, None]).sum(axis=0)
    return np.packbits(total > 0).view(np.uint64)[0]


def window_simhashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHashes of windows [start, end) of one text's words, by running sums of their bits."""
    spread = words * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(32)
    bits = np.unpackbits(spread.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0)])
    return np.packbits(sums[ends] - sums[starts] > 0, axis=1).view(np.uint64).reshape(-1)


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """The bytes of each fingerprint, as (block number * 256 + value)."""
    at = np.arange(BLOCKS, dtype=np.uint64)
    return (at * np.uint64(256) + ((prints[:, None] >> (at * np.uint64(8))) & np.uint64(255))).astype(np.int64)


@dataclass
class Probe:
    """What tasks need of the benchmark: its shingles, and the item sizes that each occurs in."""

    lengths: tuple[int, ...]  # of shingles
    shingles: dict[int, np.ndarray]  # by length, sorted
    sizes: dict[int, list[tuple[int, ...]]]  # by length and place: sizes of the items that hold it
    sieve: dict[int, np.ndarray]  # by length: which low bits occur at all


def item_rows(benchmark: DataFrame) -> DataFrame:
    """item_id, size, print, shingles (distinct, in order), counts of each: the fingerprints of all items with words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = word_hashes(batch.column(1))
            rows, at = [], 0
            for key, k in zip(batch.column(0).to_pylist(), n.tolist()):
                own = words[at : at + k]
                at += k
                if k:
                    hashes, _ = shingle_hashes(own, np.array([k]), min(SIZE, k))
                    distinct, counts = np.unique(hashes.view(np.int64), return_counts=True)
                    rows.append((key, k, int(simhash(own).view(np.int64)), distinct.tolist(), counts.tolist()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["item_id", "size", "print", "shingles", "counts"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(make, "item_id long, size int, print long, shingles array<long>, counts array<long>")


def probe_of(rows: list) -> Probe:
    held: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    for size, shingles in rows:
        for s in shingles:
            held[min(SIZE, size)][s].add(size)
    shingles = {k: np.array(sorted(v), np.int64) for k, v in held.items()}
    sizes = {k: [tuple(sorted(held[k][s])) for s in shingles[k].tolist()] for k in held}
    sieve = {k: np.zeros(1 << SIEVE_BITS, bool) for k in held}
    for k, s in shingles.items():
        sieve[k][s & ((1 << SIEVE_BITS) - 1)] = True
    return Probe(tuple(sorted(held)), shingles, sizes, sieve)


WINDOWS = "doc_id long, row string, size int, first int, print long, blocks array<long>, shingles binary, counts binary"


def _windows(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    probe: Probe = held.value
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in WINDOWS.split(", ")]
    for part in slices(batches, 2, SLICE):
        keys, row_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
        words, counts = word_hashes(part.column(2))
        base = np.cumsum(counts) - counts
        wanted: dict[tuple[int, int], set[int]] = defaultdict(set)  # (document, size): window starts
        for k in probe.lengths:
            hashes, n = shingle_hashes(words, counts, k)
            hashes = hashes.view(np.int64)
            maybe = np.flatnonzero(probe.sieve[k][hashes & ((1 << SIEVE_BITS) - 1)])
            place = np.minimum(np.searchsorted(probe.shingles[k], hashes[maybe]), len(probe.shingles[k]) - 1)
            exact = probe.shingles[k][place] == hashes[maybe]
            first = np.cumsum(n) - n
            doc = np.searchsorted(first, maybe[exact], side="right") - 1
            for d, i, p in zip(doc.tolist(), (maybe[exact] - first[doc]).tolist(), place[exact].tolist()):
                for size in probe.sizes[k][p]:
                    last = max(0, counts[d] - size)  # a shorter text is one window
                    wanted[d, size].update(range(max(0, min(i - size + k, last)), min(i, last) + 1))
        rows = []
        for (d, size), starts in wanted.items():
            begin = np.array(sorted(starts))
            own, k = words[base[d] : base[d] + counts[d]], min(SIZE, size)
            for stretch in np.split(begin, np.flatnonzero(np.diff(begin // STRETCH)) + 1):
                end = np.minimum(stretch + size, counts[d])
                low, high = int(stretch[0]), int(end[-1])
                prints = window_simhashes(own[low:high], stretch - low, end - low)
                all_hashes, _ = shingle_hashes(own[low:high], np.array([high - low]), k)
                for b, e, fp, blocks in zip((stretch - low).tolist(), (end - low).tolist(), prints.view(np.int64).tolist(), blocks_of(prints).tolist()):
                    distinct, times = np.unique(all_hashes[b : max(b + 1, e - k + 1)].view(np.int64), return_counts=True)
                    rows.append((keys[d], row_ids[d], size, b + low, fp, blocks, distinct.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
                    if len(rows) >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact weighted Jaccard of the window's and the item's shingles."""
    for batch in batches:
        out = []
        for s, n, t, m, w in zip(*(batch.column(i).to_pylist() for i in range(5, 10))):
            s, n, top = np.frombuffer(s, "<i8").tolist(), np.frombuffer(n, "<i8").tolist(), w["top"]
            mine, theirs, weigh = dict(zip(s, n)), dict(zip(t, m)), dict(zip(t, w["each"]))
            shared = sum(min(mine[x], theirs[x]) * weigh[x] for x in mine.keys() & theirs.keys())
            whole = sum(v * weigh.get(x, top) for x, v in mine.items()) + sum(v * weigh[x] for x, v in theirs.items()) - shared
            out.append(shared / whole if whole else 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.float64())], names=["doc_id", "row", "item_id", "first_word", "n_words", "similarity"])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, row: Column | None = None) -> DataFrame:
    """The best window for each leaked item of each row of ``docs``: doc_id, row (its number, or as given), item_id, first_word, n_words, similarity."""
    spark = docs.sparkSession
    items = materialize(item_rows(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    n_items = items.count()
    spread = items.select(F.explode("shingles").alias("s"), "item").groupBy("s").agg(F.count_distinct("item").alias("df"))
    weight = F.lit(1.0) + F.log(F.lit(1.0 + n_items) / (F.lit(1.0) + F.col("df")))
    top = 1.0 + float(np.log((1.0 + n_items) / 2.0))
    flat = items.select("item", "item_id", "size", "print", F.posexplode(F.arrays_zip("shingles", "counts")).alias("at", "s")).select("item", "item_id", "size", "print", "at", F.col("s.shingles").alias("s"), F.col("s.counts").alias("n"))
    weighed = flat.join(spread, "s").groupBy("item", "item_id", "size", "print").agg(F.array_sort(F.collect_list(F.struct("at", "s", "n", weight.alias("w")))).alias("x"))
    items = weighed.select(
        "item", "item_id", "size", F.col("print").alias("item_print"), F.col("x.s").alias("item_shingles"), F.col("x.n").alias("item_counts"), F.struct(F.lit(top).alias("top"), F.col("x.w").alias("each")).alias("weights"),
    )
    items = materialize(items, "item-index")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id().cast("string") if row is None else row).alias("row"), "text")
    total = items.agg(F.sum(F.size("item_shingles"))).first()[0] or 0
    passes = max(1, -(-total // HELD_SHINGLES))
    masks = [m for m in range(256) if m.bit_count() <= radius // BLOCKS]
    found = None
    for turn in range(passes):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn)
        held = spark.sparkContext.broadcast(probe_of([(r["size"], r["item_shingles"]) for r in part.select("size", "item_shingles").toLocalIterator()]))
        windows = rows.mapInArrow(lambda it, held=held: _windows(it, held), WINDOWS)
        keyed = windows.select("*", F.explode("blocks").alias("block")).drop("blocks")
        each = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("i")
        value = F.call_function("shiftrightunsigned", F.col("item_print"), F.col("i") * 8).bitwiseAND(255)
        index = part.select("size", "item", "item_print", each).select("size", "item", "item_print", (F.col("i") * 256 + value).alias("at"), F.explode(F.array(*map(F.lit, masks))).alias("mask"))
        index = index.select("size", F.col("at").bitwiseXOR(F.col("mask")).alias("block"), "item", "item_print")
        near = keyed.join(small(index, 40 * n_items * BLOCKS * len(masks), BROADCAST_BYTES), ["size", "block"])
        # A pair may meet in several blocks: it counts in the first in which it is near enough.
        differing = F.col("print").bitwiseXOR(F.col("item_print"))
        byte = lambda i: F.call_function("shiftrightunsigned", differing, i * 8).bitwiseAND(255)  # noqa: B023, E731
        lowest = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.bit_count(byte(i)) <= radius // BLOCKS))
        near = near.filter((F.bit_count(differing) <= radius) & (lowest == F.expr("block div 256")))
        held_items = part.select("item", "item_id", "item_shingles", "item_counts", "weights")
        near = near.join(small(held_items, 24 * total + 64 * n_items, BROADCAST_BYTES), "item")
        pairs = near.select("doc_id", "row", "item_id", F.col("first").alias("first_word"), F.col("size").alias("n_words"), "shingles", "counts", "item_shingles", "item_counts", "weights")
        similar = pairs.mapInArrow(_similar, "doc_id long, row string, item_id long, first_word int, n_words int, similarity double").filter(F.col("similarity") >= threshold)
        found = similar if found is None else found.unionByName(similar)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("first"), "n_words")).alias("m")
    return found.groupBy("doc_id", "row", "item_id").agg(best).select("doc_id", "row", "item_id", (-F.col("m.first")).alias("first_word"), F.col("m.n_words").alias("n_words"), F.col("m.similarity").alias("similarity"))


def op1_simhash_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark).drop("row").withColumn("similarity", F.round("similarity", 6))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text holds a leaked item, whatever their doc_id."""
    name, digest = free_name(docs, "_digest"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    bad = materialize(leaks(docs, benchmark, row=digest).select(F.col("row").alias(name)).distinct(), "leaked")
    return docs.join(small(bad, bad.count()), digest == F.col(name), "left_anti")
