"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

The model reads a text as words; each position holds the first and the last subword id of a word.
From the words before, attention gives the probability of the next word's class; the word's
probability in its class is its share of the class's training tokens, interpolated, by the share of
words seen once, with a spelling of its subword ids. So every word, known or not, has a probability.

Classes: the most frequent words and the end token have one each; all others are grouped by topic
and last character. A topic is a cluster of documents by the most frequent words of all training
documents: its start is found on a bounded seeded sample, then its centre moves ``PASSES`` times to the mean of all training documents
that it has. A word's topic is where it occurs most, an unknown word's follows from its subwords. Spellings take all pairs
of subwords of training words: every task holds the ``PAIRS`` most frequent ones, the others are joined to the words that have them. Counts cover all training documents and are joined to batches of documents by word, but
for the ``HEAD`` most frequent words, which every task holds.

Training: a start on a bounded seeded sample, then every window of all training documents is learned from
once on Spark, in ``ROUNDS`` rounds with a share of the windows each: every task takes its own steps from the
last written weights, and the weighted mean of all tasks' weights is written. Scoring: windows of ``WINDOW`` words
that overlap by half score each word once, in masked batches.

Words are maximal runs without ASCII white space, with A-Z lowered, then one end token. Nulls: a
null text is the end token alone; a null doc_id counts as ''. Repeated rows are counted and scored
each; equal texts score alike. A very long text makes a batch alone. An empty table gives no rows;
without training documents all words are unknown. Extra columns pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, partitions_for, release, slices

WINDOW, STRIDE = 16, 8
WIDTH = 16
TOPICS, KINDS = 16, 4
SINGLES = 63
END = SINGLES  # the end token's class
GROUPS = SINGLES + 1  # the first group's
CLASSES = GROUPS + TOPICS * KINDS
#: Rows of the input table for first subwords, as many for last ones, and the end token's.
BUCKETS = 4096
OWN = BUCKETS - 256
#: Documents of the training side, first in hash order, from which topics start; the words that tell them apart; passes over all.
SAMPLE_DOCS, ANCHORS, PASSES = 2_000, 256, 2
#: Words of each batch that are listed at first when anchors are sought.
LISTED_FIRST = 4096
#: Rows of streams, first in hash order, that the weights' start is fitted on.
START_ROWS, START_STEPS = 24, 400
ROUNDS = 2
#: Windows of a step of the start, and of a round.
BATCH, LOT, RATE = 256, 1024, 0.02
#: Bytes of text of a batch of documents, and tokens of a stream.
BATCH_BYTES, STREAM_TOKENS = 8 << 20, 1 << 16
#: Frequent words that every task holds, at most.
HEAD = 1 << 17
#: Frequent pairs of subword ids in words, which every task holds.
PAIRS = 1 << 19
SCORE_ROWS = 128
#: Windows of a part of a step.
STEP_ROWS = 128
#: Rows of a block of sums over rows of products.
CROSS_ROWS = 256


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words end to end, and the number of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    solid = np.ones(256, bool)
    solid[[32, 9, 10, 11, 12, 13]] = False
    keep = solid.take(data)
    starts = keep.copy()
    starts[1:] &= ~keep[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    starts[heads] = keep[heads]
    ends = keep  # where a word's last byte is
    kept = lower.take(data[keep])
    ends[:-1] &= ~keep[1:] | starts[1:]
    at, last = np.flatnonzero(starts), np.flatnonzero(ends)
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(last - at + 1, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.diff(np.searchsorted(at, bounds))


def is_held_out(key: int | None) -> bool:
    return zlib.crc32(str("" if key is None else key).encode()) % 10 == 0


@dataclass
class Topics:
    """Clusters of documents by how often ``anchors`` occur in them."""

    anchors: pa.Array
    centres: np.ndarray  # [TOPICS, anchors]

    def profiles(self, words: pa.Array, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        k = max(1, len(self.anchors))
        which = pc.fill_null(pc.index_in(words, self.anchors), -1).to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, np.int64)
        hit = which >= 0
        doc = np.repeat(np.arange(len(sizes)), sizes)[hit]
        counts = np.sqrt(np.bincount(doc * k + which[hit], minlength=len(sizes) * k).reshape(len(sizes), k))
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)

    def of(self, words: pa.Array, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.argmax(self.profiles(words, codes, sizes) @ self.centres.T, axis=1)


def find_topics(texts: pa.Array, anchors: pa.Array | None = None, seed: int = 9) -> Topics:
    """Topics come of spherical k-means over the texts' profiles; anchors are, unless given, their most frequent words."""
    flat, sizes = words_of(texts)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    top = np.lexsort((np.arange(len(counts)), -counts))[:ANCHORS]
    anchors = coded.dictionary.take(pa.array(top)) if anchors is None else anchors
    topics = Topics(anchors, np.zeros((TOPICS, max(1, len(anchors)))))
    x = topics.profiles(coded.dictionary, codes, sizes)
    x = x[x.any(axis=1)]
    if not len(x):
        return topics
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    for _ in range(TOPICS - 1):  # far apart at first
        far = np.maximum(1e-12, 1 - np.max(x @ np.array(centres).T, axis=1)) ** 2
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
    centres = np.array(centres)
    for _ in range(20):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == z].sum(axis=0) if (own == z).any() else centres[z] for z in range(TOPICS)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    topics.centres = centres
    return topics


BATCHES = "batch long, keys array<long>, sizes array<int>, codes binary, packed binary, n_words int, counts binary"


def counts_of(words: pa.Array, codes: np.ndarray, keys: list, sizes: np.ndarray, topics: Topics | None) -> np.ndarray:
    """How often each word occurs in training texts, and in which topic most (0 without topics)."""
    n, train = len(words), np.repeat(np.array([not is_held_out(k) for k in keys], bool), sizes)
    if topics is None:
        return np.stack([np.bincount(codes[train], minlength=n), np.zeros(n, np.int64)]).astype("<i4")
    topic = np.repeat(topics.of(words, codes, sizes), sizes)
    by_topic = np.bincount(codes[train].astype(np.int64) * TOPICS + topic[train], minlength=n * TOPICS).reshape(n, TOPICS)
    return np.stack([by_topic.sum(axis=1), by_topic.argmax(axis=1)]).astype("<i4")


def _batches(batches: Iterator[pa.RecordBatch], topics: Topics | None = None) -> Iterator[pa.RecordBatch]:
    """A row for some documents: which words they have (codes into ``packed``), and ``counts`` as of ``counts_of``."""
    batch_id = TaskContext.get().partitionId() << 36
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    names = [f.split()[0] for f in BATCHES.split(", ")]
    for part in slices(batches, 1, BATCH_BYTES):
        keys = part.column(0).to_pylist()
        flat, sizes = words_of(part.column(1))
        coded = flat.dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        # Frequent words have low codes, which compress well.
        order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
        place = np.empty(n, "<i4")
        place[order] = np.arange(n)
        codes, held_words = place[codes], coded.dictionary.take(pa.array(order))
        counts = counts_of(held_words, codes, keys, sizes, topics)
        held_words = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), held_words.cast(pa.string()))
        packed = [pa.compress(x, "zstd", asbytes=True) for x in (codes.tobytes(), pc.binary_join(held_words, "\n")[0].as_buffer())]
        row = [[batch_id], [keys], [sizes.astype(np.int32)], packed[:1], packed[1:], [n], [counts.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=names)
        batch_id += 1


def unpacked(packed: pa.Scalar, n: int) -> pa.Array:
    return parted(pa.CompressedInputStream(pa.BufferReader(packed.as_buffer()), "zstd").read(), n) if n else pa.array([], pa.string())


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, list, np.ndarray]]:
    """Each row of ``BATCHES`` as a batch, and its words, codes, keys and sizes."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
            sizes = row["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
            codes = np.frombuffer(pa.decompress(row["codes"].as_py(), int(4 * sizes.sum()), "zstd", asbytes=True), "<i4")
            yield batch.slice(i, 1), unpacked(row["packed"], row["n_words"].as_py()), codes, row["keys"].as_py(), sizes


def _recounted(batches: Iterator[pa.RecordBatch], topics: Topics) -> Iterator[pa.RecordBatch]:
    """batch, packed, n_words, and ``counts`` with the topics."""
    for row, words, codes, keys, sizes in opened(batches):
        counts = counts_of(words, codes, keys, sizes, topics).tobytes()
        yield pa.RecordBatch.from_arrays([row.column(row.schema.get_field_index(c)) for c in ("batch", "packed", "n_words")] + [pa.array([counts], pa.binary())], names=["batch", "packed", "n_words", "counts"])


def trained_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of each of some rows (packed, n_words, counts), and how often training texts have them."""
    for batch in batches:
        for packed, n, counts in zip(*batch.columns):
            yield unpacked(packed, n.as_py()), np.frombuffer(counts.as_buffer(), "<i4").reshape(2, -1)[0].astype(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """The ``first`` words that occur most in each batch's training texts, and ``floor``, which no other word of it exceeds; it has a row of its own, without a word."""
    for words, count in trained_words(batches):
        top = np.argsort(-count, kind="stable")[:first]
        floor = int(count[top[-1]]) if len(top) < len(count) else 0
        columns = [pa.concat_arrays([words.take(pa.array(top)), pa.nulls(1, pa.string())]), pa.array(np.append(count[top], 0)), pa.array(np.full(len(top) + 1, floor))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "floor"])


def _told(batches: Iterator[pa.RecordBatch], among: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """How often each batch's training texts have each word, or those ``among`` some."""
    for words, count in trained_words(batches):
        at = np.flatnonzero(count if among is None else count * pc.is_in(words, among).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(count[at])], names=["word", "n"])


def find_anchors(batches: DataFrame) -> pa.Array:
    """The words that occur most in all training texts, the least of equals first.

    Each batch lists its most frequent words. Their sums are lower bounds, and with the floors of the batches that don't list a word
    upper ones; only words whose upper bound reaches the least of the highest lower bounds are counted in all batches."""
    rows, first = batches.select("packed", "n_words", "counts"), LISTED_FIRST
    bounds = rows.mapInArrow(lambda it: _frequent(it, first), "word string, n long, floor long").groupBy("word").agg(F.sum("n").alias("low"), F.sum("floor").alias("own"))
    bounds = materialize(bounds, "word-bounds")
    total = bounds.filter("word is null").agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    best = [r[0] for r in bounds.filter("word is not null and low > 0").select("low").orderBy(F.desc("low")).limit(ANCHORS).collect()]
    least = best[-1] if len(best) == ANCHORS else 1
    near = bounds.filter("word is not null").filter(F.col("low") + total - F.col("own") >= least).select("word")
    # A word that no batch lists may be as frequent where the floors are high, and many may be near: then all are counted.
    among = None
    if total < least and near.count() <= 64 * ANCHORS:
        among = pa.array([r[0] for r in near.collect()], pa.string())
    release(bounds)
    counted = rows.mapInArrow(lambda it: _told(it, among), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return pa.array([r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(ANCHORS).collect()], pa.string())


def _drawn(batches: Iterator[pa.RecordBatch], topics: Topics) -> Iterator[pa.RecordBatch]:
    """Of this task's training texts: how many each topic has, and the sums of their profiles."""
    n, sums, seen = np.zeros(TOPICS), np.zeros(topics.centres.shape), 0
    for _, words, codes, keys, sizes in opened(batches):
        x = topics.profiles(words, codes, sizes)
        x = x[np.array([not is_held_out(k) for k in keys], bool) & x.any(axis=1)]
        own = np.eye(TOPICS)[np.argmax(x @ topics.centres.T, axis=1)]
        n, sums, seen = n + own.sum(axis=0), sums + own.T @ x, seen + len(x)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([np.append(n, sums).tobytes()], pa.binary())], names=["seen", "weights"])


def moved(batches: DataFrame, topics: Topics) -> Topics:
    """``topics`` with centres at the mean profiles of all training texts that each has."""
    shape, rows = "seen long, weights binary", batches.select("keys", "sizes", "codes", "packed", "n_words")
    spread = max(1, int(rows.rdd.getNumPartitions() ** 0.5))  # in two steps, so that no task adds up all tasks' sums
    for _, raw in rows.mapInArrow(lambda it: _drawn(it, topics), shape).repartition(spread).mapInArrow(_summed, shape).coalesce(1).mapInArrow(_summed, shape).collect():
        n, sums = np.split(np.frombuffer(raw), [TOPICS])
        sums = sums.reshape(topics.centres.shape)
        topics = Topics(topics.anchors, np.where(n[:, None] > 0, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), topics.centres))
    return topics


def kinds_of(words: pa.Array) -> np.ndarray:
    """0 to 3: the last character is a full stop, a comma, a letter, another."""
    last = pc.utf8_slice_codeunits(words, -1)
    out = np.full(len(words), 3)
    for kind, found in enumerate((pc.equal(last, "."), pc.equal(last, ","), pc.utf8_is_alpha(last))):
        out[found.to_numpy(zero_copy_only=False)] = kind
    return out


#: Words of a batch that fall in one bucket by hash, and for each its code in the batch, how often it occurs in training texts, and its topic.
LISTED, ENTRY = "bucket int, of long, words string, entries binary", np.dtype([("place", "<i4"), ("n", "<i4"), ("topic", "<i4")])
#: ``places``: the batches that have the word, and its code in each, as ``PLACES``.
TYPES = "word string, count long, topic int, ids array<int>, places binary"
PLACES = np.dtype([("of", "<i8"), ("place", "<i4")])


def blobs(records: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``records`` between ``bounds``."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * records.itemsize), pa.py_buffer(records.tobytes())]).cast(pa.binary())


def parted(raw: bytes, n: int) -> pa.Array:
    """The ``n`` words that ``raw`` holds, a line each."""
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    offsets = np.concatenate([[0], breaks - np.arange(len(breaks)), [len(data) - len(breaks)]])[: n + 1]
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[data != 10])])


def hashed(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, by its bytes alone."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    starts = (bounds[:-1] - bounds[0]).astype(np.int64)
    within = np.arange(len(data)) - np.repeat(starts, np.diff(bounds))
    h = np.add.reduceat((data + np.uint64(1)) * np.random.default_rng(3).integers(1 << 62, size=64, dtype=np.uint64)[within & 63], starts)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)


def _listed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of each batch, a row for each bucket of them."""
    for batch in batches:
        for of, packed, n, counts in zip(*batch.columns):
            if not (n := n.as_py()):
                continue
            words = parted(pa.CompressedInputStream(pa.BufferReader(packed.as_buffer()), "zstd").read(), n)
            bucket = hashed(words, buckets).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            bounds = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), n)
            entries = np.empty(n, ENTRY)
            entries["place"] = order
            entries["n"], entries["topic"] = np.frombuffer(counts.as_buffer(), "<i4").reshape(2, n)[:, order]
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.take(pa.array(order))), "\n")
            yield pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]]), pa.array(np.full(len(lines), of.as_py())), lines, blobs(entries, bounds)], names=["bucket", "of", "words", "entries"])


def _spelled(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each word of some buckets: what it counts in all batches, its subword ids, as it stands after a space, and where it is."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    found = pa.Table.from_batches(found)
    entries = found["entries"].to_pylist()
    of = np.repeat(found["of"].to_numpy(), [len(x) // ENTRY.itemsize for x in entries])
    entries = np.frombuffer(b"".join(entries), ENTRY)
    place, n, topic = (entries[c] for c in ENTRY.names)
    coded = parted("\n".join(found["words"].to_pylist()).encode(), len(entries)).dictionary_encode()
    codes = coded.indices.to_numpy()
    del found
    order = np.argsort(codes, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
    n, topic = n[order].astype(np.int64), topic[order]
    count, most = np.add.reduceat(n, bounds[:-1]), np.maximum.reduceat(n * TOPICS + topic, bounds[:-1]) % TOPICS
    places = np.empty(len(order), PLACES)
    places["of"], places["place"] = of[order], place[order]
    places = blobs(places, bounds)
    words = pa.RecordBatch.from_arrays([coded.dictionary, pa.array(count), pa.array(most.astype(np.int32)), places], names=["word", "count", "topic", "places"])
    for part in slices(iter([words]), 0):
        ids, n = encoder(path).encode(pc.binary_join_element_wise("", part.column(0), " "))
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*part.columns[:3], ids, part.column(3)], names=[f.split()[0] for f in TYPES.split(", ")])


#: Kinds of statistics: words by the subword id that they begin with, and by topic; later ids (or a word's end) by topic;
#: pairs of ids that follow each other; tokens and words seen once of each group; tokens of each id.
FIRST, LATER, PAIR, TOKENS, ONCE, USED = range(6)


def followers(ids: np.ndarray, n: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Each subword id of words end to end, and the one after it in its word, or ``stop``."""
    after = np.append(ids[1:], stop)
    after[np.cumsum(n) - 1] = stop
    return ids.astype(np.int64), after.astype(np.int64)


def _statistics(batches: Iterator[pa.RecordBatch], singles: pa.Array, n_ids: int) -> Iterator[pa.RecordBatch]:
    sizes = {FIRST: n_ids * TOPICS, LATER: (n_ids + 1) * TOPICS, TOKENS: TOPICS * KINDS, ONCE: TOPICS * KINDS, USED: n_ids}
    held = {k: np.zeros(n, np.int64) for k, n in sizes.items()}

    def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for part in slices(batches, 0):
        part = part.filter(pc.greater(part.column(1), 0))
        if not part.num_rows:
            continue
        count, topic = part.column(1).to_numpy(), part.column(2).to_numpy()
        ids, n = part.column(3).flatten().to_numpy(), pc.list_value_length(part.column(3)).to_numpy()
        one, after = followers(ids, n, n_ids)
        held[FIRST] += np.bincount(one[np.cumsum(n) - n] * TOPICS + topic, minlength=sizes[FIRST])
        held[LATER] += np.bincount(after * TOPICS + np.repeat(topic, n), minlength=sizes[LATER])
        held[USED] += np.bincount(ids, weights=np.repeat(count, n), minlength=n_ids).astype(np.int64)
        yield out(PAIR, *np.unique(one * (n_ids + 1) + after, return_counts=True))
        grouped = ~pc.is_in(part.column(0), singles).to_numpy(zero_copy_only=False)
        group = topic * KINDS + kinds_of(part.column(0))
        held[TOKENS] += np.bincount(group[grouped], weights=count[grouped], minlength=sizes[TOKENS]).astype(np.int64)
        held[ONCE] += np.bincount(group[grouped & (count == 1)], minlength=sizes[ONCE])
    for kind, values in held.items():
        at = np.flatnonzero(values)
        yield out(kind, at, values[at])


def looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ``values`` of ``keys`` among the sorted ``known`` ones; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], np.float32(0))


class Words:
    """What follows from the counts: spellings, groups, and the input rows of subword ids."""

    def __init__(self, singles: pa.Array, statistics: tuple, pairs: tuple, n_ids: int, totals: tuple | None = None):
        kinds, keys, n = statistics
        sizes = {FIRST: n_ids * TOPICS, LATER: (n_ids + 1) * TOPICS, TOKENS: TOPICS * KINDS, ONCE: TOPICS * KINDS, USED: n_ids}
        held = {k: np.bincount(keys[kinds == k], weights=n[kinds == k], minlength=size) for k, size in sizes.items()}
        self.singles, self.n_ids = singles, n_ids

        def by_topic(counts: np.ndarray) -> np.ndarray:
            """Shares in each topic, which lean on the shares in all topics together."""
            counts = counts.reshape(-1, TOPICS)
            whole = counts.sum(axis=1, keepdims=True) + 0.5
            whole /= whole.sum()
            return ((counts + 20 * whole) / (counts.sum(axis=0) + 20)).astype(np.float32)

        self.first, self.later = by_topic(held[FIRST]), by_topic(held[LATER])
        order = np.argsort(pairs[0])
        self.pairs, self.times = pairs[0][order], pairs[1][order].astype(np.float32)
        # How often each id occurs in words, and with how many others behind it: of ``pairs``, or where these aren't all, by ``totals`` (id, n, ways).
        first, n, ways = (self.pairs // (n_ids + 1), self.times, np.ones(len(self.pairs))) if totals is None else totals
        self.before = np.maximum(np.bincount(first, weights=n, minlength=n_ids), 1e-9).astype(np.float32)
        self.ways = np.bincount(first, weights=ways, minlength=n_ids).astype(np.float32)
        self.tokens = held[TOKENS]
        self.once = held[ONCE] + 0.5
        self.novel = self.once / (held[TOKENS] + 1)  # the share that words not met before may have
        rank = np.argsort(-held[USED], kind="stable")
        self.row = (OWN + np.arange(n_ids) % (BUCKETS - OWN)).astype(np.int32)
        self.row[rank[:OWN]] = np.arange(min(OWN, n_ids))

    def pairs_of(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each subword id and the one after it, or the end; their pair; and how often words have it, as far as it is held."""
        one, after = followers(ids, n, self.n_ids)
        pair = one * (self.n_ids + 1) + after
        return one, after, pair, looked_up(pair, self.pairs, self.times)

    def spelled(self, ids: np.ndarray, n: np.ndarray, more: tuple | None = None) -> np.ndarray:
        """log10 of each word's probability by its subword ids, in each topic ([words, TOPICS]): of the first id, and of
        each next one or the end after the one before it, by absolute discounting of pairs. ``more``: pairs that are not held, in order, and how often words have them."""
        one, after, pair, times = self.pairs_of(ids, n)
        if more is not None:
            times = np.maximum(times, looked_up(pair, *more))
        own, left = np.maximum(times - np.float32(0.5), 0) / self.before[one], np.minimum(np.float32(1), np.where(self.ways[one] > 0, np.float32(0.5) * self.ways[one] / self.before[one], np.float32(1)))
        p = self.later[after] * left[:, None]
        p += own[:, None]
        begin = np.cumsum(n) - n
        return np.log10(self.first[ids[begin]]).astype(np.float64) + np.add.reduceat(np.log10(p).astype(np.float64), begin, axis=0)

    def features(self, words: pa.Array, count: np.ndarray, topic: np.ndarray, ids: np.ndarray, n: np.ndarray, more: tuple | None = None) -> tuple[np.ndarray, ...]:
        """class, input rows of the first and the last subword, and log10 of the probability in the class, of each word."""
        begin = np.cumsum(n) - n
        spelled = self.spelled(ids, n, more)
        kind = kinds_of(words)
        likely = spelled + np.log10(self.once.reshape(TOPICS, KINDS).T[kind])
        topic = np.where(count > 0, topic, likely.argmax(axis=1))
        group = topic * KINDS + kind
        spelling = np.take_along_axis(spelled, topic[:, None].astype(np.int64), axis=1)[:, 0]
        share = (1 - self.novel[group]) * count / np.maximum(self.tokens[group], 1)
        inside = np.log10(share + self.novel[group] * 10.0 ** np.maximum(spelling, -300))
        single = pc.fill_null(pc.index_in(words, self.singles), -1).to_numpy(zero_copy_only=False)
        klass = np.where(single >= 0, single, GROUPS + group)
        return klass.astype(np.int32), self.row[ids[begin]], self.row[ids[begin + n - 1]] + BUCKETS, np.where(single >= 0, 0.0, inside)


#: ``code``: class, and input rows of the first and the last subword, of 16 bits each.
FEATURES = "word string, count long, code long, inside float"
#: Some words of a batch, as ``FOUND``.
LOCATED, FOUND = "of long, found binary", np.dtype([("place", "<i4"), ("inside", "<f4"), ("count", "<i8"), ("code", "<i8")])
#: Places that a task gathers by batch at once.
LOCATED_ROWS = 1 << 20


def _asked(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Each word's pairs that tasks don't hold."""
    for part in slices(batches, 0):
        if not part.num_rows:
            continue
        n = pc.list_value_length(part.column(1)).to_numpy().astype(np.int64)
        _, _, pair, times = held.value.pairs_of(part.column(1).flatten().to_numpy(), n)
        at = np.flatnonzero(times == 0)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)[at])), pa.array(pair[at])], names=["word", "key"])


def _featured(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 0):
        if not part.num_rows:
            continue
        more = part.column(4).flatten()
        key, at = np.unique(more.field(0).to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
        more = (key, more.field(1).to_numpy(zero_copy_only=False)[at].astype(np.float32)) if len(key) else None
        part = pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != 4], names=[c for i, c in enumerate(part.schema.names) if i != 4])
        count = part.column(1).to_numpy()
        n = pc.list_value_length(part.column(3)).to_numpy().astype(np.int64)
        klass, a, b, inside = held.value.features(part.column(0), count, part.column(2).to_numpy(), part.column(3).flatten().to_numpy(), n, more)
        code = klass.astype(np.int64) << 32 | a.astype(np.int64) << 16 | b
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code), pa.array(inside.astype(np.float32)), *part.columns[4:]], names=[f.split()[0] for f in FEATURES.split(", ")] + ["places"] * (part.num_columns - 4))


def _located(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """The features of words, gathered by the batches that have these words."""
    ofs, found = [], []

    def gathered() -> pa.RecordBatch:
        of, rows = np.concatenate(ofs), np.concatenate(found)
        order = np.argsort(of, kind="stable")
        of = of[order]
        bounds = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        return pa.RecordBatch.from_arrays([pa.array(of[bounds[:-1]]), blobs(rows[order], bounds)], names=["of", "found"])

    for part in _featured(batches, held):
        times = pc.binary_length(part.column(4)).to_numpy() // PLACES.itemsize
        places = np.frombuffer(b"".join(part.column(4).to_pylist()), PLACES)
        rows = np.empty(len(places), FOUND)
        rows["place"] = places["place"]
        for c in ("inside", "count", "code"):
            rows[c] = np.repeat(part[c].to_numpy(), times)
        ofs.append(places["of"])
        found.append(rows)
        if sum(map(len, found)) >= LOCATED_ROWS:
            yield gathered()
            ofs.clear()
            found.clear()
    if found:
        yield gathered()


STREAMS = "batch long, piece int, keys array<long>, held array<boolean>, sizes array<int>, known array<int>, base array<double>, inside array<double>, klass binary, rows binary"


def stream_rows(batch: pa.Table, found: pa.Table, head: tuple, total: int, distinct: int, ends: int) -> pa.Table:
    """The token streams of one batch's documents (each closed by the end token), and what of their scores needs no context."""
    keys, sizes = batch["keys"][0].as_py(), np.array(batch["sizes"][0].as_py(), np.int64)
    codes = np.frombuffer(pa.decompress(batch["codes"][0].as_py(), int(4 * sizes.sum()), "zstd", asbytes=True), "<i4")
    n = int(codes.max(initial=-1)) + 1  # each code is used
    words = parted(pa.CompressedInputStream(pa.BufferReader(batch["packed"][0].as_buffer()), "zstd").read(), n)
    of = [np.zeros(n, k) for k in (np.int64, np.int64, np.float32)]  # count, code, inside
    in_head = pc.fill_null(pc.index_in(words, head[0]), -1).to_numpy()
    at = np.flatnonzero(in_head >= 0)
    for x, values in zip(of, head[1:]):
        x[at] = values[in_head[at]]
    rows = np.frombuffer(b"".join(found["found"].to_pylist()), FOUND)
    for x, c in zip(of, ("count", "code", "inside")):
        x[rows["place"]] = rows[c]
    stops = np.cumsum(sizes + 1)
    is_word = np.ones(len(codes) + len(sizes), bool)
    is_word[stops - 1] = False
    blank = (ends, END << 32 | 2 * BUCKETS << 16 | 2 * BUCKETS, 0.0)
    count, code, inside = (np.full(len(is_word), v, x.dtype) for x, v in zip(of, blank))
    for x, y in zip((count, code, inside), of):
        x[is_word] = y[codes]
    klass, reads = (code >> 32).astype(np.uint8), np.stack([code >> 16 & 0xFFFF, code & 0xFFFF]).astype("<u2")
    base = np.log10(count + 0.1) - np.log10(total + 0.1 * (distinct + 1))
    starts = stops - sizes - 1
    known, bases, insides = (np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, inside.astype(np.float64)))
    held = [is_held_out(k) for k in keys]
    out, i, piece = [], 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + STREAM_TOKENS, side="right")))
        s = slice(int(starts[i]), int(stops[j - 1]))
        out.append((batch["batch"][0].as_py(), piece, keys[i:j], held[i:j], (sizes[i:j] + 1).astype(np.int32), known[i:j].astype(np.int32), bases[i:j], insides[i:j], klass[s].tobytes(), reads[:, s].tobytes()))
        i, piece = j, piece + 1
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
    pa.default_memory_pool().release_unused()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names=[f.split()[0] for f in STREAMS.split(", ")])


def rowwise(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``x @ weights`` as one product of all rows."""
    return (x.reshape(-1, x.shape[-1]) @ weights).reshape(*x.shape[:-1], -1)


def crossed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y``, as a sum over blocks of ``CROSS_ROWS`` rows, which stay in the nearest cache."""
    n = len(x) // CROSS_ROWS * CROSS_ROWS
    blocks = lambda m: m[:n].reshape(-1, CROSS_ROWS, m.shape[1])
    out = (blocks(x).transpose(0, 2, 1) @ blocks(y)).sum(0)
    return out + x[n:].T @ y[n:] if n < len(x) else out


class Attention:
    """One causal self-attention layer and a feed-forward layer over embeddings of subword ids, in float32."""

    def __init__(self, prior: np.ndarray, seed: int = 6):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        d = WIDTH
        emb = (rng.standard_normal((2 * BUCKETS + 1, d)) * 0.2).astype(np.float32)
        self.p = {"emb": emb, "pos": make(WINDOW, d), "q": make(d, d), "k": make(d, d), "v": make(d, d), "own": make(d, 2 * d), "seen": make(d, 2 * d), "b": np.zeros(2 * d, np.float32), "down": make(2 * d, d), "out": make(d, CLASSES) * np.float32(0.1), "bias": prior.astype(np.float32)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), np.float32(-1e9)), 1)[WINDOW - STRIDE :]

    def forward(self, x: np.ndarray, keep: bool = False):
        """Hidden states after the last ``STRIDE`` positions of ``x`` (input rows of first and last subwords, [2, batch, WINDOW])."""
        p = self.p
        e = p["emb"].take(x[0], axis=0)
        e += p["emb"].take(x[1], axis=0)
        e += p["pos"]
        t = np.ascontiguousarray(e[:, WINDOW - STRIDE :])
        q, kv = rowwise(t, p["q"] / np.float32(np.sqrt(WIDTH))), rowwise(e, np.concatenate([p["k"], p["v"]], axis=1))
        y, a, both, r = self.after(t, q, kv)
        return (y, (e, t, q, kv, a, both, r)) if keep else y

    def states(self, rows: np.ndarray) -> np.ndarray:
        """As ``forward`` of the windows that begin at each ``STRIDE``-th place of ``rows`` ([2, places]), which share what
        each place is embedded and projected to."""
        p = self.p
        e = p["emb"].take(rows[0], axis=0)
        e += p["emb"].take(rows[1], axis=0)
        both = np.concatenate([p["k"], p["v"]], axis=1)
        kv = e @ both
        kv = np.lib.stride_tricks.sliding_window_view(kv, WINDOW, axis=0)[::STRIDE].transpose(0, 2, 1)
        t = e[WINDOW - STRIDE :].reshape(-1, STRIDE, WIDTH) + p["pos"][WINDOW - STRIDE :]
        return self.after(t, rowwise(t, p["q"] / np.float32(np.sqrt(WIDTH))), kv, p["pos"] @ both)[0]

    def after(self, t: np.ndarray, q: np.ndarray, kv: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """From late places, queries, and keys and values ([batch, WINDOW, 2 * WIDTH]), to all of which ``more`` is added."""
        p = self.p
        a = q @ kv[..., :WIDTH].transpose(0, 2, 1)
        if more is not None:
            a += rowwise(q, more[:, :WIDTH].T)
        a += self.mask
        if a.size and a.max() > 60:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        a *= 1 / (rowwise(a, np.ones((WINDOW, 1), a.dtype)) + np.float32(1e-30))
        both = np.empty((*t.shape[:-1], 2 * WIDTH), t.dtype)  # the place's own, and what it sees
        both[..., :WIDTH], c = t, both[..., WIDTH:]
        np.matmul(a, kv[..., WIDTH:], out=c)
        if more is not None:
            c += rowwise(a, more[:, WIDTH:])
        r = rowwise(both, np.concatenate([p["own"], p["seen"]]))
        r += p["b"]
        np.maximum(r, 0, out=r)
        y = rowwise(r, p["down"])
        y += t
        return y, a, both, r

    def powers(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of states ``y`` ([n, width]): each class's odds before its bias, to a factor of the state; what the biases make of
        odds; and the state's sum of both. So no pass over all classes is spent on biases."""
        z, lift = y @ self.p["out"], np.exp(self.p["bias"])
        if len(z) and z.max() > 60:
            z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        return z, lift, z @ lift

    def log_probs(self, y: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of target classes after states ``y`` ([n, width])."""
        z, lift, sums = self.powers(y)
        return np.log(z[np.arange(len(target)), target] / sums) + self.p["bias"][target]

    def step(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of weighted cross-entropy over targets [batch, STRIDE], summed over parts that fit a core's cache."""
        loss, g, share, emb = 0.0, {}, weight / weight.sum(), self.p["emb"]
        de = np.empty((len(target), WINDOW, WIDTH), emb.dtype)
        for a in range(0, len(target), STEP_ROWS):
            s = slice(a, a + STEP_ROWS)
            lost, more = self.slopes(x[:, s], target[s], share[s], de[s])
            loss += lost
            for name, grad in more.items():
                g[name] = g[name] + grad if name in g else grad
        g["pos"] = de.sum(0)
        # Added up by pairs of numbers, as complex ones: half as many places.
        pair = np.result_type(emb.dtype, np.complex64)
        sums, flat = np.zeros(emb.size // 2, pair), de.reshape(-1).view(pair)
        for rows in x:
            at = np.multiply(rows, WIDTH // 2, dtype=np.intp)[..., None] + np.arange(WIDTH // 2)
            np.add.at(sums, at.reshape(-1), flat)
        g["emb"] = sums.view(emb.dtype).reshape(emb.shape)
        return loss, g

    def slopes(self, x: np.ndarray, target: np.ndarray, share: np.ndarray, de: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Of some windows, whose targets count ``share`` each: loss and gradients of all but embeddings; slopes at what is read go to ``de``."""
        p, scale = self.p, np.float32(1 / np.sqrt(WIDTH))
        y, (e, t, q, kv, a, both, r) = self.forward(x, keep=True)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        y, t = flat(y), flat(t)
        z, lift, sums = self.powers(y)
        w = share.reshape(-1)
        row, own = np.arange(len(w)), target.reshape(-1)
        chosen = z[row, own]
        loss = float(-(np.log(chosen * lift[own] / sums + 1e-20) * w).sum())
        z[row, own] = chosen - sums / lift[own]
        w = (w / sums)[:, None]  # with this and ``lift``, ``z`` would be the slopes
        g = {"out": crossed(y * w, z) * lift, "bias": (w[:, 0] @ z) * lift}
        dy = z @ (p["out"] * lift).T
        dy *= w
        r = flat(r)
        g["down"] = crossed(r, dy)
        du = dy @ p["down"].T
        du *= r > 0
        g["own"], g["seen"] = np.split(crossed(flat(both), du), 2)
        g["b"] = np.ones(len(du), du.dtype) @ du
        du = du @ np.concatenate([p["own"], p["seen"]]).T
        c, dc = both[..., WIDTH:], du.reshape(both.shape)[..., WIDTH:]
        ds = dc @ kv[..., WIDTH:].transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", dc, c)[..., None]
        ds *= a
        dq, dkv = flat(ds @ kv[..., :WIDTH]), np.empty_like(kv)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dc, out=dkv[..., WIDTH:])
        dkv = flat(dkv)
        g["q"] = crossed(t, dq) * scale
        g["k"], g["v"] = np.split(crossed(flat(e), dkv), 2, axis=1)
        np.matmul(dkv, np.concatenate([p["k"], p["v"]], axis=1).T, out=flat(de))
        dy += du[:, :WIDTH]
        dy += dq @ (p["q"].T * scale)
        de[:, WINDOW - STRIDE :] += dy.reshape(c.shape)
        return loss, g

    def fit(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int | None, rate: float = RATE, seed: int = 7) -> list[float]:
        """Adam over ``steps`` random batches of windows; without that over each window once, in random order. Returns the losses."""
        rng, m, s, losses = np.random.default_rng(seed), {}, {}, []
        lots = [] if steps else np.array_split(rng.permutation(len(target)), -(-len(target) // LOT))
        steps = steps or len(lots)
        for t in range(1, steps + 1):
            at = lots[t - 1] if len(lots) else rng.integers(0, x.shape[1], BATCH)
            loss, grads = self.step(x.take(at, axis=1), target.take(at, axis=0), weight.take(at, axis=0))
            losses.append(loss)
            now = rate * min(1.0, t / 40, max(0.05, 1.2 - t / steps))
            for name, grad in grads.items():
                if t == 1:
                    m[name], s[name] = np.zeros_like(grad), np.zeros_like(grad)
                mean, square = m[name], s[name]
                mean *= 0.9
                mean += 0.1 * grad
                square *= 0.99
                grad *= grad
                grad *= 0.01
                square += grad
                by = np.sqrt(square, out=grad)
                by *= 1 / np.sqrt(1 - 0.99**t)
                by += 1e-8
                np.divide(mean, by, out=by)
                by *= now / (1 - 0.9**t)
                self.p[name] -= by
        return losses

    def raw(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in self.p.values())

    def load(self, raw: bytes) -> None:
        flat, at = np.frombuffer(raw, "<f4"), 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).copy()
            at += x.size


def windows(sizes: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For texts of ``sizes`` tokens end to end, the places [windows, WINDOW] whose tokens each window reads (-1: none,
    before its text) and the places [windows, STRIDE] that it scores (-1: none, behind its text). Each place is scored once.
    ``chosen``: of which windows, if not all."""
    n = -(-sizes // STRIDE)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    if chosen is not None:
        text, at = text[chosen], at[chosen]
    begin, end = (ends - sizes)[text, None], ends[text, None]
    at = begin + at[:, None] * STRIDE
    before, own = at + np.arange(STRIDE - WINDOW - 1, STRIDE - 1), at + np.arange(STRIDE)
    return np.where(before >= begin, np.minimum(before, end - 1), -1), np.where(own < end, own, -1)


def inputs(rows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The input rows ([2, windows, WINDOW]) of the places ``before``; the end token's before a text."""
    return np.append(rows, np.full((2, 1), 2 * BUCKETS, rows.dtype), axis=1).take(before, axis=1)  # -1 is the last


def read_stream(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sizes, classes and input rows of the ``i``-th stream."""
    r = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names) if n in ("sizes", "klass", "rows")}
    return np.array(r["sizes"].as_py(), np.int64), np.frombuffer(r["klass"].as_py(), np.uint8), np.frombuffer(r["rows"].as_py(), "<u2").reshape(2, -1)


def lessons(batch: pa.RecordBatch, i: int, turn: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and weights of the windows of a stream's training texts; those of one of ``ROUNDS`` turns, or all."""
    sizes, klass, rows = read_stream(batch, i)
    held = np.array(batch.column(batch.schema.get_field_index("held"))[i].as_py(), bool)
    chosen = ~np.repeat(held, -(-sizes // STRIDE))
    if turn is not None:
        mixed = (np.arange(len(chosen), dtype=np.uint64) + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
        chosen &= (mixed >> np.uint64(40)) % np.uint64(ROUNDS) == turn
    before, own = windows(sizes, chosen)
    return inputs(rows, before), klass[np.maximum(own, 0)].astype(np.int64), (own >= 0).astype(np.float32)


def _trained(batches: Iterator[pa.RecordBatch], held, turn: int) -> Iterator[pa.RecordBatch]:
    """This task's weights after steps on its own windows, times their number."""
    prior, raw = held.value
    model, seen, found = Attention(prior), 0, []
    model.load(raw)

    def learn() -> int:
        x, y, w = (np.concatenate(c, axis=axis) for c, axis in zip(zip(*found), (1, 0, 0)))
        if len(y):
            model.fit(x, y, w, None, RATE / 4, seed=TaskContext.get().partitionId())
        return len(y)

    for batch in batches:
        for i in range(batch.num_rows):
            found.append(lessons(batch, i, turn))
            if sum(len(f[1]) for f in found) >= 64 * LOT:
                seen += learn()
                found.clear()
    if found:
        seen += learn()
    if seen:
        weights = np.frombuffer(model.raw(), "<f4").astype(np.float64) * seen
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["seen", "weights"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, weights = 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            own = np.frombuffer(batch.column(1)[i].as_py(), "<f8")
            seen, weights = seen + batch.column(0)[i].as_py(), own if weights is None else weights + own
    if weights is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["seen", "weights"])


def train(streams: DataFrame, prior: np.ndarray) -> Attention:
    spark, shape = streams.sparkSession, "seen long, weights binary"
    model = Attention(prior)
    keys = streams.select("batch", "piece").orderBy(F.xxhash64(F.lit(66), "batch", "piece"), "batch", "piece").limit(START_ROWS)
    start = streams.join(F.broadcast(keys), ["batch", "piece"], "left_semi").select("batch", "piece", "held", "sizes", "klass", "rows").toArrow().sort_by([("batch", "ascending"), ("piece", "ascending")])
    found = [lessons(b, i) for b in start.to_batches() for i in range(b.num_rows)]
    x, y, w = (np.concatenate(c, axis=axis) for c, axis in zip(zip(*found), (1, 0, 0))) if found else (None, [], None)
    if not len(y):
        return model
    model.fit(x, y, w, START_STEPS)
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((prior, model.raw()))
        own = materialize(streams.select("held", "sizes", "klass", "rows").mapInArrow(lambda it, held=held, turn=turn: _trained(it, held, turn), shape), "lm-weights", "lz4")
        spread = max(1, int(own.count() ** 0.5))  # in two steps, so that no task adds up all tasks' weights
        sums = own.repartition(spread).mapInArrow(_summed, shape).coalesce(1).mapInArrow(_summed, shape).collect()
        for seen, weights in sums:
            model.load((np.frombuffer(weights, "<f8") / seen).astype("<f4").tobytes())
        release(own)
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_stream(model: Attention, sizes: np.ndarray, klass: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's class after the tokens before it."""
    # Each text's places lie behind WINDOW - STRIDE of the end token, and reach to a multiple of STRIDE, as ``windows`` has them.
    room = WINDOW - STRIDE + -(-sizes // STRIDE) * STRIDE
    behind = np.cumsum(room) - room + WINDOW - STRIDE
    at = np.arange(len(klass)) + np.repeat(behind - (np.cumsum(sizes) - sizes), sizes)
    reads, target = np.full((2, int(room.sum()) + 1), 2 * BUCKETS, rows.dtype), np.zeros(int(room.sum()), klass.dtype)
    reads[:, at + 1] = rows
    reads[:, (behind + sizes)[sizes > 0]] = 2 * BUCKETS  # a text's last token is not read by the next one
    target[at] = klass
    out = np.zeros(len(target), np.float32)
    for a in range(0, len(target) - WINDOW + 1, SCORE_ROWS * STRIDE):
        s = slice(a + WINDOW - STRIDE, min(a + WINDOW - STRIDE + SCORE_ROWS * STRIDE, len(target)))
        out[s] = model.log_probs(model.states(reads[:, a : s.stop]).reshape(-1, WIDTH), target[s])
    return out[at] / np.float32(np.log(10))


def _scores(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    model, total = held.value
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, klass, rows = read_stream(batch, i)
            sums = np.add.reduceat(score_stream(model, sizes, klass, rows).astype(np.float64), np.cumsum(sizes) - sizes)
            part = {n: batch.column(k)[i].values for k, n in enumerate(batch.schema.names) if n not in ("klass", "rows")}
            score = part["inside"].to_numpy() + sums
            columns = [part["keys"], part["held"], pa.array(sizes), part["known"].cast(pa.int64()), pa.array(np.full(len(sizes), total, np.int64)), part["base"], pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCORES.split(", ")])
        pa.default_memory_pool().release_unused()


@dataclass
class Corpus:
    """Written streams of all documents, and what was counted on the training side."""

    streams: DataFrame
    words: Words
    prior: np.ndarray
    total: int


def read_corpus(docs: DataFrame, tokenizer: str) -> Corpus:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    side = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0
    ends = rows.filter(side).count()
    place = F.xxhash64(F.lit(66), "doc_id", "text")
    # Far more than the sample are very unlikely below this bound, so few texts travel.
    near = rows.filter(side).filter(F.pmod(place, F.lit(1 << 20)) <= (1 << 20) * 2 * SAMPLE_DOCS // max(ends, 1))
    batches = materialize(rows.mapInArrow(_batches, BATCHES), "word-batches")
    anchors = find_anchors(batches)
    sample = near.orderBy(F.pmod(place, F.lit(1 << 20)), place, "doc_id").select("text").limit(SAMPLE_DOCS).toArrow()
    topics = find_topics(sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string()), anchors)
    for _ in range(PASSES):
        topics = moved(batches, topics)

    parts = partitions_for(spark, 32 * (batches.agg(F.sum("n_words")).first()[0] or 0), 16 << 20)
    listed = batches.select("batch", "keys", "sizes", "codes", "packed", "n_words").mapInArrow(lambda it: _listed(_recounted(it, topics), 8 * parts), LISTED)
    types = materialize(listed.repartition(parts, "bucket").mapInArrow(lambda it: _spelled(it, tokenizer), TYPES), "word-types")
    told = types.select("word", "count", "topic", "ids")
    sums = types.agg(F.count(F.when(F.col("count") > 0, 1)).alias("v"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    top = types.filter("count > 0").orderBy(F.desc("count"), "word").limit(SINGLES).select("word", "count").collect()
    singles, n_ids = pa.array([r["word"] for r in top], pa.string()), len(encoder(tokenizer).begins)
    statistics = told.mapInArrow(lambda it: _statistics(it, singles, n_ids), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    statistics = materialize(statistics, "lm-statistics")
    fixed = statistics.filter(F.col("kind") != PAIR).toArrow()  # a few numbers for each id of the vocabulary
    followed = statistics.filter(F.col("kind") == PAIR).select("key", "n")
    pairs = followed.orderBy(F.desc("n"), "key").limit(PAIRS).toArrow()
    totals = followed.groupBy(F.expr(f"key div {n_ids + 1}").alias("id")).agg(F.sum("n").alias("n"), F.count("*").alias("ways")).toArrow()
    words = Words(singles, tuple(fixed[c].to_numpy() for c in ("kind", "key", "n")), tuple(pairs[c].to_numpy() for c in ("key", "n")), n_ids, tuple(totals[c].to_numpy() for c in ("id", "n", "ways")))
    mass = np.concatenate([[r["count"] for r in top] + [0] * (SINGLES - len(top)), [ends], words.tokens]) + 0.1
    held = spark.sparkContext.broadcast(words)
    if pairs.num_rows < PAIRS:
        more = F.lit(None).cast("array<struct<key: bigint, n: bigint>>").alias("more")
        spelt = types.select("word", "count", "topic", "ids", more, "places")
    else:  # pairs beyond those that tasks hold; few words have each
        last = F.struct(F.lit(-pairs["n"][-1].as_py()).alias("n"), F.lit(pairs["key"][-1].as_py()).alias("key"))
        others = followed.filter(F.struct((-F.col("n")).alias("n"), F.col("key")) > last)
        more = types.select("word", "ids").mapInArrow(lambda it: _asked(it, held), "word string, key long").join(others, "key").groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("more"))
        spelt = types.join(more, "word", "left").select("word", "count", "topic", "ids", "more", "places")
    # The head ends between two counts; words of a count are few kinds of rows, whatever their number.
    often = told.filter("count > 0").groupBy("count").agg(F.count("*").alias("n")).toArrow().sort_by([("count", "descending")])
    fits = int(np.searchsorted(np.cumsum(often["n"].to_numpy()), HEAD, side="right"))
    least = often["count"][fits].as_py() if fits < often.num_rows else 0
    head = spelt.drop("places").filter(F.col("count") > least).mapInArrow(lambda it: _featured(it, held), FEATURES).toArrow().combine_chunks()
    known = spark.sparkContext.broadcast((pa.array(head["word"].to_pylist(), pa.string()), *(head[c].to_numpy() for c in ("count", "code", "inside"))))
    found = spelt.filter(F.col("count") <= least).mapInArrow(lambda it: _located(it, held), LOCATED)
    asked = batches.select("batch", "keys", "sizes", "codes", "packed")
    joined = asked.groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(lambda own, more: stream_rows(own, more, known.value, total, distinct, ends), STREAMS)
    streams = materialize(joined, "lm-streams")
    release(batches, types, statistics)
    return Corpus(streams, words, np.log(mass / mass.sum()), total)


def op6_attention_scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    corpus = read_corpus(docs, tokenizer)
    held = docs.sparkSession.sparkContext.broadcast((train(corpus.streams, corpus.prior), corpus.total))
    return corpus.streams.select("keys", "held", "sizes", "known", "base", "inside", "klass", "rows").mapInArrow(lambda it: _scores(it, held), SCORES)
