"""Near-duplicates by SimHash fingerprints within a Hamming radius, found by pigeonring filtering.

A fingerprint's 64 bits are a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most
``RADIUS`` bits, some segment starts a chain all of whose prefixes keep within their proportional
budgets: the first l segments of it differ in at most floor(l * RADIUS / SEGMENTS) bits together (Qin
and Xiao 2018). With 8 segments and radius 3 the budgets are 0 0 1 1 1 2 2 3: the first two segments of a
chain are equal, and of the next three at least two. So each fingerprint has three keys for each start,
its 16 + 16 equal bits; only fingerprints that share a key meet, the budgets of the chain from that start
are tested, and then all 64 bits. Keys of 32 bits keep chance meetings few: 24 / 2^32 of all pairs.

A key that many fingerprints share does not meet all its pairs: its leaders meet all its members
and are done with it; rounds with twice as many leaders follow until no key holds an untested pair in
different components. Equal fingerprints are one node. Only tables hold links, labels and fingerprints.

Nulls: a null text has no words and the fingerprint zero, like an empty one; zero is linked like
any other. Rows without doc_id are kept; they link others, but only a doc_id names a component (null if it
has none). Repeated rows and rows of one doc_id get a row each. A bit set in exactly half of the hashes
is zero. Of equal leaders the lesser fingerprint comes first. An empty table gives no rows. A very long
text is hashed alone, its bits counted in pieces. Extra columns pass by; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize, release, slices
from .near_dedup import joined

SHINGLE = 3
SEED = 42
RADIUS = 3
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
#: Differing bits that the first 1, 2, .. segments of a chain may have.
BUDGETS = [n * RADIUS // SEGMENTS for n in range(1, SEGMENTS + 1)]
#: Places in a chain that are in its key: the two that must be equal, and each choice of two of the next three.
CHOICES = [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4)]
#: A key's pairs are all taken if there are at most so many for each member.
FEW = 32
#: Hashes whose bits are counted at once.
COUNTED = 1 << 17


def shingle_digests(text: bytes) -> np.ndarray:
    """XXH64 of all runs of three words; of all words if they are fewer; none without words."""
    words = text.lower().split()  # on bytes: A-Z, and white space of ASCII
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - SHINGLE]]
    return np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), np.uint64, len(starts))


def majority(digests: np.ndarray) -> int:
    """The bits that are set in over half of ``digests``."""
    held = np.zeros(64, np.int64)
    for a in range(0, len(digests), COUNTED):
        part = digests[a : a + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        held += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * held > len(digests), bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        prints = [majority(shingle_digests(t.as_py() or b"")) for t in part.column(1)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (64 bits as a long) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_prints, "doc_id long, print long")


def segment(bits: Column, i: int) -> Column:
    """Segment ``i`` of the ring, which has no end."""
    return F.shiftrightunsigned(bits, i % SEGMENTS * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def keys(prints: DataFrame) -> DataFrame:
    """start, key, print: three keys for each start of a chain."""
    held = []
    for start in range(SEGMENTS):
        for c, places in enumerate(CHOICES):
            key = F.lit(c).cast("long")
            for p in places:
                key = F.shiftleft(key, WIDTH).bitwiseOR(segment(F.col("print"), start + p))
            held.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
    return prints.select("print", F.explode(F.array(*held)).alias("k")).select("k.start", "k.key", "print")


def within(a: str, b: str, start: str) -> Column:
    """Whether the chain from segment ``start`` keeps all its budgets, and then all bits the radius."""
    x = F.col(a).bitwiseXOR(F.col(b))
    shift = F.col(start) * WIDTH
    ring = F.call_function("shiftrightunsigned", x, shift).bitwiseOR(F.when(shift > 0, F.call_function("shiftleft", x, 64 - shift)).otherwise(0))
    out = F.lit(True)
    for n, budget in enumerate(BUDGETS[:-1], 1):
        out = out & (F.bit_count(ring.bitwiseAND((1 << n * WIDTH) - 1)) <= budget)
    return out & (F.bit_count(x) <= RADIUS)


def meeting(members: DataFrame, leaders: int) -> DataFrame:
    """``members(start, key, print, label)`` of the keys that hold several components, with their place h
    in [0, 1) and up to which place (cut) the key's members are leaders."""
    place = (F.xxhash64(F.lit(11), "print").bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))).alias("h")
    members = members.select("start", "key", "print", "label", place)
    if leaders == 1:  # each is a component yet
        stats = members.groupBy("start", "key").agg(F.count("*").alias("m"), F.count("*").cast("double").alias("square"), F.min("h").alias("low")).filter("m > 1")
    else:
        alike = members.groupBy("start", "key", "label").agg(F.count("*").alias("n"), F.min("h").alias("low"))
        square = F.sum(F.col("n").cast("double") * F.col("n")).alias("square")
        stats = alike.groupBy("start", "key").agg(F.sum("n").alias("m"), square, F.min("low").alias("low"), F.count("*").alias("labels")).filter("labels > 1")
    pairs = (F.col("m").cast("double") * F.col("m") - F.col("square")) / 2
    cut = F.when(pairs <= FEW * F.col("m"), 1.0).otherwise(F.greatest("low", F.lit(float(leaders)) / F.col("m")))
    return members.join(stats.select("start", "key", cut.alias("cut")), ["start", "key"])


def links_of(active: DataFrame) -> DataFrame:
    """a, b: the fingerprints within the radius among each key's members and its leaders in other components."""
    leaders = active.filter("h <= cut").select("start", "key", F.col("print").alias("b"), F.col("label").alias("b_label"), F.col("h").alias("b_h"))
    met = active.join(leaders, ["start", "key"]).filter("label <> b_label and (h > cut or h < b_h or (h = b_h and print < b))")
    return met.filter(within("print", "b", "start")).select(F.least("print", "b").alias("a"), F.greatest("print", "b").alias("b")).distinct()


def components_of(prints: DataFrame) -> DataFrame | None:
    """node, label (its component's least fingerprint) of each of the distinct ``prints`` that has a link; None if none has."""
    members = keys(prints).withColumn("label", F.col("print"))
    labels, leaders = None, 1
    while True:
        active = materialize(meeting(members, leaders), "key-members")
        if active.isEmpty():
            return labels
        found = materialize(links_of(active), "print-links")
        if not found.isEmpty():
            labels = joined(labels, found)
        left = active.filter("h > cut").select("start", "key", "print", "label")
        if labels is not None:
            left = left.drop("label").join(labels, left["print"] == labels["node"], "left").select("start", "key", "print", F.coalesce("label", "print").alias("label"))
        members = materialize(left, "key-rest")
        release(active)
        leaders *= 2


def op11_pigeonring(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each row."""
    prints = materialize(fingerprints(docs), "prints")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    labels = components_of(nodes.select("print"))
    if labels is None:
        heads = nodes.select("print", F.col("least").alias("component_id"))
    else:
        labelled = nodes.join(labels, nodes["print"] == labels["node"], "left").select("print", "least", F.coalesce("label", "print").alias("label"))
        least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        heads = labelled.join(least, "label").select("print", "component_id")
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return prints.join(heads, "print").select("doc_id", hexed.alias("fingerprint"), "component_id")
