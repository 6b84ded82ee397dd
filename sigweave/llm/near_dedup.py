"""Near-duplicates by weighted MinHash over TF-IDF shingles.

Shingles of five words weigh ``tf * idf``, idf falling from 2 (rare) to 1 (in all documents).
Document frequencies are counted over all documents in ``DF_BUCKETS`` hashed counters, less the
noise expected in each, so the table has a fixed size. Improved consistent weighted sampling
(Ioffe 2010) draws ``HASHES`` samples of each text, with its random variates looked up in a pool;
bands of ``ROWS`` samples put texts into buckets, whose pairs are compared by exact weighted Jaccard.
In crowded buckets, leaders come first and join most of the alike; of the other pairs in different
components those are compared that upper bounds of what they share leave open. So every pair of a bucket
is tested, ruled out or joined; connected components are the classes. Equal texts are grouped first and enter once.

Nulls: a null text counts as empty; texts without words are grouped only with equal texts.
Repeated rows get a row each, in one class. Texts count, not doc_ids: different texts of one doc_id
are apart, and rows without doc_id have their text's class, null if nothing in it has a doc_id. An
empty table gives no rows. A very long text is profiled alone, in memory of some times its size.
Extra columns pass by, whatever their names. Of equal leaders and links the lesser node number comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, release, slices, small
from .shingling import shingle_hashes, word_hashes

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
HASHES = BANDS * ROWS
#: All pairs of a bucket are taken if there are at most so many for each member; else it is crowded.
FEW = 32
#: Leaders of a crowded bucket in the first round, with four times as many in each next one, and rounds before
#: all pairs that are left may be taken.
LEADERS, ROUNDS = 4, 2
#: Parts by hash of a text's shingles; their weights bound what two texts share.
PARTS = 32
#: Bits of the table of shingles that several crowded texts have, and shingles that meet in a block, about.
SHARED_BITS, BLOCK_SHINGLES = 26, 1 << 18
#: What rounding may take from a bound, relative.
SLACK = 1e-4
DF_BUCKETS = 1 << 20
DF_BLOCK = 1 << 14
LEVELS = 32
POOL = 1 << 16
PIECE_BYTES = 1 << 20
SHINGLE_BITS = 44


def pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeded variates of consistent weighted sampling: r ~ Gamma(2, 1), log c with c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    rng = np.random.Generator(np.random.PCG64(2010))
    return rng.gamma(2.0, 1.0, POOL), np.log(rng.gamma(2.0, 1.0, POOL)), rng.random(POOL)


def multipliers() -> np.ndarray:
    """Odd multipliers that give every hash function its own way into the pool."""
    rng = np.random.Generator(np.random.PCG64(48))
    return rng.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def draw(weight: np.ndarray, r: np.ndarray, log_c: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Samples as uint64: log a in sortable bits above, t mixed below. Equal where shingle variate and t are."""
    t = np.floor(np.log(weight) / r + beta)
    log_a = (log_c - r * (t - beta) - r).astype(np.float32)
    bits = log_a.view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    mixed = (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (bits.astype(np.uint64) << np.uint64(32)) | mixed


def level_weight(level: np.ndarray) -> np.ndarray:
    return 1.0 + level / (LEVELS - 1)


class Sampler:
    """Tables for shingles that occur once in a text; others are drawn as they come."""

    def __init__(self):
        self.r, self.log_c, self.beta = pool()
        self.ways = multipliers()
        self.once = np.stack([draw(np.full(POOL, level_weight(v)), self.r, self.log_c, self.beta) for v in range(LEVELS)])

    def signatures(self, ids: np.ndarray, tf: np.ndarray, level: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Per text (given by its first shingle) ``HASHES`` samples."""
        out = np.empty((len(starts), HASHES), np.uint64)
        base = level.astype(np.int64) * POOL
        flat = self.once.reshape(-1)
        many = np.flatnonzero(tf > 1)
        weight = tf[many] * level_weight(level[many].astype(np.float64))
        for k, way in enumerate(self.ways):
            mixed = ids * way
            at = (mixed >> np.uint64(48)).astype(np.int64)
            value = flat[base + at]
            if len(many):
                m = at[many]
                value[many] = draw(weight, self.r[m], self.log_c[m], self.beta[m])
            value ^= (mixed >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(value, starts)
        return out


_sampler: list[Sampler] = []


def sampler() -> Sampler:
    if not _sampler:
        _sampler.append(Sampler())
    return _sampler[0]


def profile(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (44 bits) of all texts in order of text and shingle, their counts, and each text's number."""
    hashes, n = shingle_hashes(*word_hashes(texts), SIZE)
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    keys = np.sort((owner << np.uint64(SHINGLE_BITS)) | (hashes >> np.uint64(64 - SHINGLE_BITS)))
    if not len(keys):
        return keys, np.zeros(0, np.int64), n
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    tf = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    distinct = np.bincount((keys >> np.uint64(SHINGLE_BITS)).astype(np.int64), minlength=len(n))
    return keys & np.uint64((1 << SHINGLE_BITS) - 1), tf, distinct


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(SHINGLE_BITS - 20)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(DF_BUCKETS, np.int64)
    for part in slices(batches, 0, PIECE_BYTES):
        held += np.bincount(bucket_of(profile(part.column(0))[0]), minlength=DF_BUCKETS)
    if held.any():
        blocks = held.astype("<u4").reshape(-1, DF_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[block] = held.get(block, 0) + np.frombuffer(counts, "<u4" if len(counts) == 4 * DF_BLOCK else "<i8").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in held.values()], pa.binary())], names=["block", "counts"])


def idf_levels(docs: DataFrame) -> np.ndarray:
    """Level (0 to ``LEVELS`` - 1) of each hashed counter, from all documents."""
    shape = "block int, counts binary"
    n = docs.count()
    partial = docs.select("text").mapInArrow(_frequencies, shape)
    for spread in (8, 1):  # in two steps, so that no task adds up all tasks' blocks
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
        partial = partial.withColumn("s", salt).repartition(DF_BUCKETS // DF_BLOCK * spread, "block", "s").select("block", "counts").mapInArrow(_added, shape)
    counts = np.zeros(DF_BUCKETS, np.int64)
    for block, held in partial.collect():  # 8 MB, whatever the input
        counts[block * DF_BLOCK : (block + 1) * DF_BLOCK] += np.frombuffer(held, "<i8")
    df = np.maximum(counts - counts.mean(), 1.0)
    idf = np.log((1.0 + n) / (1.0 + np.minimum(df, n))) / np.log(2.0 + n)
    return np.clip(np.rint(idf * (LEVELS - 1)), 0, LEVELS - 1).astype(np.uint8)


def _signed(batches: Iterator[pa.RecordBatch], levels) -> Iterator[pa.RecordBatch]:
    table = levels.value
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
    for part in slices(batches, 2, PIECE_BYTES):
        ids, tf, n = profile(part.column(2))
        has = np.flatnonzero(n)
        bands = np.zeros((len(n), BANDS), np.int64)
        if len(has):
            sig = sampler().signatures(ids, tf, table[bucket_of(ids)], (np.cumsum(n) - n)[has])
            rows = sig.reshape(len(has), BANDS, ROWS)
            rows = (rows ^ (rows >> np.uint64(31))) * mix
            bands[has] = np.bitwise_xor.reduce(rows ^ (rows >> np.uint64(29)), axis=2).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[n > 0].reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "digest", "bands"])


VECTORS = "node long, whole double, ids binary, weights binary"


def _vectors(batches: Iterator[pa.RecordBatch], levels) -> Iterator[pa.RecordBatch]:
    table = levels.value
    for part in slices(batches, 1, PIECE_BYTES):
        ids, tf, n = profile(part.column(1))
        weight = (tf * level_weight(table[bucket_of(ids)].astype(np.float64))).astype("<f4")
        ends = np.cumsum(n).tolist()
        begins = [0, *ends[:-1]]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([float(weight[a:b].sum()) for a, b in zip(begins, ends)], pa.float64()), pa.array([ids[a:b].astype("<u8").tobytes() for a, b in zip(begins, ends)], pa.binary()), pa.array([weight[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())], names=[f.split()[0] for f in VECTORS.split(", ")]
        )


def weighted_jaccard(ids_a: np.ndarray, w_a: np.ndarray, ids_b: np.ndarray, w_b: np.ndarray) -> float:
    ids = np.concatenate([ids_a, ids_b])
    order = np.argsort(ids, kind="stable")
    ids, w = ids[order], np.concatenate([w_a, w_b])[order]
    twice = np.flatnonzero(ids[1:] == ids[:-1])
    shared = float(np.minimum(w[twice], w[twice + 1]).sum())
    whole = float(w_a.sum()) + float(w_b.sum()) - shared
    return shared / whole if whole else 0.0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, PIECE_BYTES):
        sims = []
        for ia, wa, ib, wb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            sims.append(weighted_jaccard(np.frombuffer(ia, "<u8"), np.frombuffer(wa, "<f4"), np.frombuffer(ib, "<u8"), np.frombuffer(wb, "<f4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for each node of ``links(a, b)``.

    Each node hooks on to its least neighbour, if that is less; hooks are followed to their ends, and the
    links between different ends are the next round's, so dense components shrink to a node at once.
    """
    links, labels = materialize(links.select("a", "b").filter("a <> b").distinct(), "edges"), None
    while True:
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "hooks")
        while True:  # of each node the hook's hook
            on = hooks.select(F.col("node").alias("at"), F.col("label").alias("end"))
            moved = materialize(hooks.join(on, hooks["label"] == on["at"]).select("node", F.col("label").alias("old"), F.col("end").alias("label")), "hooks")
            changed = not moved.filter("old <> label").isEmpty()
            release(hooks)
            hooks = moved
            if not changed:
                break
        hooks_now = hooks.select("node", "label")
        rest = materialize(contracted(links, hooks_now), "edges")
        release(links)
        links = rest
        labels = hooks_now if labels is None else followed(labels, hooks_now)
        if links.isEmpty():
            return labels


def contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct links between different components of ``labels``, from label to label."""
    one, two = (labels.select(F.col("node").alias(f"node_{k}"), F.col("label").alias(f"label_{k}")) for k in "ab")
    met = links.join(one, F.col("a") == F.col("node_a"), "left").join(two, F.col("b") == F.col("node_b"), "left")
    return met.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b").distinct()


def followed(labels: DataFrame, up: DataFrame) -> DataFrame:
    """``labels`` with each label replaced by its own in ``up``, written."""
    ends = up.select(F.col("node").alias("at"), F.col("label").alias("end"))
    return materialize(labels.join(ends, labels["label"] == ends["at"], "left").select("node", F.coalesce("end", "label").alias("label")), "labels")


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (None: each node alone) after ``links`` have joined components; only new links are read."""
    if labels is None:
        return components(links)
    between = materialize(contracted(links, labels), "edges")
    if between.isEmpty():
        return labels
    up = components(between)
    fresh = up.join(labels.select("node"), "node", "left_anti")
    return materialize(followed(labels, up).unionByName(fresh.select("node", "label")), "labels")


def _mixed(ids: pa.Array) -> np.ndarray:
    """The shingles of all vectors end to end, mixed one to one: leading bits give part, block and bit."""
    return np.frombuffer(b"".join(ids.to_pylist()), "<u8") * np.uint64(0x9E3779B97F4A7C15)


def _dealt(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The mixed shingles of some vectors, a row for each of 2 ** ``bits`` blocks."""
    for part in slices(batches, 0):
        keys = np.sort(_mixed(part.column(0)))
        edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
        rows = [(k, keys[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "keys"])


def _shared(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Of each block, whose rows are all here, the bits of the shingles that more than one vector has."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(block, []).append(keys)
    for block, found in held.items():
        keys = np.sort(np.frombuffer(b"".join(found), "<u8"))
        flags = np.zeros(1 << SHARED_BITS - bits, bool)
        flags[(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - SHARED_BITS)) & np.uint64(len(flags) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["block", "flags"])


BOUNDS = "node long, whole double, cap double, parts array<double>, h double"


def _bounds(batches: Iterator[pa.RecordBatch], held, threshold: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2, PIECE_BYTES):
        n = pc.binary_length(part.column(2)).to_numpy() // 8
        keys, weight = _mixed(part.column(2)), np.frombuffer(b"".join(part.column(3).to_pylist()), "<f4")
        at = keys >> np.uint64(64 - SHARED_BITS)
        met = held.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1
        own = np.repeat(np.arange(len(n)) * PARTS, n) + (keys >> np.uint64(65 - PARTS.bit_length())).astype(np.int64)
        parts = np.bincount(own, weights=weight * met, minlength=len(n) * PARTS).reshape(-1, PARTS)
        cap, whole = parts.sum(axis=1), part.column(1).to_numpy()
        kept = np.flatnonzero(cap >= (threshold - SLACK) * whole)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * PARTS), pa.array(parts[kept].reshape(-1)))
        columns = [part.column(0).take(pa.array(kept)), pa.array(whole[kept]), pa.array(cap[kept]), lists, pa.array(1 - cap[kept] / np.maximum(whole[kept], 1e-30))]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BOUNDS.split(", ")])


def bounds(vectors: DataFrame, threshold: float) -> DataFrame:
    """node, whole (weight), cap, parts, h: the weight, in all and by part, of those shingles that other ``vectors`` have
    too, and the rest's share. A text with too little of it is like no other and has no row.

    Shingles meet in blocks, packed, and leave a table of ``SHARED_BITS``, of fixed size. A shingle that falls on
    another's bit there counts as shared, which makes a bound wider and no less true."""
    total = (vectors.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8
    bits = min(max(6, (total // BLOCK_SHINGLES).bit_length()), 16)
    dealt = vectors.select("ids").mapInArrow(lambda it: _dealt(it, bits), "block int, keys binary")
    table = np.zeros((1 << bits, (1 << SHARED_BITS - bits) // 8), np.uint8)
    for block, flags in dealt.repartition(1 << bits, "block").mapInArrow(lambda it: _shared(it, bits), "block int, flags binary").collect():  # 8 MB at most
        table[block] = np.frombuffer(flags, np.uint8)
    held = vectors.sparkSession.sparkContext.broadcast(table.reshape(-1))
    return materialize(vectors.mapInArrow(lambda it: _bounds(it, held, threshold), BOUNDS), "bounds")


def _open(threshold: float) -> F.Column:
    """Whether two texts may be as similar as ``threshold``. They share s of their weights v and w, where s / (v + w - s)
    is the similarity, and no more of a part, or in all, than either has in common with any others."""
    least = (threshold / (1 + threshold) - SLACK) * (F.col("whole") + F.col("b_whole"))
    shared = F.aggregate(F.zip_with("parts", "b_parts", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    return (F.least("cap", "b_cap") >= least) & (shared >= least)


def _crowd(members: DataFrame, labels: DataFrame | None, leaders: int) -> DataFrame:
    """Members of the crowded buckets that hold several components, with their label and whether they lead: in each of
    a bucket's ``leaders`` lots the one with the most in common with others."""
    label = F.col("node").alias("label") if labels is None else F.coalesce("label", "node").alias("label")
    met = members if labels is None else members.drop("label").join(labels, "node", "left")
    lot = F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(leaders)).alias("lot")
    met = met.select("band", "value", "node", "whole", "cap", "parts", "h", label, lot)
    mixed = met.groupBy("band", "value").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band", "value")
    met = met.join(mixed, ["band", "value"], "left_semi")
    first = met.groupBy("band", "value", "lot").agg(F.min(F.struct("h", "node")).alias("f")).select("band", "value", F.col("f.node").alias("node"), F.lit(True).alias("lead"))
    met = met.join(first, ["band", "value", "node"], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    return materialize(met.drop("lot"), "crowd")


def _pairs(members: DataFrame, others: DataFrame, condition) -> DataFrame:
    """Distinct pairs of a bucket's ``members`` and ``others`` that meet ``condition``."""
    others = others.select("band", "value", *(F.col(c).alias(f"b_{c}") for c in others.columns if c not in ("band", "value")))
    met = members.join(others, ["band", "value"]).filter(condition)
    return met.select(F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Each row's doc_id and digest; and each distinct text's digest and doc_id (its least), with its class's
    least doc_id (class_id) and the digest of the text that stands for the class (rep).

    A crowded bucket's leaders meet all its members and are done with it; that goes on, with four times as many
    leaders each time, until what is left open between different components is little enough to be taken at once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    levels = spark.sparkContext.broadcast(idf_levels(rows))
    rows = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    signed = materialize(rows.mapInArrow(lambda it: _signed(it, levels), "doc_id long, digest string, bands array<long>"), "signatures")
    # The node numbers are written, so that no later reading changes them.
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"))
    texts = materialize(texts.select("digest", "doc_id", "bands", F.monotonically_increasing_id().alias("node")), "texts")
    signed = signed.select("doc_id", "digest")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """node, text: once for each of ``nodes``."""
        wanted = texts.join(small(nodes, nodes.count()), "node", "left_semi").select("node", "digest", F.col("doc_id").alias("_id"))
        wanted = materialize(wanted, "wanted")
        # By both, so that the rows of a text that is repeated often don't meet in one place.
        met = rows.join(small(wanted.withColumnRenamed("digest", "_digest"), wanted.count()), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        return met.select("node", "text").dropDuplicates(["node"])

    members = texts.select("node", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = sizes.select("band", "value", ((F.col("m") > 3) & (F.col("m") - 1 > 2 * FEW)).alias("crowded"))
    members = materialize(members.join(sizes, ["band", "value"]).select("band", "value", "node", "crowded"), "members")
    vectors = materialize(texts_of(members.select("node").distinct()).mapInArrow(lambda it: _vectors(it, levels), VECTORS), "vectors")
    one, two = (vectors.select(F.col("node").alias(k), F.col("ids").alias(f"ids_{k}"), F.col("weights").alias(f"weights_{k}")) for k in "ab")

    def linked(pairs: DataFrame) -> DataFrame:
        compared = pairs.join(one, "a").join(two, "b").select("a", "b", "ids_a", "weights_a", "ids_b", "weights_b").mapInArrow(_compared, "a long, b long, similarity double")
        return materialize(compared.filter(F.col("similarity") >= threshold), "links")

    apart, later = F.col("label") != F.col("b_label"), F.col("node") < F.col("b_node")
    easy = members.filter("not crowded").select("band", "value", "node")
    pairs, crowd = materialize(_pairs(easy, easy, later), "pairs"), None
    found = linked(pairs)
    labels, tested = None if found.isEmpty() else joined(None, found), pairs
    crowded = members.filter("crowded").select("band", "value", "node")
    if not crowded.isEmpty():
        near = materialize(vectors.join(crowded.select("node").distinct(), "node", "left_semi"), "crowd-vectors")
        crowd = crowded.join(bounds(near.select(vectors.columns), threshold), "node")
        release(near)
    turn = 0
    while crowd is not None:
        crowd = _crowd(crowd, labels, LEADERS * 4**turn)
        left = crowd.count()
        if not left:
            break
        rest = None
        if turn >= ROUNDS:
            rest = materialize(_pairs(crowd, crowd, apart & later & _open(threshold)).join(tested, ["a", "b"], "left_anti"), "pairs")
            if rest.count() > FEW * left:
                release(rest)
                rest = None
        if rest is None:
            met = _pairs(crowd, crowd.filter("lead"), apart & (~F.col("lead") | later) & _open(threshold))
            pairs = materialize(met.join(tested, ["a", "b"], "left_anti"), "pairs")
        else:
            pairs = rest
        found = linked(pairs)
        if not found.isEmpty():
            labels = joined(labels, found)
        if rest is not None:
            break
        tested = tested.unionByName(pairs)
        crowd = crowd.filter("not lead")
        turn += 1
    release(vectors)
    out = texts.select("digest", "doc_id", "node")
    if labels is None:
        return signed, out.select("digest", "doc_id", F.col("doc_id").alias("class_id"), F.col("digest").alias("rep"))
    # Texts without doc_id come last in their class.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("m")
    heads = out.join(labels, "node").groupBy("label").agg(first).select("label", F.col("m.doc_id").alias("head"), F.col("m.digest").alias("rep"))
    of_node = labels.join(heads, "label").select("node", "head", "rep")
    out = out.join(of_node, "node", "left")
    return signed, out.select("digest", "doc_id", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("head")).alias("class_id"), F.coalesce("rep", "digest").alias("rep"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its near-duplicates) for each row of ``docs(doc_id, text)``."""
    signed, texts = classes(docs, threshold)
    return signed.join(texts.select("digest", "class_id"), "digest").select("doc_id", "class_id")


def op4_consistent_sampling(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: that of the least doc_id; one without doc_id if none has any."""
    _, texts = classes(docs)
    key, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    kept = materialize(texts.filter("digest = rep").select(F.col("digest").alias(digest), F.col("doc_id").alias(key)), "kept")
    mine = free_name(docs.withColumn(digest, F.lit(0)).withColumn(key, F.lit(0)), "_mine")
    digested = docs.withColumn(mine, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    met = digested.join(kept, (F.col(mine) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return met.dropDuplicates([digest]).select(*(f"`{c}`" for c in docs.columns))
