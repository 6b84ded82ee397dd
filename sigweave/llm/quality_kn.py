"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a 4-gram model over UTF-8 bytes, so that scripts stay apart, with white space levelled
and with a word that repeats the one before it written as a repeat mark (another one from the third
time on), which weighs as many symbols as it stands for. Of all documents labelled good, one half (by a
seeded hash of doc_id) trains it and the other gives the thresholds; counts, continuation counts, discounts
and back-offs are Spark aggregates and joins sharded by n-gram. Perplexities of all documents come from two exact parts:
a fixed-size table of frequent n-grams, which every task holds, and a join of all other n-grams
with the model, by n-gram. A document goes if its perplexity is above a quantile, for its
language, of trusted documents that the model has not seen.

Nulls: a null text counts as empty and is kept (nothing speaks against it); a null language is a
group of its own. Languages with fewer than ``LEAST`` trusted documents use the quantile of all.
Repeated rows are judged alike, ties with a quantile are kept. A very long text is counted in one piece. Without trusted documents all rows are kept. An empty table gives
no rows. Extra columns pass by, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, materialize, small

ORDER = 4
QUANTILE = 0.995
#: Pseudo-symbols of the language's mean that steady short texts.
PRIOR = 60
LEAST = 30
#: Slots of the table of frequent n-grams: 2 ** 20, 12 MB.
HEAD_BITS = 20
MULTIPLIER = np.uint32(0x5E3779B1)
#: Characters of a piece, whose symbols take some 100 times their memory, and 4-grams that are counted at once.
PIECE_CHARS, COUNT_GRAMS = 250_000, 2_000_000
MARK, RUN, UNIFORM = 2, 1, 256


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as symbols (UTF-8 bytes and marks), each led by three 0s and closed by one; each text's length so; and
    each symbol's weight, the bytes that it stands for."""
    own = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\0\0\0" + b"\0\0\0\0".join(own) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in own], np.int64) + 4
    border = np.zeros(len(raw), bool)
    ends = np.cumsum(sizes)
    for k in (1, 2, 3):
        border[ends - sizes + k - 1] = True
    border[ends - 1] = True
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    sym = np.where(blank, np.uint8(32), np.where((raw < 9) & ~border, np.uint8(3), raw))
    # A word: a run between blanks or borders. Its hash tells whether it repeats the word before.
    inside = ~(blank | border)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))
    weight = np.ones(len(raw), np.int32)
    if len(starts):
        stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        owner = np.repeat(np.arange(len(starts)), stops - starts)
        at = np.flatnonzero(inside)
        mixed = (raw[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= (2 * (at - starts[owner]).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = np.add.reduceat(mixed, np.cumsum(stops - starts) - (stops - starts))
        text_of = np.searchsorted(ends, starts, side="right")
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])])
        again = at[same[owner]]
        keep[again] = False
        keep[starts[same]] = True
        sym[starts[same]] = MARK
        sym[starts[1:][same[1:] & same[:-1]]] = RUN
        weight[starts[same]] = (stops - starts)[same]
    before = np.concatenate([[0], np.cumsum(keep)])
    return sym[keep], before[ends] - before[ends - sizes], weight[keep]


def grams(sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (uint32) of all texts in order, and the number of each."""
    s = sym.astype(np.uint32)
    keys = (s[:-3] << np.uint32(24)) | (s[1:-2] << np.uint32(16)) | (s[2:-1] << np.uint32(8)) | s[3:]
    ends = np.cumsum(sizes)
    whole = np.ones(len(keys), bool)
    for k in (1, 2, 3):
        over = ends[:-1] - k
        whole[over] = False
    return keys[whole], sizes - 3


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded number of characters, with the first one's row."""
    run, chars, first = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py() or ""
        run.append(t)
        chars += len(t)
        if chars >= PIECE_CHARS:
            yield first, run
            run, chars, first = [], 0, i + 1
    if run:
        yield first, run
    give_back()


def _tallied(found: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        for _, texts in _pieces(batch, 0):
            held.append(grams(*symbols(texts)[:2])[0])
            if sum(map(len, held)) >= COUNT_GRAMS:
                yield _tallied(held)
                held = []
    if held:
        yield _tallied(held)


def train(texts: DataFrame) -> DataFrame:
    """The model of column ``text``: rows (kind, ord, key, value), kind ``p`` for log10 probabilities
    of n-grams of order ``ord`` and ``b`` for log10 back-offs of contexts of that order; ``n`` counts 4-grams."""
    counts = texts.select("text").mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    level = {ORDER: materialize(counts, "kn-counts")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        level[k] = level[k + 1].groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.count("*").alias("n"))
    lower, rows = None, []
    for k in range(1, ORDER + 1):
        of = level[k].agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        y = of["n1"] / max(1, of["n1"] + 2 * of["n2"])
        cut = [min(max(i - (i + 1) * y * of[f"n{i + 1}"] / of[f"n{i}"], 0.05), i - 0.05) if of[f"n{i}"] else 0.5 for i in (1, 2, 3)]
        n = F.col("n")
        discount = F.when(n == 1, cut[0]).when(n == 2, cut[1]).otherwise(cut[2])
        context = F.expr("key div 256").alias("ctx")
        contexts = level[k].groupBy(context).agg(F.sum("n").alias("total"), F.sum(discount).alias("freed")).withColumn("bow", F.col("freed") / F.col("total"))
        here = level[k].select("key", "n", context).join(contexts, "ctx")
        own = (F.col("n") - discount) / F.col("total")
        if lower is None:
            p = own + F.col("bow") / UNIFORM
        else:
            here = here.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix")
            p = own + F.col("bow") * F.col("q")
        lower = materialize(here.select("key", "n", p.alias("p")), "kn-order")
        rows.append(lower.select(F.lit("p").alias("kind"), F.lit(k).alias("ord"), "key", F.log10("p").alias("value"), "n"))
        rows.append(contexts.select(F.lit("b").alias("kind"), F.lit(k - 1).alias("ord"), F.col("ctx").alias("key"), F.log10("bow").alias("value"), F.col("total").alias("n")))
    model = rows[0]
    for r in rows[1:]:
        model = model.unionByName(r)
    return materialize(model, "kn-model")


def resolve(keys: DataFrame, model: DataFrame) -> DataFrame:
    """log10 probability of each distinct 4-gram of ``keys(key)``, seen or not, by one join with the model's shards."""
    asked = []
    for k in range(ORDER, 0, -1):
        asked.append(F.struct(F.lit("p").alias("kind"), F.lit(k).alias("ord"), F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("at")))
        suffix = F.col("key").bitwiseAND((1 << 8 * k) - 1)
        asked.append(F.struct(F.lit("b").alias("kind"), F.lit(k - 1).alias("ord"), F.call_function("shiftright", suffix, F.lit(8)).alias("at")))
    probes = keys.select("key", F.explode(F.array(*asked)).alias("a")).select("key", "a.kind", "a.ord", F.col("a.at").alias("at"))
    held = model.select("kind", "ord", F.col("key").alias("at"), "value")
    found = probes.join(held, ["kind", "ord", "at"], "left").groupBy("key").agg(
        *[F.max(F.when((F.col("kind") == kind) & (F.col("ord") == k), F.col("value"))).alias(f"{kind}{k}") for k in range(ORDER + 1) for kind in "pb" if (kind, k) not in (("p", 0), ("b", ORDER))]
    )
    logp = F.coalesce("b0", F.lit(0.0)) - math.log10(UNIFORM)
    for k in range(1, ORDER + 1):
        logp = F.coalesce(F.col(f"p{k}"), (F.coalesce(F.col(f"b{k - 1}"), F.lit(0.0)) + logp) if k > 1 else logp)
    return found.select("key", logp.alias("logp"))


def head_table(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and log10 probabilities by slot; of 4-grams that share a slot the most frequent stays, the others are left to the join."""
    slot = F.call_function("shiftright", (F.col("key") * int(MULTIPLIER)).bitwiseAND(0xFFFFFFFF), F.lit(32 - HEAD_BITS))
    best = model.filter(f"kind = 'p' and ord = {ORDER}").groupBy(slot.cast("int").alias("slot")).agg(F.max(F.struct("n", "key", "value")).alias("m"))
    rows = best.select("slot", "m.key", "m.value").toPandas()
    keys, values = np.zeros(1 << HEAD_BITS, np.int64) - 1, np.zeros(1 << HEAD_BITS, np.float32)
    keys[rows["slot"]], values[rows["slot"]] = rows["key"], rows["value"]
    return keys, values


SCORED = "rid long, doc_id long, lang string, digest long, n long, head double, tail_keys array<long>, tail_counts array<int>"


def _score(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    keys_at, values_at = table.value
    rid = TaskContext.get().partitionId() << 36
    for batch in batches:
        for first, texts in _pieces(batch, 3):
            sym, sizes, weight = symbols(texts)
            keys, n = grams(sym, sizes)
            weight = weight[3:][np.repeat(np.arange(len(n)), n) * 3 + np.arange(len(keys))]  # of each gram's last symbol
            slot = ((keys * MULTIPLIER) >> np.uint32(33 - len(keys_at).bit_length())).astype(np.int64)
            known = keys_at[slot] == keys
            ends = np.cumsum(n)
            sums = np.add.reduceat(np.where(known, values_at[slot] * weight, np.float32(0)).astype(np.float64), ends - n)
            rest = np.flatnonzero(~known)
            doc = np.searchsorted(ends, rest, side="right").astype(np.int64)
            pairs, which = np.unique((doc << 32) | keys[rest].astype(np.int64), return_inverse=True)
            counts = np.bincount(which, weights=weight[rest], minlength=len(pairs))
            n = np.add.reduceat(weight, ends - n).astype(np.int64)
            offsets = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).astype(np.int32)
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + len(texts))), part.column(0), part.column(1), part.column(2), pa.array(n), pa.array(sums),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs & 0xFFFFFFFF)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int32)))],
                names=[f.split()[0] for f in SCORED.split(", ")],
            )
            rid += len(texts)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, digest (of the text), n_chars (as modelled), perplexity, threshold, keep: a row for each of ``docs``."""
    spark = docs.sparkSession
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # Even ones train, odd ones calibrate.
    trusted = materialize(good.select("doc_id", F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(2)).cast("int").alias("sample")), "trusted")
    trusted = small(trusted, trusted.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.xxhash64("text").alias("digest"), "text")
    model = train(rows.join(trusted.filter("sample = 0"), "doc_id", "left_semi"))
    held = spark.sparkContext.broadcast(head_table(model))
    scored = materialize(rows.mapInArrow(lambda it: _score(it, held), SCORED), "kn-scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("tail_keys", "tail_counts")).alias("t")).select("rid", F.col("t.tail_keys").alias("key"), F.col("t.tail_counts").alias("times"))
    solved = materialize(resolve(tail.select("key").distinct(), model), "kn-tail")
    tails = tail.join(small(solved, solved.count()), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("logp")).alias("tail"))
    total = scored.drop("tail_keys", "tail_counts").join(tails, "rid", "left").withColumn("nll", -(F.col("head") + F.coalesce("tail", F.lit(0.0)))).drop("head", "tail")
    total = materialize(total.join(trusted, "doc_id", "left"), "kn-total")  # texts don't travel to their labels

    # Quantiles by language, of trusted documents that the model has not seen.
    calm = total.filter("sample = 1 and n > 1")
    means = calm.groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    overall = calm.agg((F.sum("nll") / F.sum("n")).alias("m")).first()["m"]
    steady = (F.col("nll") + PRIOR * F.coalesce("mean", F.lit(overall or 0.0))) / (F.col("n") + PRIOR)
    calm = calm.join(F.broadcast(means), "lang", "left").withColumn("steady", steady)
    by_lang = calm.groupBy("lang").agg(F.percentile_approx("steady", quantile, 10_000).alias("q"), F.count("*").alias("docs"))
    everyone = calm.agg(F.percentile_approx("steady", quantile, 10_000).alias("q")).first()["q"]
    limits = means.join(by_lang, "lang").select("lang", "mean", F.when(F.col("docs") >= LEAST, F.col("q")).otherwise(F.lit(everyone)).alias("q"))
    limits = materialize(limits, "kn-limits")
    judged = total.join(small(limits, limits.count()), "lang", "left").withColumn("steady", steady)
    limit = F.coalesce("q", F.lit(everyone))
    return judged.select(
        "doc_id", "lang", "digest", F.col("n").alias("n_chars"), F.pow(F.lit(10.0), F.col("nll") / F.col("n")).alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"),
        (F.coalesce(F.col("steady") <= limit, F.lit(True)) | (F.col("n") <= 1)).alias("keep"),
    )


def op7_kneser_ney(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).drop("digest")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    key, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    bad = judge(docs, labels).filter("not keep").select(F.col("doc_id").alias(key), F.col("digest").alias(digest)).distinct()
    bad = materialize(bad, "kn-bad")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest))
    return docs.join(small(bad, bad.count()), match, "left_anti")
