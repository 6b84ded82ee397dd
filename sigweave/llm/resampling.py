"""Importance resampling towards a target distribution of hashed word and word-pair features.

Features of the corpus and of the target are counted in ``BUCKETS`` hashed buckets over all rows; a
bucket's gain is the log ratio of its two smoothed shares. A text's weight is its features' mean gain, looked
up in an array; a Gumbel variate seeded by doc_id makes a draw without replacement of the highest scores.
Scores are integers, so the draw needs no global sort: the histogram of scores, counted from the top,
gives each score's first rank and the score at which the draw ends; within a score rows are numbered by
doc_id.

The histogram is bounded whatever the input: a gain lies within 1000 * ln(2^63 * BUCKETS) of zero and a
variate between -3,100 and 23,000, so there are fewer than 140,000 scores, in fact some 20,000.

Nulls: a null text has no words: no features and weight 0; so has a null text of the target. A null
doc_id hashes ``7:null`` and comes last among equal scores. Repeated rows count each, and are drawn each; rows
that are equal in score and doc_id are ranked in any order, as they are alike but for their features'
number and weight, which order them then. An empty table gives no rows; an empty target has no features,
and gains stay defined. A very long text is taken alone, in memory of some times its size. Extra
columns pass by; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .crc_sql import CRC, crc32_sql

BUCKETS = 10_000
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Everything below 0x80 but digits and lower-case letters ends a word.
SPACED = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 0x20 for c in range(256))


def feature_buckets(text: bytes) -> tuple[np.ndarray, int]:
    """Buckets of all words and of all pairs of consecutive words of ``text``, and the number of words."""
    words = text.lower().translate(SPACED).split()
    one = list(map(crc32, words))
    two = map(crc32, map(b" ".__add__, words[1:]), one)  # a pair's checksum goes on from its first word's
    n = len(words)
    return np.fromiter((*one, *two), np.int64, max(0, 2 * n - 1)) % BUCKETS, n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS, np.int64)
    for part in slices(batches, 0):
        for text in part.column(0):
            held += np.bincount(feature_buckets(text.as_py() or b"")[0], minlength=BUCKETS)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket. Tasks send at most ``BUCKETS`` sums each to the shuffle, the driver gets that many."""
    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(_counts, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    whole, aim = int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: math.log(float(t + 1) * float(whole + BUCKETS) / (float(s + 1) * float(aim + BUCKETS)))
    return np.array([math.floor(1000 * ratio(s, t)) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def variate(doc_id: int | None) -> int:
    h = int(sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    table = held.value
    for part in slices(batches, 1):
        rows = []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
            buckets, n = feature_buckets(text.as_py() or b"")
            weight = int(table[buckets].sum()) // len(buckets) if n else 0
            rows.append((doc_id, len(buckets), n, weight, weight + variate(doc_id)))
        names = ["doc_id", "n_features", "n_words", "weight", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], names=names)


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: _scores(it, held), "doc_id long, n_features long, n_words long, weight long, score long")


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (as of ``scored``, written) with rank: 1, 2, .. for the draw's, in order of score; else null."""
    able = F.col("n_words") >= least_words
    histogram = sorted(((s, n) for s, n in rows.filter(able).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in histogram) // 100
    offsets, before = [], 0
    for score, n in histogram:
        if before >= wanted:
            break
        offsets.append((score, before))
        before += n
    if not offsets:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    at = F.broadcast(rows.sparkSession.createDataFrame(offsets, "score long, before long"))  # bounded, as the histogram
    chosen = able & (F.col("score") >= offsets[-1][0])
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("before") + F.row_number().over(order)
    high = rows.filter(chosen).join(at, "score").withColumn("rank", rank).drop("before")
    high = high.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return high.select(*rows.columns, "rank").unionByName(rows.filter(~chosen).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    rows = materialize(scored(docs, target), "scores")
    return drawn(rows).select("doc_id", "n_features", "weight", "score", "rank")


WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_OP12 = f"""
WITH {CRC},
split AS (
  SELECT 'd' AS kind, doc_id, {WORDS} AS words FROM documents
  UNION ALL
  SELECT 't', item_id, {WORDS} FROM benchmark
),
features AS (
  SELECT kind, doc_id, f, count(*) AS n
  FROM (SELECT kind, doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f FROM split)
  GROUP BY ALL
),
buckets AS (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc_steps),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 't'), 0)::DOUBLE AS t FROM features JOIN buckets USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain) AS total FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
scores AS (
  SELECT doc_id, len(coalesce(words, [])) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN ((total - ((total % n_features) + n_features) % n_features) // n_features)::BIGINT ELSE 0 END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS variate
  FROM split LEFT JOIN weights USING (doc_id) WHERE kind = 'd'
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + variate DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scores)
SELECT doc_id, n_features, weight, weight + variate AS score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank
FROM ranked
"""
