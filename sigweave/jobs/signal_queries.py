"""Queries of the signal operators over the given tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import align, clean, erp, features, labels, metrics, split, windows
from ..sources import standins as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
WINDOW, STEP = 64, 16
FIRST, LAST = -3, 5

# Shared parts of the oracle SQL.
S = "s AS (SELECT user_id AS recording_id, epoch_us(ts) / 1e6 AS t, value, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS sample_idx FROM events WHERE event_type <> 'signup')"
M = "m AS (SELECT user_id AS recording_id, event_id AS marker_id, epoch_us(ts) / 1e6 AS t, 30000 + CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 28 AS code FROM events WHERE event_type = 'signup')"
LABEL = "CASE WHEN code IN (9701, 9702, 8888, 8899, 9999) OR code // 10000 <> 3 THEN -1 WHEN code % 100 IN (1, 2, 7) THEN 1 WHEN code % 100 IN (3, 4, 5, 6, 8) THEN 2 WHEN code % 100 IN (11, 12) THEN 3 WHEN code % 100 IN (13, 14) THEN 4 ELSE -1 END"
A = f"a AS (SELECT m.*, {LABEL} AS label, (SELECT count(*) FROM s WHERE s.recording_id = m.recording_id AND s.t < m.t) AS sample_idx FROM m)"
E_ = f"""e AS (SELECT * FROM (SELECT x.recording_id, x.marker_id AS epoch_id, x.label, s.sample_idx - x.sample_idx AS rel_idx, s.value, count(*) OVER (PARTITION BY x.recording_id, x.marker_id) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, sample_idx ORDER BY marker_id) AS turn FROM a WHERE label > 0) x
  JOIN s ON s.recording_id = x.recording_id AND s.sample_idx BETWEEN x.sample_idx + {FIRST} AND x.sample_idx + {LAST} WHERE x.turn = 1) WHERE n = {LAST - FIRST + 1}),
b AS (SELECT recording_id, epoch_id, label, rel_idx, value - avg(CASE WHEN rel_idx <= 0 THEN value END) OVER (PARTITION BY recording_id, epoch_id) AS value FROM e)"""
EPOCHS = f"WITH {S}, {M}, {A}, {E_}"
L = "l AS (SELECT l_suppkey AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS sample_idx, l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax, l_returnflag AS action1, CASE WHEN l_linenumber = 1 THEN l_linestatus END AS action2, coalesce(CASE WHEN l_linenumber = 1 THEN l_linestatus END, l_returnflag) AS gesture FROM lineitem)"
X = "x AS (SELECT vec_id AS epoch_id, CAST(vec_id % 5 AS INT) AS group_id, label, i - 1 AS rel_idx, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, generate_series(1, 64) g(i))"
CHANNELS = src.CHANNELS


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def _indexed(spark, d):
    return align.sample_index(src.event_samples(spark, d))


def _events(spark, d):
    return labels.remap_events(align.align_markers(src.event_markers(spark, d), src.event_samples(spark, d)))


def _epochs(spark, d):
    return align.baseline(align.epochs(_events(spark, d), _indexed(spark, d), FIRST, LAST))


def _supplier(spark, d):
    """Wide supplier samples with sample_idx and gesture; a supplier's rows are far fewer than an executor holds."""
    w = Window.partitionBy("recording_id").orderBy(*src.SAMPLE_ORDER)
    return labels.flat_label(src.supplier_samples(spark, d)).withColumn("sample_idx", (F.row_number().over(w) - 1).cast("long")).drop(*src.SAMPLE_ORDER)


@query("erp_flagship", f"{EPOCHS} SELECT label, rel_idx, round(avg(value), 6) AS value, count(*) AS n FROM b GROUP BY 1, 2")
def erp_flagship(spark, d):
    """A4 over W1, J1, P6, J2 and J3: mean marker-locked response per class."""
    return _epochs(spark, d).groupBy("label", F.col("rel_idx").cast("long").alias("rel_idx")).agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("n"))


@query("w1_sample_index", f"WITH {S} SELECT recording_id, round(t, 6) AS t, sample_idx FROM s")
def w1(spark, d):
    return _indexed(spark, d).select("recording_id", F.round("t", 6).alias("t"), "sample_idx")


@query("j1_align_markers", f"WITH {S}, {M}, {A} SELECT recording_id, marker_id, code, sample_idx FROM a")
def j1(spark, d):
    return align.align_markers(src.event_markers(spark, d), src.event_samples(spark, d)).select("recording_id", "marker_id", "code", "sample_idx")


@query("p5_trigger_parts", f"WITH {M} SELECT marker_id, code, CAST(code // 10000 AS INT) AS phase, CAST(code // 1000 % 10 AS INT) AS arm, CAST(code // 100 % 10 AS INT) AS baseline, CAST(code % 100 AS INT) AS movement, {LABEL} AS label FROM m")
def p5(spark, d):
    return labels.trigger_parts(src.event_markers(spark, d)).drop("recording_id", "t")


@query("p6_a1_class_counts", f"WITH {M} SELECT label, count(*) AS n FROM (SELECT {LABEL} AS label FROM m) WHERE label > 0 GROUP BY 1")
def p6(spark, d):
    return labels.class_counts(labels.remap_events(src.event_markers(spark, d)), "label")


@query("j2_epochs", f"WITH {S}, {M}, {A}, {E_} SELECT recording_id, epoch_id, label, rel_idx, round(value, 6) AS value FROM e")
def j2(spark, d):
    return r6(align.epochs(_events(spark, d), _indexed(spark, d), FIRST, LAST).withColumn("rel_idx", F.col("rel_idx").cast("long")), "value")


@query("j3_baseline", f"{EPOCHS} SELECT recording_id, epoch_id, label, rel_idx, round(value, 6) AS value FROM b")
def j3(spark, d):
    return r6(_epochs(spark, d).withColumn("rel_idx", F.col("rel_idx").cast("long")), "value")


@query("j4_split_files", "SELECT l_returnflag AS action1, (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)) AS is_test, count(*) AS n FROM lineitem GROUP BY 1, 2")
def j4(spark, d):
    test = src.table(spark, d, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("recording_id"))
    return align.split_files(src.supplier_samples(spark, d), test).groupBy("action1", "is_test").agg(F.count("*").alias("n"))


@query("j5_contrasts", f"""{EPOCHS}, r AS (SELECT label, rel_idx, avg(value) AS value FROM b GROUP BY 1, 2)
SELECT p.label_1, p.label_2, x.rel_idx, round(x.value - y.value, 6) AS value FROM (VALUES (1, 2), (4, 3)) p(label_1, label_2) JOIN r x ON x.label = p.label_1 JOIN r y ON y.label = p.label_2 AND y.rel_idx = x.rel_idx""")
def j5(spark, d):
    response = erp.mean_response(_epochs(spark, d), "label", "rel_idx")
    return r6(erp.contrasts(response).withColumn("rel_idx", F.col("rel_idx").cast("long")), "value")


@query("j7_stream_roles", """SELECT o_custkey AS recording_id, arg_max(o_orderkey, length(o_orderpriority) * 1000000000 - o_orderkey) AS signal_stream,
 (array_agg(o_orderkey ORDER BY length(o_orderpriority), o_totalprice DESC, o_orderkey))[1] AS trigger_stream FROM orders GROUP BY 1""")
def j7(spark, d):
    return align.stream_roles(src.order_streams(spark, d))


@query("a2_sampling_freq", f"WITH {S}, g AS (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY t) AS gap FROM s) SELECT recording_id, round(avg(gap), 4) AS interval, round(1 / avg(gap), 9) AS fs FROM g GROUP BY 1")
def a2(spark, d):
    return windows.sampling_freq(src.event_samples(spark, d), "recording_id").select("recording_id", F.round("interval", 4).alias("interval"), F.round("fs", 9).alias("fs"))


@query("p1_p4_volts", "SELECT l_returnflag AS flag, round(sum(l_extendedprice * 1e-6), 6) AS volts, round(sum(l_partkey * 5.0 / 8388607 / 256), 6) AS amplified, count(*) FILTER (WHERE l_discount = 0) AS replaced, round(sum(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_tax / l_discount END), 4) AS repaired FROM lineitem GROUP BY 1")
def p1(spark, d):
    li = src.table(spark, d, "lineitem").withColumn("ratio", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount")))
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.sum(clean.to_volts(F.col("l_extendedprice"))), 6).alias("volts"), F.round(F.sum(clean.counts_to_volts(F.col("l_partkey"), clean.GAIN)), 6).alias("amplified"),
        F.count_if(F.abs("ratio") == float("inf")).alias("replaced"), F.round(F.sum(clean.finite_or_zero(F.col("ratio"))), 4).alias("repaired"),
    )


@query("p2_select_channels", "SELECT p_brand AS channel, count(*) AS n FROM part WHERE NOT starts_with(p_brand, 'AUX') AND NOT starts_with(p_brand, 'TRIGGER') AND p_brand <> 'Brand#11' AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size < 10) GROUP BY 1")
def p2(spark, d):
    part = src.table(spark, d, "part").select(F.col("p_brand").alias("channel"), "p_size")
    return labels.class_counts(clean.select_channels(part, ["Brand#11"], part.filter("p_size < 10")), "channel")


@query("p3_off_montage", "SELECT DISTINCT n_name AS channel FROM nation WHERE upper(n_name) NOT IN (SELECT upper(n_name) FROM nation WHERE n_regionkey <> 2)")
def p3(spark, d):
    nation = src.table(spark, d, "nation").withColumnRenamed("n_name", "channel")
    return clean.off_montage(nation, nation.filter("n_regionkey <> 2").select(F.lower("channel").alias("channel")))


GESTURES = {"A": 6, "F": 0, "N": 13, "O": 14, "R": 5}


@query("p7_p8_gestures", f"WITH {L} SELECT gesture, CASE gesture WHEN 'A' THEN 6 WHEN 'F' THEN 0 WHEN 'O' THEN 14 END AS gesture_id, count(*) AS n FROM l WHERE sample_idx > 0 GROUP BY 1, 2")
def p7(spark, d):
    return labels.gesture_ids(_supplier(spark, d).filter("sample_idx > 0"), GESTURES, ("A", "F", "O")).groupBy("gesture", "gesture_id").agg(F.count("*").alias("n"))


@query("p9_simplify_labels", "WITH modes(mode, old_label, new_label, name) AS (VALUES ('wrist_dir', 3, 0, 'flexion'), ('wrist_dir', 4, 1, 'extension'), ('hand_dir', 1, 0, 'open'), ('hand_dir', 2, 1, 'close'), ('fine_type', 5, 0, 'fine_open'), ('fine_type', 6, 1, 'fine_closed')) SELECT mode, new_label AS label, name, count(*) AS n FROM embeddings JOIN modes ON label = old_label GROUP BY 1, 2, 3")
def p9(spark, d):
    return labels.class_counts(labels.simplify_labels(src.embedding_epochs(spark, d), labels.modes_table(spark)), "mode", "label", "name")


@query("p10_flatten", "SELECT vec_id AS epoch_id, CAST(vec_id % 5 AS INT) AS group_id, label, 64 AS n, round(list_sum(list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) * i)), 4) AS checksum FROM embeddings")
def p10(spark, d):
    flat = features.flattened(src.embedding_epochs(spark, d, 4))
    check = F.aggregate(F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return flat.select("epoch_id", "group_id", "label", F.size("features").alias("n"), F.round(check, 4).alias("checksum"))


@query("p11_rectify", "SELECT l_suppkey AS recording_id, sum(abs(l_partkey % 1024 - 496.0)) AS rectified FROM lineitem GROUP BY 1")
def p11(spark, d):
    return src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("recording_id")).agg(F.sum(windows.rectify(F.col("l_partkey") % 1024)).alias("rectified"))


BYTES = "d AS (SELECT l_suppkey AS buffer, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos, CAST(l_partkey % 256 AS INT) AS byte FROM lineitem)"


@query("p12_decode_frames", f"""WITH {BYTES}, n AS (SELECT *, lead(byte) OVER (PARTITION BY buffer ORDER BY pos) AS nxt FROM d),
h AS (SELECT *, sum(CASE WHEN byte > 127 THEN 0 ELSE 1 END) OVER (PARTITION BY buffer ORDER BY pos) AS run FROM n WHERE pos >= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY buffer, run ORDER BY pos) AS place FROM h WHERE byte > 127)
SELECT buffer, pos, (byte & 127) * 128 + nxt AS frame FROM k WHERE place % 2 = 1 AND nxt IS NOT NULL""")
def p12(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(*src.SAMPLE_ORDER)
    data = src.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("buffer"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("l_partkey") % 256).cast("int").alias("byte"))
    return windows.decode_frames(data)


@query("a3_average_reference", f"WITH {L} SELECT recording_id, round(sum(abs(quantity - (quantity + extendedprice + discount + tax) / 4)), 3) AS quantity, round(sum(abs(tax - (quantity + extendedprice + discount + tax) / 4)), 3) AS tax FROM l GROUP BY 1")
def a3(spark, d):
    return clean.average_reference_wide(src.supplier_samples(spark, d), CHANNELS).groupBy("recording_id").agg(F.round(F.sum(F.abs("quantity")), 3).alias("quantity"), F.round(F.sum(F.abs("tax")), 3).alias("tax"))


@query("a3_average_reference_long", f"WITH {L}, u AS (SELECT recording_id, sample_idx, channel, value FROM l UNPIVOT (value FOR channel IN (quantity, extendedprice, discount, tax))), z AS (SELECT *, value - avg(value) OVER (PARTITION BY recording_id, sample_idx) AS y FROM u) SELECT channel, round(sum(abs(y)), 2) AS total FROM z GROUP BY 1")
def a3_long(spark, d):
    long = _supplier(spark, d).unpivot(["recording_id", "sample_idx"], list(CHANNELS), "channel", "value")
    return clean.average_reference(long).groupBy("channel").agg(F.round(F.sum(F.abs("value")), 2).alias("total"))


BASE = "z AS (SELECT recording_id, avg(value) AS mean, stddev_pop(value) AS std FROM s WHERE kind = 'view' GROUP BY 1)"


@query("a7_rest_baseline", f"WITH {S}, {BASE} SELECT recording_id, round(mean, 6) AS mean, round(std, 6) AS std FROM z")
def a7(spark, d):
    return r6(clean.rest_baseline(src.event_samples(spark, d), F.col("kind") == "view", "recording_id"), "mean", "std")


@query("a8_z_score", f"WITH {S}, {BASE} SELECT recording_id, count(*) AS n, round(avg((value - mean) / nullif(std, 0)), 5) AS z, round(max((value - mean) / nullif(std, 0)), 5) AS top FROM s JOIN z USING (recording_id) GROUP BY 1")
def a8(spark, d):
    samples = src.event_samples(spark, d)
    z = clean.z_score(samples, clean.rest_baseline(samples, F.col("kind") == "view", "recording_id"), "recording_id")
    return z.groupBy("recording_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("z"), F.round(F.max("value"), 5).alias("top"))


@query("a4_a5_response_spread", f"WITH {X}, g AS (SELECT label, rel_idx, avg(value) AS mean, stddev_pop(value) / sqrt(count(*)) AS sem FROM x GROUP BY 1, 2) SELECT label, rel_idx, round(mean, 6) AS mean, round(sem, 6) AS sem FROM g")
def a5(spark, d):
    return r6(erp.response_spread(erp.exploded(src.embedding_epochs(spark, d))).withColumn("rel_idx", F.col("rel_idx").cast("long")), "mean", "sem")


@query("a5_spread_summary", f"WITH {X}, g AS (SELECT label, rel_idx, stddev_pop(value) / sqrt(count(*)) AS sem FROM x GROUP BY 1, 2) SELECT label, round(avg(sem), 6) AS mean_sem, round(max(sem), 6) AS max_sem FROM g GROUP BY 1")
def a5b(spark, d):
    return r6(erp.spread_summary(erp.response_spread(erp.exploded(src.embedding_epochs(spark, d)))), "mean_sem", "max_sem")


@query("a6_at_times", f"WITH {X}, g AS (SELECT label, rel_idx, avg(value) AS value FROM x GROUP BY 1, 2) SELECT label, CAST(time AS DOUBLE) AS time, round(value, 6) AS value FROM g JOIN (VALUES (0.0, 0), (0.1, 6), (0.2, 13), (0.3, 19)) w(time, place) ON rel_idx = place")
def a6(spark, d):
    response = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d)), "label", "rel_idx")
    return r6(erp.at_times(response, (0.0, 0.1, 0.2, 0.3), 64).select("label", "time", "value"), "value")


@query("a9_reject_artefacts", f"WITH {X}, t AS (SELECT avg(value) + 4.2 * stddev_pop(value) AS lim FROM x) SELECT epoch_id, label FROM x, t GROUP BY epoch_id, label, lim HAVING max(value) - min(value) <= lim")
def a9(spark, d):
    epochs = src.embedding_epochs(spark, d)
    return clean.reject_artefacts(epochs, clean.artefact_threshold(epochs, 4.2)).select("epoch_id", "label")


PAIRS = " UNION ALL ".join(f"SELECT gesture AS task, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM l GROUP BY 1" for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :])


@query("a10_connectivity", f"WITH {L}, p AS ({PAIRS}) SELECT * FROM p UNION ALL SELECT task, b, a, r FROM p")
def a10(spark, d):
    rows = labels.flat_label(src.supplier_samples(spark, d)).withColumnRenamed("gesture", "task")
    return r6(erp.symmetric(erp.connectivity(rows, CHANNELS)), "r")


@query("j6_pair_join", f"WITH {X}, c AS (SELECT CAST(label AS VARCHAR) AS task, 'c' || (rel_idx // 16) AS channel, rel_idx % 16 AS i, avg(value) AS v FROM x GROUP BY 1, 2, 3) SELECT p.task, p.channel AS a, q.channel AS b, round(corr(p.v, q.v), 6) AS r FROM c p JOIN c q ON p.task = q.task AND p.i = q.i AND p.channel < q.channel GROUP BY 1, 2, 3")
def j6(spark, d):
    mean = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d, 4)), "label", "channel", "rel_idx").withColumn("task", F.col("label").cast("string"))
    return r6(erp.pair_correlation(erp.channel_pairs(mean)), "r")


@query("a11_segments", f"WITH {X}, c AS (SELECT label, rel_idx, avg(value) AS v FROM x GROUP BY 1, 2) SELECT CAST(label AS VARCHAR) AS task, CAST(rel_idx // 12 AS INT) AS segment, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM c WHERE rel_idx // 12 < 64 // 12 GROUP BY 1, 2")
def a11(spark, d):
    mean = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d)), "label", "channel", "rel_idx").withColumn("task", F.col("label").cast("string"))
    return r6(erp.segment_features(mean, 64, 12).drop("channel"), "mean", "std")


PRED = "p AS (SELECT quality AS label, CAST(n_chars > 500 AS INT) AS prediction FROM documents JOIN labels USING (doc_id))"


@query("a12_confusion", f"WITH {PRED}, k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p), g AS (SELECT x.c AS label, y.c AS prediction FROM k x, k y), f AS (SELECT g.label, g.prediction, count(p.label) AS n FROM g LEFT JOIN p ON p.label = g.label AND p.prediction = g.prediction GROUP BY 1, 2) SELECT label, prediction, n, round(n / nullif(sum(n) OVER (PARTITION BY label), 0), 6) AS share FROM f")
def a12(spark, d):
    return r6(metrics.confusion(src.length_predictions(spark, d)), "share")


SCORES = "k AS (SELECT DISTINCT c FROM (SELECT label AS c FROM p UNION ALL SELECT prediction FROM p)), q AS (SELECT c, (SELECT count(*) FROM p WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM p WHERE label = c) AS tr, (SELECT count(*) FROM p WHERE prediction = c) AS sa FROM k)"


@query("a13_scores", f"WITH {PRED}, {SCORES} SELECT round(sum(tp) / sum(tr), 6) AS accuracy, round(avg(tp / nullif(tr, 0)), 6) AS balanced_accuracy, round(avg(coalesce(2 * tp / nullif(tr + sa, 0), 0)), 6) AS f1_macro FROM q")
def a13(spark, d):
    return r6(metrics.scores(src.length_predictions(spark, d)), "accuracy", "balanced_accuracy", "f1_macro")


@query("a13_binary_scores", f"WITH {PRED}, {SCORES} SELECT round(tp / sa, 6) AS precision, round(tp / tr, 6) AS recall, round(2 * tp / (sa + tr), 6) AS f1 FROM q WHERE c = 1")
def a13b(spark, d):
    return r6(metrics.binary_scores(src.length_predictions(spark, d)), "precision", "recall", "f1")


@query("a14_fold_means", "WITH f AS (SELECT doc_id % 5 AS fold, avg(CAST(quality = CAST(n_chars > 500 AS INT) AS INT)) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT 'rule' AS run, round(avg(acc), 6) AS accuracy, count(*) AS folds FROM f")
def a14(spark, d):
    rows = src.length_predictions(spark, d).withColumn("fold", F.col("id") % 5)
    return r6(metrics.fold_means(metrics.scores(rows, "fold").withColumn("run", F.lit("rule")), "run").select("run", "accuracy", "folds"), "accuracy")


CAL = "q AS (SELECT recording_id, avg(value) AS mean, stddev_pop(value) AS std, avg(value) + 1.5 * stddev_pop(value) AS threshold FROM (SELECT *, min(t) OVER (PARTITION BY recording_id) AS t0 FROM s) WHERE t < t0 + 864000 GROUP BY 1)"
DAYS10, SIGMAS = 864_000.0, 1.5


def _hits(spark, d):
    samples = src.event_samples(spark, d)
    return windows.crossings(samples, windows.calibration(samples, DAYS10, SIGMAS))


@query("a15_calibration", f"WITH {S}, {CAL} SELECT recording_id, round(mean, 6) AS mean, round(std, 6) AS std, round(threshold, 6) AS threshold FROM q")
def a15(spark, d):
    return r6(windows.calibration(src.event_samples(spark, d), DAYS10, SIGMAS), "mean", "std", "threshold")


@query("a15_psd_calibration", f"""WITH {X}, c AS (SELECT epoch_id, label, 'c' || (rel_idx // 32) AS channel, rel_idx % 32 AS i, (value - avg(value) OVER (PARTITION BY epoch_id, rel_idx // 32)) * (0.54 - 0.46 * cos(2 * pi() * (rel_idx % 32) / 32)) AS v FROM x),
f AS (SELECT epoch_id, label, channel, q, 2 * (sum(v * cos(2 * pi() * q * i / 32)) ** 2 + sum(v * sin(2 * pi() * q * i / 32)) ** 2) / (64 * (SELECT sum((0.54 - 0.46 * cos(2 * pi() * j / 32)) ** 2) FROM generate_series(0, 31) h(j))) AS p FROM c, generate_series(1, 7) g(q) GROUP BY 1, 2, 3, 4),
m AS (SELECT epoch_id, label, channel, avg(p) AS p FROM f GROUP BY 1, 2, 3)
SELECT label, channel, round(avg(p), 8) AS mean, round(stddev_pop(p), 8) AS std, round(avg(p) + 4 * stddev_pop(p), 8) AS threshold FROM m GROUP BY 1, 2""")
def a15b(spark, d):
    """A15 per channel: each label's two-channel epochs at 64 Hz stand for a recording's calibration windows."""
    power = features.mean_psd(64, 1, 15, 32)("x")
    out = windows.psd_calibration(src.embedding_epochs(spark, d, 2), power, "label", "channel")
    return out.select("label", "channel", *[F.round(c, 8).alias(c) for c in ("mean", "std", "threshold")])


@query("w9_crossings", f"WITH {S}, {CAL}, h AS (SELECT recording_id, CAST(floor(t / 7200) AS BIGINT) AS win, value - mean > threshold - mean AS hit FROM s JOIN q USING (recording_id)) SELECT recording_id, win AS \"window\", bool_or(hit) AS any_hit FROM h GROUP BY 1, 2")
def w9(spark, d):
    return windows.window_hits(_hits(spark, d), 7200.0)


@query("w10_refractory", f"WITH RECURSIVE {S}, {CAL}, h AS MATERIALIZED (SELECT recording_id, t FROM s JOIN q USING (recording_id) WHERE value - mean > threshold - mean), acc AS (SELECT recording_id, min(t) AS t FROM h GROUP BY 1 UNION ALL SELECT a.recording_id, min(h.t) AS t FROM acc a JOIN h ON h.recording_id = a.recording_id AND h.t > a.t + 5400 GROUP BY a.recording_id) SELECT recording_id, round(t, 6) AS t FROM acc")
def w10(spark, d):
    return windows.accepted_hits(_hits(spark, d), 5400.0).select("recording_id", F.round("t", 6).alias("t"))


# A small shift keeps exact ties off the rounding.
FEATURES_SQL = "round(avg(abs(v)) + 1e-9, 7) AS mav, round(stddev_pop(v) + 1e-9, 7) AS std, round(var_pop(v) + 1e-9, 7) AS var, round(max(abs(v)) + 1e-9, 7) AS maxav, round(sqrt(avg(v * v)) + 1e-9, 7) AS rms"
UNPIVOT = "u AS (SELECT recording_id, sample_idx, gesture, channel, v FROM l UNPIVOT (v FOR channel IN (quantity, discount)))"
WIN = f"w AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((sample_idx - {WINDOW - 1}) / {STEP}.0) AS BIGINT)), sample_idx // {STEP})) AS window_id FROM u)"


@query("w2_f1_pane_features", f"WITH {L}, {UNPIVOT}, {WIN} SELECT recording_id, window_id, channel, arg_min(gesture, sample_idx) AS gesture, {FEATURES_SQL} FROM w GROUP BY 1, 2, 3 HAVING count(*) = {WINDOW}")
def w2(spark, d):
    out = windows.pane_features(_supplier(spark, d), WINDOW, STEP, ("quantity", "discount"), "gesture")
    return out.select("recording_id", "window_id", "channel", "gesture", *[F.round(F.col(c) + 1e-9, 7).alias(c) for c in ("mav", "std", "var", "maxav", "rms")])


@query("w2_f2_f3_array_features", f"""WITH {L}, {WIN.replace('FROM u)', 'FROM l)')}, c AS (SELECT *, discount - 0.05 AS v FROM w),
g AS (SELECT *, lag(v) OVER o AS p, lag(v, 2) OVER o AS pp, stddev_pop(quantity) OVER (PARTITION BY recording_id, window_id) AS sd FROM c WINDOW o AS (PARTITION BY recording_id, window_id ORDER BY sample_idx))
SELECT recording_id, window_id, arg_min(gesture, sample_idx) AS gesture, round(sum(abs(v - p)), 5) AS centred_wl, CAST(count(*) FILTER (WHERE sign(round(v, 9)) <> sign(round(p, 9))) AS DOUBLE) AS centred_zc, CAST(count(*) FILTER (WHERE round((v - p) * (p - pp), 9) < 0) AS DOUBLE) AS centred_ssc,
round(exp(avg(ln(quantity))), 5) AS quantity_log_det, CAST(count(*) FILTER (WHERE quantity > 0.2 * sd) AS DOUBLE) AS quantity_wamp, round(sum(quantity * quantity) * {WINDOW}, 2) AS quantity_total_power FROM g GROUP BY 1, 2 HAVING count(*) = {WINDOW}""")
def w2b(spark, d):
    rows = _supplier(spark, d).withColumn("centred", F.round(F.col("discount") - 0.05, 9))
    arrays = windows.sliding_windows(rows, WINDOW, STEP, ("centred", "quantity"), "gesture")
    keys = ["recording_id", "window_id", "gesture"]
    both = arrays.select(*keys, *[features.BUILT_IN[f](F.col("centred")).cast("double").alias(f"centred_{f}") for f in ("wl", "zc", "ssc")], *[features.BUILT_IN[f](F.col("quantity")).cast("double").alias(f"quantity_{f}") for f in ("log_det", "wamp", "total_power")])
    return both.select(*keys, F.round("centred_wl", 5).alias("centred_wl"), "centred_zc", "centred_ssc", F.round("quantity_log_det", 5).alias("quantity_log_det"), "quantity_wamp", F.round("quantity_total_power", 2).alias("quantity_total_power"))


FRAME = "(PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query("w4_hampel", f"WITH {S}, a1 AS (SELECT *, CASE WHEN count(value) OVER {FRAME} = 7 THEN median(value) OVER {FRAME} END AS med FROM s), a2 AS (SELECT *, abs(value - med) AS dev FROM a1), a3 AS (SELECT *, CASE WHEN count(dev) OVER {FRAME} = 7 THEN 1.4826 * median(dev) OVER {FRAME} END AS mad FROM a2) SELECT recording_id, sample_idx, value, CASE WHEN dev > 3.0 * mad THEN med ELSE value END AS cleaned FROM a3")
def w4(spark, d):
    return clean.hampel(_indexed(spark, d).select("recording_id", "sample_idx", "value"))


WIDE = "(PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)"


@query("w4_hampel_wide", f"WITH {S}, a1 AS (SELECT *, CASE WHEN count(value) OVER {WIDE} = 41 THEN median(value) OVER {WIDE} END AS med FROM s), a2 AS (SELECT *, abs(value - med) AS dev FROM a1), a3 AS (SELECT *, CASE WHEN count(dev) OVER {WIDE} = 41 THEN 1.4826 * median(dev) OVER {WIDE} END AS mad FROM a2) SELECT recording_id, sample_idx, value, CASE WHEN dev > 3.0 * mad THEN med ELSE value END AS cleaned FROM a3")
def w4b(spark, d):
    return clean.hampel(_indexed(spark, d).select("recording_id", "sample_idx", "value"), 20)


RUN = "r AS (SELECT recording_id, sample_idx, CASE WHEN count(*) OVER v = 10 THEN avg(value) OVER v END AS running FROM s WINDOW v AS (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"


@query("w5_w11_running_state", f"WITH {S}, {RUN}, t AS (SELECT recording_id, avg(running) + stddev_pop(running) AS threshold FROM r GROUP BY 1) SELECT recording_id, sample_idx, round(running, 6) AS running, round(threshold, 6) AS threshold, running > threshold AS above FROM r JOIN t USING (recording_id)")
def w5(spark, d):
    run = windows.running_mean(_indexed(spark, d).select("recording_id", "sample_idx", "value"), 10)
    return r6(windows.running_state(run).drop("value"), "running", "threshold")


@query("w5_stretched", f"""WITH {S}, {RUN}, z AS (SELECT recording_id, count(*) AS n, count(running) AS m FROM r GROUP BY 1), k AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) - 1 AS k, running FROM r WHERE running IS NOT NULL),
p AS (SELECT r.recording_id, r.sample_idx, (r.sample_idx * (m - 1)) / greatest(n - 1, 1) AS place FROM r JOIN z USING (recording_id) WHERE m > 0)
SELECT p.recording_id, p.sample_idx, round(x.running + (y.running - x.running) * (place - floor(place)) + 1e-9, 6) AS stretched FROM p JOIN k x ON x.recording_id = p.recording_id AND x.k = floor(place) JOIN k y ON y.recording_id = p.recording_id AND y.k = ceil(place)""")
def w5b(spark, d):
    run = windows.running_mean(_indexed(spark, d).select("recording_id", "sample_idx", "value"), 10)
    return windows.stretched(run).select("recording_id", "sample_idx", F.round(F.col("stretched") + 1e-9, 6).alias("stretched"))


@query("w6_downsample", f"WITH {S}, g AS (SELECT recording_id, CAST(floor(t / 86400) AS BIGINT) AS bin, kind, count(*) AS n, sum(value) AS sv FROM s GROUP BY 1, 2, 3), h AS (SELECT recording_id, bin, sum(sv) / sum(n) AS value, (array_agg(kind ORDER BY n DESC, kind))[1] AS label FROM g GROUP BY 1, 2) SELECT recording_id, bin, round(value, 6) AS value, label FROM h")
def w6(spark, d):
    return r6(clean.downsample(src.event_samples(spark, d).withColumnRenamed("kind", "label"), 86_400.0), "value")


RATE = 1 / 172_800


@query("w7_resample", f"""WITH {S}, c AS (SELECT recording_id, count(*) AS old, greatest(1, CAST(floor((max(t) - min(t)) * {RATE!r}::DOUBLE) AS BIGINT)) AS new FROM s GROUP BY 1),
k AS (SELECT recording_id, old, new, unnest(generate_series(0, least(old, new) // 2)) AS k FROM c),
x AS (SELECT k.recording_id, k, any_value(old) AS old, any_value(new) AS new, sum(value * cos(2 * pi() * ((k * sample_idx) % old) / old)) AS re, -sum(value * sin(2 * pi() * ((k * sample_idx) % old) / old)) AS im FROM k JOIN s USING (recording_id) GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN k = 0 THEN 1 WHEN 2 * k = least(old, new) THEN CASE WHEN new < old THEN 2 ELSE 1 END ELSE 2 END AS weight FROM x),
y AS (SELECT *, unnest(generate_series(0, new - 1)) AS j FROM w)
SELECT recording_id, 'v' AS channel, j AS sample_idx, round(sum(weight * (re * cos(2 * pi() * ((k * j) % new) / new) - im * sin(2 * pi() * ((k * j) % new) / new))) / any_value(old) + 1e-9, 6) AS value FROM y GROUP BY recording_id, j""")
def w7(spark, d):
    long = _indexed(spark, d).select("recording_id", F.lit("v").alias("channel"), "sample_idx", "t", "value")
    return clean.resample(long, RATE).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("w7_resample_chunked", ORACLE["w7_resample"])
def w7_chunked(spark, d):
    """The same in chunks shorter than the recordings, so that these are transformed over a grid."""
    long = _indexed(spark, d).select("recording_id", F.lit("v").alias("channel"), "sample_idx", "t", "value")
    return clean.resample(long, RATE, chunk=16).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("w8_transitions", f"WITH {S}, g AS (SELECT *, lag(kind) OVER (PARTITION BY recording_id ORDER BY t, kind) AS before FROM s) SELECT recording_id, before, kind, count(*) AS n FROM g WHERE before <> kind GROUP BY 1, 2, 3")
def w8(spark, d):
    return windows.transitions(src.event_samples(spark, d), "kind").groupBy("recording_id", "before", "kind").agg(F.count("*").alias("n"))


DFT = f"""{X}, f AS (SELECT epoch_id, k, sum(value * cos(2 * pi() * k * rel_idx / 64)) AS re, sum(value * sin(2 * pi() * k * rel_idx / 64)) AS im FROM x, generate_series(0, 63) g(k) GROUP BY 1, 2), w AS (SELECT epoch_id, CASE WHEN k < 32 THEN k ELSE k - 64 END AS freq, re * re + im * im AS p FROM f)"""


@query("f4_fft_features", f"WITH {DFT} SELECT epoch_id, round(sum(p), 3) AS total_power, round(sum(freq * p) / sum(p), 4) AS mean_freq, round(median(freq * p), 3) AS median_freq FROM w GROUP BY 1")
def f4(spark, d):
    x = F.col("x")
    return src.embedding_epochs(spark, d).select("epoch_id", F.round(features.total_power(x), 3).alias("total_power"), F.round(features.mean_freq(64)(x), 4).alias("mean_freq"), F.round(features.fft_feature(64, "median_freq")(x), 3).alias("median_freq"))


@query("f4_peak_freq", f"WITH {DFT} SELECT epoch_id, CAST(arg_max(freq, p) AS DOUBLE) AS peak_freq FROM w WHERE freq >= 0 OR freq = -32 GROUP BY 1")
def f4b(spark, d):
    return src.embedding_epochs(spark, d).select("epoch_id", features.fft_feature(64, "peak_freq")("x").alias("peak_freq"))


EMB_BANDS = ((4, 8), (8, 12), (13, 30))


@query("f5_log_band_power", f"""WITH {X}, g AS (SELECT epoch_id, k AS seg, rel_idx - 16 * k AS i, value FROM x, generate_series(0, 2) h(k) WHERE rel_idx BETWEEN 16 * k AND 16 * k + 31),
c AS (SELECT *, (value - avg(value) OVER (PARTITION BY epoch_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS v FROM g),
f AS (SELECT epoch_id, seg, q, (sum(v * cos(2 * pi() * q * i / 32)) ** 2 + sum(v * sin(2 * pi() * q * i / 32)) ** 2) / (64 * 12.0) * (CASE WHEN q IN (0, 16) THEN 1 ELSE 2 END) AS p FROM c, generate_series(0, 16) h(q) GROUP BY 1, 2, 3),
s AS (SELECT epoch_id, 2 * q AS freq, avg(p) AS p FROM f GROUP BY 1, 2), b(band, lo, hi) AS (VALUES (0, 4, 8), (1, 8, 12), (2, 13, 30)),
t AS (SELECT epoch_id, band, p, lead(p) OVER (PARTITION BY epoch_id, band ORDER BY freq) AS nx FROM s JOIN b ON freq >= lo AND freq < hi)
SELECT epoch_id, band, round(ln(coalesce(sum((p + nx) / 2 * 2), 0) + 1e-12), 2) AS power FROM t GROUP BY 1, 2""")
def f5(spark, d):
    power = features.log_band_power(64, EMB_BANDS, 32, 16)
    return src.embedding_epochs(spark, d).select("epoch_id", F.posexplode(power("x")).alias("band", "power")).select("epoch_id", "band", F.round(F.col("power").cast("double"), 2).alias("power"))


@query("f6_response_bands", f"""WITH {X}, r AS (SELECT label, rel_idx, avg(value) AS value FROM x GROUP BY 1, 2), c AS (SELECT label, rel_idx, (value - avg(value) OVER (PARTITION BY label)) * (0.54 - 0.46 * cos(2 * pi() * rel_idx / 64)) AS v FROM r),
p AS (SELECT label, q, 2 * (sum(v * cos(2 * pi() * q * rel_idx / 64)) ** 2 + sum(v * sin(2 * pi() * q * rel_idx / 64)) ** 2) / (64 * (64 * (0.54 * 0.54 + 0.46 * 0.46 / 2))) AS p FROM c, generate_series(4, 30) h(q) GROUP BY 1, 2),
b(band, lo, hi) AS (VALUES (0, 4, 8), (1, 8, 12), (2, 13, 30)) SELECT label, band, round(avg(p), 6) AS power FROM p JOIN b ON q BETWEEN lo AND hi GROUP BY 1, 2""")
def f6(spark, d):
    response = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d)), "label", "channel", "rel_idx")
    arrays = response.groupBy("label", "channel").agg(F.array_sort(F.collect_list(F.struct("rel_idx", "value")))["value"].alias("x"))
    return r6(arrays.select("label", F.posexplode(features.band_mean(64, EMB_BANDS)("x")).alias("band", "power")), "power")


@query("f7_periodogram", f"WITH {X}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY epoch_id) AS v FROM x), f AS (SELECT epoch_id, k, 2 * (sum(v * cos(2 * pi() * k * rel_idx / 64)) ** 2 + sum(v * sin(2 * pi() * k * rel_idx / 64)) ** 2) / (64 * 64) AS p FROM c, generate_series(8, 12) g(k) GROUP BY 1, 2) SELECT epoch_id, round(sum(p * CASE WHEN k IN (8, 12) THEN 1 WHEN k IN (9, 11) THEN 4 ELSE 2 END) / 3, 6) AS power FROM f GROUP BY 1")
def f7(spark, d):
    return src.embedding_epochs(spark, d).select("epoch_id", F.round(features.periodogram_power(64, 8, 12)("x"), 6).alias("power"))


@query("f8_mean_psd", f"""WITH {X}, g AS (SELECT epoch_id, 'c' || (rel_idx // 16) AS channel, rel_idx % 16 AS i, value FROM x), c AS (SELECT epoch_id, channel, i, (value - avg(value) OVER (PARTITION BY epoch_id, channel)) * (0.54 - 0.46 * cos(2 * pi() * i / 16)) AS v FROM g),
p AS (SELECT epoch_id, channel, q, 2 * (sum(v * cos(2 * pi() * q * i / 16)) ** 2 + sum(v * sin(2 * pi() * q * i / 16)) ** 2) / (64 * (16 * (0.54 * 0.54 + 0.46 * 0.46 / 2))) AS p FROM c, generate_series(1, 3) h(q) GROUP BY 1, 2, 3)
SELECT epoch_id, channel, round(avg(p), 6) AS power FROM p GROUP BY 1, 2""")
def f8(spark, d):
    return src.embedding_epochs(spark, d, 4).select("epoch_id", "channel", F.round(features.mean_psd(64, n_fft=16)("x"), 6).alias("power"))


def _supplier_long(spark, d):
    return _supplier(spark, d).unpivot(["recording_id", "sample_idx"], list(CHANNELS), "channel", "value")


@query("f9_averaged_psd", f"""WITH {L}, u AS (SELECT recording_id, channel, sample_idx // 64 AS seg, sample_idx % 64 AS i, CAST(v AS DOUBLE) AS v, count(*) OVER (PARTITION BY recording_id, channel, sample_idx // 64) AS n FROM l UNPIVOT (v FOR channel IN (quantity, extendedprice, discount, tax))),
c AS (SELECT recording_id, channel, seg, i, (v - avg(v) OVER (PARTITION BY recording_id, channel, seg)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM u WHERE n = 64),
p AS (SELECT recording_id, channel, seg, q, (sum(v * cos(2 * pi() * q * i / 64)) ** 2 + sum(v * sin(2 * pi() * q * i / 64)) ** 2) / (64 * 24.0) * (CASE WHEN q IN (0, 32) THEN 1 ELSE 2 END) AS p FROM c, generate_series(0, 32) h(q) GROUP BY 1, 2, 3, 4)
SELECT channel, CAST(q AS DOUBLE) AS freq, round(ln(avg(p)), 6) AS power FROM p GROUP BY 1, 2""")
def f9(spark, d):
    return features.averaged_psd(_supplier_long(spark, d), 64, 64, 32).select("channel", "freq", F.round(F.log("power"), 6).alias("power"))


def _task_means(spark, d, channels=1):
    response = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d, channels)), "label", "channel", "rel_idx")
    return response.groupBy(F.col("label").cast("string").alias("task"), "channel").agg(F.array_sort(F.collect_list(F.struct("rel_idx", "value")))["value"].alias("x"))


def _tf(spark, d):
    return features.time_frequency(_task_means(spark, d), 64, range(1, 31), ((1, 4), (4, 8), (8, 12), (12, 30)))


#: Taper of l = 0 to 31 samples with its norm, at a place 16 samples after the value it is centred on.
TF = f"""{X}, c AS (SELECT CAST(label AS VARCHAR) AS task, @channel@ AS channel, @i@ AS i, avg(value) AS v FROM x GROUP BY 1, 2, 3),
w AS (SELECT f, tap, l, sin(pi() * tap * (l + 1) / 33) / sqrt(16.5) AS a, 2 * pi() * f * (l - 16) / 64 AS angle FROM generate_series(1, 29) f(f), generate_series(1, 3) t(tap), generate_series(0, 31) l(l)),
z AS (SELECT task, channel, f, tap, i + l - 16 AS spot, sum(v * a * cos(angle)) AS re, sum(v * a * sin(angle)) AS im FROM c, w WHERE i + l - 16 BETWEEN 0 AND @last@ GROUP BY 1, 2, 3, 4, 5),
tf AS (SELECT task, channel, CAST(CASE WHEN f < 4 THEN 0 WHEN f < 8 THEN 1 WHEN f < 12 THEN 2 ELSE 3 END AS INT) AS band, CAST(spot // 12 AS INT) AS time_bin, sum(re * re + im * im) / 3 / count(DISTINCT f) / 12 AS power FROM z GROUP BY 1, 2, 3, 4)"""


def tf_sql(channels: int) -> str:
    n = 64 // channels
    return TF.replace("@channel@", f"'c' || (rel_idx // {n})").replace("@i@", f"rel_idx % {n}").replace("@last@", str(n // 12 * 12 - 1))


@query("f10_time_frequency", f"WITH {tf_sql(1)} SELECT task, channel, band, time_bin, round(power, 6) AS power FROM tf")
def f10(spark, d):
    return r6(_tf(spark, d), "power")


@query("f11_envelope", f"""WITH {X}, y AS (SELECT a.epoch_id, a.rel_idx, any_value(a.value) AS value, sum(CASE WHEN (a.rel_idx - b.rel_idx) % 2 <> 0 THEN b.value * 2 / 64 / tan(pi() * (a.rel_idx - b.rel_idx) / 64) ELSE 0 END) AS h FROM x a JOIN x b USING (epoch_id) GROUP BY 1, 2)
SELECT epoch_id, round(avg(sqrt(value * value + h * h)), 6) AS mean, round(max(sqrt(value * value + h * h)), 6) AS top FROM y GROUP BY 1""")
def f11(spark, d):
    return src.embedding_epochs(spark, d).select("epoch_id", F.posexplode(features.envelope("x")).alias("rel_idx", "value")).groupBy("epoch_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))


@query("f12_feature_frame")
def f12(spark, d):
    power = _tf(spark, d).groupBy("task", F.col("channel").alias("item")).agg(F.array_sort(F.collect_list(F.struct("band", "time_bin", "power")))["power"].alias("values"))
    rows = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d, 4)), "label", "channel", "rel_idx").withColumn("task", F.col("label").cast("string"))
    corr = erp.pair_correlation(erp.channel_pairs(rows)).select("task", F.concat_ws("-", "a", "b").alias("item"), F.array("r").alias("values"))
    parts = erp.segment_features(rows, 16, 4).groupBy("task", F.col("channel").alias("item")).agg(F.array_sort(F.collect_list(F.struct("segment", "mean", "std"))).alias("z"))
    mstd = parts.select("task", "item", F.concat(F.col("z.mean"), F.col("z.std")).alias("values"))
    return features.feature_frame(power, corr, mstd).withColumn("values", F.transform("values", lambda v: F.round(v, 6)))


@query("f12_feature_values", f"""WITH {tf_sql(1)}, h AS (SELECT CAST(label AS VARCHAR) AS task, 'c' || (rel_idx // 16) AS channel, rel_idx % 16 AS i, avg(value) AS v FROM x GROUP BY 1, 2, 3),
g AS (SELECT task, channel, i // 4 AS segment, avg(v) AS mean, stddev_pop(v) AS std FROM h GROUP BY 1, 2, 3),
o AS (SELECT 'freq' AS section, channel AS item, task, band * (SELECT max(time_bin) + 1 FROM tf) + time_bin AS place, power AS value FROM tf
UNION ALL SELECT 'corr', p.channel || '-' || q.channel, p.task, 0, corr(p.v, q.v) FROM h p JOIN h q ON p.task = q.task AND p.i = q.i AND p.channel < q.channel GROUP BY p.task, p.channel, q.channel
UNION ALL SELECT 'mstd', channel, task, segment, mean FROM g UNION ALL SELECT 'mstd', channel, task, 4 + segment, std FROM g)
SELECT section, item, task, CAST(place AS INT) AS place, round(value, 6) AS value FROM o""")
def f12_values(spark, d):
    """The values of ``f12_feature_frame``, a row each."""
    return f12(spark, d).select("section", "item", "task", F.posexplode("values").alias("place", "value"))


def _by_channel(wide, **parts):
    """recording_id, channel, n and aggregates of each channel of wide samples."""
    one = [F.struct(F.lit(c).alias("channel"), F.count("*").alias("n"), *[f(c).alias(name) for name, f in parts.items()]).alias(c) for c in CHANNELS]
    return wide.groupBy("recording_id").agg(*one).select("recording_id", F.inline(F.array(*CHANNELS)))


@query("c1_fir_small", f"WITH {L}, u AS (SELECT recording_id, channel, sample_idx, CAST(v AS DOUBLE) AS v, max(sample_idx) OVER (PARTITION BY recording_id) AS top FROM l UNPIVOT (v FOR channel IN (quantity, extendedprice, discount, tax))), f AS (SELECT recording_id, channel, sample_idx, top, 0.25 * lag(v) OVER w + 0.5 * v + 0.25 * lead(v) OVER w AS value FROM u WINDOW w AS (PARTITION BY recording_id, channel ORDER BY sample_idx)) SELECT recording_id, channel, sample_idx, round(value, 6) AS value FROM f WHERE sample_idx BETWEEN 1 AND top - 1")
def c1_small(spark, d):
    top = src.supplier_samples(spark, d).groupBy("recording_id").agg((F.count("*") - 1).alias("top"))
    out = clean.fir_filter_wide(_supplier(spark, d), CHANNELS, [0.25, 0.5, 0.25], chunk=100).join(top, "recording_id").filter("sample_idx between 1 and top - 1")
    return out.unpivot(["recording_id", "sample_idx"], list(CHANNELS), "channel", "value").select("recording_id", "channel", "sample_idx", F.round("value", 6).alias("value"))


@query("c1_c2_band_pass_notch")
def c1(spark, d):
    # Both filters in one pass: their taps are convolved.
    taps = np.convolve(kernels.fir_taps(300, 8, 50), kernels.notch_taps(300, 50, 2, 6))
    return _by_channel(clean.fir_filter_wide(_supplier(spark, d), CHANNELS, taps, chunk=4096), std=lambda v: F.round(F.stddev_pop(v), 6))


def _sections_sql(sections, source: str, name: str) -> str:
    """A recursive CTE ``name`` (recording_id, channel, n, p, i, y) that runs sections over the list x of each row of ``source``, sample by sample."""
    k = range(len(sections))
    g = sections[0][0]
    inputs, outputs = ["x[i + 1]"], []
    for j in k:
        outputs.append(f"({sections[j][0]!r} * {inputs[j]} + a{j})")
        inputs.append(outputs[j])
    first = ", ".join(f"{-g!r} * x[1] AS a0, {-g!r} * x[1] AS b0" if j == 0 else f"0.0::DOUBLE AS a{j}, 0.0::DOUBLE AS b{j}" for j in k)
    step = ", ".join(f"{-sections[j][1]!r} * {outputs[j]} + b{j}, {-sections[j][0]!r} * {inputs[j]} - {sections[j][2]!r} * {outputs[j]}" for j in k)
    return f"{name} AS (SELECT recording_id, channel, n, p, x, 0 AS i, NULL::DOUBLE AS y, {first} FROM {source} UNION ALL SELECT recording_id, channel, n, p, x, i + 1, {outputs[-1]}, {step} FROM {name} WHERE i < len(x))"


_SECTIONS = kernels.butterworth_sections(300, 8, 45, 2).tolist()


@query("c3_iir_sections", f"""WITH RECURSIVE {L}, u AS (SELECT recording_id, channel, list(CAST(v AS DOUBLE) ORDER BY sample_idx) AS x, count(*) AS n, least(count(*) - 1, 112) AS p FROM l UNPIVOT (v FOR channel IN (quantity, extendedprice, discount, tax)) GROUP BY 1, 2),
e AS (SELECT recording_id, channel, n, p, list_concat(list_concat(list_transform(range(p, 0, -1), lambda i: 2 * x[1] - x[i + 1]), x), list_transform(range(1, p + 1), lambda i: 2 * x[n] - x[n - i])) AS x FROM u),
{_sections_sql(_SECTIONS, "e", "f")},
r AS (SELECT recording_id, channel, n, p, list(y ORDER BY i DESC) AS x FROM f WHERE i > 0 GROUP BY ALL),
{_sections_sql(_SECTIONS, "r", "b")}
SELECT recording_id, channel, count(*) AS n, round(stddev_pop(y), 4) AS std, round(max(abs(y)), 4) AS peak FROM b WHERE i > p AND i <= p + n GROUP BY 1, 2""")
def c3_sections(spark, d):
    """Two sections, in chunks of 256 samples."""
    out = clean.iir_filter_wide(_supplier(spark, d), CHANNELS, 300, 8, 45, order=2, chunk=256)
    return _by_channel(out, std=lambda v: F.round(F.stddev_pop(v), 4), peak=lambda v: F.round(F.max(F.abs(v)), 4))


@query("c3_iir")
def c3(spark, d):
    return _by_channel(clean.iir_filter_wide(_supplier(spark, d), CHANNELS, 300, 1, 45), std=lambda v: F.round(F.stddev_pop(v), 6))


MD5 = "md5(concat('42|', CAST({0} AS VARCHAR)))"


@query("k1_group_split", f"WITH g AS (SELECT DISTINCT vec_id % 5 AS g FROM embeddings), r AS (SELECT g, row_number() OVER (ORDER BY {MD5.format('g')}, g) AS r, count(*) OVER () AS n FROM g) SELECT vec_id AS epoch_id, CAST(vec_id % 5 AS INT) AS group_id, r <= ceil(0.2 * n) AS is_test FROM embeddings JOIN r ON g = vec_id % 5")
def k1(spark, d):
    return split.group_split(src.embedding_epochs(spark, d).select("epoch_id", "group_id"), "group_id")


RANK = f"r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {MD5.format('vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query("k2_stratified_split", f"WITH {RANK} SELECT vec_id AS epoch_id, label, r <= floor(n * 0.2 + 0.5) AS is_test FROM r")
def k2(spark, d):
    return split.stratified_split(src.embedding_epochs(spark, d).select("epoch_id", "label"), "label", "epoch_id")


@query("k3_stratified_folds", f"WITH {RANK} SELECT vec_id AS epoch_id, label, CAST((r - 1) % 5 AS INT) AS fold FROM r")
def k3(spark, d):
    return split.stratified_folds(src.embedding_epochs(spark, d).select("epoch_id", "label"), "label", "epoch_id")


@query("k4_file_split", f"WITH g AS (SELECT DISTINCT l_suppkey AS g FROM lineitem), r AS (SELECT g, row_number() OVER (ORDER BY {MD5.format('g')}, g) AS r, count(*) OVER () AS n FROM g) SELECT g AS recording_id, r <= ceil(0.2 * n) AS is_test, count(*) AS n FROM lineitem JOIN r ON g = l_suppkey GROUP BY 1, 2")
def k4(spark, d):
    return split.group_split(src.supplier_samples(spark, d).select("recording_id"), "recording_id").groupBy("recording_id", "is_test").agg(F.count("*").alias("n"))


@query("k5_balance_rest", f"WITH c AS (SELECT CAST(floor(count(*) FILTER (WHERE label <> 0) * 0.05 / 0.95) AS BIGINT) AS k FROM embeddings), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label = 0 ORDER BY {MD5.format('vec_id')}, vec_id) AS r FROM embeddings) SELECT vec_id AS epoch_id, label FROM r, c WHERE label <> 0 OR r <= k")
def k5(spark, d):
    return split.balance_rest(src.embedding_epochs(spark, d).select("epoch_id", "label"), F.col("label") == 0, "epoch_id", 0.05)


@query("k6_best", "SELECT o_custkey AS name, sum(o_totalprice) AS score FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def k6(spark, d):
    totals = src.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return split.best(totals, "score", "name")


ORACLE["k6_best"] = "SELECT o_custkey AS name, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"


@query("k7_concatenate", "SELECT group_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 'events' AS group_id, value FROM events UNION ALL SELECT 'lineitem', l_quantity FROM lineitem) GROUP BY 1")
def k7(spark, d):
    parts = [src.table(spark, d, "events").select(F.lit("events").alias("group_id"), "value"), src.table(spark, d, "lineitem").select(F.lit("lineitem").alias("group_id"), F.col("l_quantity").alias("value"))]
    return split.concatenated(parts).groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


