"""Queries of the models, comparisons, streams and sources over the given tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, clean, decoder, erp, features, labels, metrics, models, split
from ..sources import io
from ..sources import standins as src
from ..streaming import streams
from . import decoding, pipelines, training
from . import signal_queries as sig

QUERIES: dict[str, sig.Query] = {}
ORACLE: dict[str, str] = {}
BANDS = {"bands": sig.EMB_BANDS, "nperseg": 16}
FS = 64


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


scratch = io.shared_folder


def _hands(spark, d, channels: int = 4) -> DataFrame:
    """Epochs of two classes, relabelled 0 and 1."""
    modes = labels.modes_table(spark, {"hand_dir": labels.MODES["hand_dir"]})
    return labels.simplify_labels(src.embedding_epochs(spark, d, channels), modes).drop("mode", "name")


def _split(epochs: DataFrame) -> tuple[DataFrame, DataFrame]:
    dealt = split.group_split(epochs, "group_id")
    return dealt.filter("not is_test").drop("is_test"), dealt.filter("is_test").drop("is_test")


def _scored(predictions: DataFrame, name: str) -> DataFrame:
    return sig.r6(metrics.scores(predictions), "accuracy", "balanced_accuracy", "f1_macro").withColumn("model", F.lit(name))


@query("m1_scaler", "WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) g(i)), t AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE vec_id % 5 <> 0 GROUP BY 1) SELECT vec_id AS epoch_id, round(sum((v - m) / s), 4) AS total FROM x JOIN t USING (i) WHERE vec_id % 5 = 0 GROUP BY 1")
def m1(spark, d):
    rows = src.embedding_epochs(spark, d).withColumnRenamed("x", "features")
    mean, std = models.scaler(rows.filter("group_id <> 0"))
    return models.scaled(rows.filter("group_id = 0"), mean, std).select("epoch_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def _run(model: str, features: str):
    def f(spark, d):
        train, test = _split(_hands(spark, d))
        return _scored(training.fit_predict(train, test, features, model, FS, max_iter=500, **(BANDS if features == "bandpower" else {})), model)

    return f


QUERIES["m2_logistic"] = _run("logreg", "none")
QUERIES["m2_logistic_bandpower"] = _run("logreg", "bandpower")
QUERIES["m3_linear_svm"] = _run("lsvm", "none")
QUERIES["m5_csp_lda"] = _run("csp_lda", "none")


@query("m4_lda")
def m4(spark, d):
    train, test = (training.feature_rows(x, "none", FS) for x in _split(src.embedding_epochs(spark, d)))
    return _scored(models.LDA(train).predict(test), "lda")


_CLASS_SUMS = "n, n / sum(n) OVER () AS prior, ma, mb, sa, sb, r, least(greatest((q / n - 2 - 2 * r * r) / (n * 2), 0), r * r) AS beta"


@query("m7_pipeline", f"""WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, vec_id % 5 = 0 AS test FROM embeddings),
m AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM e WHERE NOT test GROUP BY 1),
q AS (SELECT label, sum((((a - ma) / sa) ** 2 + ((b - mb) / sb) ** 2) ** 2) AS q FROM e JOIN m USING (label) WHERE NOT test GROUP BY 1),
k AS (SELECT label, {_CLASS_SUMS} FROM m JOIN q USING (label)),
c AS (SELECT sum(prior * sa * sa) AS aa, sum(prior * sb * sb) AS bb, sum(prior * (1 - CASE WHEN r = 0 THEN 0 ELSE beta / (r * r) END) * r * sa * sb) AS ab FROM k),
w AS (SELECT label, prior, ma, mb, (bb * ma - ab * mb) / (aa * bb - ab * ab) AS wa, (aa * mb - ab * ma) / (aa * bb - ab * ab) AS wb FROM k, c),
p AS (SELECT vec_id, e.label, arg_max(w.label, a * wa + b * wb - (ma * wa + mb * wb) / 2 + ln(prior)) AS prediction FROM e, w WHERE test GROUP BY 1, 2)
SELECT label, prediction, count(*) AS n FROM p GROUP BY 1, 2""")
def m7(spark, d):
    """A pipeline of flat epochs, scaler and discriminant fitted, saved, loaded and applied to other groups; each epoch of two samples."""
    epochs = src.embedding_epochs(spark, d).withColumn("x", F.slice("x", 1, 2))
    path = scratch(spark, "pipeline")
    pipelines.pipeline("none", "lda").fit(epochs.filter("group_id <> 0")).write().save(path)
    out = PipelineModel.load(path).transform(epochs.filter("group_id = 0"))
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


QUERIES["m7_lda_bandpower"] = _run("lda", "bandpower")


@query("m6_forest_grid")
def m6(spark, d):
    train, test = (training.feature_rows(x, "bandpower", FS, **BANDS) for x in _split(_hands(spark, d)))
    best = models.forest_grid(train, trees=(10, 20), depths=(3, 5), leaves=(1,), folds=2)
    return _scored(models.predict(best.bestModel, test), "forest")


@query("m8_training_run")
def m8(spark, d):
    out = training.run(_hands(spark, d), "bandpower", "logreg", FS, cv=3, ignore_groups=True, max_iter=500, outdir=scratch(spark, "run"), **BANDS)
    return sig.r6(out, "accuracy", "balanced_accuracy", "f1_macro")


@query("m9_comparison")
def m9(spark, d):
    modes = labels.modes_table(spark, labels.MODES)
    return sig.r6(training.compare(src.embedding_epochs(spark, d, 4), modes, FS, **BANDS), "accuracy", "balanced_accuracy", "f1_macro")


@query("c4_ica")
def c4(spark, d):
    samples = src.supplier_samples(spark, d)
    ica = models.ICA(samples, list(src.CHANNELS), n=4)
    out = ica.sources(samples, list(src.CHANNELS))
    return out.groupBy("recording_id").agg(*[F.round(F.stddev_pop(f"s{i}"), 4).alias(f"s{i}") for i in range(4)])


def _drained(spark, stream, tag):
    return streams.drained(stream, scratch(spark, tag), scratch(spark, f"{tag}-checkpoint"))


def nearest_sql(names: list[str], keys: str) -> str:
    """CTEs that predict, for the rows of f (keys, label, features, train), the label with the nearest mean of scaled features."""
    sc = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in names)
    z = ", ".join(f"({n} - m_{n}) / s_{n} AS z_{n}" for n in names)
    c = ", ".join(f"avg(z_{n}) AS c_{n}" for n in names)
    far = " + ".join(f"(z_{n} - c_{n}) ** 2" for n in names)
    return f"sc AS (SELECT {sc} FROM f WHERE train), g AS (SELECT f.*, {z} FROM f, sc), c AS (SELECT label AS name, {c} FROM g WHERE train GROUP BY 1), p AS (SELECT {keys}, arg_min(name, {far}) AS prediction FROM g, c GROUP BY {keys}), d AS (SELECT * FROM f JOIN p USING ({keys}))"


OFFLINE = ["mav", "std", "maxav"]
MS, STEP_MS = 1e9, 2.5e8


@query("w3_offline_decoding", f"""WITH {sig.S}, r AS (SELECT 1 / avg(gap) AS fs FROM (SELECT (max(t) - min(t)) / (count(*) - 1) AS gap FROM s GROUP BY recording_id)), n AS (SELECT CAST(floor({MS / 1000} * fs) AS BIGINT) AS win, CAST(floor({STEP_MS / 1000} * fs) AS BIGINT) AS step FROM r),
w AS (SELECT s.*, win, unnest(generate_series(greatest(0, CAST(ceil((sample_idx - (win - 1)) / CAST(step AS DOUBLE)) AS BIGINT)), sample_idx // step)) AS window_id FROM s, n),
f AS (SELECT recording_id, window_id, arg_min(kind, sample_idx) AS label, avg(abs(value)) AS mav, stddev_pop(value) AS std, max(abs(value)) AS maxav, recording_id % 5 <> 0 AS train FROM w GROUP BY recording_id, window_id, win HAVING count(*) = win),
{nearest_sql(OFFLINE, "recording_id, window_id")} SELECT label, prediction, count(*) AS n FROM d WHERE NOT train GROUP BY 1, 2""")
def w3(spark, d):
    """Windows sized by the measured rate, features, a scaler and a model fitted, saved, loaded and applied to other recordings."""
    samples = sig._indexed(spark, d).select("recording_id", "sample_idx", "t", "value", F.col("kind").alias("label"))
    rows = decoding.window_features(samples, OFFLINE, MS, STEP_MS)
    rows = rows.withColumnsRenamed({f"value_{n}": n for n in OFFLINE})
    fitted, _, _ = decoding.offline_decoding(rows, F.col("recording_id") % 5 == 0, lambda r: decoder.nearest_mean(r, OFFLINE))
    path = scratch(spark, "decoder")
    fitted.save(spark, path)
    out = decoder.Decoder.load(spark, path).predict(rows.filter("recording_id % 5 = 0"))
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("w3_offline_scores")
def w3_scores(spark, d):
    """Logistic regression instead, and the scores of all test windows."""
    samples = sig._indexed(spark, d).select("recording_id", "sample_idx", "t", "value", F.col("kind").alias("label"))
    names = [f"value_{n}" for n in OFFLINE]
    rows = decoding.window_features(samples, OFFLINE, MS, STEP_MS)
    _, _, scores = decoding.offline_decoding(rows, F.col("recording_id") % 5 == 0, lambda r: decoder.logistic(r, names))
    return sig.r6(scores, "accuracy", "balanced_accuracy", "f1_macro")


ONLINE = ["mav", "maxav", "rms"]


@query("t1_online_decoding", f"""WITH e AS (SELECT user_id AS recording_id, ts, value, event_type AS kind FROM events WHERE event_type <> 'signup'), b AS (SELECT recording_id, avg(value) AS mean, stddev_pop(value) AS std FROM e WHERE kind = 'view' GROUP BY 1),
v AS (SELECT recording_id, ts, kind, (value - mean) / nullif(std, 0) AS v, unnest(generate_series(0, 1)) AS k FROM e JOIN b USING (recording_id)),
f AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start, recording_id, count(*) AS n, arg_min(kind, ts) AS label, avg(abs(v)) AS mav, max(abs(v)) AS maxav, sqrt(avg(v * v)) AS rms, recording_id % 5 <> 0 AS train FROM v GROUP BY 1, 2),
{nearest_sql(ONLINE, "start, recording_id")} SELECT epoch(start) AS start, recording_id, n, label, round(mav, 6) AS mav, prediction FROM d WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)""")
def t1(spark, d):
    """A decoder fitted to the table's windows, saved, loaded and applied to the stream."""
    samples = src.event_samples(spark, d).withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    baselines = clean.rest_baseline(src.event_samples(spark, d), F.col("kind") == "view", "recording_id")
    windows = ("2 hours", "1 hour", "1 hour")
    rows = streams.window_features(samples.drop("t"), baselines, ONLINE, *windows)
    path = scratch(spark, "decoder")
    decoder.nearest_mean(rows.filter("recording_id % 5 <> 0"), ONLINE).save(spark, path)
    out = streams.decode(streams.event_stream(spark, d), baselines, decoder.Decoder.load(spark, path), *windows)
    out = _drained(spark, out, "t1").select(F.col("start").cast("double").alias("start"), "recording_id", F.col("n").cast("long").alias("n"), "label", "mav", "prediction")
    return sig.r6(out, "mav")


@query("t2_blinks", f"""WITH RECURSIVE e AS (SELECT user_id AS recording_id, epoch_us(ts) AS us, value FROM events WHERE event_type <> 'signup'),
s AS (SELECT recording_id, us / 1e6 AS t, value, min(us / 1e6) OVER (PARTITION BY recording_id) AS t0 FROM e WHERE us < ((SELECT max(us) FROM e) // 1000 - 3600000) * 1000),
q AS (SELECT recording_id, avg(value) + {sig.SIGMAS} * stddev_pop(value) AS threshold FROM s WHERE t < t0 + {sig.DAYS10} GROUP BY 1),
h AS MATERIALIZED (SELECT recording_id, t FROM s JOIN q USING (recording_id) WHERE t >= t0 + {sig.DAYS10} AND value > threshold),
a AS (SELECT recording_id, min(t) AS t FROM h GROUP BY 1 UNION ALL SELECT a.recording_id, min(h.t) FROM a JOIN h ON h.recording_id = a.recording_id AND h.t > a.t + 5400 GROUP BY a.recording_id)
SELECT recording_id, round(t, 3) AS t FROM a""")
def t2(spark, d):
    out = streams.blinks(streams.event_stream(spark, d), sig.DAYS10, sig.SIGMAS, 5400.0, "1 hour", idle=3e7)
    return _drained(spark, out, "t2").select("recording_id", F.round("t", 3).alias("t"))


@query("t3_band_power", """WITH e AS (SELECT user_id AS recording_id, ts, value FROM events WHERE event_type <> 'signup'),
w AS (SELECT recording_id, ts, value, date_trunc('day', ts) - k * INTERVAL 1 DAY AS start FROM (SELECT *, unnest(generate_series(0, 1)) AS k FROM e)),
x AS (SELECT start, recording_id, value - avg(value) OVER p AS v, row_number() OVER (PARTITION BY start, recording_id ORDER BY ts, value) - 1 AS i, count(*) OVER p AS n FROM w WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e) WINDOW p AS (PARTITION BY start, recording_id)),
f AS (SELECT start, recording_id, n, k, 2 * (sum(v * cos(2 * pi() * k * i / n)) ** 2 + sum(v * sin(2 * pi() * k * i / n)) ** 2) / (16 * n) AS y FROM (SELECT *, unnest(generate_series((2 * n + 15) // 16, 7 * n // 16)) AS k FROM x WHERE n > 2) GROUP BY 1, 2, 3, 4),
g AS (SELECT *, row_number() OVER (PARTITION BY start, recording_id ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY start, recording_id) AS m FROM f),
h AS (SELECT start, recording_id, sum(16 / n * y * CASE WHEN m = 1 THEN 0 WHEN m = 2 THEN 0.5e0 ELSE CASE WHEN j >= m - (m + 1) % 2 THEN 0 WHEN j IN (0, m - 1 - (m + 1) % 2) THEN 1e0 / 3 WHEN j % 2 = 1 THEN 4e0 / 3 ELSE 2e0 / 3 END + CASE WHEN m % 2 = 1 THEN 0 WHEN j = m - 1 THEN 5e0 / 12 WHEN j = m - 2 THEN 2e0 / 3 WHEN j = m - 3 THEN -1e0 / 12 ELSE 0 END END) AS power FROM g GROUP BY 1, 2)
SELECT epoch(start) AS start, recording_id, CAST(n AS INT) AS n, round(coalesce(any_value(power), 0) + 1e-8, 6) AS power FROM x LEFT JOIN h USING (start, recording_id) WHERE n > 2 GROUP BY start, recording_id, n""")
def t3(spark, d):
    out = streams.band_power(streams.event_stream(spark, d), 16.0, "2 days", "1 day", "1 hour", 2.0, 7.0)
    # Short windows of values with two decimals give powers that end in a five.
    return _drained(spark, out, "t3").select(F.col("start").cast("double").alias("start"), "recording_id", "n", F.round(F.col("power") + 1e-8, 6).alias("power"))


@query("t4_running_state", """WITH s AS (SELECT user_id AS recording_id, ts, value FROM events WHERE event_type <> 'signup'),
w AS (SELECT *, unnest(generate_series(0, 1)) AS k FROM s), g AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS start, recording_id, count(*) AS n, avg(value) AS running FROM w GROUP BY 1, 2)
SELECT epoch(start) AS start, recording_id, n, round(running, 6) AS running, running > 60 AS above FROM g WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM s)""")
def t4(spark, d):
    out = _drained(spark, streams.running_state(streams.event_stream(spark, d), "2 hours", "1 hour", "1 hour", 60.0), "t4")
    return sig.r6(out.withColumn("start", F.col("start").cast("double")), "running")


_CHANGES = "WITH s AS (SELECT user_id AS recording_id, epoch_us(ts) / 1e6 AS t, event_type AS label, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type <> 'signup') SELECT recording_id, round(t, 3) AS t, label FROM s WHERE before IS NULL OR before <> label"


@query("t5_label_changes", _CHANGES)
def t5(spark, d):
    out = _drained(spark, streams.label_changes(streams.event_stream(spark, d)), "t5")
    return out.select("recording_id", F.round(F.unix_micros("ts") / F.lit(1e6), 3).alias("t"), "label")


@query("t5_published_changes", _CHANGES)
def t5_published(spark, d):
    """The changes as a receiver of the announced batches reads them."""
    changes, path = streams.label_changes(streams.event_stream(spark, d)), scratch(spark, "published")
    streams.publish(changes, path, scratch(spark, "published-checkpoint")).awaitTermination()
    out = streams.published(spark, path, changes.schema)
    return out.select("recording_id", F.round(F.unix_micros("ts") / F.lit(1e6), 3).alias("t"), "label")


@query("s2_identity", "SELECT o_custkey AS run, CASE WHEN o_custkey % 3 = 0 THEN 'hand_dir' WHEN o_custkey % 3 = 1 THEN 'wrist_dir' ELSE 'default' END AS mode, count(*) AS n FROM orders GROUP BY 1, 2")
def s2(spark, d):
    mode = F.when(F.col("o_custkey") % 3 == 0, "/hand_dir").when(F.col("o_custkey") % 3 == 1, "/wrist_dir").otherwise("")
    path = F.concat(F.lit("/data"), mode, F.lit("/sub-1_ses-2_task-move_run-"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.lit("_eeg.xdf"))
    files = io.identity(src.table(spark, d, "orders").select(path.alias("path")))
    return files.groupBy(F.col("run").cast("long").alias("run"), "mode").agg(F.count("*").alias("n"))


@query("s5_s6_round_trip", "SELECT l_suppkey AS recording_id, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def s5(spark, d):
    path = scratch(spark, "signal")
    io.write_by_recording(src.supplier_samples(spark, d).select("recording_id", "quantity"), path)
    back = spark.read.schema("quantity double, recording_id long").parquet(path)
    return back.groupBy("recording_id").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("total"))


@query("s7_registry", """WITH s AS (SELECT user_id AS r, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'signup'), m AS (SELECT user_id AS r, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1), k AS (SELECT o_custkey AS r FROM orders GROUP BY 1 HAVING count(*) >= 2)
SELECT s.r AS recording_id, round((count(DISTINCT t) - 1) / (max(t) - min(t)), 9) AS sfreq, 1 AS n_channels, coalesce(max(n), 0) AS n_events, 'out/recording_id=' || s.r AS output_path FROM s LEFT JOIN m USING (r) WHERE s.r IN (SELECT r FROM k) GROUP BY s.r""")
def s7(spark, d):
    samples = src.event_samples(spark, d).withColumn("channel", F.lit("v"))
    out = io.registry(samples, src.event_markers(spark, d), src.order_streams(spark, d), "out")
    return out.withColumn("sfreq", F.round("sfreq", 9))


@query("s2_emg_identity", "SELECT 'p' || (p_partkey % 7) AS participant, CASE WHEN p_size % 2 = 0 THEN 'left' ELSE 'right' END AS hand, CAST(p_size % 9 + 1 AS INT) AS channels, CAST(p_partkey % 4 AS INT) AS sequence, count(*) AS n FROM part GROUP BY 1, 2, 3, 4")
def s2_emg(spark, d):
    side = F.when(F.col("p_size") % 2 == 0, "left").otherwise("right")
    name = F.format_string("/data/p%d_%s_ch%d_seq%d_2024-01-02.csv", F.col("p_partkey") % 7, side, F.col("p_size") % 9 + 1, F.col("p_partkey") % 4)
    files = io.emg_identity(src.table(spark, d, "part").select(name.alias("path")))
    return files.groupBy("participant", "hand", "channels", "sequence").agg(F.count("*").alias("n"))


@query("j7_streams_by_name", "SELECT o_custkey AS recording_id, min(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS signal_stream, min(o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS trigger_stream FROM orders GROUP BY 1")
def j7_names(spark, d):
    streams_ = src.table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("stream_id"), F.col("o_orderpriority").alias("name"))
    return align.streams_by_name(streams_, "1-URGENT", "5-LOW")


@query("s9_summaries", "SELECT l_returnflag AS mode, l_linestatus AS model, CAST(l_linenumber AS VARCHAR) AS features, round(avg(l_discount), 6) AS accuracy FROM lineitem GROUP BY 1, 2, 3")
def s9(spark, d):
    """Summaries written per mode and read back as one table."""
    mean = src.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").cast("string").alias("features")).agg(F.round(F.avg("l_discount"), 6).alias("accuracy"))
    path = scratch(spark, "summaries")
    io.write_summaries(mean, path)
    return io.read_summaries(spark, f"{path}/mode=*").select("mode", "model", "features", F.col("accuracy").cast("double").alias("accuracy"))


@query("s10_feature_frame", f"WITH {sig.X}, r AS (SELECT label, rel_idx // 16 AS c, rel_idx % 16 AS i, avg(value) AS value FROM x GROUP BY 1, 2, 3) SELECT 'mstd' AS section, 'c' || c AS item, CAST(label AS VARCHAR) AS task, i // 4 AS place, round(avg(value), 6) AS value FROM r GROUP BY 1, 2, 3, 4")
def s10(spark, d):
    """Segment means of each class and channel, written as a feature frame and read back."""
    rows = erp.mean_response(erp.exploded(src.embedding_epochs(spark, d, 4)), "label", "channel", "rel_idx").withColumn("task", F.col("label").cast("string"))
    parts = erp.segment_features(rows, 16, 4).groupBy("task", F.col("channel").alias("item")).agg(F.array_sort(F.collect_list(F.struct("segment", "mean")))["mean"].alias("values"))
    path = scratch(spark, "frame")
    io.write_feature_frame(features.feature_frame(None, None, parts), path)
    back = spark.read.parquet(path)
    return back.select("section", "item", "task", F.posexplode("values").alias("place", "value")).withColumn("place", F.col("place").cast("long")).withColumn("value", F.round("value", 6))
