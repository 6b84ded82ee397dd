"""Structured Streaming jobs: windowed decoding features, blink detection, live band power, running state, label changes.

Every job has a watermark: rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import features
from ..operators.decoder import Decoder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, ts, value, kind of the events as they come."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp").alias("ts")
    return raw.filter("event_type <> 'signup'").select(F.col("user_id").alias("recording_id"), ts, "value", F.col("event_type").alias("kind"))


def windowed(stream: DataFrame, length: str, step: str) -> DataFrame:
    """Each recording's values, in order of time, in sliding windows of a stream with a watermark: start, end, recording_id, x, and the first sample's kind as label."""
    w = stream.groupBy(F.window("ts", length, step), "recording_id")
    return w.agg(F.array_sort(F.collect_list(F.struct("ts", "value")))["value"].alias("x"), F.min_by("kind", "ts").alias("label")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "recording_id", "x", "label")


def window_features(stream: DataFrame, baselines: DataFrame, names: list[str], length: str, step: str, delay: str) -> DataFrame:
    """start, end, recording_id, n, label and features of baseline-scaled windows, of a stream or a table. The join's side is left to Spark.

    Features are of the values that are known, and null without any, as where a baseline has no spread. Recordings without a
    baseline have no windows, but their rows move the watermark too."""
    scaled = stream.withWatermark("ts", delay).join(baselines, "recording_id").withColumn("value", F.try_divide(F.col("value") - F.col("mean"), F.col("std"))).drop("mean", "std")
    x = windowed(scaled, length, step).withColumn("known", F.filter("x", F.isnotnull))
    built = [F.when(F.size("known") > 0, features.BUILT_IN[n](F.col("known"))).cast("double").alias(n) for n in names]
    return x.select("start", "end", "recording_id", "label", F.size("x").alias("n"), *built)


def decode(stream: DataFrame, baselines: DataFrame, decoder: Decoder, length: str, step: str, delay: str) -> DataFrame:
    """Baseline scaling, window features, the fitted scaler and the model's prediction."""
    return decoder.predict(window_features(stream, baselines, decoder.features, length, step, delay))


def band_power(stream: DataFrame, fs: float, length: str, step: str, delay: str, low: float, high: float) -> DataFrame:
    x = windowed(stream.withWatermark("ts", delay), length, step).filter(F.size("x") > 2)
    return x.select("start", "recording_id", F.size("x").alias("n"), features.periodogram_power(fs, low, high)("x").alias("power"))


def running_state(stream: DataFrame, length: str, step: str, delay: str, threshold: float) -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", length, step), "recording_id").agg(F.avg("value").alias("running"), F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "recording_id", "n", "running", (F.col("running") > threshold).alias("above"))


class Blinks(StatefulProcessor):
    """Calibrates over a recording's first seconds, then emits hits above mean + sigmas * std outside the refractory gap.

    Rows wait in state until the watermark has passed them and are then taken in order of time, so it is
    of no matter in which batch they come. One timer stands for the earliest row that waits, or for the end of an idle recording."""

    def __init__(self, calibration: float, sigmas: float, gap: float, idle: float | None):
        self.calibration, self.sigmas, self.gap, self.idle = calibration, sigmas, gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, value double")
        self.state = handle.getValueState("blink", "t0 double, n long, s double, q double, last double, seen double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        data = pd.concat(list(rows))
        data = data[data["us"] >= late]
        if len(data):
            self.waiting.appendList([(int(u), float(v)) for u, v in zip(data["us"], data["value"])])
            self.wake(int(data["us"].min()) // 1000 + 1)
        yield pd.DataFrame({"recording_id": [], "t": []}).astype({"recording_id": "int64", "t": "float64"})

    def wake(self, ms: int) -> None:
        """A timer at ``ms``, unless one comes earlier."""
        timers = list(self.handle.listTimers())
        if not timers or ms < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [(us / 1e6, v) for us, v in waiting if us < passed]
        rest = waiting[len(ready) :]
        new = (None, 0, 0.0, 0.0, float("-inf"), float("-inf"))
        t0, n, s, q, last, seen = self.state.get() if self.state.exists() else new
        hits = []
        for t, v in ready:
            if self.idle is not None and t > seen + self.idle:
                t0, n, s, q, last, seen = new
            t0, seen = t if t0 is None else t0, t
            if t < t0 + self.calibration:
                n, s, q = n + 1, s + v, q + v * v
                continue
            std = max(0.0, q / n - (s / n) ** 2) ** 0.5 if n else 0.0
            if n and v > s / n + self.sigmas * std and t > last + self.gap:
                hits.append(t)
                last = t
        end = None if self.idle is None else int((seen + self.idle) * 1000) + 1
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if not rest and end is not None and end * 1000 <= passed:  # all that could come now is late or a new recording's begin
            self.state.clear()
        else:
            self.state.update((t0, n, s, q, last, seen))
            ms = rest[0][0] // 1000 + 1 if rest else end
            if ms is not None:
                self.handle.registerTimer(ms)
        yield pd.DataFrame({"recording_id": [key[0]] * len(hits), "t": hits}).astype({"recording_id": "int64", "t": "float64"})

    def close(self) -> None:
        pass


def blinks(stream: DataFrame, calibration: float, sigmas: float, gap: float, delay: str = "1 hour", idle: float | None = None) -> DataFrame:
    """recording_id, t (seconds) of accepted hits, each once the watermark has passed it, whatever order rows come in; rows
    later than the watermark are dropped. State per recording: six numbers and the rows of the last ``delay``. A
    recording without rows for more than ``idle`` seconds is forgotten, and calibrated anew if it goes on."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withWatermark("ts", delay).select("recording_id", "ts", F.unix_micros("ts").alias("us"), "value")
    return rows.groupBy("recording_id").transformWithStateInPandas(statefulProcessor=Blinks(calibration, sigmas, gap, idle), outputStructType="recording_id long, t double", outputMode="Append", timeMode="EventTime")


def label_changes(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """recording_id, ts, label wherever a recording's label differs from its last one; rows later than the
    watermark are dropped. State, for good: each recording's last label."""

    def run(key, batches, state):
        data = pd.concat(list(batches)).sort_values("ts")
        data = data[data["ts"] >= pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]
        if not len(data):
            return
        last = state.get[0] if state.exists else None
        before = data["kind"].shift(1)
        before.iloc[0] = last
        out = data[data["kind"] != before]
        state.update((data["kind"].iloc[-1],))
        yield pd.DataFrame({"recording_id": [key[0]] * len(out), "ts": out["ts"].to_numpy(), "label": out["kind"].to_numpy()})

    keyed = stream.withWatermark("ts", delay).groupBy("recording_id")
    return keyed.applyInPandasWithState(run, "recording_id long, ts timestamp, label string", "last string", "append", "NoTimeout")


def publisher(path: str, send: Callable[[Iterator[Row]], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that publishes each row once: a batch has a folder of its own, which a
    repeated batch writes anew, and is announced by a marker once it is whole.

    ``send``, if given, gets the rows of each partition on the executors before the batch is announced; a batch that
    failed before that is sent again, so receivers tell rows apart by batch and key."""

    def write(rows: DataFrame, batch: int) -> None:
        fs_path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/done/{batch}")
        fs = fs_path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(fs_path):
            rows.write.format("noop").mode("overwrite").save()  # nothing is published, but the state goes on
            return
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        if send is not None:
            rows.sparkSession.read.parquet(f"{path}/rows/batch={batch}").foreachPartition(send)
        marker = fs.create(fs_path, True)
        marker.write(49)  # readers skip empty files
        marker.close()

    return write


def publish(stream: DataFrame, path: str, checkpoint: str, send: Callable[[Iterator[Row]], None] | None = None) -> StreamingQuery:
    """Start publishing ``stream`` (all that its source holds now) into ``path``; after a failure, start it again with the same folders."""
    return stream.writeStream.foreachBatch(publisher(path, send)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the announced batches, and their batch."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long"))
    done = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/done").select(F.regexp_extract("path", r"/(\d+)$", 1).cast("long").alias("batch"))
    return rows.join(done, "batch", "left_semi")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run ``stream`` over all that its source holds now, into Parquet, and read it."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
