import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sigweave.streaming import streams

SCHEMA = "recording_id long, ts timestamp, value double, kind string"


def files(spark, path, batches):
    """A file, and so a batch, for each list of (recording, second, value, kind)."""
    for rows in batches:
        df = spark.createDataFrame(rows, "recording_id long, s double, value double, kind string")
        df.select("recording_id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "value", "kind").coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def batch_blinks(rows, calibration, sigmas, gap, until, idle=None):
    out = []
    for r in sorted({x[0] for x in rows}):
        held, last, seen, t0 = [], -np.inf, -np.inf, None
        for _, t, v, *_ in sorted(x for x in rows if x[0] == r and x[1] < until):
            if idle is not None and t > seen + idle:
                held, last, t0 = [], -np.inf, None
            t0, seen = t if t0 is None else t0, t
            if t < t0 + calibration:
                held.append(v)
            elif v > np.mean(held) + sigmas * np.std(held) and t > last + gap:
                out.append((r, t))
                last = t
    return out


def test_blinks_in_any_order_give_the_batch_answer(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(r, 1000.0 + i * 0.5, float(rng.standard_normal() + 4 * (i % 17 == 0)), "a") for i in range(160) for r in (1, 2)]
    batches = [rows[k : k + 80] for k in range(0, 320, 80)]
    for a, b in ((0, 1), (1, 2), (2, 3)):  # neighbours swap rows that are less than the delay apart
        for i in range(0, 80, 3):
            batches[a][i], batches[b][i] = batches[b][i], batches[a][i]
    late = (1, 1003.25, 99.0, "a")  # long after the watermark has passed it
    closing = (3, 1600.0, 0.0, "a")
    stream = files(spark, tmp_path / "in", [*batches, [closing], [late, (3, 1601.0, 0.0, "a")]])
    out = streams.drained(streams.blinks(stream, 20.0, 2.0, 3.0, "100 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    want = batch_blinks(rows, 20.0, 2.0, 3.0, 1500.0)
    assert sorted((r["recording_id"], r["t"]) for r in out.collect()) == want and len(want) > 10


def test_idle_recordings_are_forgotten(spark, tmp_path):
    one = [(1, 1000.0 + i, float(i % 2), "a") for i in range(20)] + [(1, 1025.0, 9.0, "a")]
    two = [(1, 3000.0 + i, 100.0 + i % 2, "a") for i in range(20)] + [(1, 3025.0, 100.2, "a"), (1, 3026.0, 109.0, "a")]
    clock = [[(9, t, 0.0, "a")] for t in (1100.0, 2000.0, 2900.0)]
    stream = files(spark, tmp_path / "in", [one, *clock, two, [(9, 3200.0, 0.0, "a")]])
    out = streams.drained(streams.blinks(stream, 20.0, 3.0, 1.0, "10 seconds", idle=500.0), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["recording_id"], r["t"]) for r in out.collect()) == [(1, 1025.0), (1, 3026.0)]
    assert batch_blinks(one + two, 20.0, 3.0, 1.0, 3190.0, 500.0) == [(1, 1025.0), (1, 3026.0)]
    # At the end only the clock and the recording that went on have state, of their latest rows.
    left = spark.read.format("statestore").option("stateVarName", "blink").load(f"{tmp_path}/state")
    assert left.count() <= 2


@pytest.mark.parametrize("when", ["before", "after"])
def test_changes_are_published_once_after_a_failure(spark, tmp_path, when):
    """The second batch fails before or after its rows are written, and the query is started again."""
    batches = [[(1, 10.0 * b + i, 0.0, "ab"[(b + i) % 2]) for i in range(3)] + [(2, 10.0 * b, 0.0, "c")] for b in range(4)]
    stream = files(spark, tmp_path / "in", batches)
    changes = streams.label_changes(stream)
    write = streams.publisher(f"{tmp_path}/out")

    def failing(rows, batch):
        if batch == 1 and when == "before":
            raise RuntimeError("gone")
        write(rows, batch)
        if batch == 1:
            raise RuntimeError("gone")

    query = changes.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination()
    streams.publish(changes, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r["recording_id"], r["ts"].timestamp(), r["label"]) for r in streams.published(spark, f"{tmp_path}/out", changes.schema).collect())
    flat, want = sorted(x for b in batches for x in b), []
    for k, (r, t, _, label) in enumerate(flat):
        if k == 0 or flat[k - 1][0] != r or flat[k - 1][3] != label:
            want.append((r, t, label))
    assert got == want and len(want) > 8


def test_batches_that_are_not_announced_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "recording_id long, label string")
    write = streams.publisher(f"{tmp_path}/out")
    write(rows, 0)
    write(rows, 0)
    rows.write.parquet(f"{tmp_path}/out/rows/batch=1")
    assert [tuple(r) for r in streams.published(spark, f"{tmp_path}/out", rows.schema).select("recording_id", "label").collect()] == [(1, "x")]
