"""Channel selection, scaling, repair, references, baselines, artefacts, Hampel, resampling, filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from . import arrow, windows

MICROVOLT = 1e-6
#: Fixed values of the converter: 5 V full scale over 2^31 - 1 counts, amplifier gain 256.
FULL_SCALE, COUNTS, GAIN = 5.0, 0x7FFFFF, 256


def to_volts(x: Column) -> Column:
    return x * F.lit(MICROVOLT)


def counts_to_volts(x: Column, gain: int = 1) -> Column:
    return x * F.lit(FULL_SCALE) / F.lit(float(COUNTS)) / F.lit(float(gain))


def finite_or_zero(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(x)


def repair(samples: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``samples`` with 0 for what is not finite, and the number of replacements by column."""
    changed = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))).alias(c) for c in columns]
    fixed = samples.select(*[finite_or_zero(F.col(c)).alias(c) if c in columns else F.col(c) for c in samples.columns])
    return fixed, samples.agg(*changed)


def select_channels(samples: DataFrame, bads: Sequence[str] = (), keep: DataFrame | None = None) -> DataFrame:
    """Long samples without AUX and TRIGGER channels and bads; with ``keep(channel)``, only those channels."""
    kept = samples.filter(~F.col("channel").startswith("AUX") & ~F.col("channel").startswith("TRIGGER"))
    if bads:
        kept = kept.filter(~F.col("channel").isin(*bads))
    return kept if keep is None else kept.join(F.broadcast(keep.select("channel").distinct()), "channel", "left_semi")


def off_montage(samples: DataFrame, montage: DataFrame) -> DataFrame:
    """Channels of ``samples`` without a position in ``montage(channel)``, names compared without case."""
    names = samples.select("channel").distinct().withColumn("k", F.upper("channel"))
    return names.join(F.broadcast(montage.select(F.upper("channel").alias("k")).distinct()), "k", "left_anti").select("channel")


def average_reference_wide(samples: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Each channel less the channels' mean at the same sample; plain column arithmetic, no shuffle."""
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in channels]) / len(channels)
    return samples.select(*[(F.col(c) - mean).alias(c) if c in channels else F.col(c) for c in samples.columns])


def average_reference(samples: DataFrame) -> DataFrame:
    """The same for long samples (recording_id, sample_idx, channel, value)."""
    mean = samples.groupBy("recording_id", "sample_idx").agg(F.avg("value").alias("mean"))
    return samples.join(mean, ["recording_id", "sample_idx"]).withColumn("value", F.col("value") - F.col("mean")).drop("mean")


def rest_baseline(samples: DataFrame, rest: Column, *keys: str) -> DataFrame:
    """Mean and population deviation of ``value`` over the rest samples of each key."""
    return samples.filter(rest).groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def z_score(samples: DataFrame, baselines: DataFrame, *keys: str, scale: bool = True) -> DataFrame:
    """(value - mean) / std of the key's baseline, or only value - mean. A zero deviation gives null."""
    joined = samples.join(baselines, list(keys))
    centred = F.col("value") - F.col("mean")
    return joined.withColumn("value", F.try_divide(centred, F.col("std")) if scale else centred).drop("mean", "std")


def artefact_threshold(epochs: DataFrame, sigmas: float = 6.0) -> Column:
    """Mean + ``sigmas`` population deviations of all values of all epochs' arrays ``x``."""
    parts = epochs.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("s"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("ss"), F.sum(F.size("x")).alias("n")).first()
    mean = parts["s"] / parts["n"]
    return F.lit(mean + sigmas * max(0.0, parts["ss"] / parts["n"] - mean * mean) ** 0.5)


def reject_artefacts(epochs: DataFrame, threshold: Column) -> DataFrame:
    """Epochs none of whose channels has a peak-to-peak above the threshold."""
    spread = epochs.groupBy("epoch_id").agg(F.max(F.array_max("x") - F.array_min("x")).alias("peak"))
    return epochs.join(spread.filter(F.col("peak") <= threshold).select("epoch_id"), "epoch_id", "left_semi")


#: Frames of more samples than this take their medians from an ordered list that moves along, not frame by frame.
NARROW = 31


def hampel(samples: DataFrame, window: int = 3, sigmas: float = 3.0, chunk: int | None = None, narrow: int = NARROW) -> DataFrame:
    """``samples`` (recording_id, sample_idx, value) plus ``cleaned``: a value off its centred rolling median
    by more than ``sigmas`` scaled rolling median deviations becomes the median. Incomplete frames, and those with a
    value that is null or not finite, change nothing.

    Frames of up to ``narrow`` samples are SQL frames. Of wider ones each chunk with its halo goes to a
    task as Arrow batches, whose rolling medians take the logarithm of the frame's length a sample; the rows are the same,
    but that a NaN comes back as null."""
    # A deviation needs its own frame's median, so the halo is twice the frame's reach.
    size = max(chunk or windows.CHUNK, window)
    cut = windows.haloed(samples, size, 2 * window)
    full = 2 * window + 1
    if full > narrow:
        schema = T.StructType([*cut.schema.fields, T.StructField("cleaned", T.DoubleType())])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("sample_idx")
            value = pdf["value"].astype(float)
            med = value.rolling(full, center=True).median()
            dev = (value - med).abs()
            off = dev > sigmas * (1.4826 * dev.rolling(full, center=True).median())
            return pdf.assign(cleaned=med.where(off, value))

        return windows.own_rows(cut.groupBy("recording_id", "chunk").applyInPandas(run, schema), size)
    w = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx").rowsBetween(-window, window)
    known = F.when(F.abs("value") < F.lit(float("inf")), F.col("value"))
    med = F.when(F.count(known).over(w) == full, F.percentile(known, 0.5).over(w))
    first = cut.withColumn("med", med).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    mad = F.when(F.count("dev").over(w) == full, F.lit(1.4826) * F.percentile("dev", 0.5).over(w))
    out = first.withColumn("mad", mad)
    off = F.col("dev") > F.lit(sigmas) * F.col("mad")
    return windows.own_rows(out.withColumn("cleaned", F.when(off, F.col("med")).otherwise(F.col("value"))).drop("med", "dev", "mad"), size)


def downsample(samples: DataFrame, bin_seconds: float) -> DataFrame:
    """Mean value and most frequent label (the least of equals, carried forward) of each time bin:
    recording_id, bin, value, label."""
    bins = samples.groupBy("recording_id", F.floor(F.col("t") / bin_seconds).alias("bin")).agg(F.avg("value").alias("value"), F.mode("label", True).alias("label"))
    w = Window.partitionBy("recording_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("label", F.last("label", ignorenulls=True).over(w))


def resample(samples: DataFrame, points_per_second: float, chunk: int | None = None) -> DataFrame:
    """Fourier resampling of each channel (recording_id, channel, sample_idx, t, value; indices from 0 without gaps) to the
    given rate: recording_id, channel, sample_idx, value. The spectrum is cut or padded, its middle bin halved or doubled.

    A channel of at most ``chunk`` samples before and after is transformed whole by a task. Longer ones go twice through
    ``transformed``, there to the kept bins and back to the new samples, where no task holds more than about ``chunk``
    of them; the results agree. A value that is null or not a number makes its channel's values null."""
    size = chunk or windows.CHUNK
    keys = ["recording_id", "channel"]
    ends = samples.groupBy(*keys).agg(F.count("*").alias("old"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    new = F.greatest(F.lit(1).cast("long"), ((F.col("t1") - F.col("t0")) * points_per_second).cast("long"))
    ends = ends.select(*keys, "old", new.alias("new"))
    rows = samples.select(*keys, "sample_idx", "value").join(ends, keys)
    short = (F.col("old") <= size) & (F.col("new") <= size)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("sample_idx")["value"].to_numpy(float)
        y = kernels.fourier_resample(x[None, :], int(pdf["new"].iloc[0]))[0]
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "sample_idx": range(len(y)), "value": y})

    at_once = rows.filter(short).groupBy(*keys).applyInPandas(whole, "recording_id long, channel string, sample_idx long, value double")
    bins = F.expr("least(old, new) div 2 + 1")
    shape = lambda period, have, want: [F.col("old"), F.col("new"), period.alias("period"), have.alias("have"), want.alias("want")]
    there = rows.filter(~short).select(*keys, F.col("sample_idx").alias("at"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"), *shape(F.col("old"), F.col("old"), bins))
    long = ends.filter(~short).select(*keys, *shape(F.col("old"), F.col("old"), bins))
    kept = transformed(there, long, size)
    # A bin stands for itself and its mirror image, but for the first and, of an even number, the middle one.
    weight = F.when(F.col("at") == 0, 1).when(2 * F.col("at") == F.least("old", "new"), F.when(F.col("new") < F.col("old"), 2).otherwise(1)).otherwise(2)
    back = kept.select(*keys, "at", (F.col("re") * weight).alias("re"), (-F.col("im") * weight).alias("im"), *shape(F.col("new"), bins, F.col("new")))
    made = transformed(back, ends.filter(~short).select(*keys, *shape(F.col("new"), bins, F.col("new"))), size).select(*keys, F.col("at").alias("sample_idx"), (F.col("re") / F.col("old")).alias("value"))
    return at_once.unionByName(made)


def transformed(rows: DataFrame, channels: DataFrame, chunk: int) -> DataFrame:
    """Discrete Fourier transforms of any ``period``: ``rows`` (recording_id, channel, at, re, im and the columns of ``channels``)
    hold a channel's values at 0 to ``have`` - 1, those returned its bins 0 to ``want`` - 1. ``channels`` (recording_id,
    channel, period, have, want, old, new) has one row each.

    It is a convolution with a chirp, of a power of two that is set up as a matrix: blocks of columns are transformed and
    turned, then blocks of rows, multiplied and transformed back, then blocks of columns again. Between these, tiles
    travel. A block is of at most ``chunk`` values, or of one column or row where these are longer."""
    keys, shape = ["recording_id", "channel"], ["old", "new", "period", "have", "want"]
    chunk = 1 << (chunk.bit_length() - 1)
    carried = "recording_id long, channel string, old long, new long, period long, have long, want long"
    tile = f"{carried}, block long, part long, tile binary, chirp binary"
    bits = F.length(F.bin(F.col("have") + F.col("want") - 2))
    # The grid is of 2^(bits div 2) rows and 2^(bits - bits div 2) columns, as in ``kernels.ChirpGrid``.
    wide = F.expr("shiftleft(1L, bits - bits div 2)")
    broad = F.least(wide, F.greatest(F.lit(1).cast("long"), F.expr(f"{chunk}L div shiftleft(1L, bits div 2)")))
    sized = lambda df: df.withColumn("bits", bits).withColumn("wide", wide).withColumn("broad", broad)
    dealt = sized(rows).withColumn("block", F.expr("(at % wide) div broad")).select(*keys, *shape, "block", "at", "re", "im")
    # Every block has a row, so that columns without values bring their part of the chirp.
    nothing = F.lit(None)
    every = sized(channels).withColumn("block", F.explode(F.expr("sequence(0L, wide div broad - 1)")))
    every = every.select(*keys, *shape, "block", nothing.cast("long").alias("at"), nothing.cast("double").alias("re"), nothing.cast("double").alias("im"))

    group, names = [*keys, "block"], [f.split()[0] for f in tile.split(", ")]
    many = max(1, arrow.ROWS * 16 // chunk)  # rows of tiles that are taken together

    def alike(table: pa.Table, begin: np.ndarray) -> Iterator[tuple[kernels.ChirpGrid, int, np.ndarray]]:
        """The grid and block of groups of one shape, which channels of one length share, and their places."""
        numbers = (table[c].to_numpy()[begin[:-1]] for c in ("period", "have", "want", "block"))
        for (period, have, want, block), at in arrow.alike(*numbers):
            yield kernels.ChirpGrid(period, have, want, chunk), block, at

    def blobs(x: np.ndarray, n: int) -> pa.Array:
        """``x`` as ``n`` equal parts."""
        x = np.ascontiguousarray(x)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (x.nbytes // n)).astype(np.int32)), pa.py_buffer(x)])

    def tiles(table: pa.Table, column: str, rows: np.ndarray, grid: kernels.ChirpGrid) -> np.ndarray:
        """[group, part, row, column]"""
        raw = b"".join(table[column].combine_chunks().take(pa.array(rows.ravel())).to_pylist())
        return np.frombuffer(raw, complex).reshape(*rows.shape, grid.tall, grid.broad)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, group):
            known, size = table["at"].is_valid().to_numpy(), np.diff(begin)
            place = table["at"].fill_null(0).to_numpy()
            value = table["re"].to_numpy().astype(float) + 1j * table["im"].to_numpy().astype(float)
            for grid, block, every in alike(table, begin):
                few = max(1, (arrow.ROWS * 16) // (grid.n1 * grid.broad))
                for g in (every[i : i + few] for i in range(0, len(every), few)):
                    rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in g])
                    of, rows = np.repeat(np.arange(len(g)), size[g])[known[rows]], rows[known[rows]]
                    a, b = grid.columns(block, place[rows], value[rows], of, len(g))
                    cuts = grid.n1 // grid.tall
                    held = arrow.repeated(table, [*keys, *shape], begin[g], cuts)
                    part = [pa.array(np.tile(np.arange(cuts), len(g))), pa.array(np.full(len(g) * cuts, block))]
                    yield pa.RecordBatch.from_arrays([*held, *part, blobs(a, len(g) * cuts), blobs(np.broadcast_to(b, a.shape), len(g) * cuts)], names=names)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, group, many):
            for grid, block, g in alike(table, begin):
                cuts = grid.n2 // grid.broad
                rows = begin[g][:, None] + np.arange(cuts)
                a, b = (tiles(table, c, r, grid).swapaxes(1, 2).reshape(len(r), grid.tall, grid.n2) for c, r in (("tile", rows), ("chirp", rows[:1])))
                c = grid.lines(block, a, b).reshape(len(g), grid.tall, cuts, grid.broad).swapaxes(1, 2)
                held = arrow.repeated(table, [*keys, *shape], begin[g], cuts)
                part = [pa.array(np.tile(np.arange(cuts), len(g))), pa.array(np.full(len(g) * cuts, block))]
                yield pa.RecordBatch.from_arrays([*held, *part, blobs(c, len(g) * cuts), pa.nulls(len(g) * cuts, pa.binary())], names=names)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, group, many):
            for grid, block, g in alike(table, begin):
                rows = begin[g][:, None] + np.arange(grid.n1 // grid.tall)
                at, y = grid.ends(block, tiles(table, "tile", rows, grid).reshape(len(g), grid.n1, grid.broad))
                if len(at):
                    held = arrow.repeated(table, [*keys, *shape], begin[g], len(at))
                    yield pa.RecordBatch.from_arrays([*held, pa.array(np.tile(at, len(g))), *(pa.array(v.ravel(), from_pandas=True) for v in (y.real, y.imag))], names=[*keys, *shape, "at", "re", "im"])

    turned = arrow.grouped(dealt.unionByName(every), group).mapInArrow(columns, tile)
    through = arrow.grouped(turned, group, "part").mapInArrow(lines, tile)
    return arrow.grouped(through, group, "part").mapInArrow(ends, f"{carried}, at long, re double, im double")


def fir_filter(samples: DataFrame, taps, chunk: int = 65_536) -> DataFrame:
    """Zero-phase FIR filtering of long samples (recording_id, channel, sample_idx, value).

    Recordings are cut into chunks with a halo of half the filter, so no task holds a recording and
    the result equals the unchunked one; at the recording's ends the signal is reflected."""
    return _fir(samples, ["recording_id", "channel"], ["value"], taps, chunk)


def fir_filter_wide(samples: DataFrame, channels: Sequence[str], taps, chunk: int = 65_536) -> DataFrame:
    """The same for wide samples (recording_id, sample_idx and the channels), which are a fraction of the rows."""
    return _fir(samples, ["recording_id"], list(channels), taps, chunk)


def _schema(samples: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> T.StructType:
    fields = [samples.schema[k] for k in keys] + [T.StructField("sample_idx", T.LongType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in columns])


def _fir(samples: DataFrame, keys: list[str], columns: list[str], taps, chunk: int) -> DataFrame:
    taps = np.asarray(taps, float)
    half, size = len(taps) // 2, max(chunk, len(taps))
    values = [F.col(c).cast("double").alias(c) for c in columns]
    cut = windows.haloed(samples.select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), *values), size, half)
    group, schema = [*keys, "chunk"], _schema(samples, keys, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, group):
            idx, x = table["sample_idx"].to_numpy(), arrow.matrix(table, columns)
            begin, stop = begin[:-1], begin[1:]
            own, first, last = table["chunk"].to_numpy()[begin] * size, idx[begin], idx[stop - 1]
            # Rows that end inside the chunk, or in its halo, end with the recording.
            lead = np.where(first == 0, np.maximum(0, half - own), 0)
            tail = np.maximum(0, half - np.maximum(0, last - own - size + 1))
            n = np.minimum(last + 1, own + size) - own
            for (length, a, b, skip, kept), at in arrow.alike(stop - begin, lead, tail, own - first + lead, n):
                if kept <= 0:
                    continue
                rows = kernels.reflect(x[:, begin[at][:, None] + np.arange(length)], a, b)
                y = kernels.fft_convolve(rows.reshape(-1, rows.shape[-1]), taps).reshape(rows.shape)[..., skip : skip + kept]
                places = (own[at][:, None] + np.arange(kept)).ravel()
                yield pa.RecordBatch.from_arrays([*arrow.repeated(table, keys, begin[at], kept), pa.array(places), *(pa.array(v, from_pandas=True) for v in y.reshape(len(columns), -1))], names=schema.names)

    return arrow.grouped(cut, group, "sample_idx").mapInArrow(run, schema)


def iir_filter(samples: DataFrame, fs: float, low: float, high: float, order: int = 4, chunk: int | None = None) -> DataFrame:
    """Zero-phase Butterworth band-pass of long samples (recording_id, channel, sample_idx, value), forward and backward.

    At both ends the signal goes on reflected, for three periods of ``low`` or as far as it reaches, from a state at rest.
    Channels that are with this no longer than a chunk are filtered whole, many together. Chunks of longer ones are filtered
    apart: the state behind a chunk is an affine map of the state before it, each way, so the maps of all chunks, a few numbers each, give
    every chunk's own first states, and then each is filtered with those. So no task holds a long channel, only one small
    row for each of its chunks; the result is the sequential filter's."""
    return _iir(samples, ["recording_id", "channel"], ["value"], fs, low, high, order, chunk)


def iir_filter_wide(samples: DataFrame, channels: Sequence[str], fs: float, low: float, high: float, order: int = 4, chunk: int | None = None) -> DataFrame:
    """The same for wide samples (recording_id, sample_idx and the channels), which are a fraction of the rows."""
    return _iir(samples, ["recording_id"], list(channels), fs, low, high, order, chunk)


def _iir(samples: DataFrame, keys: list[str], columns: list[str], fs: float, low: float, high: float, order: int, chunk: int | None) -> DataFrame:
    size, reach, k = chunk or windows.CHUNK, int(3 * fs / low), len(columns)
    made = kernels.SectionFilter(kernels.butterworth_sections(fs, low, high, order))
    schema, group = _schema(samples, keys, columns), [*keys, "chunk"]
    samples = samples.select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), *[F.col(c).cast("double").alias(c) for c in columns])
    ends = [f(c, "sample_idx").alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min_by), ("z", F.max_by))]
    edges = samples.groupBy(*keys).agg(F.max("sample_idx").alias("top"), *ends).withColumn("pad", F.least("top", F.lit(reach).cast("long")))
    short = F.col("top") + 1 + 2 * F.col("pad") <= size
    rows = samples.join(edges, keys)

    def filtered(table: pa.Table, at: np.ndarray, places: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """Rows of ``y`` [column, row of ``at``, place]."""
        return pa.RecordBatch.from_arrays([*arrow.repeated(table, keys, at, y.shape[-1]), pa.array(places.ravel()), *map(pa.array, y.reshape(k, -1))], names=schema.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, keys):
            x = arrow.matrix(table, columns)
            for (n,), at in arrow.alike(np.diff(begin)):
                pad, at = min(n - 1, reach), begin[:-1][at]
                y = made.there_and_back(kernels.reflect(x[:, at[:, None] + np.arange(n)], pad, pad))[..., pad : pad + n]
                yield filtered(table, at, np.tile(np.arange(n), len(at)), y)

    at_once = arrow.grouped(rows.filter(short).select(*keys, "sample_idx", *columns), keys, "sample_idx").mapInArrow(whole, schema)

    # Of longer ones, places count from the begin of what is reflected.
    at, top, pad = F.col("sample_idx"), F.col("top"), F.col("pad")
    place = lambda where, value: F.struct(where.alias("at"), *[value(i, F.col(c)).alias(c) for i, c in enumerate(columns)])
    before = F.when((at >= 1) & (at <= pad), place(pad - at, lambda i, v: 2 * F.col(f"_a{i}") - v))
    after = F.when((at < top) & (at >= top - pad), place(2 * top - at + pad, lambda i, v: 2 * F.col(f"_z{i}") - v))
    long = rows.filter(~short).select(*keys, "top", "pad", F.explode(F.array_compact(F.array(place(at + pad, lambda i, v: v), before, after))).alias("e"))
    dealt = arrow.grouped(long.select(*keys, F.expr(f"e.at div {size}").alias("chunk"), "top", "pad", "e.*"), group, "at")
    key_fields = [samples.schema[c] for c in keys] + [T.StructField("chunk", T.LongType())]
    fields = lambda **more: T.StructType(key_fields + [T.StructField(n, t) for n, t in more.items()])
    told, arrays, begun = fields(n=T.LongType(), map=T.BinaryType()), fields(top=T.LongType(), pad=T.LongType(), x=T.BinaryType()), fields(state=T.BinaryType())
    # Of each column: the first sample, the state behind the chunk, the last output, the state behind the output turned around; all from no state.
    width = 2 * made.order + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, group):
            x = arrow.matrix(table, columns)
            for (n,), at in arrow.alike(np.diff(begin)):
                at = begin[:-1][at]
                own = x[:, at[:, None] + np.arange(n)]
                y = made.run(own, np.zeros(made.order))
                maps = np.concatenate([own[..., :1], made.end(own), y[..., -1:], made.end(y[..., ::-1])], axis=-1)
                yield pa.RecordBatch.from_arrays([*arrow.repeated(table, group, at, 1), pa.array(np.full(len(at), n)), pa.array([m.tobytes() for m in maps.swapaxes(0, 1)], pa.binary())], names=told.names)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, tuple[np.ndarray, ...]] = {}
        for table, begin in arrow.tables(batches, keys):
            n = table["n"].to_numpy()
            maps = np.frombuffer(b"".join(table["map"].to_pylist())).reshape(-1, k, width)
            head, after, last, back = np.split(maps, [1, made.order + 1, made.order + 2], axis=-1)
            for m in np.unique(n).tolist():
                if m not in ways:
                    free = made.free(m)
                    ways[m] = np.linalg.matrix_power(made.a, m).T, free[:, -1:], made.end(free[:, ::-1])
            states, size_of = np.empty((len(n), k, 2, made.order)), np.diff(begin)
            for turn in range(2):
                place = begin[:-1] if turn == 0 else begin[1:] - 1
                now = None
                for step in range(int(size_of.max())):  # the chunks of all recordings go on together
                    going = size_of > step
                    at = (place + step if turn == 0 else place - step)[going]
                    if now is None:
                        now = head[at] * made.rest if turn == 0 else np.stack([last[i] + states[i, :, 0] @ ways[int(n[i])][1] for i in at]) * made.rest
                    states[at, :, turn] = now[going]
                    for (m,), some in arrow.alike(n[at]):
                        over, _, through = ways[m]
                        one = at[some]
                        now[np.flatnonzero(going)[some]] = states[one, :, turn] @ over + (after[one] if turn == 0 else back[one] + states[one, :, 0] @ through)
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in group), pa.array([s.tobytes() for s in states], pa.binary())], names=begun.names)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in arrow.tables(batches, group):
            x = arrow.matrix(table, columns)
            raw = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:])]
            for a in range(0, len(raw), most):
                rest = arrow.repeated(table, [*group, "top", "pad"], begin[:-1][a : a + most], 1)
                yield pa.RecordBatch.from_arrays([*rest, pa.array(raw[a : a + most], pa.binary())], names=arrays.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                table = pa.Table.from_batches([batch.slice(a, most)])
                x, state = (table[c].combine_chunks() for c in ("x", "state"))
                chunk, top, pad = (table[c].to_numpy() for c in ("chunk", "top", "pad"))
                n, begin = pc.binary_length(x).to_numpy() // (8 * k), chunk * size - pad
                low, high = np.maximum(0, -begin), np.minimum(n, top + 1 - begin)  # the places of samples, not of what is reflected
                for (m, first, last), at in arrow.alike(n, low, high):
                    if first >= last:
                        continue
                    own = np.frombuffer(b"".join(x.take(pa.array(at)).to_pylist())).reshape(len(at), k, m)
                    s = np.frombuffer(b"".join(state.take(pa.array(at)).to_pylist())).reshape(len(at), k, 2, made.order)
                    y = made.run(made.run(own, s[:, :, 0])[..., ::-1], s[:, :, 1])[..., ::-1][..., first:last]
                    yield filtered(table, at, begin[at][:, None] + np.arange(first, last), y.swapaxes(0, 1))

    most = max(1, arrow.ROWS // size)  # chunks of a batch
    states = arrow.grouped(dealt.mapInArrow(summed, told), keys, "chunk").mapInArrow(composed, begun)
    chunks = dealt.mapInArrow(folded, arrays).join(states, group)
    return at_once.unionByName(chunks.select(*arrays.names, "state").mapInArrow(run, schema))
