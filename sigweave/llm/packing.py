"""Packing into fixed windows, mixed by deficit round-robin over source queues.

Every source is one queue over the whole corpus: its documents in the order of the input's
partitions. The targets say how many tokens of each source stand before any position of the packed
sequence: all queues that hold text share in proportion to their targets; as one runs dry, the
others go on in proportion; sources without a target come last, by their size. Frames of about
``frame_ids`` positions are cut from all queues at these bounds (in runs of ``RUN`` tokens), so each
frame holds its sources in the target proportions whatever its documents, and frames are packed
apart. In a frame, a window grants each source credit by the same schedule; queues are served
round-robin while their credit lasts, in runs of at least ``RUN`` tokens, and what a queue is over
or under its share is carried to the next window, and over the frame's end to the next frame.
Windows continue across frames: only the last window of all is not full.

Encoded documents are written once in blocks; prefix sums over the blocks' token counts place them,
so texts are never shuffled and ids once (twice where the blocks' offsets are too many to broadcast).

A null or empty text is its end id alone; a null source is a queue of its own. Repeated rows are
packed each. A very long text is encoded in parts, and its ids go on in blocks and frames of bounded
size. An empty table gives no pieces. Extra columns pass by; only doc_id, source and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, slices, small
from .token_store import append_end

WINDOW = 2048
RUN = 256
FRAME_IDS = 1 << 20
#: Frames are numbered in groups of so many for their prefix sums.
GROUP = 4096
BLOCK = "part int, block int, names array<string>, totals array<long>, keys array<long>, sources array<int>, starts array<long>, lengths array<long>, doc_tokens array<long>, ids binary"
CUT = "frame long, part int, block int, names array<string>, totals array<long>, keys array<long>, sources array<int>, starts array<long>, lengths array<long>, doc_tokens array<long>, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.schema([(name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]) for name, kind in fields])


class Schedule(NamedTuple):
    """How many tokens of a source stand before a position. ``listed``: the turning points (positions, tokens)
    of the sources with targets; all others share what lies between ``begin`` and ``end`` by their size."""

    begin: float
    end: float
    listed: dict[str, tuple[list[float], list[float]]]

    def served(self, name: str, total: int, at):
        x, y = self.listed.get(name) or ([self.begin, max(self.end, self.begin + 1)], [0.0, float(total)])
        return np.interp(at, x, y)

    def near(self, name: str, total: int, tokens: int) -> float:
        """A position before which about so many tokens of the source stand."""
        x, y = self.listed.get(name) or ([self.begin, self.end], [0.0, float(total)])
        return float(np.interp(tokens, y, x))

    def bound(self, name: str, total: int, frames: np.ndarray, frame_ids: int) -> np.ndarray:
        """The first token of the source in each of ``frames``: whole runs, whose phase differs between sources."""
        exact = self.served(name, total, frames * float(frame_ids))
        phase = zlib.crc32(name.encode()) % RUN
        runs = np.clip((np.floor((exact + phase) / RUN) * RUN - phase).astype(np.int64), 0, total)
        runs[exact <= 0] = 0
        runs[(exact >= total - 0.5) | (frames * float(frame_ids) >= self.end)] = total
        return runs

    def frames(self, name: str, total: int, first: int, last: int, frame_ids: int) -> tuple[int, np.ndarray]:
        """The frame of token ``first``, and the bounds of the frames from there up to that of token ``last``."""
        a = max(0, int(self.near(name, total, first) // frame_ids) - 1)
        b = int(self.near(name, total, last) // frame_ids) + 2
        while True:
            bounds = self.bound(name, total, np.arange(a, b + 1), frame_ids)
            if bounds[0] > first and a:
                a = max(0, a - 2 * (b - a))
            elif bounds[-1] <= last:
                b += 2 * (b - a)
            else:
                break
        low = int(np.searchsorted(bounds, first, side="right")) - 1
        high = int(np.searchsorted(bounds, last, side="right"))
        return a + low, bounds[low : high + 1]


def scheduled(totals: dict[str, int], targets: dict[str, float], grand: int) -> Schedule:
    """Turning points of the sources in ``targets``, whose tokens are ``totals``."""
    points = {s: ([0.0], [0.0]) for s in targets if totals.get(s) and targets[s] > 0}
    x, left = 0.0, {s: float(totals[s]) for s in points}
    while left:
        whole = sum(targets[s] for s in left)
        step = min(left[s] * whole / targets[s] for s in left)
        x += step
        for s in list(left):
            left[s] -= step * targets[s] / whole
            px, py = points[s]
            dry = left[s] <= 1e-6 * totals[s]
            px.append(x)
            py.append(float(totals[s]) if dry else totals[s] - left[s])
            if dry:
                del left[s]
    return Schedule(x, float(grand), points)


def queue_name(source: str | None) -> str:
    """Queues are named so that a null source differs from any other."""
    return "" if source is None else "=" + source


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    part, block, schema, enc = TaskContext.get().partitionId(), 0, arrow_schema(BLOCK), encoder(path)
    small_ids = np.dtype("<u2") if len(enc.begins) <= 1 << 16 else np.dtype("<u4")
    for batch in slices(batches, 2):
        ids, counts = append_end(*enc.encode(batch.column(2)), end_id)
        keys = batch.column(0).to_pylist()
        names, codes = np.unique([queue_name(s) for s in batch.column(1).to_pylist()], return_inverse=True)
        ends = np.cumsum(counts)
        # Cut at every block_ids ids; a document goes on in the next block.
        for a in range(0, int(ends[-1]), block_ids):
            b = min(a + block_ids, int(ends[-1]))
            i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left")) + 1
            begin = np.maximum(ends[i:j] - counts[i:j], a)
            starts = begin - (ends[i:j] - counts[i:j])
            lengths = np.minimum(ends[i:j], b) - begin
            own, local = np.unique(codes[i:j], return_inverse=True)
            totals = np.bincount(local, weights=lengths).astype(np.int64)
            row = [[part], [block], [names[own].tolist()], [totals], [keys[i:j]], [local], [starts], [lengths], [counts[i:j]], [ids[a:b].astype(small_ids).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema.types)], schema=schema)
            block += 1


def _spans(batches: Iterator[pa.RecordBatch], plan: Schedule, frame_ids: int) -> Iterator[pa.RecordBatch]:
    """(frame, tokens) of each run of a source in a block."""
    for batch in batches:
        frame, tokens = [], []
        for name, total, first, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            k, bounds = plan.frames(name, total, first, first + n - 1, frame_ids)
            sizes = np.diff(np.clip(bounds, first, first + n))
            frame.append(k + np.flatnonzero(sizes))
            tokens.append(sizes[sizes > 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (frame, tokens)], names=["frame", "n"])


def _cut(batches: Iterator[pa.RecordBatch], plan: Schedule, frame_ids: int) -> Iterator[pa.RecordBatch]:
    """Each block's documents, cut and sorted into frames."""
    schema = arrow_schema(CUT)
    for batch in batches:
        for at in range(batch.num_rows):
            r = {n: batch.column(i)[at] for i, n in enumerate(batch.schema.names)}
            keys, lengths, starts, tokens, source = (r[c].values.to_numpy(zero_copy_only=False) for c in ("keys", "lengths", "starts", "doc_tokens", "sources"))
            null_keys = np.array(r["keys"].values.is_null())
            names, queues = r["names"].as_py(), {q["source"]: q for q in r["queues"].as_py()}
            raw, ids = r["ids"].as_py(), None
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(lengths.sum()) else "<u4")
            begin = np.cumsum(lengths) - lengths
            doc, start, length, frame = [], [], [], []
            for s, name in enumerate(names):
                mine = np.flatnonzero(source == s)
                first, total = queues[name]["first"], queues[name]["total"]
                ends = first + np.cumsum(lengths[mine])
                k, bounds = plan.frames(name, total, first, int(ends[-1]) - 1, frame_ids)
                cuts = np.unique(np.concatenate([ends - lengths[mine], bounds[(bounds > first) & (bounds < ends[-1])]]))
                which = np.searchsorted(ends, cuts, side="right")
                doc.append(mine[which])
                start.append(cuts - (ends - lengths[mine])[which])
                length.append(np.diff(np.append(cuts, ends[-1])))
                frame.append(k + np.searchsorted(bounds, cuts, side="right") - 1)
            doc, start, length, frame = map(np.concatenate, (doc, start, length, frame))
            order = np.lexsort((start, doc, frame))
            doc, start, length, frame = doc[order], start[order], length[order], frame[order]
            borders = [0, *(np.flatnonzero(np.diff(frame)) + 1).tolist(), len(frame)]
            totals = [queues[n]["total"] for n in names]
            for a, b in zip(borders, borders[1:]):
                d = doc[a:b]
                own = np.concatenate([ids[p : p + n] for p, n in zip((begin[d] + start[a:b]).tolist(), length[a:b].tolist())])
                row = [[int(frame[a])], [r["part"].as_py()], [r["block"].as_py()], [names], [totals], [pa.array(keys[d].astype(np.int64) if not null_keys.any() else np.where(null_keys, 0, keys)[d].astype(np.int64), mask=null_keys[d])], [source[d]], [starts[d] + start[a:b]], [length[a:b]], [tokens[d]], [own.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema.types)], schema=schema)


def schedule(lengths: list[int], queue_of: list[int], credit: Callable[[int, int], list[float]], balance: list[float], position: int, window: int = WINDOW, run: int = RUN) -> list[tuple[int, int, int, int]]:
    """Deficit round-robin over the documents of a frame, from global token ``position`` on.

    ``credit(a, b)``: each queue's share of the positions from a to b. ``balance``: tokens by which each
    queue is behind its share. Returns (document, start, length, position) of each piece, in order; no
    piece crosses a window's end.
    """
    queues: list[list[int]] = [[] for _ in balance]
    for d in range(len(lengths) - 1, -1, -1):
        queues[queue_of[d]].append(d)
    heads = [q.pop() if q else -1 for q in queues]
    done = [0] * len(balance)
    left = sum(lengths)
    pieces: list[tuple[int, int, int, int]] = []
    turn, granted = 0, position
    live = [s for s in range(len(balance)) if heads[s] >= 0]
    while left:
        room = window - position % window
        if position >= granted:  # a new window, or the rest of one begun before: grant its credit
            balance = [x + y for x, y in zip(balance, credit(position, position + room))]
            granted = position + room
        # The next queue in turn that has credit, or else the one that is least ahead.
        for k in range(len(live)):
            s = live[(turn + k) % len(live)]
            if balance[s] > 0:
                turn = (turn + k) % len(live)
                break
        else:
            s = max(live, key=balance.__getitem__)
            turn = live.index(s)
        d = heads[s]
        n = min(room, lengths[d] - done[s], max(run, int(balance[s])))
        if pieces and pieces[-1][0] == d and pieces[-1][3] + pieces[-1][2] == position and position % window:
            last = pieces[-1]
            pieces[-1] = (d, last[1], last[2] + n, last[3])
        else:
            pieces.append((d, done[s], n, position))
        balance[s] -= n
        position += n
        left -= n
        done[s] += n
        if done[s] == lengths[d]:
            done[s] = 0
            if queues[s]:
                heads[s] = queues[s].pop()
            else:
                heads[s] = -1
                live.remove(s)
                continue
        if balance[s] <= 0:
            turn += 1
    return pieces


def _pack(frame: pa.Table, plan: Schedule, frame_ids: int, window: int) -> pa.Table:
    """The pieces of one frame, which has a row for each block that it has documents from."""
    names: dict[str, int] = {}
    totals: list[int] = []
    keys, starts, lengths, tokens, queue, ids = [], [], [], [], [], []
    order = sorted(zip(frame["part"].to_pylist(), frame["block"].to_pylist(), range(frame.num_rows)))
    for _, _, i in order:
        r = {c: frame[c][i] for c in frame.column_names}
        for n, t in zip(r["names"].as_py(), r["totals"].as_py()):
            if n not in names:
                names[n] = len(names)
                totals.append(t)
        local = np.array([names[n] for n in r["names"].as_py()])
        keys += r["keys"].as_py()
        starts += r["starts"].as_py()
        lengths += r["lengths"].as_py()
        tokens += r["doc_tokens"].as_py()
        queue += local[r["sources"].values.to_numpy()].tolist()
        raw = r["ids"].as_py()
        ids.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * sum(r["lengths"].as_py()) else "<u4").astype("<u4"))
    k, position = frame["frame"][0].as_py(), frame["position"][0].as_py()
    listed = list(zip(names, totals))
    served = lambda at: np.array([plan.served(n, t, at) for n, t in listed])
    first = np.array([plan.bound(n, t, np.array([k]), frame_ids)[0] for n, t in listed])
    # All windows' grants at once.
    stops = np.arange(position - position % window, position + sum(lengths) + window, window)
    stops[0] = position
    grants = np.stack([plan.served(n, t, stops) for n, t in listed])
    credit = lambda a, b: (grants[:, -(-b // window) - position // window] - grants[:, a // window - position // window]).tolist()
    pieces = schedule(lengths, queue, credit, (served(position) - first).tolist(), position, window)
    raw = memoryview(np.concatenate(ids).tobytes())
    begin = (np.cumsum(lengths) - lengths).tolist()
    doc, start, length, at = map(np.array, zip(*pieces))
    crc = [zlib.crc32(raw[4 * (begin[d] + s) : 4 * (begin[d] + s + n)]) for d, s, n, _ in pieces]
    columns = [pa.array(keys, pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (np.array(starts)[doc] + start, length, crc, np.array(tokens)[doc], at // window, at % window))]
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in PIECE.split(", ")])


def pack(docs: DataFrame, tokenizer: str, targets: dict[str | None, float] | None = None, window: int = WINDOW, end_id: int = 1, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Pieces of all ``docs(doc_id, source, text)``. ``targets``: share of each source; by default its share of all tokens."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    blocks = materialize(read.mapInArrow(lambda it: _blocks(it, tokenizer, end_id, frame_ids), BLOCK), "blocks")

    # Tokens of its source before each block: prefix sums over parts, then over the blocks of a part.
    counts = blocks.select("part", "block", F.explode(F.arrays_zip("names", "totals")).alias("d")).select("part", "block", F.col("d.names").alias("source"), F.col("d.totals").alias("n"))
    zero, before = F.lit(0).cast("long"), (Window.unboundedPreceding, -1)
    parts = counts.groupBy("part", "source").agg(F.sum("n").alias("n"))
    totals = materialize(parts.groupBy("source").agg(F.sum("n").alias("total")), "sources")
    over = Window.partitionBy("source").orderBy("part").rowsBetween(*before)
    parts = parts.select("part", "source", F.coalesce(F.sum("n").over(over), zero).alias("p"))
    inside = Window.partitionBy("part", "source").orderBy("block").rowsBetween(*before)
    within = counts.select("part", "block", "source", "n", F.coalesce(F.sum("n").over(inside), zero).alias("q"))
    n_sources = totals.count()
    placed = within.join(parts, ["part", "source"]).join(small(totals, n_sources), "source")
    placed = materialize(placed.select("part", "block", "source", "total", (F.col("p") + F.col("q")).alias("first"), "n"), "placed")

    grand = totals.agg(F.sum("total")).first()[0] or 0
    wanted = {queue_name(s): float(t) for s, t in (targets or {}).items()}
    held = {r["source"]: r["total"] for r in totals.filter(F.col("source").isin(list(wanted))).collect()} if wanted else {}
    plan = scheduled(held, wanted, grand)
    spans = placed.select("source", "total", "first", "n").mapInArrow(lambda it: _spans(it, plan, frame_ids), "frame long, n long")
    frames = spans.groupBy("frame").agg(F.sum("n").alias("n")).withColumn("group", F.expr(f"frame div {GROUP}"))
    groups = frames.groupBy("group").agg(F.sum("n").alias("n")).select("group", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(*before)), zero).alias("p"))
    inside = Window.partitionBy("group").orderBy("frame").rowsBetween(*before)
    positions = frames.select("frame", "group", F.coalesce(F.sum("n").over(inside), zero).alias("q")).join(groups, "group").select("frame", (F.col("p") + F.col("q")).alias("position"))
    positions = materialize(positions, "positions")

    queues = placed.groupBy("part", "block").agg(F.collect_list(F.struct("source", "total", "first")).alias("queues"))
    cut = blocks.drop("totals").join(small(queues, placed.count()), ["part", "block"]).mapInArrow(lambda it: _cut(it, plan, frame_ids), CUT)
    framed = cut.join(small(positions, positions.count()), "frame")
    return framed.groupBy("frame").applyInArrow(lambda t: _pack(t, plan, frame_ids, window), PIECE)


def op3_drr_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer)
