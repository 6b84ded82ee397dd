"""A Spark data source of epoch bundles: ``.npz`` archives with arrays X, y and maybe groups, read in slices of epochs.

An array stored without compression is read by its place in the file, so a bundle of any size is many
partitions; a compressed one is one partition, decompressed as a stream. In both, a task holds one slice. Files are
opened by pyarrow's file systems (local or shared folders, hdfs, s3, ...); pickled objects are refused.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "recording_id string, epoch_id long, group_id int, label int, channel string, x array<double>"
#: Bytes of X in a slice.
SLICE = 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Member:
    """One array of a bundle, read from row to row."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.info = archive.getinfo(f"{name}.npy")
        self.stream = archive.open(self.info)
        version = npy.read_magic(self.stream)
        self.shape, fortran, self.kind = npy.read_array_header_1_0(self.stream) if version == (1, 0) else npy.read_array_header_2_0(self.stream)
        if self.kind.hasobject or (fortran and len(self.shape) > 1):
            raise ValueError(f"{name}: objects and column-major arrays are not read")
        self.begin, self.at = self.stream.tell(), 0
        self.row = self.kind.itemsize * prod(self.shape[1:])

    def rows(self, start: int, stop: int) -> np.ndarray:
        if start != self.at:
            self.stream.seek(self.begin + start * self.row)
        raw = self.stream.read((stop - start) * self.row)
        self.at = stop
        return np.frombuffer(raw, self.kind).reshape(stop - start, *self.shape[1:])


@dataclass
class Slice(InputPartition):
    path: str
    place: int
    start: int
    stop: int


class BundleReader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int):
        self.path, self.slice_bytes = path, slice_bytes

    def partitions(self) -> list[Slice]:
        """From the files' headers alone; a file's place is that in order of path."""
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        out = []
        for place, name in enumerate(sorted(f.path for f in found if f.is_file and f.path.endswith(".npz"))):
            with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                x = Member(archive, "X")
                if len(x.shape) not in (2, 3):
                    raise ValueError(f"{name}: X has {len(x.shape)} dimensions")
                whole = x.info.compress_type != zipfile.ZIP_STORED
                step = max(1, x.shape[0] if whole else self.slice_bytes // max(1, x.row))
            out += [Slice(name, place, a, min(a + step, x.shape[0])) for a in range(0, x.shape[0], step)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with ExitStack() as held:
            # Each array has a handle of its own, as members of one archive share its position.
            archives = [held.enter_context(zipfile.ZipFile(held.enter_context(system.open_input_file(partition.path)))) for _ in range(3)]
            x, y = Member(archives[0], "X"), Member(archives[1], "y")
            groups = Member(archives[2], "groups") if "groups.npy" in archives[2].namelist() else None
            step = max(1, self.slice_bytes // max(1, x.row))
            for a in range(partition.start, partition.stop, step):
                b = min(a + step, partition.stop)
                part = x.rows(a, b).astype(float)
                part = part[:, None, :] if part.ndim == 2 else part
                n, c, t = part.shape
                of = groups.rows(a, b) if groups else np.full(n, partition.place)
                arrays = [
                    pa.array([partition.path] * (n * c)), pa.array(np.repeat(np.arange(a, b), c)), pa.array(np.repeat(of, c).astype(np.int32)), pa.array(np.repeat(y.rows(a, b), c).astype(np.int32)),
                    pa.array([f"c{i}" for i in range(c)] * n), pa.ListArray.from_arrays(pa.array(np.arange(n * c + 1) * t, pa.int32()), pa.array(part.reshape(-1))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")])


class EpochBundles(DataSource):
    """``spark.read.format("epoch_bundles").option("slice", bytes).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "epoch_bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BundleReader:
        return BundleReader(self.options["path"], int(self.options.get("slice", SLICE)))
