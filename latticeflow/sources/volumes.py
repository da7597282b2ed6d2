"""`volume`, a Python data source over NIfTI-1 images that reads only the slices, rows and bricks asked for, and writes from many tasks (see sinks).

    volumes.register(spark)
    spark.read.format("volume").option("path", folder).option("slice", "3:5").load().where("row >= 10 and row < 20")

Uncompressed images are read by byte ranges, a partition for each run of slices; options slice, row and col
(`a:b`, b not included) and bricks (an index list, repeats allowed) cut before anything is read.  Comparisons
of slice, row and col with numbers are taken over from the plan.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import files, images, sinks

AXES = ("slice", "row", "col")
FAR = 1 << 31
PARTITION_BYTES = 64 << 20


@dataclass
class Run(InputPartition):
    path: str
    first: int
    stop: int


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.box = {k: self._range(options.get(k)) for k in AXES}
        self.bricks = options.get("bricks")
        self.flip = options.get("flip", "true").lower() == "true"

    @staticmethod
    def _range(text: str | None) -> tuple[int, int]:
        a, _, b = (text or ":").partition(":")
        return int(a or 0), int(b or FAR)

    def pushFilters(self, filters: list) -> Iterator:
        """Take over comparisons of a place with a whole number; the others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in AXES or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            a, b = self.box[name]
            low = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f), a)
            high = {EqualTo: f.value + 1, LessThan: f.value, LessThanOrEqual: f.value + 1}.get(type(f), b)
            if (low, high) == (a, b) and not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            self.box[name] = max(a, low), min(b, high)

    def _open(self, path: str):
        store, at = files.filesystem(path)
        return store.open_input_file(at)

    def partitions(self) -> list[Run]:
        from pyarrow import fs

        store, at = files.filesystem(self.folder)
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        out = []
        for x in sorted(found, key=lambda i: i.path):
            if x.type != fs.FileType.File or not x.path.lower().endswith((".nii", ".nii.gz")):
                continue
            if x.path.lower().endswith(".gz"):
                out.append(Run(x.path, *self.box["slice"]))
                continue
            with store.open_input_file(x.path) as f:
                dim = images.parse_nifti_header(f.read(images.HEADER))["dim"]
            n = dim[2] if len(dim) > 2 else 1
            lo, hi = max(0, self.box["slice"][0]), min(n, self.box["slice"][1])
            step = max(1, int(PARTITION_BYTES * n / max(1, x.size)))
            out += [Run(x.path, s, min(hi, s + step)) for s in range(lo, hi, step)]
        return out

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        with self._open(partition.path) as f:
            zipped = partition.path.lower().endswith(".gz")
            raw = gzip.decompress(f.read()) if zipped else None
            head = raw[: images.HEADER] if zipped else f.read(images.HEADER)
            h = images.parse_nifti_header(head)
            dim = (*h["dim"], *[1] * (3 - len(h["dim"])))
            nx, ny, nz = dim[:3]
            every = int(np.prod(dim[3:])) if len(dim) > 3 else 1
            bricks = images.int_list(self.bricks, every) if self.bricks else list(range(every))
            kind = np.dtype(h["order"] + images.DTYPES[h["datatype"]])
            rows = range(max(0, self.box["row"][0]), min(ny, self.box["row"][1]))
            cols = range(max(0, self.box["col"][0]), min(nx, self.box["col"][1]))
            if not rows or not cols:
                return
            place = [ny - 1 - r if self.flip else r for r in rows]
            low, high = min(place), max(place) + 1  # lines of a slice that hold the rows asked for
            for z in range(max(0, partition.first), min(nz, partition.stop)):
                planes = []
                for t in bricks:
                    at = h["offset"] + kind.itemsize * nx * (low + ny * (z + nz * t))
                    size = kind.itemsize * nx * (high - low)
                    if zipped:
                        piece = raw[at : at + size]
                    else:
                        f.seek(at)
                        piece = f.read(size)
                    planes.append(np.frombuffer(piece, kind).reshape(high - low, nx)[:, cols.start : cols.stop])
                cube = np.stack(planes, axis=-1).astype(float)
                if h["slope"] not in (0.0, 1.0) or h["slope"] and h["inter"]:
                    cube = cube * h["slope"] + h["inter"]
                for r, y in zip(rows, place, strict=True):
                    n = len(cols)
                    values = pa.ListArray.from_arrays(np.arange(0, n * len(bricks) + 1, len(bricks), dtype=np.int32), pa.array(cube[y - low].reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.full(n, z, np.int32)), pa.array(np.full(n, r, np.int32)), pa.array(np.arange(cols.start, cols.stop, dtype=np.int32)), values], names=["path", "slice", "row", "col", "values"])


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "path string, slice int, row int, col int, values array<double>"

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> sinks.VolumeWriter:
        return sinks.VolumeWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, which from then on passes filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
