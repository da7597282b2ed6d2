"""Writing one image from many tasks: each writes the byte ranges of its own voxels, and the image appears at commit.

    volumes.register(spark)
    voxels.write.format("volume").option("path", "/data/a.nii").option("shape", "90,110,90").mode("overwrite").save()

The image grows under a hidden name beside the one asked for; commit gives it its header and its name in one
step, abort takes it away.  A task that is tried again, or twice at a time, writes the same bytes to the same
places, so neither leaves a trace.  No task holds more than a few slices, and nothing passes through the driver.

Byte ranges need a file system that can write in the middle of a file: a path that every machine mounts.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from . import images

OPEN_SLICES = 4


@dataclass
class Wrote(WriterCommitMessage):
    voxels: int


def local(path: str) -> str:
    found = re.sub("^file:/+", "/", path)
    if not found.startswith("/"):
        raise ValueError(f"{path}: an image is written to a path that all machines mount")
    return found


class VolumeWriter(DataSourceArrowWriter):
    """Rows slice, row, col, value (or values: the bricks of a voxel).

    Options: shape (slices, rows, cols); bricks of a voxel's array (`length`, default 1) to write, as an index list
    (all); kind of number (f4); centred (affine with its origin in the middle); flip rows (true).  Voxels that have no
    row, and null values, are 0 in the image; a voxel outside the shape is an error.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = local(options["path"]), overwrite
        self.nz, self.ny, self.nx = (int(n) for n in options["shape"].split(","))
        length = int(options.get("length", 1))
        self.bricks = images.int_list(options["bricks"], length) if options.get("bricks") else list(range(length))
        self.kind = options.get("kind", "f4")
        self.flip = options.get("flip", "true").lower() == "true"
        shape = (self.nx, self.ny, self.nz, *([len(self.bricks)] if len(self.bricks) > 1 else []))
        affine = np.eye(4)
        affine[:3, 3] = [-n / 2 for n in shape[:3]]
        self.head = images.nifti_head(shape, self.kind, affine=affine if options.get("centred", "").lower() == "true" else None)
        folder, name = os.path.split(self.path)
        self.hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        os.makedirs(os.path.dirname(self.hidden), exist_ok=True)
        out, n, slices = os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o644), 0, {}
        try:
            for batch in iterator:
                column = lambda name: np.asarray(batch.column(batch.schema.get_field_index(name)))  # noqa: B023, E731
                z, y, x = (column(k).astype(np.int64) for k in ("slice", "row", "col"))
                if len(z) and not ((z >= 0) & (z < self.nz) & (y >= 0) & (y < self.ny) & (x >= 0) & (x < self.nx)).all():
                    raise ValueError("a voxel outside the image's shape")
                values = self._values(batch)
                y = self.ny - 1 - y if self.flip else y
                for s in np.unique(z):
                    if s not in slices and len(slices) >= OPEN_SLICES:
                        first = next(iter(slices))
                        self._flush(out, first, *slices.pop(first))
                    if s not in slices:
                        slices[s] = np.zeros((len(self.bricks), self.ny, self.nx), dtype="<" + self.kind), np.zeros((self.ny, self.nx), dtype=bool)
                    own = z == s
                    slices[s][0][:, y[own], x[own]] = values[own].T
                    slices[s][1][y[own], x[own]] = True
                n += len(z)
            for s, (data, there) in slices.items():
                self._flush(out, s, data, there)
        finally:
            os.close(out)
        return Wrote(n)

    def _values(self, batch: pa.RecordBatch) -> np.ndarray:
        """rows x bricks."""
        if (at := batch.schema.get_field_index("values")) >= 0:
            lists = batch.column(at)
            flat = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float), nan=0.0) if lists.flatten().null_count else lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) != len(batch) * (len(flat) // max(1, len(batch))) or lists.null_count:
                raise ValueError("voxels differ in the number of their values")
            return flat.reshape(len(batch), -1)[:, self.bricks] if len(batch) else np.zeros((0, len(self.bricks)))
        one = batch.column(batch.schema.get_field_index("value")).fill_null(0)
        return one.to_numpy(zero_copy_only=False)[:, None][:, self.bricks]

    def _flush(self, out: int, z: int, data: np.ndarray, there: np.ndarray) -> None:
        """Write a slice's runs of voxels: the whole plane at once where it is complete."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], there.reshape(-1).view(np.int8), [0]])))
        size = data.dtype.itemsize
        for t in range(len(self.bricks)):
            plane, at = data[t].reshape(-1), len(self.head) + size * self.ny * self.nx * (int(z) + self.nz * t)
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                os.pwrite(out, plane[a:b].tobytes(), at + size * a)

    def commit(self, messages: list[Wrote | None]) -> None:
        if not self.overwrite and os.path.exists(self.path):
            self.abort(messages)
            raise FileExistsError(self.path)
        os.makedirs(os.path.dirname(self.hidden), exist_ok=True)
        out = os.open(self.hidden, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.ftruncate(out, len(self.head) + np.dtype(self.kind).itemsize * self.nx * self.ny * self.nz * len(self.bricks))
            os.pwrite(out, self.head, 0)
            os.fsync(out)
        finally:
            os.close(out)
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


def save_volume(voxels: DataFrame, value: str, path: str, bricks: str = "", **options) -> None:
    """Write the column `value` (numbers, or arrays of one length) of all voxels as one image, from as many tasks as slices call for."""
    array = voxels.schema[value].dataType.simpleString().startswith("array")
    length = F.max(F.size(value)) if array else F.lit(1)
    top = voxels.agg(*[F.max(k).alias(k) for k in ("slice", "row", "col")], length.alias("length")).first()
    if top["slice"] is None:
        raise ValueError("an image needs a voxel")
    shape = ",".join(str(top[k] + 1) for k in ("slice", "row", "col"))
    rows = voxels.select("slice", "row", "col", F.col(value).cast("array<double>" if array else "double").alias("values" if array else "value"))
    rows = rows.repartitionByRange("slice").sortWithinPartitions("slice", "row", "col")
    out = rows.write.format("volume").option("path", path).option("shape", shape).option("length", top["length"]).mode("overwrite")
    out.options(**options, **({"bricks": bricks} if bricks else {})).save()
