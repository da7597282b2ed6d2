"""NIfTI-1 and MRtrix images, tracks and plain volumes: decoded from binaryFile rows, written through Spark's writers or to bytes.

Reading goes through spark.read.format("binaryFile"), so any store that Spark reads will do; a file is one
row and is decoded by one task.
"""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator
from html import unescape
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

# Header codes and numpy types of the image format.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 32: "c8", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8", 1792: "c16"}
CODES = {v: k for k, v in DTYPES.items()}
HEADER = 348


def parse_nifti_header(raw: bytes) -> dict:
    """Fields of a NIfTI-1 header in either byte order; ValueError if it is none."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == HEADER else ">"
    if struct.unpack(order + "i", raw[:4])[0] != HEADER:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(order + "8h", raw[40:56])
    pixdim = struct.unpack(order + "8f", raw[76:108])
    datatype, bitpix = struct.unpack(order + "hh", raw[70:74])
    offset, slope, inter = struct.unpack(order + "fff", raw[108:120])
    qform, sform = struct.unpack(order + "hh", raw[252:256])
    quatern = struct.unpack(order + "6f", raw[256:280])
    rows = struct.unpack(order + "12f", raw[280:328])
    return {"order": order, "dim": list(dim[1 : 1 + dim[0]]), "pixdim": list(pixdim[1:4]), "qfac": pixdim[0], "datatype": datatype, "bitpix": bitpix, "offset": int(offset), "slope": slope, "inter": inter, "qform": qform, "sform": sform, "quatern": list(quatern), "srow": list(rows), "units": raw[123], "intent": struct.unpack(order + "h", raw[68:70])[0], "magic": raw[344:348]}


def sniff(raw: bytes) -> int:
    """0 for an older image without the mark of the format, 1 for one file, 2 for a pair of files, -1 for neither."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    if len(raw) < HEADER:
        return -1
    if re.fullmatch(rb"n[+i][1-9]\0", raw[344:348]):
        return 1 if raw[345:346] == b"+" else 2
    return 0 if HEADER in struct.unpack("<i", raw[:4]) + struct.unpack(">i", raw[:4]) else -1


def extensions(raw: bytes, order: str = "<") -> list[tuple[int, bytes]]:
    """(code, data) of the extensions between header and image; each block's size is a multiple of 16."""
    if raw[HEADER : HEADER + 1] != b"\1":
        return []
    end, at, out = int(struct.unpack(order + "f", raw[108:112])[0]), HEADER + 4, []
    while at + 16 <= min(end, len(raw)):
        size, code = struct.unpack(order + "ii", raw[at : at + 8])
        if size < 16 or size % 16 or at + size > end:
            break
        out.append((code, raw[at + 8 : at + size].rstrip(b"\0")))
        at += size
    return out


def extension_block(code: int, data: bytes) -> bytes:
    size = -(-(len(data) + 8) // 16) * 16
    return struct.pack("<ii", size, code) + data.ljust(size - 8, b"\0")


# Names of the header's fields in its text form.
EXTENTS, STEPS = ("nx", "ny", "nz", "nt", "nu", "nv", "nw"), ("dx", "dy", "dz")


def header_text(h: dict) -> str:
    """The header as one element of `name = 'value'` lines."""
    rows = {"nifti_type": "NIFTI-1+", "image_offset": h["offset"], "ndim": len(h["dim"])}
    rows |= dict(zip(EXTENTS, h["dim"], strict=False)) | {k: f"{x:g}" for k, x in zip(STEPS, h["pixdim"][: len(h["dim"])], strict=False)}
    rows |= {"datatype": h["datatype"], "nvox": int(np.prod(h["dim"])), "nbyper": h["bitpix"] // 8, "byteorder": "LSB_FIRST" if h["order"] == "<" else "MSB_FIRST"}
    rows |= {"scl_slope": f"{h['slope']:g}", "scl_inter": f"{h['inter']:g}", "intent_code": h["intent"], "qform_code": h["qform"], "sform_code": h["sform"]}
    if h["sform"] > 0:
        rows["sto_xyz_matrix"] = " ".join(f"{x:g}" for x in [*h["srow"], 0, 0, 0, 1])
    return "<nifti_image\n" + "".join(f"  {k} = '{escape(str(v))}'\n" for k, v in rows.items()) + "/>\n"


def parse_header_text(text: str) -> dict[str, str]:
    """The fields of a header's text form; ValueError if it is none."""
    body = re.match(r"\s*<nifti_image\s(.*?)/>", text, re.S)
    if not body:
        raise ValueError("no header element")
    return {k: unescape(a or b) for k, a, b in re.findall(r"(\w+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\")", body[1])}


def int_list(text: str, n: int) -> list[int]:
    """Indices of a list such as [2,7..4,3..9(2)]; $ is the last one, a-b is a..b, (k) the step.  ValueError for what is none."""
    number = r"(\$|\d+)"
    out: list[int] = []
    for part in re.split(r"[\]}]", text.strip().lstrip("[{"))[0].split(","):
        if not part.strip():
            continue
        found = re.fullmatch(rf"{number}(?:(?:\.\.|-){number}(?:\((-?\d+)\))?)?", re.sub(r"\s", "", part))
        if not found:
            raise ValueError(f"no index list: {part!r}")
        a, b = (None if x is None else n - 1 if x == "$" else int(x) for x in found.groups()[:2])
        if not 0 <= a < n or not 0 <= (a if b is None else b) < n:
            raise ValueError(f"{part!r} is out of 0..{n - 1}")
        if b is None:
            out.append(a)
            continue
        step = int(found[3]) if found[3] else 1 if a <= b else -1
        if not step:
            raise ValueError("a step of 0")
        out += list(range(a, b + (1 if step > 0 else -1), step))
    return out


def decode_nifti(raw: bytes, legacy: bool = False) -> tuple[dict, np.ndarray]:
    """(header, array indexed x, y, z, ...); scaled by slope and intercept unless legacy."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    h = parse_nifti_header(raw[:HEADER])
    if h["datatype"] not in DTYPES:
        raise ValueError(f"datatype {h['datatype']} can't be read")
    n = int(np.prod(h["dim"]))
    kind = np.dtype(h["order"] + DTYPES[h["datatype"]])
    data = np.frombuffer(raw, dtype=kind, count=n, offset=h["offset"]).reshape(h["dim"], order="F")
    if not legacy and h["slope"] not in (0.0, 1.0) or not legacy and h["slope"] and h["inter"]:
        data = data * h["slope"] + h["inter"]
    return h, data


def nifti_head(shape: tuple[int, ...], kind: str, pixdim=(1.0, 1.0, 1.0), affine: np.ndarray | None = None, more: tuple[tuple[int, bytes], ...] = ()) -> bytes:
    """What stands before the numbers of a single-file NIfTI-1 image of that shape (x, y, z, ...) and kind of number."""
    blocks = b"".join(extension_block(*x) for x in more)
    raw = bytearray(HEADER + 4)
    struct.pack_into("<i", raw, 0, HEADER)
    struct.pack_into("<8h", raw, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into("<hh", raw, 70, CODES[kind], np.dtype(kind).itemsize * 8)
    struct.pack_into("<8f", raw, 76, 1.0, *pixdim, *[1.0] * 4)
    struct.pack_into("<fff", raw, 108, HEADER + 4 + len(blocks), 1.0, 0.0)
    raw[123] = 10  # millimetres and seconds
    if affine is not None:
        struct.pack_into("<hh", raw, 252, 0, 1)
        struct.pack_into("<12f", raw, 280, *np.asarray(affine, float)[:3].reshape(-1))
    raw[344:348] = b"n+1\0"
    raw[HEADER] = 1 if more else 0
    return bytes(raw) + blocks


def encode_nifti(data: np.ndarray, pixdim=(1.0, 1.0, 1.0), affine: np.ndarray | None = None, compress: bool = False, more: tuple[tuple[int, bytes], ...] = ()) -> bytes:
    """A single-file NIfTI-1 image of an array indexed x, y, z, ...; more: extensions as (code, data)."""
    kind = data.dtype.str[1:]
    if kind not in CODES:
        data, kind = data.astype("f4"), "f4"
    out = nifti_head(data.shape, kind, pixdim, affine, more) + np.asfortranarray(data).astype("<" + kind).tobytes(order="F")
    return gzip.compress(out, mtime=0) if compress else out


def read_nifti_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, dim, datatype, pixdim) of each file, decoded from its header alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                h = parse_nifti_header((gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)[:HEADER])
                rows.append((p, h["dim"], h["datatype"], h["pixdim"]))
            yield pd.DataFrame(rows, columns=["path", "dim", "datatype", "pixdim"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, dim array<int>, datatype int, pixdim array<double>")


def read_nifti(spark: SparkSession, path: str, box: dict[str, tuple[int, int]] | None = None, flip: bool = True, legacy: bool = False) -> DataFrame:
    """(path, slice, row, col, values): one row for each voxel, the rest of the dimensions in an array.

    x is the column, y the row (counted from the bottom up if flip) and z the slice.  box keeps ranges of
    slice, row and col, [a, b), before any row is made.
    """
    box = box or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                _, data = decode_nifti(raw, legacy)
                data = data.reshape(*data.shape, *[1] * max(0, 3 - data.ndim))
                nx, ny, nz = data.shape[:3]
                flat = data.reshape(nx, ny, nz, -1, order="F")
                cut = [range(*box.get(k, (0, n))) for k, n in (("col", nx), ("row", ny), ("slice", nz))]
                for z in cut[2]:
                    r, c = (g.reshape(-1) for g in np.meshgrid(list(cut[1]), list(cut[0]), indexing="ij"))
                    y = ny - 1 - r if flip else r
                    yield pd.DataFrame({"path": p, "slice": np.int32(z), "row": r.astype(np.int32), "col": c.astype(np.int32), "values": list(flat[c, y, z].astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, slice int, row int, col int, values array<double>")


def split_baseline(voxels: DataFrame, baseline: list[int]) -> DataFrame:
    """(voxel, s0, dw) of `values`: the mean of the baseline places, and the others in order."""
    places = F.array(*[F.lit(int(i)) for i in baseline]) if baseline else F.array().cast("array<int>")
    with_index = F.transform("values", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    base = F.transform(F.filter(with_index, lambda s: F.array_contains(places, s["i"])), lambda s: s["x"])
    rest = F.transform(F.filter(with_index, lambda s: ~F.array_contains(places, s["i"])), lambda s: s["x"])
    s0 = F.aggregate(base, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(base), F.lit(0))
    return voxels.select("slice", "row", "col", s0.alias("s0"), rest.alias("dw"))


def volume_bytes(voxels: DataFrame, value: str, fmt: str = "nifti", flip: bool = True, shape: tuple[int, ...] | None = None, kind: str = "f4", centred: bool = False, compress: bool = False) -> DataFrame:
    """(volume, content): the image file of each volume id.  A volume is one group, of image size.

    shape: extents of what a voxel's array holds, the first runs fastest (default: its length).  centred: the
    affine has its origin in the middle.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, r, c = (pdf[k].to_numpy() for k in ("slice", "row", "col"))
        v = np.stack([np.atleast_1d(np.asarray(x, float)) for x in pdf[value]])
        data = np.zeros((c.max() + 1, r.max() + 1, s.max() + 1, v.shape[1]))
        data[c, r.max() - r if flip else r, s] = v
        data = data.reshape(*data.shape[:3], *shape, order="F") if shape else data[..., 0] if v.shape[1] == 1 else data
        affine = np.eye(4)
        affine[:3, 3] = [-n / 2 for n in data.shape[:3]]
        encoded = {"nifti": lambda: encode_nifti(data.astype(kind), affine=affine if centred else None, compress=compress), "mif": lambda: encode_mrtrix(data), "plain": lambda: plain_volume(data)}
        return pd.DataFrame({"volume": [pdf["volume"].iloc[0]], "content": [encoded[fmt]()]})

    return voxels.select("volume", "slice", "row", "col", value).groupBy("volume").applyInPandas(run, f"volume {voxels.schema['volume'].dataType.simpleString()}, content binary")


def write_volumes(voxels: DataFrame, value: str, folder: str, fmt: str = "nifti", **how) -> DataFrame:
    """Write each volume's image to <volume>.nii (.nii.gz, .mif or .dat) in a folder; returns (name, bytes)."""
    ending = {"nifti": ".nii.gz" if how.get("compress") else ".nii", "mif": ".mif", "plain": ".dat"}[fmt]
    made = volume_bytes(voxels, value, fmt, **how)
    return files.write_files(made.select(F.concat(F.col("volume").cast("string"), F.lit(ending)).alias("name"), "content"), folder)


def join_signal(signals: DataFrame) -> DataFrame:
    """(voxel, values): s0 before the signal, for one image of both."""
    return signals.select("slice", "row", "col", F.concat(F.array(F.col("s0").cast("double")), F.col("dw").cast("array<double>")).alias("values"))


def stack_volumes(voxels: DataFrame, order: list[str], baseline: list[int] = ()) -> DataFrame:
    """(voxel, s0, dw) from many 3D images (path, voxel, values): each file is one place of the signal, in the order of the file names.

    Places of `baseline` are averaged into s0; a name that is listed twice stands for the mean of its files.
    """
    rank = F.create_map(*[F.lit(x) for kv in {n: i for i, n in enumerate(dict.fromkeys(order))}.items() for x in kv])
    place = rank[F.substring_index("path", "/", -1)]
    rows = voxels.select("slice", "row", "col", place.alias("i"), F.element_at("values", 1).alias("x")).where("i is not null")
    rows = rows.groupBy("slice", "row", "col", "i").agg(F.avg("x").alias("x")).groupBy("slice", "row", "col").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return split_baseline(rows.select("slice", "row", "col", F.col("v.x").alias("values")), list(baseline))


def average_volumes(voxels: DataFrame) -> DataFrame:
    """(voxel, values): the mean of several images, place by place."""
    rows = voxels.select("slice", "row", "col", F.posexplode("values").alias("i", "x")).groupBy("slice", "row", "col", "i").agg(F.avg("x").alias("x"))
    return rows.groupBy("slice", "row", "col").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("slice", "row", "col", F.col("v.x").alias("values"))


def pick_bricks(voxels: DataFrame, bricks: list[int]) -> DataFrame:
    """voxels with the places of `values` that are listed, in that order; a place may be listed more than once."""
    return voxels.withColumn("values", F.array(*[F.element_at("values", int(b) + 1) for b in bricks]))


def signal_at(voxels: DataFrame, s: int, r: int, c: int) -> DataFrame:
    """The signal of one voxel; no row outside the lattice."""
    return voxels.where((F.col("slice") == s) & (F.col("row") == r) & (F.col("col") == c))


def mask_volume(voxels: DataFrame, mask: str, bits: int, value: int) -> DataFrame:
    """(voxel, on): 1 where mask & bits = value."""
    return voxels.select("slice", "row", "col", (F.col(mask).bitwiseAND(F.lit(bits)) == value).cast("int").alias("on"))


def plain_volume(data: np.ndarray) -> bytes:
    """Four int32 extents (slices, rows, cols, length), then doubles voxel by voxel."""
    d = data if data.ndim == 4 else data[..., None]
    return struct.pack("<4i", d.shape[2], d.shape[1], d.shape[0], d.shape[3]) + np.ascontiguousarray(d.transpose(2, 1, 0, 3)).astype("<f8").tobytes()


def parse_plain_volume(raw: bytes) -> np.ndarray:
    s, r, c, n = struct.unpack("<4i", raw[:16])
    return np.frombuffer(raw, dtype="<f8", offset=16).reshape(s, r, c, n)


def text_header(raw: bytes) -> tuple[dict[str, list[str]], int]:
    """Fields of an MRtrix header and the place of the data."""
    end = raw.index(b"\nEND") + 1
    fields: dict[str, list[str]] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\n")[1:]:
        k, sep, v = line.partition(":")
        if sep:
            fields.setdefault(k.strip(), []).append(v.strip())
    return fields, int(fields["file"][0].split()[-1])


def encode_mrtrix(data: np.ndarray, vox=None, layout: str | None = None, transform: np.ndarray | None = None) -> bytes:
    lines = ["mrtrix image", "dim: " + ",".join(map(str, data.shape)), "vox: " + ",".join(map(str, vox or [1] * data.ndim)), "layout: " + (layout or ",".join(f"+{i}" for i in range(data.ndim))), "datatype: Float32LE"]
    if transform is not None:
        lines += ["transform: " + ",".join(f"{x:.9g}" for x in row) for row in np.asarray(transform)[:3]]
    head = "\n".join(lines) + "\n"
    at = len(head) + 64
    text = f"{head}file: . {at}\nEND\n".encode()
    return text + b"\0" * (at - len(text)) + np.asfortranarray(data).astype("<f4").tobytes(order="F")


def decode_mrtrix(raw: bytes) -> tuple[dict, np.ndarray]:
    """(fields, array); Float32LE with axes in their natural order or as `layout` says."""
    fields, at = text_header(raw)
    if fields["datatype"][0] != "Float32LE":
        raise ValueError(f"datatype {fields['datatype'][0]} can't be read")
    dim = [int(x) for x in fields["dim"][0].split(",")]
    layout = fields.get("layout", [",".join(f"+{i}" for i in range(len(dim)))])[0].split(",")
    order = np.argsort([int(x.strip("+-")) for x in layout])
    data = np.frombuffer(raw, dtype="<f4", offset=at, count=int(np.prod(dim))).reshape([dim[i] for i in order], order="F")
    data = data.transpose(np.argsort(order))
    for axis, x in enumerate(layout):
        if x.startswith("-"):
            data = np.flip(data, axis)
    return fields, data


def decode_tracks(raw: bytes) -> tuple[dict[str, str], list[np.ndarray]]:
    """(properties, tracks): triples of Float32LE, a NaN triple after each track and an infinite one at the end."""
    fields, at = text_header(raw)
    x = np.frombuffer(raw, dtype="<f4", offset=at)
    x = x[: len(x) // 3 * 3].reshape(-1, 3)
    stop = np.flatnonzero(np.isinf(x).any(1))
    x = x[: stop[0]] if len(stop) else x
    ends = np.flatnonzero(np.isnan(x).any(1))
    starts = np.concatenate([[0], ends + 1])
    return {k: v[-1] for k, v in fields.items()}, [x[a:b].astype(float) for a, b in zip(starts, [*ends, len(x)], strict=True) if b > a]


def encode_tracks(tracks: list[np.ndarray], properties: dict[str, str] | None = None) -> bytes:
    head = "mrtrix tracks\n" + "".join(f"{k}: {v}\n" for k, v in ({"count": len(tracks)} | (properties or {})).items() if k not in ("file", "datatype")) + "datatype: Float32LE\n"
    at = len(head) + 64
    text = f"{head}file: . {at}\nEND\n".encode()
    body = b"".join(np.asarray(t, "<f4").tobytes() + np.full(3, np.nan, "<f4").tobytes() for t in tracks)
    return text + b"\0" * (at - len(text)) + body + np.full(3, np.inf, "<f4").tobytes()


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(path, track_id, points, properties)"""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                props, tracks = decode_tracks(raw)
                yield pd.DataFrame({"path": p, "track_id": np.arange(len(tracks)), "points": [[{"x": a, "y": b, "z": c} for a, b, c in t.tolist()] for t in tracks], "properties": [props] * len(tracks)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, track_id bigint, points array<struct<x:double,y:double,z:double>>, properties map<string,string>")


def read_mrtrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, slice, row, col, values) of MRtrix images."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                _, data = decode_mrtrix(raw)
                data = data.reshape(*data.shape, *[1] * max(0, 3 - data.ndim))
                nx, ny, nz = data.shape[:3]
                flat = data.reshape(nx, ny, nz, -1)
                for z in range(nz):
                    r, c = (g.reshape(-1) for g in np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij"))
                    yield pd.DataFrame({"path": p, "slice": np.int32(z), "row": r.astype(np.int32), "col": c.astype(np.int32), "values": list(flat[c, r, z].astype(float))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, slice int, row int, col int, values array<double>")
