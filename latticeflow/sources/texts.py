"""Text and binary field files, direction lists, gradient schemes and settings files."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import fields as dataclass_fields
from itertools import chain, groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 4
PIECE = 1 << 14  # bytes of a file that reach a task at once
VOXELS = 1024  # parsed at once
FIELD = "path string, slice int, row int, col int, compartments array<struct<fraction:double,rotation:array<double>,lambda:array<double>,seg:int>>, atoms array<struct<alpha:double,dir:array<double>,grp:int>>"


class Tokens:
    """The numbers of a text that comes in pieces."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.items, self.at, self.rest = iter(pieces), [], 0, ""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            piece, done = " ", not self.rest
        else:
            done = False
        text = self.rest + piece
        self.items, self.at = self.items[self.at :] + text.split(), 0
        self.rest = self.items.pop() if self.items and text and not text[-1].isspace() else ""
        return not done

    def take(self, n: int = 1, kind=float) -> list:
        while len(self.items) - self.at < n and self.more():
            pass
        out = [kind(x) for x in self.items[self.at : self.at + n]]
        if len(out) != n:
            raise ValueError("the field file ends early")
        self.at += n
        return out


class Numbers:
    """The numbers of a binary field that comes in pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.raw, self.at = iter(pieces), b"", 0

    def take(self, n: int = 1, kind=float) -> list:
        size = n * (4 if kind is int else 8)
        while len(self.raw) - self.at < size:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("the field file ends early")
            self.raw, self.at = self.raw[self.at :] + piece, 0
        out = list(struct.unpack_from(f"<{n}{'i' if kind is int else 'd'}", self.raw, self.at))
        self.at += size
        return out


def parse_voxel(read) -> tuple[list[dict], list[dict]]:
    """One versioned record: a negative first number is minus the version; later versions carry more."""
    (first,) = read(1, int)
    version = -first if first < 0 else 0
    n = read(1, int)[0] if first < 0 else first
    fractions = read(n)
    rotations = [np.array(read(9)).reshape(3, 3).T.reshape(-1).tolist() for _ in range(n)]  # columns first on disk
    lambdas = [read(3) for _ in range(n)]
    m = read(1, int)[0] if version > 0 else 0
    alpha = read(m) if version > 0 else []
    dirs = [read(3) for _ in range(m)] if version > 1 else [None] * m
    groups = read(m, int) if version > 2 else [None] * m
    seg = read(n, int) if version > 3 else [None] * n
    return [{"fraction": f, "rotation": r, "lambda": l, "seg": s} for f, r, l, s in zip(fractions, rotations, lambdas, seg, strict=True)], [{"alpha": a, "dir": d, "grp": g} for a, d, g in zip(alpha, dirs, groups, strict=True)]


def voxel_numbers(compartments, atoms) -> list:
    """The numbers of a version-4 record in order."""
    cs, at = list(compartments if compartments is not None else []), list(atoms if atoms is not None else [])
    out: list = [-VERSION, len(cs), *[float(c["fraction"]) for c in cs]]
    for c in cs:
        out += np.asarray(c["rotation"], float).reshape(3, 3).T.reshape(-1).tolist()
    for c in cs:
        out += [float(x) for x in c["lambda"]]
    out += [len(at), *[float(a["alpha"]) for a in at]]
    for a in at:
        out += [float(x) for x in (a["dir"] if a["dir"] is not None else (0, 0, 0))]
    return out + [int(a["grp"]) if a["grp"] is not None else -1 for a in at] + [int(c["seg"]) if c["seg"] is not None else -1 for c in cs]


def text_voxels(pieces: Iterable[str]) -> Iterator[tuple]:
    """(slice, row, col, compartments, atoms) of a text field; rows stand bottom-up."""
    t = Tokens(pieces)
    (dim,) = t.take(1, int)
    ns = t.take(1, int)[0] if dim == 3 else 1
    nr, nc = t.take(2, int)
    return ((s, r, c, *parse_voxel(t.take)) for s in range(ns) for r in reversed(range(nr)) for c in range(nc))


def binary_voxels(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """(slice, row, col, compartments, atoms) of a binary field."""
    t = Numbers(pieces)
    ns, nr, nc = t.take(3, int)
    return ((s, r, c, *parse_voxel(t.take)) for s in range(ns) for r in range(nr) for c in range(nc))


def parse_field(text: str) -> list[tuple]:
    return list(text_voxels([text]))


def voxel_text(compartments, atoms) -> str:
    """A voxel's line of a text field."""
    return " ".join(repr(x) for x in voxel_numbers(compartments, atoms)) + "\n"


def voxel_bytes(compartments, atoms) -> bytes:
    """A voxel's record of a binary field: little-endian int32 counts and labels, float64 values."""
    return b"".join(struct.pack("<i" if isinstance(x, int) else "<d", x) for x in voxel_numbers(compartments, atoms))


def format_field(rows: dict, ns: int, nr: int, nc: int) -> str:
    """A text field; voxels that are not in rows {(slice, row, col): (compartments, atoms)} are empty."""
    lines = [f"3\n{ns} {nr} {nc}\n"]
    for s in range(ns):
        for r in reversed(range(nr)):
            for c in range(nc):
                lines.append(voxel_text(*rows.get((s, r, c), ([], []))))
    return "".join(lines)


def encode_binary_field(rows: dict, ns: int, nr: int, nc: int) -> bytes:
    """The same records as little-endian numbers."""
    out = [struct.pack("<3i", ns, nr, nc)]
    for s in range(ns):
        for r in range(nr):
            for c in range(nc):
                out.append(voxel_bytes(*rows.get((s, r, c), ([], []))))
    return b"".join(out)


def decode_binary_field(raw: bytes) -> list[tuple]:
    return list(binary_voxels([raw]))


def read_field(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Text and binary fields, one row for each voxel; a file is parsed by one task, which holds a few pieces of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((p, raw) for pdf in batches for p, raw in zip(pdf["path"], pdf["raw"], strict=True))
        for p, own in groupby(rows, key=lambda r: r[0]):
            pieces = (raw for _, raw in own)
            head = b""
            while len(head) < 64 and (raw := next(pieces, None)) is not None:
                head += raw
            pieces = chain([head], pieces)
            voxels = binary_voxels(pieces) if b"\0" in head[:64] else text_voxels(raw.decode("latin-1") for raw in pieces)  # all of it is ASCII
            while some := list(islice(voxels, VOXELS)):
                yield pd.DataFrame([(p, *v) for v in some], columns=["path", "slice", "row", "col", "compartments", "atoms"])

    whole = spark.read.format("binaryFile").load(path)
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / piece)).cast("int")
    each = whole.select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    return each.select("path", F.substring("content", F.col("i") * piece + 1, F.lit(piece)).alias("raw")).mapInPandas(run, FIELD)


def field_text(field: DataFrame) -> DataFrame:
    """(id, content) of the text file of each field id; a field is one group, of file size."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {(s, r, c): (cs, a) for s, r, c, cs, a in zip(pdf["slice"], pdf["row"], pdf["col"], pdf["compartments"], pdf["atoms"], strict=True)}
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "content": [format_field(rows, *[int(pdf[k].max()) + 1 for k in ("slice", "row", "col")])]})

    return field.groupBy("id").applyInPandas(run, f"id {field.schema['id'].dataType.simpleString()}, content string")


def tensor_lines(tensors: DataFrame, order: str) -> DataFrame:
    """(order, line) of single tensors (fraction, rotation, lambda): fraction, rotation by columns, diffusivities."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda p: F.element_at("rotation", (F.pmod(p, F.lit(3)) * 3 + F.floor(p / 3) + 1).cast("int")))
    numbers = F.concat(F.array("fraction"), turned, F.col("lambda"))
    return tensors.select(order, F.array_join(F.transform(numbers, lambda x: F.format_string("%f", x)), "\t").alias("line"))


def parse_tensor_lines(lines: DataFrame) -> DataFrame:
    """lines' columns and fraction, rotation, lambda of each line of single tensors."""
    x = F.transform(F.split(F.trim("line"), r"\s+"), lambda t: t.cast("double"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda p: F.element_at(x, (F.pmod(p, F.lit(3)) * 3 + F.floor(p / 3) + 2).cast("int")))
    return lines.select("*", F.element_at(x, 1).alias("fraction"), turned.alias("rotation"), F.slice(x, 11, 3).alias("lambda")).drop("line")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, x): the numbers of each line that has any."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "t"))
    x = F.transform(F.filter(F.split(F.trim(F.regexp_replace("t", r"[\s,]+", " ")), " "), lambda s: s != ""), lambda s: s.try_cast("double"))
    return rows.select("path", "line", x.alias("x")).where(F.size("x") > 0)


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, x, y, z) of a list of directions."""
    order = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    at = lambda i: F.element_at("x", i)
    return read_numbers(spark, path).where(F.size("x") >= 3).select("path", order.alias("idx"), at(1).alias("x0"), at(2).alias("y"), at(3).alias("z")).withColumnRenamed("x0", "x")


def read_scheme(spark: SparkSession, path: str, zero: float = 1e-5) -> DataFrame:
    """(path, idx, x, y, z, is_s0): a gradient scheme; near-zero rows are baselines, the others unit vectors."""
    d = read_directions(spark, path)
    base = (F.abs("x") <= zero) & (F.abs("y") <= zero) & (F.abs("z") <= zero)
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return d.select("path", "idx", *[F.when(base, F.col(k)).otherwise(F.col(k) / n).alias(k) for k in "xyz"], base.alias("is_s0"))


def read_b_scheme(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, azimuth, elevation, b) of rows x y z b with b > 0."""
    at = lambda i: F.element_at("x", i)
    rows = read_numbers(spark, path).where((F.size("x") >= 4) & (F.element_at("x", 4) > 0))
    n = F.sqrt(at(1) ** 2 + at(2) ** 2 + at(3) ** 2)
    order = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return rows.select("path", order.alias("idx"), F.atan2(at(2), at(1)).alias("azimuth"), F.acos(at(3) / n).alias("elevation"), at(4).alias("b"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of each white-space separated file name."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name != ''")


def format_settings(values: dict) -> str:
    """Lines `name value`, typed as parse_settings() reads them back."""
    return "".join(f"{k} {int(v) if isinstance(v, bool) else v}\n" for k, v in values.items())


def parse_settings(text: str, kinds: dict[str, type]) -> tuple[dict, list[str]]:
    """(values, warnings) of lines `name value`; # begins a comment; names without a kind are warned of."""
    values, warnings = {}, []
    for line in text.splitlines():
        name, _, value = line.split("#")[0].strip().partition(" ")
        if not name:
            continue
        if name not in kinds:
            warnings.append(f"unknown setting {name}")
            continue
        value = value.strip()
        try:
            values[name] = value.lower() in ("1", "true", "yes") if kinds[name] is bool else kinds[name](value)
        except ValueError:
            warnings.append(f"{name}: {value!r} is no {kinds[name].__name__}")
    return values, warnings


def settings(text: str, into: type):
    """A dataclass filled from a settings text; unknown names raise."""
    kinds = {f.name: {"str": str, "int": int, "float": float, "bool": bool}.get(f.type, f.type) for f in dataclass_fields(into)}
    values, warnings = parse_settings(text, kinds)
    if warnings:
        raise ValueError("; ".join(warnings))
    return into(**values)
