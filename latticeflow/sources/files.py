"""Whole files: written from the tasks, found by pattern, and plain matrices as text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from . import texts


def filesystem(folder: str):
    """(file system, path) of a folder: an absolute path or a URI that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


@contextmanager
def whole_file(folder: str, name: str):
    """A stream into a file of a folder, which appears under its name once it is whole."""
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        yield f
    store.move(part, f"{base}/{name}")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) as files of a folder, from the tasks; returns (name, bytes) of each.

    A file appears under its name once it is whole, so a task that is tried again leaves nothing half done.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with whole_file(folder, name) as f:
                    f.write(content)
            yield pd.DataFrame({"name": pdf["name"], "bytes": [len(c) for c in pdf["content"]]})

    kind = files.schema["content"].dataType.simpleString()
    content = F.encode("content", "UTF-8") if kind == "string" else F.col("content")
    return graph.settle(files.select("name", content.alias("content")).mapInPandas(run, "name string, bytes bigint"))


def name_matches(name: Column, pattern: str) -> Column:
    """Whether a whole name matches a pattern of * and ?, whatever the case."""
    marks = {"*": ".*", "?": "."}
    return name.rlike("(?is)^" + "".join(marks.get(c, re.escape(c)) for c in pattern) + "$")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes) of the files of a folder whose name matches; their contents aren't read."""
    rows = spark.read.format("binaryFile").load(folder).select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"))
    return rows.where(name_matches(F.col("name"), pattern))


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _hadoop(spark, path)
    return bool(store.exists(at))


def make_dir(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there after it was made; one that was there before is no error."""
    store, at = _hadoop(spark, path)
    return bool(store.mkdirs(at))


def number_lines(rows: DataFrame, order: str, vector: str, form: str = "%f") -> DataFrame:
    """(order, line): the numbers of each row in a printf form, a tab after each."""
    return rows.select(order, F.concat_ws("", F.transform(vector, lambda x: F.concat(F.format_string(form, x), F.lit("\t")))).alias("line"))


def save_matrix(rows: DataFrame, order: str, vector: str, path: str, form: str = "%f") -> None:
    """A text matrix: lines in the order of a column, over as many part files as ranges; forms %f, %E and %0.8E are usual."""
    lines = number_lines(rows, order, vector, form)
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, x) of a text matrix, part files in the order of their names; no row at all if the lines' lengths differ."""
    rows = texts.read_numbers(spark, path)
    order = Window.partitionBy("path").orderBy("line")
    sizes = rows.groupBy("path").agg(F.count("*").alias("m"), F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b"))
    every = Window.partitionBy()
    sizes = sizes.select("path", F.coalesce(F.sum("m").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), (F.min("a").over(every) == F.max("b").over(every)).alias("even"))
    numbered = rows.withColumn("r", F.row_number().over(order) - 1).join(F.broadcast(sizes), "path")
    return numbered.where("even").select((F.col("base") + F.col("r")).cast("bigint").alias("i"), "x")


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(i, x): all numbers of text files in order."""
    rows = texts.read_numbers(spark, path).select("path", "line", F.posexplode("x").alias("k", "x"))
    sizes = rows.groupBy("path", "line").agg(F.count("*").alias("m"))
    base = sizes.withColumn("base", F.coalesce(F.sum("m").over(Window.orderBy("path", "line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(base.drop("m"), ["path", "line"]).select((F.col("base") + F.col("k")).cast("bigint").alias("i"), "x")


def save_frequencies(hist: DataFrame, path: str) -> None:
    """Lines `centre<tab>freq` of a histogram, in the order of its buckets."""
    line = F.concat(F.format_string("%.15f", F.col("centre")), F.lit("\t"), F.col("freq").cast("string"))
    hist.repartitionByRange("bucket").sortWithinPartitions("bucket").select(line).write.text(path)


def result_table(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One line for each row header, one column for each column header."""
    return cells.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row)


def best_cell(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(value, row, column) of the least value; ties to the first row and column."""
    order = F.struct(value, row, column)
    return cells.agg(F.min(order).alias("b")).select(f"b.{value}", f"b.{row}", f"b.{column}")


# The codes of a pair mask file and its two path lines before the binary header.
def parse_pair_mask(raw: bytes) -> tuple[int, int, bytes]:
    """(rows, columns, codes) of a pair mask: two path lines, a byte, two int32, two bytes, the extents as text, one byte, the codes."""
    at = raw.index(b"\n", raw.index(b"\n") + 1) + 1
    at += 1 + 8 + 2
    found = re.match(rb"\s*(\d+)\s+(\d+)", raw[at:])
    if not found:
        raise ValueError("no extents in the pair mask")
    rows, cols = int(found[1]), int(found[2])
    body = raw[at + found.end() + 1 :]
    if len(body) < rows * cols:
        raise ValueError("the pair mask ends early")
    return rows, cols, body[: rows * cols]


def format_pair_mask(rows: int, cols: int, codes: bytes, gallery: str = "gallery", probe: str = "probe") -> bytes:
    return f"{gallery}\n{probe}\n".encode() + b"\0" + b"\1\0\0\0" * 2 + b"MF" + f"{rows} {cols}\n".encode() + codes


def read_pair_mask(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, code) of pair mask files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                n, m, codes = parse_pair_mask(raw)
                for i in range(n):
                    yield pd.DataFrame({"path": p, "i": i, "j": range(m), "code": list(codes[i * m : (i + 1) * m])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i bigint, j bigint, code int")
