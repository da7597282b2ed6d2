"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import platform
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "__lf_rid"
NULL_ID = -(1 << 63)
BITMAP_BITS = 1 << 27
AT_ONCE = 500
HOT_KEYS, HOT_ROWS = 1000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session that has none gets a temporary folder, kept for its life; on a cluster it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="latticeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/latticeflow/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lattice_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more: what was made of them is written itself.

    The shuffle files behind them go when the driver collects its garbage, which a long chain of jobs with
    little garbage each would put off until the disks are full; so it is asked to.
    """
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.lattice_path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    for spark in {t.sparkSession for t in tables}:
        spark.sparkContext._jvm.System.gc()


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A stable 64-bit key of (doc_id, text): the same on every read, whatever the partitions.

    Rows equal in both get one key and so one result; a null text is the empty text.
    """
    return F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))


def documents(df: DataFrame, key: bool = False) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns there are."""
    out = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return out.withColumn(RID, row_key()) if key else out


def quoted(name: str) -> Column:
    """A column by its whole name, dots and back-ticks in it too."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_row(df: DataFrame, at: str) -> Column:
    """Aggregate: the least of a group's rows by all columns but `at`, as a struct; columns that have no order, such as maps, count by their JSON."""
    names = [c for c in df.columns if c != at]
    ordered = lambda c: "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()
    order = [quoted(c) if ordered(c) else F.to_json(F.struct(quoted(c).alias("x"))) for c in names]
    return F.min_by(F.struct(*[quoted(c) for c in names]), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle, as the session sizes them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def spread_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows left-joined with few (at most one row for each key), without a task for all rows of a common key.

    The HOT_KEYS commonest keys, where more than HOT_ROWS rows have one, come to the driver; few's rows of
    these, no more than that, are broadcast to rows where they stand.  Any other key has at most one row in
    HOT_KEYS of all, and goes through the shuffle.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > HOT_ROWS) & F.col(key).isNotNull())
    hot = [r[key] for r in counts.orderBy(F.desc("n"), key).limit(HOT_KEYS).collect()]
    if not hot:
        return rows.join(few, key, "left")
    common = F.coalesce(F.col(key).isin(hot), F.lit(False))
    names = list(dict.fromkeys([key, *rows.columns, *few.columns]))
    there = rows.where(common).join(F.broadcast(few.where(common)), key, "left").select(*names)
    return there.unionByName(rows.where(~common).join(few.where(~common), key, "left").select(*names))


class Bitmap:
    """A set of 64-bit hashes as a bit array of fixed size: it may say yes too often, never no."""

    def __init__(self, spark: SparkSession, hashes: DataFrame, column: str):
        block = F.col(column).bitwiseAND(F.lit(BITMAP_BITS - 1))
        cut = hashes.select(F.shiftright(block, 12).cast("int").alias("blk"), block.bitwiseAND(F.lit(4095)).cast("int").alias("bit")).repartition(width(spark), "blk")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own: dict[int, np.ndarray] = {}
            for pdf in batches:
                for b, bits in pdf.groupby("blk")["bit"]:
                    own.setdefault(b, np.zeros(4096, dtype=bool))[bits.to_numpy()] = True
            yield pd.DataFrame({"blk": list(own), "bits": [np.packbits(x).tobytes() for x in own.values()]}).astype({"blk": "int32"})

        table = np.zeros((BITMAP_BITS >> 12, 512), dtype=np.uint8)
        for r in cut.mapInPandas(tidy(run), "blk int, bits binary").collect():  # at most BITMAP_BITS in all
            table[r["blk"]] |= np.frombuffer(r["bits"], dtype=np.uint8)
        self.shared = spark.sparkContext.broadcast(table.reshape(-1).tobytes())
        del table
        give_back()

    def drop(self) -> None:
        """Give its room back, once the tables made with it are written."""
        self.shared.destroy()

    def __getstate__(self):
        return self.shared

    def __setstate__(self, shared):
        self.shared = shared

    def has(self, h: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.shared.value, dtype=np.uint8)
        bit = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
        return (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def give_back() -> None:
    """Return what is free to the system: workers, and the driver, live on, and both allocators keep what is freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if platform.libc_ver()[0] == "glibc":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving its memory back at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def each_text(run: Callable[[list[str]], pd.DataFrame], kind: str, text: str = "text", close: Callable[[], None] = lambda: None) -> Column:
    """A struct column made from the text column alone (null: empty), some hundred texts at a time.

    Only the texts cross to Python; all other columns stay in the JVM as they are, whatever their types.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch.to_numpy()
            for lo in range(0, len(own), AT_ONCE):
                yield run(own[lo : lo + AT_ONCE].tolist())
        close()

    return F.pandas_udf(tidy(texts), kind)(F.coalesce(F.col(text), F.lit("")))
