"""Resampling documents towards a target distribution, with features hashed by an algebra of CRCs.

The CRC-32 of two strings joined is crc(a) shifted by len(b) zero bytes, xor crc(b), and the shift is a linear
map over GF(2).  So each word's CRC is computed once, and the CRC of a run of words follows from those of its
words: no run is ever put together as a string.  Shifts by 2^k bytes are tables of 4 x 256 words.

A feature's bucket is its CRC modulo BUCKETS.  Counts of buckets over all documents and over all target texts
give each bucket a gain; the sum of a document's gains, with Gumbel noise from a hash of its id, ranks it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT_ONCE, discard, materialise, tidy, width

BUCKETS, RUNS, PER_CENT, LEAST_WORDS, SALT = 10000, 1, 10, 20, "2024"
KNOWN_WORDS, PIECE = 1 << 18, 4 << 20
POLYNOMIAL = 0xEDB88320
#: Words are of ASCII letters and digits and all bytes of other characters; A-Z counts as a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=64)
def shift_table(k: int) -> np.ndarray:
    """4 x 256 table of the map that appends 2^k zero bytes to a CRC, one row for each byte of it."""
    if k:
        half = shift_table(k - 1)
        return apply_shift(half, half)
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        columns = np.where(columns & 1, (columns >> 1) ^ np.uint32(POLYNOMIAL), columns >> 1).astype(np.uint32)
    table = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * byte + bit]
    return table


def apply_shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def combine(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of a + b from those of a and b and the lengths of b in bytes."""
    out, k = first.copy(), 0
    while (left := length >> k).any():
        odd = left & 1 == 1
        out[odd] = apply_shift(shift_table(k), out[odd])
        k += 1
    return out ^ second


class Words:
    """CRC and length of every word of a text; each word's CRC is computed when it is first met."""

    def __init__(self):
        self.of: dict[bytes, int] = {}
        self.crc, self.length = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def _piece(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        new = list(set(words).difference(self.of))
        if new:
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), dtype=np.uint32, count=len(new))])
            self.length = np.concatenate([self.length, np.fromiter(map(len, new), dtype=np.int64, count=len(new))])
        at = np.fromiter(map(self.of.__getitem__, words), dtype=np.int64, count=len(words))
        out = self.crc[at], self.length[at]
        if len(self.of) > KNOWN_WORDS:
            self.__init__()
        return out

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crc, length) of all words of the texts in order, and the number of words of each text.

        Texts are split in pieces of about PIECE bytes, so that a long text's words never stand in memory as strings all at once.
        """
        parts, waiting, counts, held = [], [], np.zeros(len(texts), dtype=np.int64), 0
        for k, text in enumerate(texts):
            clean, lo = text.translate(LETTERS), 0
            while lo < len(clean):
                hi = min(lo + PIECE, len(clean))
                if hi < len(clean):
                    cut = clean.find(b" ", hi)
                    hi = len(clean) if cut < 0 else cut
                own = clean[lo:hi].split()
                counts[k] += len(own)
                waiting += own
                held, lo = held + hi - lo, hi
                if held >= PIECE:
                    parts.append(self._piece(waiting))
                    waiting, held = [], 0
        parts.append(self._piece(waiting))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), counts


def run_crcs(crc: np.ndarray, length: np.ndarray, doc: np.ndarray, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(CRC, document) of every run of 1, 2, ... `runs` consecutive words of one document, joined by one space."""
    yield crc, doc
    now = crc
    if runs > 1:
        spaced = combine(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), crc, length)
    for k in range(1, runs):
        if len(crc) <= k:
            return
        now = combine(now[:-1], spaced[k:], length[k:] + 1)
        whole = doc[:-k] == doc[k:]
        yield now[whole], doc[k:][whole]


def bucket_counts(texts: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts by bucket; each task adds up its own, so at most `buckets` rows of each are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = Words(), np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            own = pdf["b"].to_numpy()
            for lo in range(0, len(own), AT_ONCE):
                crc, length, n = words.read(own[lo : lo + AT_ONCE].tolist())
                for c, _ in run_crcs(crc, length, np.repeat(np.arange(len(n)), n), runs):
                    total += np.bincount(c % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": hit.astype(np.int32), "n": total[hit]})

    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("b"))
    return rows.mapInPandas(tidy(count), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; one number a bucket comes to the driver, whatever the corpus."""
    s, t = corpus.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = materialise(spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "buckets")
    total = both.agg(F.sum("s"), F.sum("t")).first()
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (F.lit(total[0]) + buckets) / ((F.col("s") + 1) * (F.lit(total[1]) + buckets))))
    out = [r[0] for r in both.orderBy("bucket").select(gain).collect()]
    discard(both)
    return out


def weights(gain: list[int], runs: int = RUNS) -> Column:
    """Struct of n_words, n_features and weight of the text column."""
    table, buckets = np.array(gain, dtype=np.int64), len(gain)

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            own = batch.to_numpy()
            for lo in range(0, len(own), AT_ONCE):
                crc, length, n = words.read(own[lo : lo + AT_ONCE].tolist())
                features, weight = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
                for c, doc in run_crcs(crc, length, np.repeat(np.arange(len(n)), n), runs):
                    ends = np.searchsorted(doc, np.arange(len(n) + 1))
                    features += np.diff(ends)
                    weight += np.diff(np.concatenate([[0], np.cumsum(table[c % np.uint32(buckets)])])[ends])
                yield pd.DataFrame({"n_words": n, "n_features": features, "weight": weight})

    return F.pandas_udf(tidy(weigh), "n_words bigint, n_features bigint, weight bigint")(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def ranked(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """rows with rank 1, 2, 3... in a total order, by range partitions: none holds more than its share, and only their sizes come to the driver."""
    parts = rows.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    parts = materialise(parts.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), label)
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "part bigint, before bigint")  # one row for each partition of the shuffle
    return parts.join(F.broadcast(table), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, salt: str = SALT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; the drawn ones, floor(per_cent * N / 100) of the N with least_words words, have a rank.

    docs needs doc_id and text, target needs text; other columns, whatever their names, are not read.  A null text has no words, a
    text without words weight 0.  A null doc_id hashes as the empty text and comes after all others among ties; rows that repeat a
    doc_id are documents of their own, those that tie in all columns in any order.  An empty target or corpus has counts of 0.
    """
    spark = docs.sparkSession
    gain = gains(spark, bucket_counts(docs, "text", runs, buckets), bucket_counts(target, "text", runs, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = docs.select("doc_id", weights(gain, runs).alias("e")).select("doc_id", "e.n_words", "e.n_features", "e.weight")
    scored = materialise(scored.withColumn("score", (F.col("weight") + noise).cast("bigint")), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * per_cent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    inside = ranked(able, order, "ranks").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    outside = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return inside.unionByName(outside).select("doc_id", "n_features", "weight", "score", "rank")
