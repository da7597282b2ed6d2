"""A bounded sample of labelled documents for fitting, brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_DOCUMENTS = 6000
FIT_BYTES = 64 << 20


def fold(doc_id: str, folds: int):
    """crc32 of the decimal doc_id, modulo folds; a null doc_id has remainder 0 of the empty text's crc32."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, limit: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most `limit` labelled documents outside the held-out fold, in the order of a hash of doc_id.

    The bounds are parameters of the fit alone: whole texts are taken until they exceed `most_bytes` in
    all (the first is always taken).  A doc_id labelled twice has the smaller label, and one with several
    texts the least of them; null labels, null ids and labels without a document don't count.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold("doc_id", folds) != held)
    chosen = chosen.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    sizes = sorted((r["h"], r["doc_id"], r["n"]) for r in rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("text").alias("n")).collect())
    total, last = 0, 0
    for k, (_, _, n) in enumerate(sizes):
        total += n
        if total > most_bytes and k:
            break
        last = k + 1
    if last < len(sizes):
        rows = rows.where(F.col("doc_id").isin([d for _, d, _ in sizes[:last]]))
    return [(r["text"], r["y"]) for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]
