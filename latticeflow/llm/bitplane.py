"""Token ids in plane-shuffled files.

Ids are cut into blocks of fixed size; a block is transposed into byte (or bit) planes, low plane
first, planes above the block's largest id left out, and each plane is compressed with zstandard.  A
file ends in a footer with the chunk index (offset, ids, plane lengths) and the document index.

Layout: b"LFPLANE1" | planes of block 0 | planes of block 1 | ... | footer (zstd of JSON) | footer length u32 | b"LFPLANE1"
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_bpe import byte_alphabet
from .common import documents, fresh_path, tidy, width

MAGIC = b"LFPLANE1"
BLOCK = 1 << 16
FILE_IDS = 1 << 20
TABLE_WORDS = 600_000
END_ID = 1
# Characters on which lowering, composing and splitting are known to agree with the library's.
UNUSUAL = re.compile("[^\\n\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]")
# The pre-token pattern of the word vocabulary, for lower-cased words of those characters.
PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9\\s]+")


def pack_block(ids: np.ndarray, planes: str = "byte", level: int = 1) -> list[bytes]:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
    if planes == "byte":
        table = ids.view(np.uint8).reshape(-1, 4)
        return [squeeze(np.ascontiguousarray(table[:, k]).tobytes()) for k in range((bits + 7) // 8)]
    return [squeeze(np.packbits((ids >> np.uint32(k)) & np.uint32(1)).tobytes()) for k in range(bits)]


def unpack_block(parts: list[bytes], n: int, planes: str = "byte") -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    if planes == "byte":
        table = np.zeros((n, 4), dtype=np.uint8)
        for k, part in enumerate(parts):
            table[:, k] = np.frombuffer(expand(part), dtype=np.uint8)
        return table.reshape(-1).view("<u4")
    ids = np.zeros(n, dtype="<u4")
    for k, part in enumerate(parts):
        ids |= np.unpackbits(np.frombuffer(expand(part), dtype=np.uint8), count=n).astype("<u4") << np.uint32(k)
    return ids


def write_file(ids: np.ndarray, doc_ids: list, lengths: list[int], planes: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    body, index, at = [MAGIC], [], len(MAGIC)
    for lo in range(0, len(ids), block):
        parts = pack_block(ids[lo : lo + block], planes, level)
        index.append([at, min(block, len(ids) - lo), [len(p) for p in parts]])
        body += parts
        at += sum(map(len, parts))
    foot = zstandard.ZstdCompressor(level=3).compress(json.dumps({"planes": planes, "block": block, "chunks": index, "doc_ids": doc_ids, "lengths": lengths}).encode())
    return b"".join([*body, foot, struct.pack("<I", len(foot)), MAGIC])


def read_footer(content: bytes) -> dict:
    if content[: len(MAGIC)] != MAGIC or content[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a plane file")
    (n,) = struct.unpack("<I", content[-len(MAGIC) - 4 : -len(MAGIC)])
    return json.loads(zstandard.ZstdDecompressor().decompress(content[-len(MAGIC) - 4 - n : -len(MAGIC) - 4], max_output_size=1 << 30))


def read_ids(content: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a file; only the blocks that hold them are expanded."""
    foot = read_footer(content)
    total = sum(c[1] for c in foot["chunks"])
    stop = total if stop is None else min(stop, total)
    out, block = [], foot["block"]
    for k in range(start // block, -(-stop // block)):
        at, n, sizes = foot["chunks"][k]
        edges = np.cumsum([at, *sizes]).tolist()
        ids = unpack_block([content[a:b] for a, b in zip(edges, edges[1:], strict=False)], n, foot["planes"])
        out.append(ids[max(0, start - k * block) : stop - k * block])
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.used = np.zeros(1 << 16, dtype=dtype), 0

    def extend(self, values: list) -> None:
        to = self.used + len(values)
        if to > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), dtype=self.data.dtype)])
        self.data[self.used : to] = values
        self.used = to


class WordEncoder:
    """The tokenizers library's ids word by word: white space always parts this vocabulary's pre-tokens.

    Texts of plain characters are lowered and split by the vocabulary's own pattern, and each distinct
    pre-token goes through the library's model once; words of any other text go through the whole
    library, each distinct one once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.mapped = {b: c for c, b in byte_alphabet().items()}
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.odd: dict[str, int] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.pool, self.ends = Grown(np.uint32), Grown(np.int64)
        self.count = 0

    def plain_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for token in (word,) if word.isalpha() else PRETOKEN.findall(word):
            ids = self.tokens.get(token)
            if ids is None:
                spelled = token if token.isascii() else "".join([self.mapped[b] for b in token.encode()])
                ids = self.tokens[token] = tuple([t.id for t in self.model.tokenize(spelled)])  # tuples of numbers leave the collector's lists
            out += ids
        return out

    def slots(self, text: str, fresh: list, ends: list) -> list[int]:
        """The numbers of the text's words; ids of new ones are appended to fresh, their ends to ends."""
        plain = not UNUSUAL.search(text) and "<|" not in text
        table = self.words if plain else self.odd
        words = (text.lower() if plain else text).replace("\n", " ").split(" ")
        found = list(map(table.get, words))
        missing = found.count(None)
        at = -1
        for _ in range(missing):
            at = found.index(None, at + 1)
            w = words[at]
            n = table.get(w)
            if n is None:
                fresh += self.plain_ids(w) if plain else self.tokenizer.encode(w, add_special_tokens=False).ids
                ends.append(self.pool.used + len(fresh))
                n = table[w] = self.count
                self.count += 1
            found[at] = n
        return found

    def encode(self, texts: list[str], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end id after each if given; number of ids of each)."""
        if self.count > TABLE_WORDS:
            self.reset()
        slots, counts, fresh, ends = [], [], [], []
        for text in texts:
            found = self.slots(text, fresh, ends)
            slots += found
            counts.append(len(found))
        if not counts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.pool.extend(fresh)
        self.ends.extend(ends)
        slot = np.array(slots, dtype=np.int64)
        stop = self.ends.data[slot]
        size = stop - np.where(slot > 0, self.ends.data[slot - 1], 0)
        done = np.cumsum(size)
        ids = self.pool.data[np.repeat(stop - done, size) + np.arange(int(done[-1]), dtype=np.int64)]
        last = np.cumsum(counts)
        done = np.concatenate([[0], done])[np.concatenate([[0], last])]
        lengths = np.diff(done)
        if end_id is not None:
            ids, lengths = np.insert(ids, done[1:], end_id), lengths + 1
        return ids, lengths


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_planes(docs: DataFrame, path: str, out: str, planes: str = "byte", block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """Write every document's ids, in ascending doc_id order, as plane files; returns the table of files.

    One row of the table at `out` is one file: part (range of doc_id), seq (file within it), first
    (ids of the part before it), n_ids, content.  Documents never straddle files.  A null text has the
    end id alone; a null doc_id sorts first; rows with equal doc_id stand in the order of their texts'
    hash.  Spark's own writer commits the files, so a retried task leaves nothing behind.
    """
    spark = docs.sparkSession
    rows = documents(docs, key=True).repartitionByRange(width(spark), "doc_id").sortWithinPartitions("doc_id", "__lf_rid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part, seq, first = word_encoder(path), TaskContext.get().partitionId(), 0, 0
        held, names, sizes, total = [], [], [], 0

        def flush():
            nonlocal seq, first, held, names, sizes, total
            content = write_file(np.concatenate(held), names, sizes, planes, block)
            row = pd.DataFrame({"part": [part], "seq": [seq], "first": [first], "n_ids": [total], "content": [content]})
            seq, first = seq + 1, first + total
            held, names, sizes, total = [], [], [], 0
            return row

        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                cut = pdf.iloc[lo : lo + 256]
                ids, lengths = own.encode(cut["text"].tolist(), end_id)
                held.append(ids)
                sizes += lengths.tolist()
                names += [None if d is None else int(d) for d in cut["doc_id"]]
                total += len(ids)
                if total >= FILE_IDS:
                    yield flush()
        if held:
            yield flush()

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # a whole number beside a null would lose its last digits
    rows.mapInPandas(tidy(run), "part int, seq int, first bigint, n_ids bigint, content binary").write.option("compression", "uncompressed").parquet(out)
    return spark.read.parquet(out)


def read_planes(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    The ids before a part come from one row for each part (as many as the write had range partitions).
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, at = {}, 0
    for p, n in sorted((r["part"], r["n"]) for r in parts):
        before[p], at = at, at + n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, first, content in zip(pdf["part"], pdf["first"], pdf["content"], strict=True):
                foot, ids = read_footer(content), read_ids(content)
                ends = np.cumsum(foot["lengths"])
                starts = ends - np.array(foot["lengths"], dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(foot["doc_ids"], dtype="Int64"),
                    "start": starts + first + before[part],
                    "n_tokens": np.array(foot["lengths"], dtype=np.int64),
                    "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64),
                })

    return files.select("part", "first", "content").mapInPandas(tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def plane_digests(docs: DataFrame, path: str, planes: str = "byte") -> DataFrame:
    """Write the plane files to the shared folder and read every document back from them."""
    return read_planes(write_planes(docs, path, fresh_path(docs.sparkSession, "planes"), planes=planes))
