"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts the UTF-8 text where its top bits are zero, so equal passages fall
into equal chunks in whatever document they stand.  Each distinct chunk of a task is encoded once.
What a chunk alone cannot decide are its ends: a cut may split a word.  A chunk therefore keeps ids
only for its body, between its first and last *settled* positions (a visible ASCII byte followed by a
space or line feed: no pre-token can span it, whatever stands on either side).  The bytes between one
body and the next are re-encoded together; while the next chunk has no settled position the join
grows by that whole chunk, so both edges always agree exactly with the plain encoding.

Bodies and joins go through a byte-pair merge by rank over the same vocabulary.  Text outside the
alphabet on which the two pre-token patterns are known to agree goes through the tokenizers library
itself.  A document that spells special tokens is cut at these, the longest at each place, and what stands
between them goes the same way.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text

WINDOW = 16
CHUNK_BITS = 9
MAX_CHUNK = 1 << 14
TABLE_BYTES = 48 << 20
# The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ſ]")
GEAR = np.random.default_rng(20_011).integers(0, 1 << 32, 256, dtype=np.uint32)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 stands for itself, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def cut_points(data: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Content-defined ends of chunks within one text, its own end included."""
    n = len(data)
    if n <= WINDOW:
        return np.array([n], dtype=np.int64)
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        grown = h.copy()
        grown[step:] += h[:-step] << np.uint32(step)
        h, step = grown, step * 2
    ends = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    ends = ends[ends >= WINDOW]
    edges = np.concatenate([[0], ends[ends < n], [n]])
    if (long := np.flatnonzero(np.diff(edges) > MAX_CHUNK)).size:
        more = [np.arange(edges[i] + MAX_CHUNK, edges[i + 1], MAX_CHUNK) for i in long]
        edges = np.unique(np.concatenate([edges, *more]))
    return edges[1:]


def settled(data: np.ndarray) -> np.ndarray:
    """Positions that begin a pre-token in any context: a visible ASCII byte before, a space or line feed at it."""
    before, at = data[:-1], data[1:]
    return np.flatnonzero((before > 0x20) & (before < 0x7F) & ((at == 0x20) | (at == 0x0A))) + 1


class ChunkCodec:
    """Encoder and decoder over one vocabulary file, with tables of the chunks and joins met so far."""

    def __init__(self, path: str, bits: int = CHUNK_BITS):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bits = bits
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that take blanks or words with them can't be cut out alone")
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.bytes_of = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        pieces = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        merged = [spec["model"]["vocab"][a + b] for a, b in pieces]
        if any(b <= a for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("merge order and id order differ: the rank encoder would not agree with this vocabulary")
        self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.chunks: dict[bytes, tuple] = {}
        self.joins: dict[bytes, tuple] = {}
        self.held = 0
        self.reused = self.seen = 0

    def clear(self) -> None:
        self.chunks.clear()
        self.joins.clear()
        self.held = 0

    def encode_text(self, text: str) -> list[int]:
        if UNUSUAL.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def piece(self, raw: bytes) -> tuple[str, int, bytes]:
        """(ids in decimal, how many, the bytes they decode to) of text between two settled positions."""
        ids = self.encode_text(raw.decode("utf-8"))
        return str(ids)[1:-1].replace(" ", ""), len(ids), b"".join([self.bytes_of[i] for i in ids])

    def chunk(self, raw: bytes, data: np.ndarray) -> tuple:
        """(head, body, tail): body None where the chunk holds no two settled positions."""
        marks = settled(data)
        if len(marks) < 2:
            return raw, None, b""
        first, last = int(marks[0]), int(marks[-1])
        return raw[:first], self.piece(raw[first:last]), raw[last:]

    def join(self, raw: bytes) -> tuple:
        found = self.joins.get(raw)
        if found is None:
            found = self.joins[raw] = self.piece(raw)
            self.held += 3 * len(raw) + 200
        return found

    def encode(self, text: str) -> tuple[str, int, str]:
        """(decimal ids joined by commas, their number, the text they decode to)."""
        if self.held > TABLE_BYTES:
            self.clear()
        parts, at = [], 0
        for mark in self.marks.finditer(text):
            parts += self.parts(text[at : mark.start()])
            parts.append((str(self.special[mark[0]]), 1, mark[0].encode("utf-8")))
            at = mark.end()
        parts += self.parts(text[at:])
        return ",".join([p[0] for p in parts]), sum(p[1] for p in parts), b"".join([p[2] for p in parts]).decode("utf-8", "replace")

    def parts(self, text: str) -> list[tuple[str, int, bytes]]:
        """The pieces of a text without special tokens."""
        raw = text.encode("utf-8")
        data = np.frombuffer(raw, dtype=np.uint8)
        parts, pending, start = [], b"", 0
        for end in cut_points(data, self.bits).tolist():
            key = raw[start:end]
            found = self.chunks.get(key)
            self.seen += 1
            if found is None:
                found = self.chunks[key] = self.chunk(key, data[start:end])
                self.held += 4 * len(key) + 300
            else:
                self.reused += 1
            head, body, tail = found
            pending += head
            if body is not None:
                if pending:
                    parts.append(self.join(pending))
                parts.append(body)
                pending = tail
            start = end
        if pending:
            parts.append(self.join(pending))
        return [p for p in parts if p[1]]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, bits: int = CHUNK_BITS) -> ChunkCodec:
    return ChunkCodec(path, bits)


def encode_documents(docs: DataFrame, path: str, text: str = "text", bits: int = CHUNK_BITS, keep_ids: bool = True) -> DataFrame:
    """docs' columns and n_tokens, ids (array<int>, if keep_ids), ids_sha256, decoded_sha256.

    path names a byte-level BPE vocabulary in the tokenizers library's JSON format.  A null text is
    the empty text: no ids, digests of the empty string.  Columns of docs named like a result give way
    to it.  No shuffle; a task holds one Arrow batch and a chunk table of at most about 50 MB.
    """
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    base = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")

    def run(texts: list[str]) -> pd.DataFrame:
        own = codec(path, bits)
        rows = [own.encode(t) for t in texts]
        out = pd.DataFrame({
            "n_tokens": np.array([r[1] for r in rows], dtype=np.int64),
            "ids_sha256": [hashlib.sha256(r[0].encode()).hexdigest() for r in rows],
            "decoded_sha256": [hashlib.sha256(r[2].encode("utf-8")).hexdigest() for r in rows],
        })
        if keep_ids:
            out["ids"] = [np.array(r[0].split(","), dtype=np.int32) if r[0] else np.zeros(0, np.int32) for r in rows]
        return out

    made = base.withColumn("__lf_bpe", each_text(run, kind, text, close=codec.cache_clear))  # a worker lives on after the task
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    return made.select(*[F.col(f"`{c}`") for c in base.columns], *[F.col(f"__lf_bpe.{n}").alias(n) for n in names])


def digests(docs: DataFrame, path: str, bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_documents(docs.select("doc_id", "text"), path, bits=bits, keep_ids=False).drop("text")
