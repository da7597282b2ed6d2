"""Operator 12 against plain strings and zlib."""

import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeflow.llm import crc_resampling as cr

TEXT = st.lists(st.sampled_from(["the", "The", "é", "ÀB", "a1", "日本", "x" * 40, "9", "İ", "ſ"]), max_size=12).map(" ,".join)


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_features(text, runs):
    w = plain_words(text)
    return [" ".join(w[i : i + k]).encode() for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, runs=1, buckets=10000, per_cent=10, least=20):
    s, t = ([0] * buckets for _ in range(2))
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for f in plain_features(text, runs):
                counts[zlib.crc32(f) % buckets] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = plain_features(text, runs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: per_cent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_combined_crcs(a, b):
    got = cr.combine(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([zlib.crc32(b)], dtype=np.uint32), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


def test_shifts_of_great_length():
    n = (1 << 21) + 12345
    got = cr.combine(np.array([zlib.crc32(b"head")], dtype=np.uint32), np.array([zlib.crc32(bytes(n))], dtype=np.uint32), np.array([n]))
    assert got[0] == zlib.crc32(b"head" + bytes(n))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_runs_without_their_strings(texts, runs):
    crc, length, n = cr.Words().read([t.encode() for t in texts])
    doc = np.repeat(np.arange(len(n)), n)
    got = sorted((int(d), int(c)) for cs, ds in cr.run_crcs(crc, length, doc, runs) for c, d in zip(cs, ds, strict=True))
    assert got == sorted((k, zlib.crc32(f)) for k, t in enumerate(texts) for f in plain_features(t, runs))


def test_pieces_and_forgotten_words(monkeypatch):
    text = " ".join(f"w{i % 97} Ü{i}" for i in range(3000)).encode()
    whole = cr.Words().read([b"", text, b"end"])
    monkeypatch.setattr(cr, "PIECE", 100)
    monkeypatch.setattr(cr, "KNOWN_WORDS", 50)
    parts = cr.Words().read([b"", text, b"end"])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and parts[2].tolist() == [0, 6000, 1]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id bigint, text string, score string, `a.b` bigint")


def test_resampling_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "Ünï"]
    rows = [(int(i), " ".join(rng.choice(words, size=rng.integers(0, 60)))) for i in range(80)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (200, None), (201, ""), (202, "W1-w2;" * 40), (1 << 60, "w3 " * 5000)]
    target = [(1, "w1 w2 w3 w1 w2"), (2, None), (3, "w4 É")]
    for runs, buckets in ((1, 10000), (3, 64)):
        got = cr.resample(docs_of(spark, rows), docs_of(spark, target), runs=runs, buckets=buckets, per_cent=25).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows, target, runs, buckets, 25)


def test_empty_tables(spark):
    assert cr.resample(docs_of(spark, []), docs_of(spark, [])).count() == 0
    got = cr.resample(docs_of(spark, [(1, "a " * 30)]), docs_of(spark, [])).collect()
    assert [tuple(r) for r in got] == plain([(1, "a " * 30)], [])
