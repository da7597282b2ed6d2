"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

1. Every string of LENGTH bytes has one anchor: the leftmost GRAM bytes in it with the least hash.  Strings
   that are equal have equal anchors at equal offsets, so only strings with one anchor need to meet.
   Runs of neighbouring strings with the same anchor place are one region of text.
2. Anchors that stand once anywhere are dropped.  Regions with equal text are settled at once: all but
   the earliest are repeats as a whole.  Regions of an anchor that has very many of them are dealt anew by
   longer and longer context, so that no task gets more than HOT_REGIONS about one.
3. What is left are different regions about one anchor.  A task takes whole anchors, deals their regions over
   shards, sorts each shard's rotations and keeps its transform.  The transforms are merged by
   refining an interleave: it starts as the shards one after another, and each pass sorts it stably by
   the symbols before each entry, so that after h symbols it is right for prefixes of h.  Where two
   neighbours first differ is carried along as a mark, so after LENGTH symbols the unmarked neighbours
   share LENGTH bytes: these intervals are the repeated strings.  Nothing is sorted again.

A symbol of the merge is a dense code of 4, 2 or 1 bytes, the most whose codes fit 16 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, NULL_ID, RID, discard, documents, materialise, quoted, row_key, tidy, width

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
HALF = (LENGTH - GRAM) // 2
SHARDS = 4
BATCH = 1 << 16
PACK = 1 << 17
HOT_REGIONS = 4096
MIX32 = np.random.default_rng(32_003).integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)
K64 = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
S29, S32 = np.uint64(29), np.uint64(32)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * K64[3]
    h = (h ^ (h >> S29)) * K64[3]
    return h ^ (h >> S32)


def regions(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first string, last string) of each run of strings with one anchor.

    data holds texts one after another, ends their ends; no string crosses one.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none
    h, w, c = MIX32[data], 1, np.uint32(0x9E3779B1)
    while w < GRAM:
        h = h[:-w] * c + h[w:]
        w, c = 2 * w, np.uint32(int(c) * int(c) & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    low, at, w = h, np.arange(len(h), dtype=np.int32), 1
    while w < SPAN:
        step = min(w, SPAN - w)
        better = low[step:] < low[:-step]
        at = np.where(better, at[step:], at[:-step])
        low = np.minimum(low[:-step], low[step:])
        w += step
    first = np.concatenate([[0], ends[:-1]])
    size = np.maximum(ends - first - LENGTH + 1, 0)  # strings of each text
    live = np.flatnonzero(size)
    if not len(live):
        return none
    step = np.ones(int(size[live].sum()), dtype=np.int64)
    cut = np.cumsum(size[live])[:-1]
    step[0] = first[live[0]]
    step[cut] = first[live[1:]] - (first[live[:-1]] + size[live[:-1]] - 1)
    starts = np.cumsum(step)
    at = at[starts]
    change = at[1:] != at[:-1]
    change[cut - 1] = True
    edge = np.flatnonzero(change)
    s0, s1 = starts[np.concatenate([[0], edge + 1])], starts[np.concatenate([edge, [len(starts) - 1]])]
    place = at[np.concatenate([[0], edge + 1])].astype(np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)[place]).view(np.uint64)
    g = mix64(grams[:, 0] * K64[0] + grams[:, 1])
    g = mix64(g * K64[1] + grams[:, 2])
    return mix64(g * K64[2] + grams[:, 3]), place, s0, s1


def packs(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, bytes, np.ndarray]]:
    """Rows of pdf whose texts make about PACK bytes, those bytes, and the texts' ends in them."""
    lo, held, size = 0, [], 0
    texts = pdf["text"].tolist()
    for k, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= PACK or k + 1 == len(texts):
            yield pdf.iloc[lo : k + 1], b"".join(held), np.cumsum([len(x) for x in held])
            lo, held, size = k + 1, [], 0


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """h of the anchors that stand at two places or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"h": h.view(np.int64), "c": np.minimum(c, 2).astype(np.int8)})

        for pdf in batches:
            for _, raw, ends in packs(pdf):
                held.append(regions(np.frombuffer(raw, np.uint8), ends)[0])
                n += len(held[-1])
                if n >= 1 << 21:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInPandas(tidy(run), "h bigint, c tinyint").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h")


def place_key(rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix64(rid.view(np.uint64) * K64[0] + start.astype(np.uint64))


def fingerprints(docs: DataFrame, known: Bitmap) -> DataFrame:
    """Rows (h, th, doc_id, rid, start, n): a region's anchor, hash of its text, place and number of strings.

    Of a task's regions with equal text only the earliest has an h; the others are repeats already.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        lost: list[tuple[int, int, int, int]] = []

        def table(rows: list, keys: list | None) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", RID, "start", "n"])
            out["h"] = pd.array([k[0] for k in keys] if keys else [None] * len(rows), dtype="Int64")
            out["th"] = pd.array([k[1] for k in keys] if keys else [None] * len(rows), dtype="Int64")
            return out[["h", "th", "doc_id", RID, "start", "n"]]

        for pdf in batches:
            for cut, raw, ends in packs(pdf):
                h, _, s0, s1 = regions(np.frombuffer(raw, np.uint8), ends)
                keep = known.has(h)
                h, s0, s1 = h[keep].view(np.int64), s0[keep], s1[keep]
                k = np.searchsorted(ends, s0, side="right")
                begin = np.concatenate([[0], ends[:-1]])[k]
                ids, keys = cut["doc_id"].to_numpy()[k], cut[RID].to_numpy()[k]
                digest = xxhash.xxh3_64_intdigest
                for hh, a, b, d, r, o in zip(h.tolist(), s0.tolist(), s1.tolist(), ids.tolist(), keys.tolist(), (s0 - begin).tolist(), strict=True):
                    key = (hh, digest(raw[a : b + LENGTH]) - (1 << 63))
                    row = (d, r, o, b - a + 1)
                    old = best.get(key)
                    if old is None:
                        best[key] = row
                    elif row < old:
                        best[key] = row
                        lost.append(old)
                    else:
                        lost.append(row)
            if lost:
                yield table(lost, None)
                lost = []
            if len(best) > 200_000:
                yield table(list(best.values()), list(best))
                best = {}
        yield table(list(best.values()), list(best))

    return docs.mapInPandas(tidy(run), f"h bigint, th bigint, doc_id bigint, {RID} bigint, start int, n int")


def texts_of(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """Rows (h, region, at, doc_id, rid, start) of the wanted places (and, rarely, of others); at: the anchor's place in the region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cut, raw, ends in packs(pdf):
                h, place, s0, s1 = regions(np.frombuffer(raw, np.uint8), ends)
                k = np.searchsorted(ends, s0, side="right")
                start = s0 - np.concatenate([[0], ends[:-1]])[k]
                rid = cut[RID].to_numpy()[k]
                keep = np.flatnonzero(wanted.has(place_key(rid, start)))
                if len(keep):
                    yield pd.DataFrame({"h": h[keep].view(np.int64), "region": [raw[s0[i] : s1[i] + LENGTH] for i in keep], "at": (place - s0)[keep].astype(np.int32), "doc_id": cut["doc_id"].to_numpy()[k[keep]], RID: rid[keep], "start": start[keep].astype(np.int32)})

    return docs.mapInPandas(tidy(run), f"h bigint, region binary, at int, doc_id bigint, {RID} bigint, start int")


DEALT = f"h bigint, region binary, at int, lo int, hi int, doc_id bigint, {RID} bigint, start int"


def dealt_anew(rows: DataFrame) -> DataFrame:
    """Regions of hot anchors under keys of longer context.

    The strings of a row have their anchor at an offset of lo to hi, so equal ones agree from lo bytes before
    the anchor on, to LENGTH - hi after its begin.  Each half of that range makes a region of its own, with a
    key of the longer context that its strings must share.  Of a task's equal regions under one key only the
    earliest keeps its text; the others are repeats as a whole (at holds their number of strings).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, tuple] = {}
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            lost = []
            for h, region, at, lo, hi, d, r, s in zip(*[pdf[c].tolist() for c in ("h", "region", "at", "lo", "hi", "doc_id", RID, "start")], strict=True):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    first, last = max(0, at - b), min(len(region) - LENGTH, at - a)
                    if a > b or first > last:
                        continue
                    key = digest(b"%d %d %d " % (h, a, b) + region[at - a : at + LENGTH - b]) - (1 << 63)
                    which, row = (key, bytes(region[first : last + LENGTH])), (d, r, s + first, at - first, a, b)
                    old = best.setdefault(which, row)
                    if old is not row:
                        best[which] = min(old, row)
                        d2, r2, s2, *_ = max(old, row)
                        lost.append((0, None, last - first + 1, 0, 0, d2, r2, s2))
            if lost:
                yield frame(lost)
            if len(best) > 100_000:
                yield frame([(k, t, at, a, b, d, r, s) for (k, t), (d, r, s, at, a, b) in best.items()])
                best = {}
        yield frame([(k, t, at, a, b, d, r, s) for (k, t), (d, r, s, at, a, b) in best.items()])

    def frame(found: list[tuple]) -> pd.DataFrame:
        names = ["h", "region", "at", "lo", "hi", "doc_id", RID, "start"]
        return pd.DataFrame(found, columns=names).astype({n: "int64" if n in ("h", "doc_id", RID) else "int32" for n in names if n != "region"})

    return rows.mapInPandas(tidy(run), DEALT)


class Rotations:
    """Texts, each closed by a sentinel and read in a circle, with dense codes for their symbols."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        raw = np.frombuffer(b"".join([t + b"\0" for t in texts]), dtype=np.uint8).astype(np.int64) + 1
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        raw[self.end - 1] = 0
        self.n = len(raw)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.first, self.size = self.begin[self.text], sizes[self.text]
        self.place = np.arange(self.n) - self.first
        one = self.dense(raw, 257)
        self.wide, self.code, self.mark = 1, one, raw == 0
        for _ in range(2):  # codes of 2 and then 4 symbols, while they fit 16 bits
            top = int(self.code.max()) + 1
            if top * top > 1 << 26:
                break
            after = self.turn(self.wide)
            pair = self.dense(self.code * top + self.code[after], top * top)
            if pair.max() > 65535:
                break
            self.mark = self.mark | self.mark[after]
            self.code, self.wide = pair, 2 * self.wide

    @staticmethod
    def dense(values: np.ndarray, top: int) -> np.ndarray:
        seen = np.zeros(top, dtype=bool)
        seen[values] = True
        used = np.flatnonzero(seen)
        code = np.zeros(top, dtype=np.int32)
        code[used] = np.arange(len(used))
        return code[values].astype(np.int64)

    def turn(self, by: int) -> np.ndarray:
        """For each place the place `by` symbols on, in its text's circle."""
        return self.first + (self.place + by) % self.size

    def order(self, lo: int, hi: int) -> np.ndarray:
        """Places [lo, hi), which hold whole texts, in the order of their rotations."""
        rank, depth, longest = self.code[lo:hi].copy(), self.wide, int(self.size[lo:hi].max())
        first, place, size = self.first[lo:hi] - lo, self.place[lo:hi], self.size[lo:hi]
        n = hi - lo
        while True:
            after = rank[first + (place + depth) % size]
            key = rank * (n + 65536) + after
            by = np.argsort(key, kind="stable")
            sorted_key = key[by]
            step = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[by] = step
            depth *= 2
            if step[-1] == n - 1 or depth >= longest:
                return by + lo


def merge(rot: Rotations, shards: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(places of all rotations, interleaved; where an entry shares no `depth` symbols with the one before it).

    shards: each shard's places in its own order.  Only the shards' order and their symbols go in: the
    interleave is refined rot.wide symbols at a time.
    """
    back = rot.turn(0)
    back = rot.first + (rot.place - rot.wide) % rot.size
    where = np.concatenate(shards)
    symbol = rot.code[back][where].astype(np.uint16)  # the transforms: the symbols before each entry
    apart = rot.mark[back][where]
    lengths = [len(s) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), lengths)
    new = np.zeros(rot.n, dtype=bool)
    new[0] = True
    entry = np.arange(rot.n)
    for _ in range(depth // rot.wide):
        c = symbol[entry]
        by = np.argsort(c, kind="stable")
        block = np.cumsum(new, dtype=np.int32)[by]
        c, split = c[by], apart[entry][by]
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        new |= split
        new[1:] |= split[:-1]
        z = z[by]
        entry = np.empty(rot.n, dtype=np.int64)
        entry[np.argsort(z, kind="stable")] = np.arange(rot.n)
    return where[entry], new


def repeats(texts: list[bytes], doc_id: np.ndarray, rid: np.ndarray, start: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(rid, place in the document) of each string of LENGTH bytes in texts that stands earlier in another of them."""
    rot = Rotations(texts)
    k = max(1, min(shards, len(texts)))
    cuts = [int(rot.begin[len(texts) * j // k]) for j in range(k)] + [rot.n]
    places, new = merge(rot, [rot.order(a, b) for a, b in zip(cuts, cuts[1:], strict=False)])
    block = np.cumsum(new)
    size = np.bincount(block)
    held = np.flatnonzero(size[block] > 1)
    places, block = places[held], block[held]
    t = rot.text[places]
    at = start[t] + rot.place[places]
    by = np.lexsort((at, rid[t], doc_id[t], block))
    later = np.concatenate([[False], block[by][1:] == block[by][:-1]]) if len(by) else np.zeros(0, bool)
    by = by[later]
    return rid[t[by]], at[by]


def spans(rid: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Runs of neighbouring strings as rows (rid, start, stop) of bytes."""
    if not len(rid):
        return pd.DataFrame({RID: np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "stop": np.zeros(0, np.int32)})
    by = np.lexsort((at, rid))
    rid, at = rid[by], at[by]
    edge = np.flatnonzero((rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1))
    a, b = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(at) - 1]])
    return pd.DataFrame({RID: rid[a], "start": at[a].astype(np.int32), "stop": (at[b] + LENGTH).astype(np.int32)})


def narrowed(group: list[tuple]) -> list[tuple]:
    """Regions of one anchor, cut to the strings that could be shared.

    A string holds HALF bytes more than the anchor on one side at least; where no other region has the
    same there, its strings that reach so far are no repeats.
    """
    if len(group) < 2:
        return []
    left, right = Counter(), Counter()
    for t, o, *_ in group:
        if o >= HALF:
            left[t[o - HALF : o + GRAM]] += 1
        if len(t) - o >= GRAM + HALF:
            right[t[o : o + GRAM + HALF]] += 1
    out = []
    for t, o, d, r, s in group:
        lo, hi = 0, len(t) - LENGTH
        if not (o >= HALF and left[t[o - HALF : o + GRAM]] > 1):
            lo = max(lo, o - HALF + 1)
        if not (len(t) - o >= GRAM + HALF and right[t[o : o + GRAM + HALF]] > 1):
            hi = min(hi, o - HALF)
        if lo <= hi:
            out.append((t[lo : hi + LENGTH], d, r, s + lo))
    return out


def merged_repeats(rows: DataFrame, parts: int) -> DataFrame:
    """(rid, start, stop) of repeated strings among regions (h, region, at, doc_id, rid, start), by anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last, group = [], 0, None, {}
        again: list[tuple[int, int, int]] = []

        def settle():
            t, d, r, s = zip(*held, strict=True)
            return spans(*repeats(list(t), np.array(d, np.int64), np.array(r, np.int64), np.array(s, np.int64)))

        def rows_of(group: dict) -> list[tuple]:
            return narrowed([(t, o, d, r, s) for t, (d, r, s, o) in group.items()])

        for pdf in batches:
            for h, t, o, d, r, s in zip(pdf["h"].tolist(), pdf["region"], pdf["at"].tolist(), pdf["doc_id"].tolist(), pdf[RID].tolist(), pdf["start"].tolist(), strict=True):
                if h != last:
                    more = rows_of(group)
                    held += more
                    size += sum(len(x[0]) for x in more)
                    if size >= BATCH:
                        yield settle()
                        held, size = [], 0
                    last, group = h, {}
                t, row = bytes(t), (d, r, s, o)
                old = group.setdefault(t, row)
                if old is not row:  # copies of one text: all but the earliest are repeats as a whole
                    group[t] = min(old, row)
                    _, r, s, _ = max(old, row)
                    again.append((r, s, s + len(t)))
            if again:
                yield pd.DataFrame(again, columns=[RID, "start", "stop"]).astype({RID: "int64", "start": "int32", "stop": "int32"})
                again = []
        held += rows_of(group)
        if held:
            yield settle()

    return rows.repartition(parts, "h").sortWithinPartitions("h").mapInPandas(tidy(run), f"{RID} bigint, start int, stop int")


def removal_spans(docs: DataFrame) -> DataFrame:
    """(rid, start, stop), overlapping and unordered: the bytes to remove from each document.

    docs has rid, doc_id (null: before all others) and text (no nulls).
    """
    spark = docs.sparkSession
    parts = width(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), RID, "text")
    known = Bitmap(spark, repeated_anchors(docs), "h")
    prints = materialise(fingerprints(docs, known), "prints")
    known.drop()
    done = prints.where("h is null").select(RID, "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("stop"))
    place = F.struct("doc_id", RID, "start")
    judged = prints.where("h is not null").repartition(parts, "h", "th").withColumn("kept", place == F.min(place).over(Window.partitionBy("h", "th")))
    judged = materialise(judged.select("h", RID, "start", "n", "kept"), "judged")
    done = materialise(done, "done")
    discard(prints)
    whole = judged.where("not kept").select(RID, "start", (F.col("start") + F.col("n") + LENGTH - 1).alias("stop"))
    # Anchors with several texts go by a bitmap and not by a join, so that a common anchor's regions stay dealt out.
    mixed = Bitmap(spark, judged.where("kept").groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "h")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf[mixed.has(pdf["h"].to_numpy().view(np.uint64))]
            yield pd.DataFrame({"k": place_key(own[RID].to_numpy(), own["start"].to_numpy()).view(np.int64)})

    wanted = Bitmap(spark, judged.where("kept").select("h", RID, "start").mapInPandas(tidy(keys), "k bigint"), "k")
    texts = materialise(texts_of(docs, wanted), "regions")
    wanted.drop()
    mixed.drop()
    ready, rows, spent = [], texts.withColumns({"lo": F.lit(0), "hi": F.lit(LENGTH - GRAM)}), [texts]
    while True:
        hot = rows.where("lo < hi").groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > HOT_REGIONS).select("h")
        if hot.isEmpty():
            ready.append(rows)
            break
        hot = materialise(hot, "hot")
        ready.append(rows.join(hot, "h", "left_anti").select(*rows.columns))
        dealt = materialise(dealt_anew(rows.join(hot, "h", "left_semi").select(*rows.columns)), "dealt")
        spent.append(hot)
        done = done.unionByName(dealt.where("region is null").select(RID, "start", (F.col("start") + F.col("at") + LENGTH - 1).alias("stop")))
        rows = dealt.where("region is not null")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    found = merged_repeats(every.drop("lo", "hi"), parts)
    found = materialise(found, "spans")
    discard(*spent)
    return done.unionByName(whole).unionByName(found)


def remaining(raw: bytes, found: list) -> tuple[bytes, int, int]:
    """(bytes that are left, bytes removed, maximal runs removed)."""
    kept, at, runs, removed, last = [], 0, 0, 0, -1
    for a, b in sorted(found):
        if a > last:
            runs += 1
        if a > at:
            kept.append(raw[at:a])
        removed += max(0, b - max(a, at))
        at, last = max(at, b), max(last, b)
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def span_lists(docs: DataFrame) -> DataFrame:
    """(rid, starts, stops) of the documents that lose bytes; a task tells of each document once, with its spans joined."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, int]]] = {}
        for pdf in batches:
            for r, a, b in zip(pdf[RID].tolist(), pdf["start"].tolist(), pdf["stop"].tolist(), strict=True):
                held.setdefault(r, []).append((a, b))
        rows = []
        for r, found in held.items():
            found.sort()
            a, b = found[0]
            for c, d in found[1:]:
                if c > b:
                    rows.append((r, a, b))
                    a, b = c, d
                else:
                    b = max(b, d)
            rows.append((r, a, b))
        yield pd.DataFrame(rows, columns=[RID, "start", "stop"]).astype({RID: "int64", "start": "int32", "stop": "int32"})

    lists = removal_spans(docs).mapInPandas(tidy(join), f"{RID} bigint, start int, stop int").groupBy(RID).agg(F.collect_list(F.struct("start", "stop")).alias("s"))
    return lists.select(RID, F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))


def cut_text(keep: str, valid: bool = False) -> Column:
    """(n_removed, n_spans, kept) by the spans beside the text column `keep`; only texts that lose bytes cross to Python.

    valid: kept is a string, without what is left of characters that were cut apart; else it is bytes.
    """

    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, stops in batches:
            made = []
            for t, a, b in zip(texts, starts, stops, strict=True):
                made.append((b"", 0, 0) if t is None else remaining(t.encode("utf-8", "surrogatepass"), list(zip(a.tolist(), b.tolist(), strict=True))))
            yield pd.DataFrame({"kept": [x[0].decode("utf-8", "ignore") if valid else x[0] for x in made], "n_removed": [x[1] for x in made], "n_spans": [x[2] for x in made]})

    some = F.col("__lf_starts").isNotNull()
    made = F.pandas_udf(tidy(cut), f"kept {'string' if valid else 'binary'}, n_removed bigint, n_spans bigint")(F.when(some, F.col(keep)), "__lf_starts", "__lf_stops")
    return F.when(some, made)


def with_spans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    lists = span_lists(docs).select(F.col(RID).alias("__lf_key"), F.col("starts").alias("__lf_starts"), F.col("stops").alias("__lf_stops"))
    return rows.join(lists, row_key() == F.col("__lf_key"), "left").drop("__lf_key")


def dedup(source: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) of each document.

    Null and empty texts, and texts shorter than LENGTH bytes, lose nothing.  Rows equal in doc_id and
    text are one document; rows that share a doc_id but not a text stand in the order of a hash of the
    text.  A null doc_id comes before all others.
    """
    made = with_spans(documents(source), documents(source, key=True)).withColumn("__lf_cut", cut_text("text"))
    zero, cut = F.lit(0).cast("bigint"), F.col("__lf_cut")
    return made.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.coalesce(cut["n_removed"], zero).alias("n_removed"), F.coalesce(cut["n_spans"], zero).alias("n_spans"),
        F.coalesce(cut["kept"], F.col("text").cast("binary")).alias("kept"),
    )


def dedup_rows(source: DataFrame) -> DataFrame:
    """source with each text without its repeated strings; a null text stays null, other columns stay as they are, whatever their names.

    A text must stay valid: what is left of a character cut apart goes too.
    """
    others = F.struct(*[quoted(c).alias(c) for c in source.columns if c != "text"])
    made = with_spans(source.select("doc_id", "text", others.alias("others")), documents(source, key=True)).withColumn("__lf_cut", cut_text("text", valid=True))
    text = F.coalesce(F.col("__lf_cut")["kept"], F.col("text"))
    return made.select(*[text.alias(c) if c == "text" else F.col("others").getField(c).alias(c) for c in source.columns])


def digests(source: DataFrame) -> DataFrame:
    return dedup(source).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
