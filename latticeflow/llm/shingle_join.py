"""Jaccard self-join of word shingle sets by token-combination prefixes.

With similarity s, two sets that link share at least ceil(s * n) shingles for the n of either one, so
whatever fixed order all shingles have, the first n - ceil(s * n) + k of each set share at least k.

Shingles fall in two classes: frequent (many times within one task's documents somewhere) and rare, and
rare ones come first in the order.  Of its extended prefix a set indexes each rare shingle alone, and of
the frequent ones pairs.  A linking pair of sets either shares a rare one, or at least k frequent ones;
these are dealt over g = (k - 1) / 2 groups by hash, so two of them fall in one group, and only pairs
within a group need to be indexed.  g is a power of two that grows with n and at most doubles between
sets that can link (k allows for the larger), so the pairs of a set stay in proportion to n.

Equal sets are one class from the start.  Classes in one posting list are first compared with the list's
heads only.  What links, or shares much with one head, is a cluster: all its pairs are compared in
blocks, as products of 0-1 matrices, unless it is one component already.  Complete pairs of
classes are made for those lists alone whose members still differ in component and in cluster.  Every
comparison is on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, RID, discard, documents, materialise, spread_join, tidy
from .components import connected_components, forest

WORDS = 3
PER_CENT = 90
FREQUENT_IN_TASK = 3
FREQUENT = 24
FREQUENT_MOST = 1 << 17
HEADS = 3
COUNT_EVERY = 2_000_000
WORDS_HELD = 200_000
BROADCAST_KEYS = 1 << 20
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 8192
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S31, S27 = np.uint64(31), np.uint64(27)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S31)) * M2
    h = (h ^ (h >> S27)) * M3
    return h ^ (h >> S31)


class Shingler:
    """Sorted distinct shingle hashes of texts; a bounded table holds the hashes of words met."""

    def __init__(self, words: int = WORDS):
        self.words, self.held = words, {}

    def sets(self, text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.zeros(0, dtype=np.uint64)
        held = self.held
        if len(held) > WORDS_HELD:
            held.clear()
        for w in set(tokens).difference(held):
            held[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(held.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        k = min(self.words, len(h))
        m = len(h) - k + 1
        out = np.full(m, k, dtype=np.uint64)
        for j in range(k):
            out = mix(out * M1 + h[j : j + m])
        return np.unique(out)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set: equal sets are one vertex."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def groups_of(n: int, per_cent: int) -> int:
    spare = n * (100 - per_cent) // 100
    return 1 << max(0, (-(-spare // 16) - 1).bit_length()) if spare > 16 else 1


def keys_of(s: np.ndarray, frequent: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """(keys, place of each in the set's order, how many are single shingles, frequent ones in the prefix, k).

    A key of two shingles has the place of the later one.  Sets too small to link with any other but an
    equal one have no keys.
    """
    n = len(s)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), 0, 0, 0
    if n * 100 < per_cent * (n + 1):  # not even one shingle may differ
        return none
    g = groups_of(n, per_cent)
    k = 2 * g + 1
    size = min(n, n - -(-per_cent * n // 100) + k)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        rare, often = s[~common], s[common]
    else:
        rare, often = s, s[:0]
    rare = rare[:size]
    often = often[: size - len(rare)]
    single = np.arange(len(rare), dtype=np.int32)
    if len(often) < 2:
        return rare, single, len(rare), len(often), k
    part = (mix(often) & np.uint64(g - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, places = [rare], [single]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            i, j = np.triu_indices(b - a, 1)
            i, j = order[a + i], order[a + j]
            keys.append(mix(mix(often[i] * M1) + often[j]))
            places.append((len(rare) + j).astype(np.int32))
    return np.concatenate(keys), np.concatenate(places), len(rare), len(often), k


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The commonest FREQUENT_MOST of the shingles that stand in FREQUENT documents or more.

    Counted over all documents, but a stretch of COUNT_EVERY shingles tells only of those that it holds FREQUENT_IN_TASK times.
    Only the order of the prefix depends on this, never a result; the bound makes it fit to broadcast.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held, n = Shingler(words), [], 0

        def flush():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            big = c >= FREQUENT_IN_TASK
            return pd.DataFrame({"t": t[big].view(np.int64), "c": c[big]})

        for pdf in batches:
            for text in pdf["text"]:
                held.append(own.sets(text))
                n += len(held[-1])
                if n >= COUNT_EVERY:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    rows = docs.select("text").mapInPandas(tidy(run), "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "t").limit(FREQUENT_MOST).select("t").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def describe(docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """rid, doc_id, n, v, keys, places, singles, often, k of each document; of a task's equal sets only the first has keys."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    kind = docs.schema["doc_id"].dataType
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))  # a whole number beside a null would lose its last digits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, frequent, met = Shingler(words), shared.value, set()
        none = keys_of(np.zeros(0, np.uint64), frequent, per_cent)
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                cut = pdf.iloc[lo : lo + 1000]
                sets = [own.sets(t) for t in cut["text"]]
                ids, keys = [set_id(s) for s in sets], []
                for v, s in zip(ids, sets, strict=True):
                    keys.append(none if v in met else keys_of(s, frequent, per_cent))
                    met.add(v)
                yield pd.DataFrame({RID: cut[RID], "doc_id": cut["doc_id"], "n": [len(s) for s in sets], "v": ids, "keys": [k[0].view(np.int64) for k in keys], "places": [k[1] for k in keys], "singles": [k[2] for k in keys], "often": [k[3] for k in keys], "k": [k[4] for k in keys]})

    out = docs.mapInPandas(tidy(run), f"{RID} bigint, doc_id string, n bigint, v bigint, keys array<bigint>, places array<int>, singles int, often int, k int")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def meeting_entries(light: DataFrame) -> DataFrame:
    """A table (key, place, single, v, n, singles, often, k) of the keys under which several sets are indexed.

    Only the keys themselves are shuffled to be counted; entries are made for those that a bitmap of the
    repeated ones lets through, and checked exactly then.
    """
    keys = light.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    repeated = Bitmap(light.sparkSession, keys, "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(k) for k in pdf["keys"]]
            if not sum(sizes):
                continue
            at = np.repeat(np.arange(len(pdf)), sizes)
            key = np.concatenate(pdf["keys"].to_list()).astype(np.int64)
            place = np.concatenate(pdf["places"].to_list()).astype(np.int32)
            order = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = np.flatnonzero(repeated.has(key.view(np.uint64)))
            rows = pdf[["v", "n", "singles", "often", "k"]].iloc[at[keep]].reset_index(drop=True)
            yield rows.assign(key=key[keep], place=place[keep], single=(order[keep] < rows["singles"].to_numpy()).astype(np.int32))[["key", "place", "single", "v", "n", "singles", "often", "k"]]

    made = light.where("size(keys) > 0").select("v", "n", "keys", "places", "singles", "often", "k")
    entries = materialise(made.mapInPandas(tidy(run), "key bigint, place int, single int, v bigint, n bigint, singles int, often int, k int").distinct(), "entries")
    repeated.drop()
    return entries


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """v, shingles of the documents whose key (rid) is wanted; the keys are broadcast if they are few."""
    wanted = wanted.distinct()
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(words)
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                sets = [own.sets(t) for t in pdf["text"].iloc[lo : lo + 1000]]
                yield pd.DataFrame({"v": [set_id(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    return docs.join(wanted, RID, "left_semi").select("text").mapInPandas(tidy(run), "v bigint, shingles array<bigint>").dropDuplicates(["v"])


def sets_of(docs: DataFrame, light: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The sets of the pairs' members, each from one document that has it."""
    wanted = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    # Copies are combined in their own tasks before they meet: one set may belong to very many documents.
    one = light.groupBy("v").agg(F.min(RID).alias(RID)).join(wanted, "v", "left_semi")
    return materialise(whole_sets(docs, one.select(RID), words), "sets")


def verify(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialise(both.select("a", "b", common.alias("i"), F.size("sa").alias("x"), F.size("sb").alias("y")).where(f"100 * i >= {per_cent} * (x + y - i)").select("a", "b"), "links")


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set in left with each in right, by products of 0-1 matrices."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    vocabulary = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    cells = []
    for values, size in zip(flat, sizes, strict=True):
        at = np.minimum(np.searchsorted(vocabulary, values), max(len(vocabulary) - 1, 0))
        hit = vocabulary[at] == values if len(vocabulary) else np.zeros(len(values), bool)
        cells.append((np.repeat(np.arange(len(size)), size)[hit], at[hit]))
    for lo in range(0, len(vocabulary), COLUMNS):
        grids = []
        for (row, col), size in zip(cells, sizes, strict=True):
            here = (col >= lo) & (col < lo + COLUMNS)
            grid = np.zeros((len(size), min(COLUMNS, len(vocabulary) - lo)), dtype=np.float32)
            grid[row[here], col[here] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def link_clusters(members: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b), as forests, among members (v, cluster, comp) of those clusters that hold several components.

    A cluster is cut into blocks; each pair of blocks is a task, which tells of links but not of pairs.
    """
    rows = members.join(sets, "v")  # classes without a set were compared with no head and are alone
    size = rows.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.size("shingles")).alias("t"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2")
    size = size.select("cluster", F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("t") / BLOCK_SHINGLES)).cast("int").alias("of"))
    rows = rows.join(size, "cluster").withColumn("blk", F.pmod(F.xxhash64("v"), F.col("of")).cast("int"))
    tasks = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("cluster", "v", "blk", "shingles", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))

    def link(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        own = [pdf[pdf["blk"] == b] for b in (lo, hi)]
        if len(own[0]) and len(own[1]):
            v = [x["v"].to_numpy() for x in own]
            sets = [list(x["shingles"]) for x in own]
            n = [np.array([len(s) for s in x]) for x in sets]
            i = shared_sizes(*sets)
            a, b = np.nonzero(100 * i >= per_cent * (n[0][:, None] + n[1][None, :] - i))
            edges = forest(zip(v[0][a].tolist(), v[1][b].tolist(), strict=True))
        else:
            edges = []
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return tasks.groupBy("cluster", "lo", "hi").applyInPandas(link, "a bigint, b bigint")


def near_groups(source: DataFrame, words: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """__lf_rid, doc_id, n_shingles, component_id, comp of each document (component_id: smallest doc_id reachable).

    Words are what stands between ASCII white space, A-Z in lower case; a shorter text is one shingle; a
    text without words (null and empty ones too) has no shingle and is alone.  Documents with a null
    doc_id take part; a component whose ids are all null has a null component_id.  Rows equal in doc_id
    and text are one document with one result each; rows that share a doc_id but not a text are
    documents of their own.  comp tells components apart that share a component_id; a text without words has none.
    """
    docs = documents(source, key=True)
    described = materialise(describe(docs, words, per_cent), "prefixes")
    entries = meeting_entries(described)
    light = materialise(described.select(RID, "doc_id", "n", "v"), "members")
    discard(described)
    # The head has the fewest shingles of its own: it is the likeliest to link with the others.
    lists = entries.groupBy("key").agg(F.min(F.struct("singles", "n", "v", "place")).alias("head"), F.min("v").alias("v1"), F.max("v").alias("v2")).where("v1 != v2").select("key", "head")
    live = materialise(entries.join(lists, "key"), "postings")  # entries that meet another one
    discard(entries)
    overlap = f"(({per_cent} * (n + n2) + {99 + per_cent}) div {100 + per_cent})"  # ceil of s / (1 + s) * (n + n2)
    fits = f"least(n, n2) * 100 >= {per_cent} * greatest(n, n2) and place < n - {overlap} + greatest(k, k2) and place2 < n2 - {overlap} + greatest(k, k2)"
    starred = live.select("v", "n", "place", "k", F.col("k").alias("k2"), F.col("head.v").alias("v2"), F.col("head.n").alias("n2"), F.col("head.place").alias("place2"), "often")
    starred = starred.where("v != v2").where(fits).groupBy("v", "v2").agg(F.count("*").alias("c"), F.max("often").alias("often"))
    # The HEADS that a class shares most with are enough here: what this leaves out is tried below.
    best = F.slice(F.sort_array(F.collect_list(F.struct("c", "v2")), asc=False), 1, HEADS)
    tried = starred.where("c >= 3 or often > 0").groupBy("v").agg(best.alias("best")).select("v", F.explode("best").alias("e"))
    tried = materialise(tried.select(F.col("e.v2").alias("a"), F.col("v").alias("b")), "pairs")
    sets = sets_of(docs, light, tried, words)
    links = verify(tried, sets, per_cent)
    comps = connected_components(links)
    # Classes that link, or share much with one head, are a cluster: every pair in it is tried.
    hub = starred.where("c >= 3 or often > 0").groupBy("v").agg(F.max_by("v2", F.struct("c", "v2")).alias("hub"), F.max("c").alias("c")).where("c >= 3")
    near = connected_components(links.unionByName(hub.select(F.col("v").alias("a"), F.col("hub").alias("b"))))
    place = live.select("v").distinct().join(comps, "v", "left").join(near.withColumnRenamed("comp", "cluster"), "v", "left")
    place = materialise(place.select("v", F.coalesce("comp", "v").alias("comp"), F.coalesce("cluster", "v").alias("cluster")), "clusters")
    links = links.unionByName(materialise(link_clusters(place, sets, per_cent), "links"))
    discard(tried, sets)
    comps = connected_components(links)
    # What is left: pairs of different clusters and components, complete, by the prefix shingles they share.
    named = live.drop("head", "singles").join(place.select("v", "cluster"), "v").join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("cluster").alias("k1"), F.max("cluster").alias("k2")).where("c1 != c2 and k1 != k2").select("key")
    rest = materialise(named.join(mixed, "key", "left_semi"), "mixed")
    discard(live)
    other = rest.select("key", *[F.col(c).alias(f"{c}2") for c in ("v", "n", "place", "k", "often", "comp", "cluster")])
    pairs = rest.join(other, "key").where("v < v2 and comp != comp2 and cluster != cluster2").where(fits)
    pairs = pairs.groupBy("v", "v2").agg(F.sum("single").alias("c"), F.min(F.least("often", "often2")).alias("o"), F.min(F.least("k", "k2")).alias("k")).where("c + o >= k")
    pairs = materialise(pairs.select(F.col("v").alias("a"), F.col("v2").alias("b")), "pairs")
    sets = sets_of(docs, light, pairs, words)
    more = verify(pairs, sets, per_cent)
    discard(rest, pairs, sets)
    if not more.isEmpty():
        comps = connected_components(links.unionByName(more))
    found = spread_join(light.where("n > 0").select(RID, "doc_id", "n", "v"), comps, "v").withColumn("comp", F.coalesce("comp", "v"))
    least = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")).where("m > 1").drop("m")
    out = spread_join(found, least, "comp").select(RID, "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "comp")
    alone = light.where("n = 0").select(RID, "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("comp"))
    return out.unionByName(alone)
