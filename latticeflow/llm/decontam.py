"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be quoted with up to k = floor(rate * m) edits.  Cut into k + 1 pieces, at
least one piece must stand unedited, so an Aho-Corasick pass over every document for all pieces finds
each possible place.  The same argument holds for every group of neighbouring pieces (j pieces, j - 1
edits), so a hit is verified up the tree of halves: two pieces with one edit, four with three, and at
last the whole item with k, each with Myers' bit-parallel distance over a short window.

Items of fewer than LEAST characters must stand whole and unedited, from one blank or end of the text to
another: a piece of so short an item stands in too many texts by chance.

Texts and items are compared in lower case with everything but letters and digits made one blank.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

RATE = 0.1
LEAST = 24
BLOCK_CHARS = 4_000_000
OTHERS = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return OTHERS.sub(" ", text.lower()).strip()


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def search(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any part of text, the first end of such a part)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = peq.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


@dataclass
class Node:
    """Pieces [lo, hi) of an item: its characters [start, stop), with hi - lo - 1 edits allowed."""

    item: int
    start: int
    stop: int
    budget: int
    parent: int = -1
    text: str = ""
    peq: dict = field(default_factory=dict)
    whole: bool = False  # counts only between blanks or ends of the text


class ItemIndex:
    """All pieces of a block of items in one automaton, and the tree above each."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = LEAST):
        import ahocorasick

        self.items = [(i, t) for i, raw in items if (t := normalise(raw))]
        self.nodes: list[Node] = []
        pieces: dict[str, list[int]] = defaultdict(list)
        for n, (_, text) in enumerate(self.items):
            k = min(int(rate * len(text)), len(text) - 1) if len(text) >= least else 0
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            top = len(self.nodes)
            self._grow(n, text, cuts, 0, k + 1, -1, pieces)
            self.nodes[top].whole = len(text) < least
        self.automaton = ahocorasick.Automaton()
        for piece, leaves in pieces.items():
            self.automaton.add_word(piece, (len(piece), tuple(leaves)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def _grow(self, item: int, text: str, cuts: list[int], lo: int, hi: int, parent: int, pieces: dict) -> None:
        own = text[cuts[lo] : cuts[hi]]
        self.nodes.append(Node(item, cuts[lo], cuts[hi], hi - lo - 1, parent, own, masks(own) if hi - lo > 1 else {}))
        me = len(self.nodes) - 1
        if hi - lo == 1:
            pieces[own].append(me)
        else:
            mid = (lo + hi) // 2
            self._grow(item, text, cuts, lo, mid, me, pieces)
            self._grow(item, text, cuts, mid, hi, me, pieces)

    def find(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item that stands in the text.

        Places count in characters of the normalised text; the leftmost of the least distance is given.
        """
        text = normalise(raw)
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, leaves) in self.automaton.iter(text):
            at = end - size + 1
            for leaf in leaves:
                node = self.nodes[leaf]
                if node.whole and not (text[at - 1 : at] in ("", " ") and text[end + 1 : end + 2] in ("", " ")):
                    continue
                base = at - node.start
                up, passed = node.parent, True
                # Drift between the hit and the rest is at most the budget of what is compared.
                while up >= 0 and passed:
                    node = self.nodes[up]
                    root = node.parent < 0
                    key = (up, base)
                    if key in tried:
                        break
                    tried.add(key)
                    lo, hi = base + node.start - node.budget, base + node.stop + node.budget
                    window = text[max(0, lo) : max(0, hi)]
                    d, stop = search(node.peq, len(node.text), window)
                    passed = d <= node.budget
                    if passed and root:
                        self._keep(best, node, d, max(0, lo), stop, window)
                    up = node.parent
                else:
                    if node.parent < 0 and passed and not node.peq:  # an item of one piece: the hit is all
                        self._better(best, node.item, (0, at, end + 1))
        return sorted((self.items[n][0], d, a, b) for n, (d, a, b) in best.items())

    def _better(self, best: dict, item: int, found: tuple[int, int, int]) -> None:
        if item not in best or found < best[item]:
            best[item] = found

    def _keep(self, best: dict, node: Node, d: int, offset: int, stop: int, window: str) -> None:
        back = window[:stop][::-1]
        _, length = search(masks(node.text[::-1]), len(node.text), back)
        self._better(best, node.item, (d, offset + stop - length, offset + stop))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: one row for each document and item that stands in it.

    The items go to the tasks in blocks of at most about `block_chars` characters, one pass over the
    documents for each block, so nothing that is broadcast grows with the inputs.  Items of fewer than
    `least` characters after normalising match where they stand whole and unedited between blanks; null and
    empty items (after normalising) and null or empty texts match nothing.  Items that
    repeat under other ids each match; rows that repeat a document each have their rows.
    """
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # a whole number beside a null would lose its last digits
    out = None
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = ItemIndex(shared.value, rate, least)
            for pdf in batches:
                found = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if isinstance(t, str) for m in index.find(t)]
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                yield pd.DataFrame({
                    "doc_id": pd.array(columns[0], dtype="string"), "item_id": pd.array(columns[1], dtype="Int64"),
                    "distance": np.array(columns[2], np.int32), "start": np.array(columns[3], np.int64), "end": np.array(columns[4], np.int64),
                })

        part = rows.mapInPandas(tidy(run), "doc_id string, item_id bigint, distance int, start bigint, end bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_ids, n_items, least_distance of each document that holds an item."""
    return matches(docs, benchmark, rate).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.countDistinct("item_id").alias("n_items"), F.min("distance").alias("least_distance"))
