"""A gated recurrent language model with a class-factored softmax, in numpy.

Words fall in three tiers.  The commonest CORE words have weights of their own, in classes of CLASS_SIZE
by rank; every other word belongs to one of SHAPES shapes (a hash of its last two bytes).  The network predicts
classes and shapes together, and the word within a class.  Within a shape a word's probability comes from
its count over all training documents, and one part in the Good-Turing share stands for unknown words, which
are one event, as in the base.  The end of a text is a core word.

Counts come from every training token.  The weights start from a bounded sample on the driver
(START_DOCUMENTS) and then every task trains on its training documents by truncated backpropagation: the
state goes on through the windows, and each of them is propagated back.  The tasks' weights are averaged by tokens.
Scoring runs many documents in step, longest first, and carries each one's state over all its windows.

Texts are split into words once: a table of blocks keeps the numbers of their words, and counting, training
and scoring read that.

Words beyond the HEAD commonest are looked up by a join, so nothing that is broadcast grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, documents, materialise, tidy
from .labelled import fold

FOLDS, HELD = 7, 2
CORE, CLASS_SIZE, SHAPES = 1024, 32, 32
HIDDEN = 24
HIGHEST = np.float32(60)  # a logit's ceiling: its exponential still fits single precision
ONES = np.ones(4096, np.float32)
HEAD = 1 << 17
WINDOW = 32
TOGETHER = 256
BLOCK_TOKENS = 1 << 19
SLAB_TOKENS = 1 << 22
COUNTED = 1_000_000
WORDS_HELD = 300_000
START_DOCUMENTS, START_BYTES, START_PASSES = 1200, 8 << 20, 3
START_RATE, RATE = 0.01, 0.002
SHAPE_OF = [xxhash.xxh32_intdigest(bytes(divmod(k, 256))) % SHAPES for k in range(1 << 16)]
END = -0x4C4F4F50  # stands for the end of a text among the word hashes
LN10 = np.log(10.0)


class Words:
    """Numbers of the words met, in a bounded table, and their hashes (the low bits are the shape)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.h, self.used = np.zeros(1 << 16, np.int64), 0

    def read(self, text: str) -> np.ndarray:
        """The number of each word: A-Z in lower case, between ASCII white space."""
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        number = self.number
        found, fresh, at = list(map(number.get, tokens)), [], -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            w = tokens[at]
            n = number.get(w)
            if n is None:
                n = number[w] = len(number)
                h = xxhash.xxh3_64_intdigest(w)
                fresh.append((h - h % SHAPES + SHAPE_OF[w[-1] | w[max(len(w) - 2, 0)] << 8]) - (1 << 63))
            found[at] = n
        if fresh:
            to = self.used + len(fresh)
            while to > len(self.h):
                self.h = np.concatenate([self.h, self.h])
            self.h[self.used : to] = fresh
            self.used = to
        return np.array(found, dtype=np.int32)


@dataclass
class Block:
    """Documents as runs of numbers: of token i the word's hash is words[at[i]]; sizes count each one's tokens, its end left out."""

    rid: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    at: np.ndarray

    KINDS = {"rid": np.int64, "held": np.bool_, "sizes": np.int64, "words": np.int64, "at": np.int32}

    @classmethod
    def of(cls, words: Words, numbers: list[np.ndarray], rid: list[int], held: list[bool]) -> Block:
        n = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        used = np.flatnonzero(np.bincount(n, minlength=1))
        used = used if len(n) else used[:0]
        local = np.zeros(words.used + 1, np.int32)
        local[used] = np.arange(len(used), dtype=np.int32)
        return cls(np.array(rid, np.int64), np.array(held, np.bool_), np.array([len(x) for x in numbers], np.int64), words.h[used], local[n])

    @classmethod
    def read(cls, row) -> Block:
        return cls(*[np.frombuffer(row[k], dtype=kind) for k, kind in cls.KINDS.items()])

    def row(self) -> dict:
        return {k: getattr(self, k).astype(kind).tobytes() for k, kind in self.KINDS.items()}

    @property
    def doc(self) -> np.ndarray:
        """The document of each token."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sequences(self, vocabulary: Vocabulary, slots: np.ndarray) -> list[np.ndarray]:
        """Network symbols of each document: core words by rank, others by shape, the end last."""
        core = vocabulary.core
        symbol = np.where((slots >= 0) & (slots < core), slots, core + shape_of(self.words))
        flat = np.insert(symbol.astype(np.int16)[self.at], np.cumsum(self.sizes), 0)  # the end is the first core word
        return np.split(flat, np.cumsum(self.sizes + 1)[:-1])


def read_blocks(docs: DataFrame) -> DataFrame:
    """docs (rid, doc_id, text, held_out) as a table of blocks: (doc_id array, rid, held, sizes, words, at)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        numbers, rids, ids, held, n = [], [], [], [], 0

        def flush():
            out = pd.DataFrame([{"doc_id": list(ids)} | Block.of(words, numbers, rids, held).row()])
            if len(words.number) > WORDS_HELD:
                words.clear()
            for x in (numbers, rids, ids, held):
                x.clear()
            return out

        for pdf in batches:
            for rid, doc, text, out in zip(pdf[RID].tolist(), pdf["doc_id"], pdf["text"], pdf["held_out"].tolist(), strict=True):
                numbers.append(words.read(text))
                rids.append(rid)
                ids.append(doc)
                held.append(out)
                n += len(numbers[-1]) + 1
                if n >= BLOCK_TOKENS:
                    yield flush()
                    n = 0
        if rids:
            yield flush()

    rows = docs.select(RID, F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out")  # a whole number beside a null would lose its last digits
    return materialise(rows.mapInPandas(tidy(run), "doc_id array<string>, rid binary, held binary, sizes binary, words binary, at binary"), "words")


def shape_of(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) % np.uint64(SHAPES)).astype(np.int64)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(h, c): tokens of the training documents, ends included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, ends = [], 0, 0

        def flush():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return pd.DataFrame({"h": h, "c": np.bincount(at, weights=np.concatenate([x for _, x in held])).astype(np.int64)})

        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block.read(row)
                c = np.bincount(b.at[~np.repeat(b.held, b.sizes)], minlength=len(b.words))
                ends += int((~b.held).sum())
                held.append((b.words[c > 0], c[c > 0]))
                n += len(held[-1][0])
                if n >= COUNTED:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        yield pd.DataFrame({"h": [END], "c": [ends]})

    return blocks.drop("doc_id").mapInPandas(tidy(run), "h bigint, c bigint").where("c > 0").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head words with their counts, and totals over the whole corpus."""

    def __init__(self, head: list[tuple[int, int]], total: int, distinct: int, shape_tokens: np.ndarray, shape_once: np.ndarray):
        self.h = np.array([h for h, _ in head], dtype=np.int64)
        self.c = np.array([c for _, c in head], dtype=np.int64)
        self.total, self.distinct = total, distinct
        self.core = min(CORE, len(head))
        # tokens of each shape outside the core, and the share of them that stands for unknown words
        core = np.zeros(SHAPES, dtype=np.int64)
        np.add.at(core, shape_of(self.h[: self.core][self.h[: self.core] != END]), self.c[: self.core][self.h[: self.core] != END])
        self.shape_tokens = np.maximum(shape_tokens - core, 0)
        self.unknown = np.clip((shape_once + 1) / (self.shape_tokens + 2), 1e-6, 0.5)
        self.by = np.argsort(self.h)
        self.sorted = self.h[self.by]

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The place of each word hash in the head, or -1."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.h) - 1)
        return np.where(self.sorted[at] == h, self.by[at], -1)

    def tail_log10(self, c: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """log10 probability, within its shape, of a word outside the core with count c (0: unknown)."""
        u = self.unknown[shape]
        return np.log10(np.where(c > 0, (1 - u) * c / np.maximum(self.shape_tokens[shape], 1), u))

    def base_log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.total + self.distinct + 1))


class Network:
    """Gated recurrent units; classes of core words and shapes share one softmax, words of a class another.

    xg and xc are the input weights of the gates and of the content, one row for each symbol, ug and uc the
    recurrent ones; a gate is 1 / (1 + exp(p)).  The last row of wc and of each class in ww is the bias.
    """

    NAMES = ("xg", "xc", "ug", "uc", "wc", "ww")

    def __init__(self, core: int, seed: int = 17):
        r = np.random.default_rng(seed)
        self.core, self.classes = core, -(-core // CLASS_SIZE)
        wide = self.classes + SHAPES
        normal = lambda *s, scale: (scale * r.standard_normal(s)).astype(np.float32)
        self.xg, self.xc = normal(core + SHAPES, 2 * HIDDEN, scale=0.1), normal(core + SHAPES, HIDDEN, scale=0.1)
        self.ug, self.uc = normal(HIDDEN, 2 * HIDDEN, scale=1 / np.sqrt(HIDDEN)), normal(HIDDEN, HIDDEN, scale=1 / np.sqrt(HIDDEN))
        self.wc, self.ww = normal(HIDDEN + 1, wide, scale=0.1), normal(self.classes, HIDDEN + 1, CLASS_SIZE, scale=0.1)
        self.wc[-1], self.ww[:, -1] = 0, 0
        past = np.arange(self.classes * CLASS_SIZE).reshape(self.classes, CLASS_SIZE) >= core
        self.ww[:, -1][past] = -1e4  # places past the last core word

    def start(self, counts: np.ndarray, shape_tokens: np.ndarray) -> None:
        """Biases at the corpus's own frequencies."""
        padded = np.zeros(self.classes * CLASS_SIZE)
        padded[: self.core] = counts[: self.core]
        by = padded.reshape(self.classes, CLASS_SIZE)
        first = np.log(np.concatenate([by.sum(1), shape_tokens]) + 1)
        self.wc[-1] = first - first.max()
        second = np.where(np.arange(padded.size).reshape(by.shape) < self.core, np.log(by + 1), -np.inf)
        second = second - second.max(1, keepdims=True)
        self.ww[:, -1] = np.where(np.isfinite(second), second, -1e4)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            a[...] = values[at : at + a.size].reshape(a.shape)
            at += a.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray, gate: np.ndarray, content: np.ndarray, inner: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The states after inputs x and states h, in out; both gates, the content and its recurrent part in the others."""
        np.take(self.xg, x, axis=0, out=gate, mode="clip")
        gate += h @ self.ug
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.take(self.xc, x, axis=0, out=content, mode="clip")
        np.matmul(h, self.uc, out=inner)
        content += np.multiply(gate[:, HIDDEN:], inner, out=out)
        np.tanh(content, out=content)
        np.subtract(h, content, out=out)
        out *= gate[:, :HIDDEN]
        out += content
        return out

    def run(self, x: np.ndarray, live: list[int], h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(states, gates, contents, their recurrent parts, states before, last states) of one window, step after step.

        x is (steps, rows); at step t the first live[t] rows count.
        """
        size, kind = sum(live), self.ug.dtype
        gate = np.empty((size, 2 * HIDDEN), kind)
        states, content, inner = (np.empty((size, HIDDEN), kind) for _ in range(3))
        before, at = [], 0
        with np.errstate(over="ignore"):  # a gate's exponential may be infinite: the gate is 0 then
            for t, m in enumerate(live):
                cut = slice(at, at + m)
                before.append(h[:m])
                new = self.step(x[t, :m], h[:m], gate[cut], content[cut], inner[cut], states[cut])
                h = new if m == len(h) else np.concatenate([new, h[m:]])
                at += m
        return states, gate, content, inner, before, h

    @staticmethod
    def with_one(states: np.ndarray) -> np.ndarray:
        out = np.empty((len(states), HIDDEN + 1), states.dtype)
        out[:, :HIDDEN], out[:, HIDDEN] = states, 1
        return out

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return np.where(y < self.core, y // CLASS_SIZE, self.classes + y - self.core)

    def log_prob(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of the targets y after the states h."""
        h, cls = self.with_one(h), self.class_of(y)
        logits = h @ self.wc
        np.minimum(logits, HIGHEST, out=logits)
        picked = logits[np.arange(len(y)), cls]
        out = picked - np.log(np.exp(logits, out=logits) @ ONES[: logits.shape[1]])
        by, edge = self.by_class(cls)
        w, k = self.word_logits(h[by], edge), y[by] % CLASS_SIZE
        p = w[np.arange(len(by)), k]
        out[by] += p - np.log(np.exp(w, out=w) @ ONES[:CLASS_SIZE])
        return out

    def by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(rows whose target is a core word, by class; the edges of the classes among them)."""
        by = np.argsort(cls.astype(np.int16), kind="stable")
        edge = np.searchsorted(cls[by], np.arange(self.classes + 1)).tolist()
        return by[: edge[-1]], edge

    def word_logits(self, h: np.ndarray, edge: list[int]) -> np.ndarray:
        """Logits within the class of each state (with its 1); the states are in order of class."""
        w = np.empty((len(h), CLASS_SIZE), h.dtype)
        for c in range(self.classes):
            a, b = edge[c], edge[c + 1]
            if b > a:
                np.matmul(h[a:b], self.ww[c], out=w[a:b])
        return np.minimum(w, HIGHEST, out=w)

    def gradients(self, x: np.ndarray, y: np.ndarray, live: list[int], h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float, int]:
        """(gradients of the summed log loss, last states, loss, tokens) of one window of run(), with targets y like x."""
        states, gate, content, inner, kept, h = self.run(x, live, h0)
        size, kind = len(states), states.dtype
        ys = np.concatenate([y[t, :m] for t, m in enumerate(live)])
        xs = np.concatenate([x[t, :m] for t, m in enumerate(live)])
        cls, rows, one = self.class_of(ys), np.arange(size), self.with_one(states)
        p = one @ self.wc
        np.exp(np.minimum(p, HIGHEST, out=p), out=p)
        p *= (1 / (p @ ONES[: p.shape[1]]))[:, None]
        loss = -np.log(p[rows, cls] + 1e-30).sum()
        p[rows, cls] -= 1
        g = {"wc": one.T @ p, "ww": np.zeros_like(self.ww)}
        dh = p @ self.wc[:HIDDEN].T
        by, edge = self.by_class(cls)
        if len(by):
            hs, k = one[by], ys[by] % CLASS_SIZE
            w = self.word_logits(hs, edge)
            np.exp(w, out=w)
            w *= (1 / (w @ ONES[:CLASS_SIZE]))[:, None]
            own = np.arange(len(by))
            loss -= np.log(w[own, k] + 1e-30).sum()
            w[own, k] -= 1
            more = np.empty((len(by), HIDDEN), kind)
            for c in range(self.classes):
                a, b = edge[c], edge[c + 1]
                if b > a:
                    np.matmul(hs[a:b].T, w[a:b], out=g["ww"][c])
                    np.matmul(w[a:b], self.ww[c, :HIDDEN].T, out=more[a:b])
            dh[by] += more
        before = np.concatenate(kept)
        z = gate[:, :HIDDEN]
        bend = gate - 1
        bend *= gate  # a gate's derivative
        to_update = before - content
        to_update *= bend[:, :HIDDEN]
        to_reset = inner * bend[:, HIDDEN:]
        to_content = content * content
        to_content -= 1
        to_content *= z - 1
        dg, dc, dr = np.empty((size, 2 * HIDDEN), kind), np.empty((size, HIDDEN), kind), np.empty((size, HIDDEN), kind)
        ug, uc = np.ascontiguousarray(self.ug.T), np.ascontiguousarray(self.uc.T)
        carry, end = np.zeros((0, HIDDEN), kind), size
        for m in reversed(live):
            cut, end = slice(end - m, end), end - m
            d = dh[cut]
            d[: len(carry)] += carry
            dn = np.multiply(d, to_content[cut], out=dc[cut])
            out = dg[cut]
            np.multiply(d, to_update[cut], out=out[:, :HIDDEN])
            np.multiply(dn, to_reset[cut], out=out[:, HIDDEN:])
            np.multiply(dn, gate[cut, HIDDEN:], out=dr[cut])
            carry = d * z[cut]
            carry += out @ ug
            carry += dr[cut] @ uc
        g["ug"], g["uc"] = before.T @ dg, before.T @ dr
        order = np.argsort(xs.astype(np.int16), kind="stable")
        seen = xs[order]
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        for name, d in (("xg", dg), ("xc", dc)):
            g[name] = np.zeros_like(getattr(self, name))
            g[name][seen[first]] = np.add.reduceat(d[order], first, axis=0)
        return g, h, float(loss), size


class Trainer:
    """Adam with clipped updates over windows."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.k = net, rate, 0
        self.m = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.v = {n: np.zeros_like(getattr(net, n)) for n in net.NAMES}
        self.tokens = 0

    def update(self, g: dict[str, np.ndarray], tokens: int) -> None:
        self.k += 1
        self.tokens += tokens
        c = np.float32(self.rate * np.sqrt(1 - 0.99**self.k) / (1 - 0.9**self.k) / np.sqrt(1 + self.k / 400))
        for n, d in g.items():
            d *= np.float32(1 / tokens)
            m, v = self.m[n], self.v[n]
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            v *= np.float32(0.99)
            v += np.float32(0.01) * (d * d)
            a = getattr(self.net, n)
            a -= np.clip(c * m / (np.sqrt(v) + np.float32(1e-7)), -0.05, 0.05)

    def run(self, sequences: list[np.ndarray]) -> float:
        """One pass over the sequences, the state carried on and every window propagated back; returns the mean loss of a token."""
        total, seen, h = 0.0, 0, None
        for x, y, live, _, carry in windows(sequences):
            g, h, loss, n = self.net.gradients(x, y, live, carried(h, carry))
            self.update(g, n)
            total, seen = total + loss, seen + n
        return total / max(seen, 1)


def windows(sequences: list[np.ndarray], bos: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]]:
    """(inputs, targets, rows alive at each step, the sequence of each row, its row in the window before or -1) of windows over all sequences.

    TOGETHER sequences run in step, the longest first; one that ends gives its row to the next one, so that
    the rows stay full until the last have begun.
    """
    size = np.array([len(s) for s in sequences], dtype=np.int64)
    if not size.sum():
        return
    flat = np.concatenate(sequences)
    begin = np.cumsum(size) - size
    before = np.concatenate([[bos], flat[:-1]]).astype(flat.dtype)
    before[begin[size > 0]] = bos
    queue = np.argsort(-size, kind="stable")
    queue = queue[: int((size > 0).sum())]
    rows, next_ = queue[:TOGETHER], TOGETHER
    at, left, carry = begin[rows], size[rows], np.full(len(rows), -1)
    while len(rows):
        n = np.minimum(left, WINDOW)
        by = np.argsort(-n, kind="stable")
        rows, at, left, carry, n = rows[by], at[by], left[by], carry[by], n[by]
        steps = np.arange(int(n[0]))
        place = np.minimum(at + steps[:, None], len(flat) - 1)
        yield before[place], flat[place], np.searchsorted(-n, -steps - 1, side="right").tolist(), rows, carry
        at, left = at + n, left - n
        kept = np.flatnonzero(left)
        new = queue[next_ : next_ + TOGETHER - len(kept)]
        next_ += len(new)
        rows, carry = np.concatenate([rows[kept], new]), np.concatenate([kept, np.full(len(new), -1)])
        at, left = np.concatenate([at[kept], begin[new]]), np.concatenate([left[kept], size[new]])


def carried(h: np.ndarray | None, carry: np.ndarray) -> np.ndarray:
    """The states that rows begin a window with: those of their rows in the window before, or none."""
    out = np.zeros((len(carry), HIDDEN), np.float32 if h is None else h.dtype)
    old = carry >= 0
    if old.any():
        out[old] = h[carry[old]]
    return out


def score_sequences(net: Network, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence (of core words and shapes), from its first token to its last."""
    out, h = np.zeros(len(sequences)), None
    for x, y, live, rows, carry in windows(sequences):
        states, *_, h = net.run(x, live, carried(h, carry))
        which = np.concatenate([np.arange(m) for m in live])
        lp = net.log_prob(states, np.concatenate([y[t, :m] for t, m in enumerate(live)]))
        out[rows] += np.bincount(which, weights=lp, minlength=len(rows))
    return out


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    shape = F.col("h").bitwiseAND(F.lit(SHAPES - 1)).cast("int")
    words = counts.where(F.col("h") != END).groupBy(shape.alias("s")).agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("int")).alias("once"), F.count("*").alias("v")).collect()
    ends = counts.where(F.col("h") == END).agg(F.sum("c")).first()[0] or 0
    tokens, once = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in words:
        tokens[r["s"]], once[r["s"]] = r["c"], r["once"]
    # The head is all words above a count that fits, found from a histogram of counts: a sort would send every task's best to the driver.
    step = F.floor(F.log2("c") * 16)
    many = sorted(((r["b"], r["n"]) for r in counts.where(F.col("h") != END).groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, HEAD - 1
    for b, n in many:
        room -= n
        if room < 0:
            break
        least = b
    if least is not None:
        rows = counts.where(F.col("h") != END).where(step >= least).collect()
    else:  # more words of one count than fit, and none above them
        rows = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(CORE).collect()
    head = sorted(((r["h"], r["c"]) for r in rows), key=lambda r: (-r[1], r[0]))
    distinct = sum(r["v"] for r in words) + (ends > 0)
    return Vocabulary([(END, ends), *head], int(tokens.sum()) + ends, distinct, tokens, once)


def start_texts(docs: DataFrame, many: int) -> list[str]:
    """At most START_DOCUMENTS texts in the order of a hash, as many as START_BYTES hold; many: documents in all.

    Rows far down that order are left out before the sort, so that a task sends the driver its share only.
    """
    h = F.xxhash64("text")
    share = min(1.0, 2 * (START_DOCUMENTS + 50) / max(many, 1))
    near = docs.select("text", h.alias("h"), F.octet_length("text").alias("n")).where(F.col("h") < int(-(1 << 63) + share * ((1 << 64) - 2048)))
    first = near.select("h", "n").orderBy("h").limit(START_DOCUMENTS).collect()
    total, last = 0, None
    for r in sorted(first, key=lambda r: r["h"]):
        total += r["n"]
        if total > START_BYTES and last is not None:
            break
        last = r["h"]
    if last is None:
        return []
    return [r["text"] for r in sorted(near.where(F.col("h") <= last).dropDuplicates(["h"]).collect(), key=lambda r: r["h"])]


def train(docs: DataFrame, blocks: DataFrame, vocabulary: Vocabulary) -> Network:
    """docs: training documents, text alone; blocks: theirs and the held-out ones'."""
    net = Network(vocabulary.core)
    net.start(vocabulary.c, vocabulary.shape_tokens)
    texts, own = start_texts(docs, int(vocabulary.c[0])), Words()
    numbers = [own.read(t) for t in texts]
    first = Block.of(own, numbers, [0] * len(texts), [False] * len(texts))
    sequences = first.sequences(vocabulary, vocabulary.slots(first.words)) if texts else []
    trainer = Trainer(net, START_RATE)
    for _ in range(START_PASSES):
        trainer.run(sequences)
    trained = task_weights(blocks, vocabulary, net)
    values = trained.select("tokens", F.posexplode("w").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w"))
    got = np.array([r["w"] for r in materialise(values, "weights").orderBy("i").collect()], dtype=np.float32)
    return net.load(got) if len(got) else net


def task_weights(blocks: DataFrame, vocabulary: Vocabulary, net: Network) -> DataFrame:
    """(w, tokens) of each task: the weights after its documents, from those of net, and the tokens that were propagated back."""
    shared = blocks.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, start = shared.value
        trainer, held, n = Trainer(Network(known.core).load(start), RATE), [], 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block.read(row)
                own = b.sequences(known, known.slots(b.words))
                held += [own[i] for i in np.flatnonzero(~b.held)]
                n += len(b.at)
                if n >= SLAB_TOKENS:
                    trainer.run(held)
                    held, n = [], 0
        trainer.run(held)
        if trainer.tokens:
            yield pd.DataFrame({"w": [trainer.net.flat()], "tokens": [trainer.tokens]})

    return blocks.drop("doc_id").mapInPandas(tidy(run), "w array<float>, tokens bigint")


def score(source: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    A null or empty text is an end alone.  With no training documents every word is unknown and the
    network keeps its first weights.  A null doc_id falls in the fold of the empty text.  Rows equal in
    doc_id and text are one document with a result each.
    """
    docs = documents(source, key=True).withColumn("held_out", fold("doc_id", FOLDS) == HELD)
    blocks = read_blocks(docs)
    counts = materialise(word_counts(blocks), "counts")
    vocabulary = learn_vocabulary(counts)
    net = train(docs.where("not held_out").select("text"), blocks, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, flat = shared.value
        net = Network(known.core).load(flat)
        end_base, end_known = float(known.base_log10(known.c[:1])[0]), int(known.c[0] > 0)
        def finish(b: Block, slots: np.ndarray, ids: list, lp: np.ndarray) -> pd.DataFrame:
            doc, many = b.doc, len(b.sizes)
            c = np.where(slots >= 0, known.c[slots], 0)
            rest = slots >= known.core
            inside = np.zeros(len(slots))
            inside[rest] = known.tail_log10(c[rest], shape_of(b.words[rest]))
            plain = np.where(slots >= 0, known.base_log10(c), 0.0)
            total = lambda x: np.bincount(doc, weights=x[b.at], minlength=many)
            far = np.flatnonzero(slots[b.at] < 0)
            pair, times = np.unique(doc[far] * len(b.words) + b.at[far], return_counts=True) if len(far) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            cut = np.searchsorted(pair, np.arange(1, many) * len(b.words))
            return pd.DataFrame({
                RID: b.rid, "doc_id": ids, "held_out": b.held, "n_tokens": b.sizes + 1, "known": total((c > 0).astype(float)).astype(np.int64) + end_known,
                "base": total(plain) + end_base, "own": lp / LN10 + total(inside),
                "tail": np.split(b.words[pair % max(len(b.words), 1)], cut), "many": np.split(times.astype(np.int32), cut),
            })

        def flush() -> Iterator[pd.DataFrame]:
            lp = score_sequences(net, [s for *_, own in held for s in own])
            ends = np.cumsum([len(own) for *_, own in held])
            for (b, slots, ids, _), part in zip(held, np.split(lp, ends[:-1]), strict=True):
                yield finish(b, slots, ids, part)
            held.clear()

        held: list[tuple] = []
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block.read(row)
                slots = known.slots(b.words)
                held.append((b, slots, list(row["doc_id"]), b.sequences(known, slots)))
                if sum(len(x[0].at) for x in held) >= SLAB_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    spec = f"{RID} bigint, doc_id string, held_out boolean, n_tokens bigint, known bigint, base double, own double, tail array<bigint>, many array<int>"
    scored = materialise(blocks.mapInPandas(tidy(run), spec).withColumn("doc_id", F.col("doc_id").cast("bigint")), "scored")
    # The rest of the words: counts by a join, then the within-shape and base terms, all in the JVM.
    words = scored.where(F.size("tail") > 0).dropDuplicates([RID]).select(RID, F.explode(F.arrays_zip("tail", "many")).alias("e")).select(RID, F.col("e.tail").alias("h"), F.col("e.many").alias("m"))
    words = words.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    shape = F.col("h").bitwiseAND(F.lit(SHAPES - 1)).cast("int") + 1
    tokens = F.element_at(F.array(*[F.lit(float(max(x, 1))) for x in vocabulary.shape_tokens]), shape)
    unknown = F.element_at(F.array(*[F.lit(float(x)) for x in vocabulary.unknown]), shape)
    inside = F.log10(F.when(F.col("c") > 0, (1 - unknown) * F.col("c") / tokens).otherwise(unknown))
    plain = F.log10((F.col("c") + 1) / F.lit(float(vocabulary.total + vocabulary.distinct + 1)))
    sums = words.groupBy(RID).agg(F.sum(F.col("m") * inside).alias("inside"), F.sum(F.col("m") * plain).alias("plain"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more"))
    zero = F.lit(0.0)
    return scored.drop("tail", "many").join(sums, RID, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"), F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("plain", zero)).alias("base_score"), (F.col("own") + F.coalesce("inside", zero)).alias("score"),
    )
