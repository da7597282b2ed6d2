"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score comes from its own shape and that of its neighbours, the chain
adds transition scores, and forward-backward gives each line's probability of being good.  A document's
quality is a calibrated function of the mean of these, weighted by line length.

Only documents are labelled, so fitting starts with each line carrying its document's label, then
relabels the lines of bad documents by the marginals of the current model (a bad document keeps at
least its worst line) and fits again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import each_text, give_back

FOLDS, HELD = 4, 2
THRESHOLD = 0.7
STEPS = 120
LOWER, UPPER, DIGIT, BLANK, PUNCT, PIPE, BANG, MARK, HIGH, OTHER = range(10)


def classes() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.int64)
    out[128:] = HIGH
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (" \t\n\r", BLANK), (".,;:'\"()?-", PUNCT), ("|", PIPE), ("!", BANG), ("#$%&*@~^_=+<>/\\{}[]`", MARK)):
        out[np.frombuffer(chars.encode(), dtype=np.uint8)] = kind
    return out


CLASS = classes()
OWN = 20
NEAR = (0, 1, 4, 5, 6, 9, 10, 12, 13, 18)
WIDTH = OWN + 2 * len(NEAR) + 1


def features(texts: list[str], at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece_features() of all texts, made from about `at_once` characters at a time to bound the memory."""
    parts, lo, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= at_once or k + 1 == len(texts):
            parts.append(piece_features(texts[lo : k + 1]))
            lo, size = k + 1, 0
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def piece_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x WIDTH features, line lengths in bytes, number of lines of each text); no text is without a line."""
    lines_of = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines_of], dtype=np.int64)
    raw = "\n".join(texts).encode("utf-8") + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    n = len(ends)
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    line = np.repeat(np.arange(n), sizes + 1)
    kind = CLASS[data]
    table = np.bincount(line * 10 + kind, minlength=10 * n).reshape(n, 10).astype(np.float64)
    table[:, BLANK] -= 1  # the line feed itself
    blank = kind == BLANK
    before = np.concatenate([[BLANK], kind[:-1]])
    words = np.bincount(line[~blank & (before == BLANK)], minlength=n).astype(np.float64)
    ended = np.bincount(line[blank & ((before == MARK) | (before == BANG) | (before == PIPE))], minlength=n)
    twice = np.bincount(line[1:][(data[1:] == data[:-1]) & ((kind[1:] == MARK) | (kind[1:] == BANG))], minlength=n)
    seen_before, repeats = np.zeros(n), np.zeros(n)
    k = 0
    for own in lines_of:
        met: set[str] = set()
        for x in own:
            if len(x) > 20:
                seen_before[k] = x in met
                met.add(x)
            own_words = x.split()
            if len(own_words) > 1:
                repeats[k] = 1 - len(set(own_words)) / len(own_words)
            k += 1
    size, per_word = np.maximum(sizes, 1), np.maximum(words, 1)
    f = np.zeros((n, WIDTH))
    for c, k in ((UPPER, 0), (DIGIT, 1), (BLANK, 2), (PUNCT, 3), (PIPE, 4), (BANG, 5), (MARK, 6), (HIGH, 7), (OTHER, 8)):
        f[:, k] = table[:, c] / size
    f[:, 9] = ended / per_word
    f[:, 10] = twice / per_word
    f[:, 11] = np.log1p(sizes) / 6
    f[:, 12] = seen_before
    f[:, 13] = np.minimum(table[:, [MARK, BANG, PIPE]].sum(1) / per_word, 3)
    f[:, 14] = np.minimum((table[:, LOWER] + table[:, UPPER] + table[:, HIGH]) / per_word, 40) / 10
    f[:, 15] = sizes == 0
    f[:, 16] = (words <= 2) & (sizes > 0)
    f[:, 17] = (table[:, UPPER] > table[:, LOWER]).astype(float)
    f[:, 18] = np.where(words >= 4, repeats, 0)
    f[:, 19] = f[:, 18] > 0.6
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    up, down = f[:, NEAR].copy(), f[:, NEAR].copy()
    f[1:, OWN : OWN + len(NEAR)] = up[:-1]
    f[:-1, OWN + len(NEAR) : -1] = down[1:]
    f[first, OWN : OWN + len(NEAR)] = 0
    f[np.cumsum(counts) - 1, OWN + len(NEAR) : -1] = 0
    f[:, -1] = 1
    return f, sizes + 1, counts


def chains(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each position k: the chains that have one, and their lines at k; longest chains first."""
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    sized = counts[order]
    live = np.searchsorted(-sized, -np.arange(1, int(sized[0]) + 1), side="right") if len(sized) else []
    return [first[:m] + k for k, m in enumerate(live)]


def forward_backward(score: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of every line, log partition of every chain's last line summed, expected transitions).

    Exact for chains of any length: alpha and beta are scaled to sum to one at each line.
    """
    top = score.max(1, keepdims=True)
    e, t = np.exp(score - top), np.exp(trans)
    at = chains(counts)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    for k, now in enumerate(at):
        a = e[now] if k == 0 else (alpha[at[k - 1][: len(now)]] @ t) * e[now]
        scale[now] = a.sum(1)
        alpha[now] = a / scale[now][:, None]
    pairs = np.zeros((2, 2))
    for k in range(len(at) - 1, 0, -1):
        now = at[k]
        prev = at[k - 1][: len(now)]
        w = e[now] * beta[now] / scale[now][:, None]
        beta[prev] = w @ t.T
        pairs += t * (alpha[prev].T @ w)
    m = alpha * beta
    return m / m.sum(1, keepdims=True), np.log(scale).sum() + top.sum(), pairs


class LineField:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, mean: np.ndarray, sd: np.ndarray, calibration: tuple[float, float]):
        self.weights, self.trans, self.mean, self.sd, self.calibration = weights, trans, mean, sd, calibration

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability that each line is good, its length, lines of each text)."""
        f, size, counts = features(texts)
        m, _, _ = forward_backward(((f - self.mean) / self.sd) @ self.weights, self.trans, counts)
        return m[:, 1], size, counts

    def means(self, texts: list[str]) -> np.ndarray:
        good, size, counts = self.marginals(texts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(good * size, first) / np.add.reduceat(size, first)

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a + b * (2 * self.means(texts) - 1)))) if texts else np.zeros(0)


def fit(rows: list[tuple[str, int]], steps: int = STEPS, rounds: int = 2, ridge: float = 1e-3) -> LineField:
    """Fit on (text, quality); without rows of both labels every document scores the share of label 1 (1 if no rows)."""
    texts, y = [t for t, _ in rows], np.array([q for _, q in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        sure = 20.0 if not len(y) or y[0] == 1 else -20.0
        return LineField(np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH), (sure, 0.0))
    f, size, counts = features(texts)
    mean, sd = f.mean(0), f.std(0) + 1e-6
    mean[-1], sd[-1] = 0, 1
    f = (f - mean) / sd
    doc = np.repeat(np.arange(len(texts)), counts)
    label = y[doc].copy()
    # Each document counts alike in all, however many lines it has; both labels count alike.
    weight = (1 / counts[doc]) * np.where(y[doc] == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, t = np.zeros((f.shape[1], 2)), np.zeros((2, 2))
    rate = 0.3
    for turn in range(rounds):
        m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
        truth = np.eye(2)[label]
        follows = np.flatnonzero(doc[1:] == doc[:-1])
        held = np.zeros((2, 2))
        np.add.at(held, (label[follows], label[follows + 1]), 1.0)
        for k in range(1, steps + 1):
            m, _, pairs = forward_backward(f @ w, t, counts)
            gw = f.T @ ((truth - m) * weight[:, None]) - ridge * w
            gt = (held - pairs) / max(len(follows), 1) - ridge * t
            m1, v1 = 0.9 * m1 + 0.1 * gw, 0.99 * v1 + 0.01 * gw**2
            m2, v2 = 0.9 * m2 + 0.1 * gt, 0.99 * v2 + 0.01 * gt**2
            step = rate / (1 + 3 * k / steps)
            w = w + step * (m1 / (1 - 0.9**k)) / (np.sqrt(v1 / (1 - 0.99**k)) + 1e-8)
            t = t + step * (m2 / (1 - 0.9**k)) / (np.sqrt(v2 / (1 - 0.99**k)) + 1e-8)
        if turn + 1 < rounds:
            good = forward_backward(f @ w, t, counts)[0][:, 1]
            label = np.where((y[doc] == 1) | (good > 0.5), 1, 0)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            worst = np.minimum.reduceat(good, first)
            label[(y[doc] == 0) & (good <= worst[doc])] = 0
    model = LineField(w, t, mean, sd, (0.0, 1.0))
    x = 2 * model.means(texts) - 1
    a, b = 0.0, 1.0
    own = np.where(y == 1, 1.0, (y == 1).sum() / max((y == 0).sum(), 1))
    for _ in range(60):  # Newton steps of a ridged logistic fit, labels weighted alike
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([((y - p) * own).sum(), ((y - p) * own * x).sum() - 1e-2 * b])
        q = p * (1 - p) * own + 1e-9
        h = np.array([[q.sum() + 1e-2, (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    # The decision falls at THRESHOLD: shift so that an even document scores just that.
    model.calibration = (a + float(np.log(THRESHOLD / (1 - THRESHOLD))), b)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, limit: int = labelled.FIT_DOCUMENTS) -> LineField:
    model = fit(labelled.sample(docs, labels, "quality", FOLDS, HELD, limit))
    give_back()
    return model


def quality_score(model: LineField, text: str = "text") -> Column:
    """The model's score of the text column: a null or empty text is one empty line and scores as the model says for that."""
    return each_text(lambda texts: pd.DataFrame({"p": model.score(texts)}), "p double", text)["p"]


def score_documents(docs: DataFrame, model: LineField, text: str = "text") -> DataFrame:
    """docs' columns and quality_score().

    No shuffle; the model is a few hundred numbers.
    """
    return docs.drop("quality_score").withColumn("quality_score", quality_score(model, text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts score as score_documents() says, a null doc_id falls in the fold of the empty text, and
    each of several rows of one doc_id has its own score.
    """
    scored = score_documents(docs.select("doc_id", "text"), fit_on(docs, labels))
    score = F.col("quality_score")
    return scored.select("doc_id", (labelled.fold("doc_id", FOLDS) == HELD).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
