"""Toxicity from a learned lexicon, matched through Levenshtein automata, and the words around each match.

The lexicon is a trie of whole words and of stems (prefixes), learned from labelled documents.  The set
of all strings within the terms' error budgets is the language of an automaton whose states are sets of
(trie node, errors); it is made deterministic lazily, one transition at a time, as words are read.  Each
distinct word is read once.  A match counts as abuse or as quotation by the window of words and marks
around it; a logistic model over the counts gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import each_text, give_back

FOLDS, HELD = 5, 0
WINDOW = 6
WORDS_HELD = 400_000
STATES_HELD = 50_000
STEM = range(3, 9)
WORD = re.compile(r"[^\W_]+(?:[0-9@$][^\W_]+)*")
QUOTE = re.compile("[\"“”„«»‘]")
# Words that report another's speech, and words of direct address.
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes phrase insult insults slur slurs".split())
ADDRESS = frozenset("you your youre yourself du dich dein tu te toi vous ton usted eres".split())
N_FEATURES = 8


class Lexicon:
    """Terms with error budgets, and the automaton that reads words against all of them at once."""

    DONE = -1

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = sorted(set(words)), sorted(set(stems))
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        for term in self.words:
            self.whole[self._node(term)] = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
        for term in self.stems:
            self.stem[self._node(term)] = 1 if len(term) >= 6 else 0
        self.most = max([0, *self.whole.values(), *self.stem.values()])
        self.forget()

    def forget(self) -> None:
        """Drop the states made so far; they are made again as words ask for them."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.out: list[int] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _node(self, term: str) -> int:
        at = 0
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
            at = self.next[at][c]
        return at

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of the state that holds items, closed under skipped trie letters and finished stems."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if node == self.DONE:
                continue
            if e <= self.stem.get(node, -1):
                todo.append((self.DONE, e))
            if e < self.most:
                todo += [(n, e + 1) for n in self.next[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [e for n, e in key if n == self.DONE or e <= self.whole.get(n, -1)]
            self.out.append(1 + min(found) if found else 0)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if node == self.DONE:
                items.add((node, e))
                continue
            if c in self.next[node]:
                items.add((self.next[node][c], e))
            if e < self.most:
                items.add((node, e + 1))
                items |= {(n, e + 1) for n in self.next[node].values()}
        found = self.moves[state][c] = self._state(items)
        return found

    def read(self, word: str) -> int:
        """0 if no term is near enough, else 1 + the fewest errors."""
        if len(self.sets) > STATES_HELD:
            self.forget()
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if not self.sets[at]:
                return 0
        return self.out[at]


class Scorer:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def __getstate__(self):
        return {"words": self.lexicon.words, "stems": self.lexicon.stems, "weights": self.weights}

    def __setstate__(self, s):
        self.__init__(Lexicon(s["words"], s["stems"]), s["weights"])

    def matches(self, text: str) -> tuple[list[tuple[int, str, int, bool]], int]:
        """(word position, word, errors, abusive) of each match, and the number of words of the whole text."""
        low = text.lower()
        words = WORD.findall(low)
        if len(self.clean) > WORDS_HELD:
            self.clean.clear()
        new = set(words) - self.clean
        here = {}
        for w in new:
            code = self.hits.get(w)
            if code is None:
                code = self.lexicon.read(w)
                if code:
                    if len(self.hits) > WORDS_HELD:
                        self.hits.clear()
                    self.hits[w] = code
                else:
                    self.clean.add(w)
            if code:
                here[w] = code
        if not here:
            return [], len(words)
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        out = []
        for i, w in enumerate(words):
            if w in here:
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                left = low[max(0, spans[i][0] - 40) : spans[i][0]]
                right = low[spans[i][1] : spans[i][1] + 40]
                score = -1.0 * bool(QUOTE.search(left) and QUOTE.search(right)) - 0.5 * sum(x in REPORTING for x in near) + 0.75 * sum(x in ADDRESS for x in near) + 0.5 * (sum(x in here for x in near) - 1)
                out.append((i, w, here[w] - 1, score > -1.2))
        return out, len(words)

    def features(self, text: str) -> np.ndarray:
        found, n = self.matches(text)
        c = Counter((e > 0, abuse) for _, _, e, abuse in found)
        exact, quoted, fuzzy, far = c[False, True], c[False, False], c[True, True], c[True, False]
        return np.array([1.0, math.log1p(exact), exact > 0, math.log1p(quoted), math.log1p(fuzzy), math.log1p(far), min(1.0, 20 * exact / max(n, 1)), min(1.0, 20 * fuzzy / max(n, 1))])

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights)))))


def learn_lexicon(rows: list[tuple[str, int]], least: int = 5, share: float = 0.015, purity: float = 12.0) -> Lexicon:
    """Words and shortest stems that stand in toxic documents `purity` times as often as chance allows.

    Smoothed ratio of document shares; a stem must cover at least two words, else the word itself is the term.
    """
    toxic = [set(WORD.findall(t.lower())) for t, y in rows if y]
    clean = [set(WORD.findall(t.lower())) for t, y in rows if not y]
    if not toxic or not clean:
        return Lexicon([], [])
    least = max(least, int(share * len(toxic)))
    words = Counter(w for s in toxic for w in s)
    stems = Counter(p for s in toxic for p in {w[:k] for w in s for k in STEM if k <= len(w)})
    words = {w: n for w, n in words.items() if n >= least and len(w) >= 3}
    stems = {p: n for p, n in stems.items() if n >= least}
    against = Counter(w for s in clean for w in s if w in words)
    against_stem = Counter(p for s in clean for p in {w[:k] for w in s for k in STEM if w[:k] in stems})
    ratio = lambda t, c: (t / len(toxic)) / ((c + 1) / (len(clean) + 1))
    good_words = {w for w, n in words.items() if ratio(n, against[w]) >= purity and n >= 9 * against[w]}
    good_stems = {p for p, n in stems.items() if ratio(n, against_stem[p]) >= purity and n >= 9 * against_stem[p]}
    covers = Counter(p for w in {w for s in toxic for w in s} for k in STEM if (p := w[:k]) in good_stems)
    kept = {p for p in good_stems if covers[p] >= 3 and not any(p[:k] in good_stems for k in STEM if k < len(p))}
    return Lexicon(sorted(good_words), sorted(kept))


def fit(rows: list[tuple[str, int]]) -> Scorer:
    """Lexicon from every other row of each label, weights from the rest (so that they see words the lexicon hasn't learned from)."""
    rows = sorted(rows, key=lambda r: r[1])
    toxic = next((i for i, (_, v) in enumerate(rows) if v), len(rows))
    half_rows, other_rows = rows[:toxic:2] + rows[toxic::2], rows[1:toxic:2] + rows[toxic + 1 :: 2]
    y = np.array([v for _, v in rows], dtype=float)
    weights = np.zeros(N_FEATURES)
    if len(set(y.tolist())) < 2:
        weights[0] = -4.0 if not len(y) or y[0] == 0 else 4.0
        return Scorer(Lexicon([], []), weights)
    if len({v for _, v in other_rows}) < 2:
        other_rows = rows
    half = Scorer(learn_lexicon(half_rows), weights)
    x, z = np.array([half.features(t) for t, _ in other_rows]), np.array([v for _, v in other_rows], dtype=float)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        q = p * (1 - p)
        g = x.T @ (z - p) - 0.3 * weights
        weights = weights + np.clip(np.linalg.solve((x * q[:, None]).T @ x + 0.3 * np.eye(N_FEATURES), g), -2, 2)
    return Scorer(learn_lexicon(rows), weights)


def fit_on(docs: DataFrame, labels: DataFrame, limit: int = labelled.FIT_DOCUMENTS) -> Scorer:
    model = fit(labelled.sample(docs, labels, "toxic", FOLDS, HELD, limit))
    give_back()
    return model


def score_documents(docs: DataFrame, model: Scorer, text: str = "text") -> DataFrame:
    """docs' columns, `toxicity` (0 to 1) and `toxic_matches`: number of lexicon matches that count as abuse.

    Null and empty texts have no match and score as a text without any.  No shuffle.
    """

    def run(texts: list[str]) -> pd.DataFrame:
        x = np.array([model.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.DataFrame({"p": 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))), "m": np.round(np.expm1(x[:, 1]) + np.expm1(x[:, 4])).astype(np.int64)})

    made = docs.drop("toxicity", "toxic_matches").withColumn("__lf_tox", each_text(run, "p double, m bigint", text))
    return made.select("*", F.col("__lf_tox.p").alias("toxicity"), F.col("__lf_tox.m").alias("toxic_matches")).drop("__lf_tox")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_matches of every document.

    Null and empty texts score as score_documents() says, a null doc_id falls in the fold of the empty text, and
    each of several rows of one doc_id has its own score.
    """
    scored = score_documents(docs.select("doc_id", "text"), fit_on(docs, labels))
    score = F.col("toxicity")
    return scored.select("doc_id", (labelled.fold("doc_id", FOLDS) == HELD).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "toxic_matches")
