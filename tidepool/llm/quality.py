"""Quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

A text is measured by a dozen simple features.  Each feature is cut into bins by its quantiles, and the model is one lookup table
for each feature and one for each chosen pair: the score is the logistic of the sum of table entries at a text's bins.

The tables are learned by cyclic boosting.  Round by round, every feature in turn fits a shallow tree (up to ``LEAVES`` leaves) to
the present errors and adds it, shrunk, to its table.  Then the pairs whose quarters explain most of what is left get tables
in the same way.  Learning takes at most ``rows_per_label`` texts of each label, weighted back to the shares of the labels; all texts
are scored whole, in one narrow pass.

A null text counts as empty.  Rows with a null label teach nothing; if a label is missing altogether, every score is the share of the
other (0.5 without labels).
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import slices, stratified, texts_for, texts_of
from tidepool.session import ship_package

FEATURES = ["log words", "word length", "letters", "capitals", "digits", "symbols", "blanks", "distinct words", "commonest word",
            "same word again", "repeated lines", "words a line", "short words", "words with symbols", "bars", "sentence ends"]
BINS, PAIR_BINS = 32, 8
ROUNDS, RATE, LEAVES = 150, 0.1, 4
PAIRS, PAIR_ROUNDS = 8, 50

# Classes of bytes: other, letter, capital, digit, blank, sentence end, bar, other symbol.
CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = (1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace()
                 else 5 if _c in ".!?" else 6 if _c == "|" else 7 if _b >= 33 else 0)


def measure(text: str) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``."""
    data = text.encode("utf-8", "surrogatepass")
    share = np.bincount(CLASS[np.frombuffer(data, np.uint8)], minlength=8) / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = share[1] + share[2]
    odd = sum(c for w, c in counts.items() if not w.isalnum() and not w[:-1].isalnum())
    return [math.log1p(len(words)), sum(map(len, words)) / n, letters, share[2] / letters if letters else 0.0, share[3],
            share[5] + share[6] + share[7], share[4], len(counts) / n, max(counts.values(), default=0) / n,
            sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines) if lines else 0.0, len(words) / max(1, len(lines)),
            sum(c for w, c in counts.items() if len(w) <= 3) / n, odd / n, share[6], share[5] * len(data) / n]


@dataclass
class QualityModel:
    share: float = 0.5
    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None  # features x BINS
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin to pair bin
    pair_tables: np.ndarray | None = None  # pairs x PAIR_BINS x PAIR_BINS

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.tables is None:
            return np.full(len(texts), self.share)
        at = self.bins(np.array([measure(t) for t in texts]).reshape(len(texts), len(FEATURES)))
        total = self.bias + self.tables[np.arange(len(FEATURES)), at].sum(axis=1)
        for k, (a, b) in enumerate(self.pairs):
            total += self.pair_tables[k, self.coarse[a][at[:, a]], self.coarse[b][at[:, b]]]
        return _logistic(total)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the tree with up to ``LEAVES`` leaves that splits greedily; g and h are summed by bin."""
    pieces, sums = [(0, len(g))], (np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)]))

    def total(lo, hi):
        return sums[0][hi] - sums[0][lo], sums[1][hi] - sums[1][lo]

    while len(pieces) < LEAVES:
        best = (1e-9, None, None)
        for p, (lo, hi) in enumerate(pieces):
            if hi - lo < 2:
                continue
            cut = np.arange(lo + 1, hi)
            gain = _gain(*total(lo, cut)) + _gain(*total(cut, hi)) - _gain(*total(lo, hi))
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], p, int(cut[k]))
        if best[1] is None:
            break
        lo, hi = pieces.pop(best[1])
        pieces += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in pieces:
        a, b = total(lo, hi)
        out[lo:hi] = a / (b + 1.0)
    return out


def quarters(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a pair's bins into four quarters: values and how much of the errors they explain."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, n = (-1.0, None), len(g)
    a, b = np.meshgrid(np.arange(1, n), np.arange(1, n), indexing="ij")

    def four(s):
        low = s[a, b]
        return low, s[a, n] - low, s[n, b] - low, s[n, n] - s[a, n] - s[n, b] + low

    parts = list(zip(four(G), four(H)))
    gain = sum(_gain(x, y) for x, y in parts) - _gain(G[n, n], H[n, n])
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    best = float(gain[k])
    i, j = k[0] + 1, k[1] + 1
    value = [x[k] / (y[k] + 1.0) for x, y in parts]
    out = np.empty((n, n))
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = value[0], value[1], value[2], value[3]
    return out, best


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float) -> QualityModel:
    model = QualityModel(share=share, bias=math.log((share + 1e-6) / (1 - share + 1e-6)))
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        model.cuts.append(cuts)
        model.coarse.append(np.minimum(np.arange(BINS) * PAIR_BINS // (len(cuts) + 1), PAIR_BINS - 1))
    at = model.bins(x)
    model.tables = np.zeros((x.shape[1], BINS))
    total = np.full(len(y), model.bias)
    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            p = _logistic(total)
            g = np.bincount(at[:, j], weight * (y - p), BINS)
            h = np.bincount(at[:, j], weight * p * (1 - p), BINS)
            step = RATE * shallow_tree(g, h)
            model.tables[j] += step
            total += step[at[:, j]]
    small = np.stack([c[at[:, j]] for j, c in enumerate(model.coarse)], axis=1)

    def grid(a, b):
        p = _logistic(total)
        cell = small[:, a] * PAIR_BINS + small[:, b]
        return tuple(np.bincount(cell, w, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)
                     for w in (weight * (y - p), weight * p * (1 - p)))

    every = [(a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    model.pairs = sorted(every, key=lambda ab: -quarters(*grid(*ab))[1])[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * quarters(*grid(a, b))[0]
            model.pair_tables[k] += step
            total += step[small[:, a], small[:, b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows_per_label: int = 2000) -> QualityModel:
    """Learn from the labelled texts; ``labels`` has (key, label), of which null labels and repeated rows are left out."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).filter(
        "label in (0, 1)").dropDuplicates(["key"])
    rows = texts_for(stratified(known, "label", "key", rows_per_label, "quality"), docs, key, text)
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = total.get(1, 0) / sum(total.values()) if total else 0.5
    y = np.array([v for v, _ in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return QualityModel(share=share)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return learn(np.array([measure(t) for _, t in rows]), y, weight, share)


def score(docs: DataFrame, model: QualityModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``quality_score``, 0 to 1."""
    ship_package(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != "quality_score"]
    source = docs.select(docs[text].alias("_text"), *[docs[c] for c in kept])
    shape = source.drop("_text").withColumn("quality_score", F.lit(0.0)).schema

    def run(batches):
        for part in slices(batches):
            found = model.scores(texts_of(part, "_text")) if part.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.float64())], names=[*kept, "quality_score"])

    return source.mapInArrow(run, shape)
