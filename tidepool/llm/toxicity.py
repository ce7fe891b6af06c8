"""Toxicity by compression distance: how much shorter a window of text gets with a dictionary of toxic text than without.

Two zstandard dictionaries are trained.  The ordinary one comes from windows of ordinary texts.  The toxic one has the same
content behind the spellings that set toxic texts apart: words and word beginnings whose document frequency in toxic texts is
significantly above that in ordinary texts, however many they are.  So both explain ordinary prose alike, and the difference
of the compressed lengths of a window, its gain, comes from toxic spellings only.  A dictionary trained on windows of toxic texts
explains mostly the prose around those spellings and tells almost nothing (figures in the README).

A text is cut at blanks into windows of about ``WINDOW`` bytes, whole, and scored by a logistic function of the gains: the
largest ones, sums above thresholds and shares of windows above thresholds.  Its weights are calibrated on gains of texts that the
dictionaries used for them have not seen, weighted back to the share of toxic texts among all labelled ones.

The fit takes at most twice ``rows_per_label`` texts of each label, drawn by a hash of the key.  Each half is calibrated with
dictionaries of the other; the dictionaries of the model come from both.  Scoring is one narrow pass.  A null text counts as empty; an empty text is scored as one without gains.  Rows
with a null label teach nothing; if a label is missing altogether, every score is the share of the other (0.5 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import slices, stratified, texts_for, texts_of
from tidepool.session import ship_package

WINDOW = 64  # bytes
SLACK = 40  # bytes by which a window may grow to end at a blank
LEVEL = 12
DICTIONARY_BYTES = 57344  # what it lacks of ordinary prose is noise in the gains; with the spellings it stays within a window of 64 KB
LEAST_Z = 4.5  # standard errors by which the document frequencies of a spelling must differ
LEAST_RATIO = 20  # and how many times as frequent it must be in toxic texts
WORD = re.compile(r"\w+")
STEM = range(4, 9)


def windows(text: str) -> list[bytes]:
    data = text.lower().encode("utf-8", "surrogatepass")
    out, at, size = [], 0, len(data)
    while at < size:
        end = at + WINDOW
        if end < size:
            blank = data.find(b" ", end, end + SLACK)
            end = end if blank < 0 else blank
        out.append(data[at:end])
        at = end
    return out


@lru_cache(maxsize=6)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False,
                                    write_dict_id=False)


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    share: float = 0.5

    def gains(self, text: str) -> np.ndarray:
        """Bytes that each window is shorter with the toxic dictionary."""
        plain, toxic = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)] or [0], np.float64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = np.stack([profile(self.gains(t)) for t in texts])
        return _logistic(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])


def profile(gains: np.ndarray) -> np.ndarray:
    n = len(gains)
    top = np.sort(np.concatenate([gains, np.zeros(8)]))[::-1]
    above = [np.maximum(gains - t, 0).sum() for t in (2, 4)]
    return np.array([top[0], top[1], top[2], top[4], above[0] / math.sqrt(n), above[1] / math.sqrt(n),
                     np.mean(gains >= 3), np.mean(gains >= 5), math.log(n)])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def distinct_words(texts: list[str]) -> list[set[str]]:
    """Word sets, without texts that share half of their longer words with one earlier text (copies count once)."""
    first: dict[str, int] = {}
    out = []
    for number, text in enumerate(texts):
        words = set(WORD.findall(text.lower()))
        long = [w for w in words if len(w) > 5]
        shared = Counter(first[w] for w in long if w in first).most_common(1)
        if shared and shared[0][1] > 0.5 * len(long):
            continue
        for w in long:
            first.setdefault(w, number)
        out.append(words)
    return out


def telling_spellings(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words and word beginnings that more toxic than ordinary texts have, the most telling first."""
    def counts(texts):
        sets = distinct_words(texts)
        return len(sets), Counter(s for words in sets for s in {x for w in words for x in (w, *(w[:k] + "*" for k in STEM if k < len(w)))})

    (n, t), (m, o) = counts(toxic), counts(ordinary)
    if not n or not m:
        return []
    ranked = []
    for s, k in t.items():
        p, q = k / n, o[s] / m
        both = (k + o[s] + 1) / (n + m + 2)
        z = (p - q) / math.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12)
        if z >= LEAST_Z and p >= LEAST_RATIO * q and len(s) >= 4:
            ranked.append((-z, -len(s), s))
    found = {s: -z for z, _, s in ranked}
    chosen: list[str] = []
    for _, _, s in sorted(ranked):
        stem = s.rstrip("*")
        if any(stem.startswith(c.strip()) or c.startswith(" " + stem) for c in chosen):
            continue
        # the longest spelling with that beginning that tells almost as much; a whole word takes its blanks along
        longest = max((x for x, z in found.items() if x.startswith(stem) and z >= 0.9 * found[s]), key=lambda x: (len(x), found[x], x))
        chosen.append(f" {longest[:-1]}" if longest.endswith("*") else f" {longest} ")
    return chosen


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        rows_per_label: int = 1000) -> ToxicityModel:
    """Learn from the labelled texts; ``labels`` has (key, label), of which null labels and repeated rows are left out."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).filter(
        "label in (0, 1)").dropDuplicates(["key"])
    rows = texts_for(stratified(known, "label", "key", 2 * rows_per_label, "toxicity"), docs, key, text)
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values())) if total else 0.5
    # Which half a text falls into goes by its content, so that exact copies stay together.
    halves: dict[tuple[int, int], list[str]] = {(v, h): [] for v in (0, 1) for h in (0, 1)}
    for r in rows:
        halves[r[0], sum(r[1].encode("utf-8", "surrogatepass")) % 2].append(r[1])
    for v in (0, 1):
        if not (halves[v, 0] and halves[v, 1]):  # all in one half: dealt in turn; a single text serves in both
            texts = halves[v, 0] + halves[v, 1]
            if not texts:
                return ToxicityModel(share=share)
            turn = {t: i for i, t in enumerate(sorted(set(texts)))}
            for h in (0, 1):
                halves[v, h] = [t for t in texts if len(turn) == 1 or turn[t] % 2 == h]
    model = _dictionaries(halves[1, 0] + halves[1, 1], halves[0, 0] + halves[0, 1], share)
    other = [_dictionaries(halves[1, 1 - h], halves[0, 1 - h], share) for h in (0, 1)]
    held = [(profile(other[h].gains(t)), v) for h in (0, 1) for v in (0, 1) for t in halves[v, h]]
    x = np.stack([p for p, _ in held])
    y = np.array([v for _, v in held], np.float64)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _fit_logistic((x - model.mean) / model.scale, y, weight)
    return model


def _dictionaries(toxic: list[str], clean: list[str], share: float) -> ToxicityModel:
    ordinary = _trained([w for t in clean for w in windows(t)], DICTIONARY_BYTES)
    spellings = telling_spellings(toxic, clean)
    return ToxicityModel(ordinary, "".join(reversed(spellings)).encode() + ordinary, share=share)


def _trained(samples: list[bytes], size: int) -> bytes:
    step = max(1, len(samples) // 20_000)
    samples = samples[::step]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[:size] or b" "


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    hold = np.full(z.shape[1], ridge)
    hold[-1] = 1e-6
    for _ in range(40):
        p = _logistic(z @ w)
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(hold) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - hold * w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return w


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``toxicity``, 0 to 1."""
    ship_package(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != "toxicity"]
    source = docs.select(docs[text].alias("_text"), *[docs[c] for c in kept])
    shape = source.drop("_text").withColumn("toxicity", F.lit(0.0)).schema

    def run(batches):
        for part in slices(batches):
            found = model.scores(texts_of(part, "_text")) if part.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.float64())], names=[*kept, "toxicity"])

    return source.mapInArrow(run, shape)
