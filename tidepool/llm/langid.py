"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed counts of one, two and three letters (bytes of the lower-case text, everything that is not a letter a
blank), square roots taken and brought to length one, so that whole texts of any size compare.  Families are told apart by
one linear SVM each against the rest, the languages of a family by one linear SVM for each pair.

The models are fitted on at most ``rows_per_language`` labelled texts of each language (drawn by a hash of the key, so whatever
the layout); every text is scored whole, in one narrow pass.

A null text, or one without a letter, is ``und`` with score 0.  A single learned language gets every other text.  Rows with a null
language teach nothing; without any learned language every text is ``und``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import slices, stratified
from tidepool.session import ship_package

# The branch of each language; a language that is not named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af", "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bg mk", "uralic": "fi et hu", "turkic": "tr az kk uz",
    "indo-aryan": "hi bn mr ne ur pa gu", "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

ONE, TWO, THREE = 256, 2048, 6144  # bins of the counts by number of letters
LETTER = re.compile(r"[^\W\d_]")
KEPT = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
SLOPE = 4.0  # steepness from a margin to a share of certainty


def has_letter(text: str) -> bool:
    """Whether any character is a letter; the pattern alone takes fractions and powers for one."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    a = KEPT[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    a = a[(a != 32) | np.concatenate([[True], a[:-1] != 32])] if len(a) else a  # runs of blanks as one
    a = a.astype(np.uint32)
    out = np.zeros(ONE + TWO + THREE, np.float64)
    out[:ONE] = np.bincount(a, minlength=ONE)
    two = (a[:-1] << 8) | a[1:]
    out[ONE:ONE + TWO] = np.bincount((two * np.uint32(2654435761)) >> np.uint32(21), minlength=TWO)
    three = (((two[:-1] << 8) | a[2:]) * np.uint32(2246822519)) >> np.uint32(8)
    out[ONE + TWO:] = np.bincount(three % np.uint32(THREE), minlength=THREE)
    np.sqrt(out, out=out)
    norm = math.sqrt(float(out @ out))
    return (out / norm if norm else out).astype(np.float32)


def linear_svm(gram: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Dual weights (label times alpha) of an L2 support vector machine with squared hinge loss, by coordinate ascent."""
    n = len(y)
    soft = 1 / (2 * cost)
    alpha, reach = np.zeros(n), np.zeros(n)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(n):
            step = (1 - y[i] * reach[i] - soft * alpha[i]) / (gram[i, i] + soft)
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                reach += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    return alpha * y


@dataclass
class LanguageModel:
    """Weights by decision: families against the rest, pairs of languages within a family."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    against_rest: np.ndarray | None = None  # features x families
    pairs: list[tuple[str, str]] = field(default_factory=list)
    between: np.ndarray | None = None  # features x pairs

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.families or not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = x @ self.against_rest
            best = int(np.argmax(margins))
            family = self.families[best]
            rest = float(np.max(np.delete(margins, best)))
            sure = _share((float(margins[best]) - rest) / 2)
        names = self.members[family]
        if len(names) == 1:
            return names[0], sure
        margins = x @ self.between
        votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (a, b), m in zip(self.pairs, margins.tolist()):
            if a in votes:
                votes[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        name = max(names, key=lambda n: (votes[n], total[n]))
        least = min(m if a == name else -m for (a, b), m in zip(self.pairs, margins.tolist()) if name in (a, b))
        return name, sure * _share(least)


def _share(margin: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, SLOPE * margin))))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 400,
        family_of: dict[str, str] | None = None) -> LanguageModel:
    """Learn from the rows with a language and a letter in their text; at most ``rows_per_language`` of each."""
    family_of = FAMILY_OF if family_of is None else family_of
    known = docs.select(docs[key].alias("key"), docs[text].alias("text"), docs[lang].alias("label")).filter(
        "label is not null and text is not null")
    rows = [r for r in stratified(known, "label", "key", rows_per_language, "language") if has_letter(r["text"])]
    if not rows:
        return LanguageModel()
    x = np.stack([features(r["text"]) for r in rows])
    labels = np.array([r["label"] for r in rows])
    kin = np.array([family_of.get(v, v) for v in labels])
    gram = (x @ x.T).astype(np.float64)

    def weights(chosen: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x[chosen].T @ linear_svm(gram[np.ix_(chosen, chosen)], y).astype(np.float32)

    model = LanguageModel(families=sorted(set(kin.tolist())))
    everything = np.arange(len(rows))
    if len(model.families) > 1:
        model.against_rest = np.stack([weights(everything, np.where(kin == f, 1.0, -1.0)) for f in model.families], axis=1)
    columns = []
    for family in model.families:
        names = model.members[family] = sorted(set(labels[kin == family].tolist()))
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                chosen = np.flatnonzero((labels == a) | (labels == b))
                columns.append(weights(chosen, np.where(labels[chosen] == a, 1.0, -1.0)))
                model.pairs.append((a, b))
    if columns:
        model.between = np.stack(columns, axis=1)
    return model


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``lang_pred`` and ``lang_score``."""
    ship_package(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score")]
    source = docs.select(docs[text].alias("_text"), *[docs[c] for c in kept])
    shape = source.drop("_text").withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0)}).schema

    def run(batches):
        for part in slices(batches):
            found = [model.predict(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*kept, "lang_pred", "lang_score"])

    return source.mapInArrow(run, shape)
