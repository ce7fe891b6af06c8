"""Fill-in-the-middle transformation with cuts found on a wavelet matrix over character classes.

Every code point gets a class (letter, digit, mark, blank, line break, punctuation, other) and a flag for each unit that begins there, packed in
one symbol.  The symbols of a slice of texts, laid end to end, stand in a wavelet matrix: a bit vector a symbol bit, each stably
partitioned by the one before, with ranks at every word.  The number of units that begin before a position is a sum of ranks, over the symbols
that begin a unit; the two cuts are found for all texts of the slice at once by bisection on these sums.  Cuts count in units:
``char`` (code points), ``word`` (runs of letters, digits and marks) or ``line``.

A cut after ``k`` of ``m`` units stands where unit ``k + 1`` begins, at the text's end for ``k = m`` and at its start for ``k = 0``; what is before
the first unit goes with it.  How often and where follows from a SHA-256 of the seed and the key, so that every run and layout gives the same.

A null text is empty.  An empty text, or one that holds a sentinel, stays plain; a null key is hashed as ``null``.  Texts are taken
whole whatever their length; rows that repeat give the same each time.
"""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.common import slices, texts_of
from tidepool.session import ship_package

LETTER, DIGIT, MARK, BLANK, BREAK, PUNCTUATION, OTHER = range(7)
BY_CATEGORY = {"L": LETTER, "N": DIGIT, "M": MARK, "Z": BLANK, "P": PUNCTUATION, "S": PUNCTUATION}
CLASS_BITS = 3
STARTS = {"word": 1 << CLASS_BITS, "line": 2 << CLASS_BITS}  # flags above the class
BITS = CLASS_BITS + len(STARTS)
SLICE_TEXTS = 1024
SLICE_CHARS = 1 << 21


@dataclass(frozen=True)
class Infill:
    """seed: goes into the hash with the key; plain, spm: percent of texts left alone, and of the others given suffix first."""

    unit: str = "char"
    seed: int = 1
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in ("char", *STARTS):
            raise ValueError(f"no such unit: {self.unit}")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


# ---- rank over character classes -------------------------------------------------------------------


class RankBits:
    """A bit vector with counts of ones before every word of it."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of sets of symbols in a sequence of ``bits``-bit symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in reversed(range(bits)):
            bit = (symbols >> b) & 1 == 1
            self.levels.append((RankBits(bit), len(bit) - int(np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def count(self, symbols: list[int], at: np.ndarray) -> np.ndarray:
        """Occurrences of any of the symbols before each position: the sum of their ranks, with common leading bits followed once."""
        total = np.zeros(len(at), np.int64)
        open_nodes = [(0, np.zeros_like(at), at)]  # leading bits, where their range begins, where the positions' share of it ends
        for b, (level, zeros) in zip(reversed(range(self.bits)), self.levels):
            ones_wanted = {s >> b for s in symbols}
            below = []
            for lead, low, high in open_nodes:
                low_ones, high_ones = level.rank(low), level.rank(high)
                if 2 * lead in ones_wanted:
                    below.append((2 * lead, low - low_ones, high - high_ones))
                if 2 * lead + 1 in ones_wanted:
                    below.append((2 * lead + 1, zeros + low_ones, zeros + high_ones))
            open_nodes = below
        for _, low, high in open_nodes:
            total += high - low
        return total


_known = np.full(0x110000, 255, np.uint8)


def classes_of(codes: np.ndarray) -> np.ndarray:
    """Class of every code point."""
    found = _known[codes]
    if (found == 255).any():
        for c in np.unique(codes[found == 255]):
            ch = chr(c)
            _known[c] = BREAK if ch in "\n\r\v\f\x85\u2028\u2029" else BLANK if ch == "\t" else BY_CATEGORY.get(unicodedata.category(ch)[0], OTHER)
        found = _known[codes]
    return found


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the texts end to end, where each text begins and the last ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    kind = classes_of(codes)
    starts = np.zeros(len(codes) + 1, bool)
    starts[bounds] = True
    starts = starts[:-1]
    before = np.concatenate([[OTHER], kind[:-1]]).astype(np.uint8)[:len(kind)]
    inside, inside_before = kind <= MARK, (before <= MARK) & ~starts
    symbol = kind.copy()
    symbol[inside & ~inside_before] |= STARTS["word"]
    crlf = (np.concatenate([[0], codes[:-1]])[:len(codes)] == 13) & (codes == 10)  # one break
    symbol[starts | ((before == BREAK) & ~crlf)] |= STARTS["line"]
    return symbol, bounds


def counted(unit: str) -> list[int]:
    """The symbols whose occurrences count as beginnings of a unit."""
    return [s for s in range(1 << BITS) if s % (1 << CLASS_BITS) <= OTHER and (unit == "char" or s & STARTS[unit])]


class Cutter:
    """Units and cuts of a slice of texts."""

    def __init__(self, texts: list[str], unit: str):
        symbols, self.bounds = symbols_of(texts)
        present = np.bincount(symbols, minlength=1 << BITS)
        self.symbols = [s for s in counted(unit) if present[s]]
        self.matrix = WaveletMatrix(symbols, BITS)
        self.before = self.matrix.count(self.symbols, self.bounds)

    @property
    def units(self) -> np.ndarray:
        return np.diff(self.before)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Offset in each text of the cut after ``k`` of its units; ``k`` may hold several rows of cuts."""
        start = np.broadcast_to(self.bounds[:-1], k.shape).ravel()
        goal = (self.before[:-1] + k).ravel()
        low, high = start.copy(), np.broadcast_to(self.bounds[1:], k.shape).ravel().copy()
        while len(still := np.flatnonzero(low < high)):  # the greatest position with at most ``goal`` beginnings before it
            mid = (low[still] + high[still] + 1) >> 1
            fits = self.matrix.count(self.symbols, mid) <= goal[still]
            low[still], high[still] = np.where(fits, mid, low[still]), np.where(fits, high[still], mid - 1)
        return np.where(k == 0, 0, (low - start).reshape(k.shape))


# ---- the transformation ------------------------------------------------------------------------------


def draws(seed: int, key) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def restore(output: str, form: str, how: Infill = Infill()) -> str:
    """The text that was transformed, from the output and its form alone."""
    if form == "plain":
        return output
    p, s, m = how.sentinels
    if form == "psm":
        prefix, _, rest = output[len(p):].partition(s)
        suffix, _, middle = rest.partition(m)
    else:
        suffix, _, rest = output[len(s):].partition(p)
        prefix, _, middle = rest.partition(m)
    return prefix + middle + suffix


def transform_slice(keys: list, texts: list[str], how: Infill) -> list[tuple[str, str, int, int, int]]:
    """(output, form, units, cut, cut) of each text."""
    cutter = Cutter(texts, how.unit)
    n = cutter.units
    h = np.array([draws(how.seed, k) for k in keys], np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, second = cutter.cut(np.stack([np.minimum(one, two), np.maximum(one, two)])).tolist()
    p, s, m = how.sentinels
    out = []
    for i, t in enumerate(texts):
        a, b = first[i], second[i]
        if not t or any(x in t for x in how.sentinels) or h[i, 2] % 100 >= 100 - how.plain:
            out.append((t, "plain", int(n[i]), a, b))
        elif h[i, 3] % 100 < how.spm:
            out.append((f"{s}{t[b:]}{p}{t[:a]}{m}{t[a:b]}", "spm", int(n[i]), a, b))
        else:
            out.append((f"{p}{t[:a]}{s}{t[b:]}{m}{t[a:b]}", "psm", int(n[i]), a, b))
    return out


def _parts(texts: list[str]):
    """Ranges of texts of about ``SLICE_CHARS`` code points."""
    lo, chars = 0, 0
    for i, t in enumerate(texts):
        if i > lo and chars + len(t) > SLICE_CHARS:
            yield lo, i
            lo, chars = i, 0
        chars += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _run(docs: DataFrame, how: Infill, key: str, text: str, columns, fields: str) -> DataFrame:
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, SLICE_TEXTS):
            keys, texts = part.column(0).to_pylist(), texts_of(part, "t")
            for lo, hi in _parts(texts):
                done = transform_slice(keys[lo:hi], texts[lo:hi], how)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), *columns(texts[lo:hi], done)],
                                                 names=[key, *(f.split()[0] for f in fields.split(", "))])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"`{key}` {kind}, {fields}")


def transform(docs: DataFrame, how: Infill = Infill(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, output, form, units, prefix_chars, middle_chars) of every text."""

    def columns(texts, done):
        return [pa.array([d[0] for d in done]), pa.array([d[1] for d in done]), pa.array([d[2] for d in done], pa.int64()), *_spans(done)]

    return _run(docs, how, key, text, columns, "output string, form string, units long, prefix_chars long, middle_chars long")


def _spans(done) -> list[pa.Array]:
    return [pa.array([None if d[1] == "plain" else d[3] for d in done], pa.int64()),
            pa.array([None if d[1] == "plain" else d[4] - d[3] for d in done], pa.int64())]


def digests(docs: DataFrame, how: Infill = Infill(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): ``transform`` and back, by digests only."""

    def sha(t: str) -> str:
        return hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()

    def columns(texts, done):
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([d[1] for d in done]), *_spans(done), pa.array([sha(d[0]) for d in done]),
                pa.array([sha(restore(d[0], d[1], how)) for d in done])]

    return _run(docs, how, key, text, columns,
                "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
