"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

A piece of text is encoded without replaying merges.  An Aho-Corasick automaton over the vocabulary gives the longest token
that starts at each byte.  The encoder walks left to right, takes the longest token whose pair with the token before it is
*compatible* (the two, merged on their own, stay apart), tries the next shorter prefix token otherwise and steps back at a dead
end.  Positions known to be dead are never entered again, so the walk is linear.  A sequence whose adjacent pairs are all
compatible is the result of the merges, and there is only one.

Texts are cut into pieces by the pre-tokenizer's pattern.  Where a text has no runs of white space, cutting it at its
single blanks and line ends gives chunks that the pattern never crosses, so that whole chunks come from a bounded cache.

Null texts count as empty: no tokens, empty decoded text.  Texts are never cut; lone special tokens in a text become their id.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidepool.llm.common import slices, texts_of
from tidepool.session import ship_package

# The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_CHUNKS = 300_000  # chunks and pieces that a task remembers
PLAIN = "\u0250"  # letters below it are letters in every version of Unicode
STOPS = (".", ",", ";", ":", "!", "?")  # cut off a word by the pattern
LINE = "\0"  # stands for a line end inside the chunks


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 characters stand for themselves, the rest follow from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    """Bytes of the tokens of a tokenizer file that are not special, by id."""
    alphabet = byte_alphabet()
    special = {t["content"] for t in spec["added_tokens"]}
    return {n: bytes(alphabet[c] for c in text) for text, n in spec["model"]["vocab"].items() if text not in special}


class Vocabulary:
    """Token bytes, merge ranks and the pair-compatibility rule of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for number, data in token_bytes(spec).items():
            self.bytes[number] = data
        for text, number in self.special.items():
            self.bytes[number] = text.encode()
        self.rank = [-1] * size  # -1: a single byte
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = vocab[_joined(merge)]
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (left, right), rank
                self.merged[left, right] = whole
        self._alone: dict[int, bool] = {}
        usable = {b: n for n, b in enumerate(self.bytes) if b and n not in self.special.values() and self.alone(n)}
        self.shorter: list[int] = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for data, number in usable.items():
            for cut in range(len(data) - 1, 0, -1):
                if (prefix := usable.get(data[:cut])) is not None:
                    self.shorter[number] = prefix
                    break
            self.automaton.add_word(data.decode("latin-1"), (number, len(data)))
        self.automaton.make_automaton()
        self.length = [len(b) for b in self.bytes]
        self._fit: dict[tuple[int, int], bool] = {}

    def alone(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        known = self._alone.get(token)
        if known is None:
            parts = self.parts[token]
            known = parts is None or (self.alone(parts[0]) and self.alone(parts[1])
                                      and self._apart(*parts, self.rank[token]))
            self._alone[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged together, give exactly these two tokens."""
        known = self._fit.get((left, right))
        if known is None:
            if len(self._fit) >= CACHE_CHUNKS:
                self._fit.clear()
            known = self._fit[left, right] = self._apart(left, right, len(self.merged) + 1)
        return known

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the border of ``left`` and ``right`` comes before merge ``before`` or before the merges that
        make the two.  Goes back in time: undoes the latest merge beside the border, then looks for a merge across it
        that would have come first.  Equal merges happen from left to right, so one across beats an equal one on its right."""
        rank = self.rank
        while True:
            whole = self.merged.get((left, right))
            if whole is not None and rank[whole] < before:
                return False
            if rank[left] > rank[right]:
                before, left = rank[left], self.parts[left][1]
            elif rank[right] >= 0:
                before, right = rank[right] + 1, self.parts[right][0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one piece of the pre-tokenizer."""
        size, length, shorter, fit = len(data), self.length, self.shorter, self._fit
        data = data.decode("latin-1")
        greedy = [token for _, (token, _) in self.automaton.iter_long(data)]
        known = [fit[pair] if pair in fit else self.compatible(*pair) for pair in pairwise(greedy)]
        if False not in known:  # the walk never had to try a shorter token
            return greedy
        longest = [-1] * size
        for end, (token, width) in self.automaton.iter(data):
            longest[end - width + 1] = token  # ends only grow, so the longest stays
        token = longest[0]
        dead = bytearray(size + 1)
        out = [token]
        at = length[token]
        token = longest[at]
        while True:
            if token >= 0:
                end = at + length[token]
                if not dead[end]:
                    last = out[-1] if out else -1
                    fits = fit.get((last, token))
                    if fits is None:
                        fits = last < 0 or self.compatible(last, token)
                    if fits:
                        out.append(token)
                        if end == size:
                            return out
                        at, token = end, longest[end]
                        continue
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]


class Chunks:
    """Whole texts to ids by cached chunks; ``_by_pattern`` codes what is new, see ``Codec``."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.chunks: dict[str, bytes | None] = {}

    def _by_pattern(self, text: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers."""
        if not text:
            return np.empty(0, np.uint32)
        if any(s in text for s in self.special):
            parts = [np.array([self.special[p]], np.uint32) if p in self.special else self.encode(p)
                     for p in self.split.split(text) if p]
            return np.concatenate(parts)
        coded = self._by_chunks(text)
        return np.frombuffer(self._by_pattern(text) if coded is None else coded, np.uint32)

    def _by_chunks(self, text: str) -> bytes | None:
        if LINE in text:
            return None
        parts = text.replace("\n", " " + LINE).split(" ")
        first = self._by_pattern(parts[0])
        del parts[0]
        get = self.chunks.get
        found = [get(p, 0) for p in parts]
        if 0 in found:
            if len(self.chunks) >= CACHE_CHUNKS:
                self.chunks.clear()
            for i, coded in enumerate(found):
                if coded == 0:
                    found[i] = self._chunk(parts[i])
        if None in found or parts and (first == b"" or text[len(text.split(" ", 1)[0].split("\n", 1)[0]) - 1].isspace()):
            return None
        return first + b"".join(found)

    def _chunk(self, part: str) -> bytes | None:
        """Ids of a blank or line end with what follows it; None where white space follows, or stands at its end."""
        if part in self.chunks:
            return self.chunks[part]
        coded = self.chunks[part] = self._new_chunk(part)
        return coded

    def _new_chunk(self, part: str) -> bytes | None:
        whole = "\n" + part[1:] if part[:1] == LINE else " " + part
        return None if len(whole) == 1 or whole[1].isspace() or whole[-1].isspace() else self._by_pattern(whole)


class Codec(Chunks):
    """Encoder by backtracking and decoder, with bounded caches; one per Python worker."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        super().__init__(self.vocabulary.special)
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        lengths = [len(b) for b in self.vocabulary.bytes]
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.pool = np.frombuffer(b"".join(self.vocabulary.bytes), np.uint8)

    def _new_chunk(self, part: str) -> bytes | None:
        if part.isalpha() and max(part) < PLAIN:
            return self._piece(" " + part)
        if part[-1:] in STOPS and part[:-1].isalpha() and max(part) < PLAIN:
            return self._piece(" " + part[:-1]) + self._piece(part[-1])
        return super()._new_chunk(part)

    def _piece(self, piece: str) -> bytes:
        coded = self.pieces.get(piece)
        if coded is None:
            if len(self.pieces) >= CACHE_CHUNKS:
                self.pieces.clear()
            coded = self.pieces[piece] = array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()
        return coded

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered from one pool by their offsets."""
        if not len(ids):
            return b""
        start = self.starts[ids]
        width = self.starts[ids.astype(np.int64) + 1] - start
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        shift += np.arange(len(shift))
        return self.pool[shift].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): the token ids of every whole text; a null text has none."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        coder = codec(tokenizer)
        for part in slices(batches):
            ids = [coder.encode(t).astype(np.int32) for t in texts_of(part, "text")]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                                             names=[key, "ids"])

    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_documents(coded: DataFrame, tokenizer: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of every id array; a null array gives the empty text."""
    ship_package(coded.sparkSession)
    kind = coded.schema[key].dataType.simpleString()

    def run(batches):
        coder = codec(tokenizer)
        for part in slices(batches):
            texts = [coder.decode(np.asarray([] if x is None else x, np.int64)) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return coded.select(coded[key], coded[ids].alias("ids")).mapInArrow(run, f"{key} {kind}, text string")


def round_trip(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass without a shuffle.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        coder = codec(tokenizer)
        decimal = [str(i) for i in range(len(coder.vocabulary.bytes))]
        for part in slices(batches):
            counts, coded, decoded = [], [], []
            for t in texts_of(part, "text"):
                ids = coder.encode(t)
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(
        run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _joined(merge: str | list[str]) -> str:
    return merge.replace(" ", "") if isinstance(merge, str) else "".join(merge)
