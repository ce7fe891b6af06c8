"""Secret scan with corpus-wide ownership frequency.

One narrow pass finds candidates in every whole text: the three base kinds (an assignment to a telling name, an access key, a
long hex run) and opaque tokens, long mixed strings outside the base spans.  The hash of each candidate's value is then
counted over the corpus by distinct repositories and distinct owners, both pre-aggregated before they are shuffled.  A value that many
owners have is a widely copied example; one that stays with at most ``few_owners`` owners looks live.

Base spans always stay.  The method adds the opaque tokens that look live, as kind ``owned``, and says of every base span whether
its value is an example.  Spans count code points; the end is exclusive.

Null texts count as empty.  A null owner or repository counts as one owner or repository of its own.  Repeated rows are found
like any other and do not add owners.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import keep, slices, texts_of
from tidepool.session import ship_package

# The base patterns, in the order in which kinds of the same start are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are taken whole, so a shorter match can only fail
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
MAYBE_OPAQUE = "[A-Za-z0-9+/_-]{20,}"  # every text with an opaque token has such a run
LEAST_BITS = 3.5  # entropy per character of an opaque token


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, by start and then kind."""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    out.sort()
    return out


def bits(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of mixed letters and digits that no base span touches."""
    out, at = [], 0
    ends = sorted((s, e) for s, _, e, _ in base)
    for m in OPAQUE.finditer(text):
        value = m[0]
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if any(s < m.end() and e > m.start() for s, e in ends[at:at + 4]):
            continue
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and bits(value) >= LEAST_BITS:
            out.append((m.start(), 3, m.end(), value))
    return out


def written(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


CANDIDATE = "struct<start:int,kind:int,stop:int,value:binary>"
FOUND = f"n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<{CANDIDATE}>"


def candidates(docs: DataFrame, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The carried columns with the base counts, their digest and all candidates (values as hashes, never as text)."""
    ship_package(docs.sparkSession)
    source = docs.select(docs[text].alias("_text"), *[docs[c] for c in carry])
    fields = source.drop("_text").schema
    for column in source.sparkSession.createDataFrame([], FOUND).schema:
        fields = fields.add(column)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.binary())]))

    def run(batches):
        for part in slices(batches):
            counts, digests, found = ([], [], []), [], []
            for text in texts_of(part, "_text"):
                base = base_spans(text)
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                found.append([{"start": s, "kind": k, "stop": e, "value": hashlib.blake2b(v.encode(), digest_size=16).digest()}
                              for s, k, e, v in sorted(base + opaque_spans(text, base))])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(found, kind)],
                names=fields.names)

    return source.mapInArrow(run, fields)


def ownership(found: DataFrame, *, owner: str, repo: str) -> DataFrame:
    """(value, owners, repos) of every candidate value in the corpus."""
    each = found.select(F.explode("candidates.value").alias("value"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"))
    pairs = each.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    repos = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return repos.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
         few_owners: int = 1) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, found) of every row.

    ``found`` is an array of (start, kind, stop, example) by start and kind: the base spans, and the opaque tokens that look live.
    """
    docs = docs.select(docs[key].alias("_key"), docs[text].alias("_text"), docs[owner].alias("_owner"), docs[repo].alias("_repo"))
    first = candidates(docs, text="_text", carry=["_key", "_owner", "_repo"]).withColumn("_row", F.monotonically_increasing_id())
    first = keep(first, "candidates")
    counts = ownership(first, owner="_owner", repo="_repo")
    each = first.filter(F.size("candidates") > 0).select("_row", F.explode("candidates").alias("c")).select(
        "_row", "c.start", "c.kind", "c.stop", "c.value")
    judged = (each.join(counts, "value").withColumn("example", F.col("owners") > few_owners)
              .filter("kind < 3 or not example")
              .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "example"))).alias("found")))
    return first.join(judged, "_row", "left").select(
        F.col("_key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,stop:int,example:boolean>>")).alias("found"))


def spans_text(found) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``mask``, overlapping spans by one; other texts stay as they are.

    Base spans follow from a text alone.  Only texts that hold an opaque token meet ``found``, of which one row for a key is
    used (equal texts have equal spans); the others are not shuffled.  ``n_chars``, if there is one, is counted anew.
    """
    ship_package(docs.sparkSession)
    names = docs.columns
    opaque = F.coalesce(F.col(text).rlike(MAYBE_OPAQUE), F.lit(False))
    spans = found.select(F.col(key).alias("_key"), F.filter("found", lambda x: x["kind"] == 3).alias("_owned")).filter(
        F.size("_owned") > 0).dropDuplicates(["_key"]).select("_key", F.transform("_owned", lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"))).alias("_owned"))
    none = F.lit(None).cast("array<struct<start:int,stop:int>>").alias("_owned")
    alone = docs.filter(~opaque).select(*[docs[c] for c in names], none)
    met = docs.filter(opaque).join(spans.hint("shuffle_hash"), docs[key] == spans["_key"], "left").select(
        *[docs[c] for c in names], "_owned")

    def run(batches):
        for part in slices(batches):
            texts = part.column(names.index(text)).to_pylist()
            owned = part.column(len(names)).to_pylist()
            changed = False
            for i, t in enumerate(texts):
                if t:
                    where = [(s, e) for s, _, e, _ in base_spans(t)] + [(w["start"], w["stop"]) for w in owned[i] or []]
                    if where:
                        texts[i], changed = masked(t, where, mask), True
            if changed:
                part = part.set_column(names.index(text), text, pa.array(texts, part.schema.field(text).type))
            yield part.select(names)

    clean = alone.unionByName(met).mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else clean


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for start, stop in sorted(spans):
        if stop > at:
            if start >= at:
                out.append(text[at:start] + mask)
            at = stop
    return "".join(out) + text[at:]
