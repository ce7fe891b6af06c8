"""Whitening, fill-in-the-middle and repeated passages against plain restatements; odd rows, odd tables."""

import hashlib
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import infill, queries, repeats, whitening
from tidepool.llm.common import table

# ---- whitening -------------------------------------------------------------------------------------


def matrices():
    draw = np.random.default_rng(1)
    q = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    for d in (1, 2, 3, 8, 64):
        yield np.cov(draw.standard_normal((5 * d + 3, d)).T).reshape(d, d)
    yield from (np.eye(20), np.zeros((5, 5)), np.diag(np.arange(6.0)), np.cov(draw.standard_normal((10, 64)).T))
    for values in ([5.0] * 10 + [1.0] * 30, 10.0 ** -np.arange(40), np.r_[np.linspace(1, 1 + 1e-12, 20), np.zeros(20)]):
        yield q @ np.diag(values) @ q.T


@pytest.mark.parametrize("v", list(matrices()))
def test_components_by_polar_factors(v):
    values, vectors = whitening.components(v, 32)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:32]).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values) < 1e-13 * size


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(2).standard_normal((30, 30))
    u = whitening.polar(a + a.T)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
    assert whitening.polar(np.diag([1.0, 0.0])) is None


def plain_whitening(rows, wanted=32):
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in rows}
    keys, n = sorted(x), len(x)
    sums = [sum(x[k][j] for k in keys) for j in range(len(x[keys[0]]))]
    off = np.array([[n * a - s for a, s in zip(x[k], sums)] for k in keys], dtype=object)
    y = off.astype(float) / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    return keys, n, (off * off).sum(axis=1).tolist(), y @ vectors / np.sqrt(values), values / np.trace(v)


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect() if r.embedding]
    keys, n, deviation, white, explained = plain_whitening(rows)
    got = queries.op11_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert got["vec_id"].tolist() == list(np.repeat(keys, 32)) and got["component"].tolist() == list(range(1, 33)) * n
    assert set(got["n"]) == {n} and got["deviation"].tolist() == list(np.repeat(deviation, 32))
    mine = got["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:32], explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    assert np.abs(mine.T @ mine / n - np.eye(32)).max() < 1e-10


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, -1.0]), (2, [1.0, 1.0, -1.0]), (None, [3.0, -2.0, 0.5]), (4, None), (5, [nan, 1.0, 1.0]),
            (6, [1.0, inf, 1.0]), (7, [1.0, None, 1.0]), (8, []), (9, [1.0, 2.0]), (10, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit(0))
    got = whitening.whiten(df, wanted=2).toPandas()
    assert sorted(got["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 2, 2, 2, 2] and set(got["n"]) == {4} and got["identity_error"].max() < 1e-12
    assert whitening.whiten(df.filter("vec_id > 3"), wanted=2).filter("vec_id < 9").count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, 0.0)] * 3


def test_whitening_without_spread_in_one_dimension(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got[got["component"] == 1]["whitened"].notna().all() and got[got["component"] > 1]["whitened"].isna().all()
    assert abs(got[got["component"] == 1]["explained"].iloc[0] - 1) < 1e-12 and got["identity_error"].iloc[0] < 1e-12


def test_whitening_does_not_depend_on_the_layout(spark, sf):
    vectors = table(spark, sf, "embeddings")
    a, b = (whitening.fit(v) for v in (vectors.repartition(7), vectors.repartition(1)))
    assert a.sums == b.sums and (a.vectors == b.vectors).all() and (a.values == b.values).all()


# ---- fill in the middle ----------------------------------------------------------------------------------


def plain_starts(text, unit):
    if unit == "char":
        return list(range(len(text)))
    if unit == "word":
        inside = [unicodedata.category(c)[0] in "LNM" for c in text]
        return [i for i in range(len(text)) if inside[i] and not (i and inside[i - 1])]
    breaks = "\n\r\v\f\x85  "
    return [i for i in range(len(text)) if i == 0 or (text[i - 1] in breaks and not (text[i - 1] == "\r" and text[i] == "\n"))]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_on_the_wavelet_matrix(unit):
    draw = random.Random(3)
    letters = "abc1 ́é\n\r\t.<>PSM\U0001f600ß² "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(300)] + ["", "x", "\n", "a" * 70_000, "é b " * 900]
    cutter = infill.Cutter(texts, unit)
    starts = [plain_starts(t, unit) for t in texts]
    assert cutter.units.tolist() == [len(s) for s in starts]
    k = np.array([draw.randrange(len(s) + 1) for s in starts])
    want = [0 if i == 0 else len(t) if i == len(s) else s[i] for t, s, i in zip(texts, starts, k)]
    assert cutter.cut(k).tolist() == want
    how = infill.Infill(unit=unit)
    for (output, form, *_), t in zip(infill.transform_slice(list(range(len(texts))), texts, how), texts):
        assert infill.restore(output, form, how) == t


def test_ranks_of_symbols():
    symbols = np.random.default_rng(5).integers(0, 32, 3000).astype(np.uint8)
    matrix, at = infill.WaveletMatrix(symbols, 5), np.arange(0, 3001, 7)
    for some in ([3], [0, 31], [1, 2, 3, 17], []):
        assert matrix.count(some, at).tolist() == [int(np.isin(symbols[:i], some).sum()) for i in at]


def plain_infill(key, text):
    t, digest = text or "", hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return len(t), "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_infill_of_odd_rows(spark):
    draw = random.Random(8)
    rows = [(i, "".join(draw.choice("aé\U0001f600 <PSM>\n") for _ in range(draw.randrange(40)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "x" * 300_000), (203, "a<P>b"), (3, "twice"), (3, "twice"), (-4, "below zero"), (204, "<" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("n", F.lit("y"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((k, *p[:4], sha(p[4]), sha(t or "")) for k, t in rows for p in [plain_infill(k, t)]), key=repr)
    assert sorted((tuple(r) for r in infill.digests(df).collect()), key=repr) == want
    texts = {r.doc_id: r.output for r in infill.transform(df).filter("doc_id between 0 and 199 and doc_id <> 3").collect()}
    assert texts == {k: plain_infill(k, t)[4] for k, t in rows if 0 <= k < 200 and k != 3}
    assert infill.digests(df.limit(0)).count() == 0
    assert infill.digests(spark.createDataFrame([(None, "abc")], "doc_id long, text string")).first().n == 3
    with pytest.raises(ValueError):
        infill.Infill(unit="page")


# ---- repeated passages ------------------------------------------------------------------------------------


def plain_repeats(rows, length=50):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1 if i is not None else 0):
            first[data[k:k + length]] = min(first.get(data[k:k + length], i), i)
    out = []
    for i, t in rows:
        data, hit = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(data) - length + 1 if i is not None else 0):
            if first[data[k:k + length]] < i:
                hit[k:k + length] = b"\1" * length
        rest = bytes(c for c, h in zip(data, hit) if not h)
        runs = sum(1 for k in range(len(data)) if hit[k] and not (k and hit[k - 1]))
        out.append((i, len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def quoting():
    """Texts that quote passages, whole and in part, with repeated ids, null ids and texts of one letter."""
    draw = random.Random(1)

    def words(n):
        return " ".join("".join(draw.choice("abcdé") for _ in range(draw.randrange(1, 5))) for _ in range(n))

    passages, rows = [words(draw.randrange(10, 80)) for _ in range(15)], []
    for _ in range(250):
        t = words(draw.randrange(60))
        for _ in range(draw.randrange(3)):
            t += draw.choice(["", "x", " "]) + draw.choice(passages)[draw.randrange(5):][:draw.randrange(30, 400)] + words(draw.randrange(5))
        rows.append((draw.randrange(200) if draw.random() < 0.95 else None, t))
    return rows + rows[:5] + [(7, None), (8, ""), (900, "a" * 3000), (901, "a" * 200), (902, "ab" * 400), (903, "b" + "ab" * 100), (3, "a" * 49),
                              (950, passages[0] + "\n" + passages[0]), (951, "a" * 50)]


@pytest.mark.parametrize("how", [repeats.Repeats(), repeats.Repeats(crowd=20), repeats.Repeats(common=10 ** 9, crowd=20),
                                 repeats.Repeats(crowd=3), repeats.Repeats(gram=50, crowd=30), repeats.Repeats(length=20, gram=7)])
def test_repeats_against_every_string(spark, quoting, how):
    df = spark.createDataFrame(quoting, "doc_id long, text string").repartition(3)
    got = repeats.remove(df, how, content=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_repeats(quoting, how.length)


def test_repeats_content_and_odd_tables(spark, quoting):
    df = spark.createDataFrame(quoting, "doc_id int, text string").withColumn("row", F.lit(1)).withColumn("data", F.lit("x"))
    for r in repeats.remove(df.filter("doc_id between 20 and 60")).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) + r.n_removed == r.n_bytes
        assert sum(s.high - s.low for s in r.removed) == r.n_removed and len(r.removed) == r.n_spans
    assert repeats.remove(df.limit(0)).collect() == []
    assert repeats.remove(df.filter("text is null")).count() == 1
    with pytest.raises(ValueError):
        repeats.Repeats(length=10, gram=11)


def test_every_string_lies_in_one_phrase():
    draw = random.Random(6)
    texts = [bytes(draw.choice(b"abc") for _ in range(draw.randrange(0, 400))) for _ in range(40)]
    texts.append(bytes(draw.choice(b"abcdefgh") for _ in range(repeats.SLICE_BYTES + 300)))
    found = {}
    for data, number, offset, low, high, trigger in repeats.Parser(repeats.Repeats()).phrases(texts):
        for i, at, a, b, t in zip(number.tolist(), offset.tolist(), low.tolist(), high.tolist(), trigger.tolist()):
            assert texts[i][at:at + b - a] == data[a:b].tobytes()
            for k in range(at, at + b - a - 49):
                assert (i, k) not in found
                found[i, k] = t
    assert len(found) == sum(max(0, len(t) - 49) for t in texts)
    by_string = {}
    for (i, k), t in found.items():
        if i < 40:
            assert by_string.setdefault(texts[i][k:k + 50], t) == t


def test_sorted_suffixes():
    draw = random.Random(2)
    entries = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(12, 40))) for _ in range(50)] + [bytes(14)]
    entry, offset, group = repeats.sorted_suffixes(entries, 12)
    strings = [entries[e][o:o + 12] for e, o in zip(entry, offset)]
    assert strings == sorted(strings) and len(strings) == sum(len(e) - 11 for e in entries)
    assert all((a == b) == (g == h) for a, b, g, h in zip(strings, strings[1:], group, group[1:]))
