"""Encoding, toxicity, quality and language ID: exact round trips, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidepool.llm import bpe, common, langid, quality, queries, toxicity

ODD = [None, "", " ", "\n\n", "a", "  two  blanks ", "<|endoftext|>x<|endoftext|>", "日本語 text\t\ttabs", "…" * 50, "'ll 'LL don't", "1234567 890",
       "\x00 \x00", "é" * 5000, "word " * 30_000]
SHAPE = "doc_id long, text string, lang string, lang_pred int, toxicity string, quality_score string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, 1, "x", "y", "z") for i, t in enumerate(ODD)] + [(3, "\n\n", None, 1, "x", "y", "z"), (None, "no key", None, 1, "x", "y", "z")]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(queries.tokenizer_path())


def test_encoder_equals_the_library(codec, library):
    draw = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "日本", "1", "!", "<|endoftext|>", "aaaa", "\x00", "_", "\r\n", "ſ", "🙂", "́"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(2000)]
    texts += ["".join(draw.choice("abcdefghij etanios.") for _ in range(300)) for _ in range(200)] + [t for t in ODD if t]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want, text[:80]
        assert codec.decode(codec.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_encoder_steps_back(codec):
    """Pieces for which taking the longest token each time is wrong."""
    v = codec.vocabulary
    wrong = 0
    draw = random.Random(2)
    for _ in range(3000):
        piece = "".join(draw.choice("aeinorst") for _ in range(9)).encode()
        greedy = [t for _, (t, _) in v.automaton.iter_long(piece.decode())]
        wrong += v.encode_piece(piece) != greedy
    assert wrong > 100


def test_encode_and_decode_documents(spark, odd, library):
    path = queries.tokenizer_path()
    coded = bpe.encode_documents(odd, path)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in coded.collect())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    assert got == want
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded, path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert bpe.round_trip(odd.limit(0), path).count() == 0
    assert bpe.round_trip(odd, path).filter("doc_id = 1").first()["n_tokens"] == 0


def held_out(frame, labels, label):
    rows = frame.filter("held_out").join(labels, "doc_id").filter(f"{label} is not null").select("score", "predicted", label).collect()
    return np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    y, p = held_out(queries.op4_quality(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert (y == p).mean() > 0.99 and p[y == 0].mean() < 0.05


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    y, p = held_out(queries.op2_toxicity(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert p[y == 1].mean() > 0.7 and p[y == 0].mean() < 0.06


def test_toxic_stage_recall(spark):
    """What the pipeline's stage drops of the labelled texts of each language, and of the held-out texts of the query."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id", "toxic"), "doc_id")
    stay = {r["doc_id"] for r in corpus_pipeline.toxic(spark, docs, sf).select("doc_id").collect()}
    rows = docs.select("doc_id", "toxic", "lang").collect()
    assert np.mean([r["doc_id"] in stay for r in rows if r["toxic"] == 0]) > 0.96
    assert np.mean([r["doc_id"] not in stay for r in rows if r["toxic"] == 1]) > 0.83
    for lang in ("en", "fr", "de", "es"):
        assert np.mean([r["doc_id"] not in stay for r in rows if r["toxic"] == 1 and r["lang"] == lang]) > 0.6, lang
    y, p = held_out(queries.op2_toxicity(spark, sf), labels, "toxic")
    assert p[y == 1].mean() > 0.75


def test_spellings_without_a_count():
    draw = random.Random(3)
    made = lambda letters, k: ["".join(draw.choice(letters) for _ in range(8)) for _ in range(k)]
    words = made("bcdfgkmp", 100)
    toxic, clean = ([" ".join(made("etaoinshr", 100) + draw.sample(words, k)) for _ in range(n)] for k, n in ((40, 60), (0, 600)))
    found = toxicity.telling_spellings(toxic, clean)
    assert len(found) > 64


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_langid(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99


@pytest.fixture(scope="module")
def lessons(spark):
    good = ["the quiet river runs along the old stone wall and the children walk to school in the morning light",
            "she opened the letter slowly and read each line with care before she answered him in the evening"]
    docs = [(i, f"{good[i % 2]} number {i} of the series" + (" you awful gruntwit and gruntwit again" if i % 4 == 0 else ""), "en" if i % 3 else "de",
             int(i % 4 == 0), int(i % 5 != 0)) for i in range(200)]
    return (spark.createDataFrame([(i, t, g) for i, t, g, _, _ in docs], "doc_id long, text string, lang string"),
            spark.createDataFrame([(i, q, x) for i, _, _, x, q in docs] + [(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int"))


def test_models_on_odd_rows(spark, odd, lessons):
    docs, labels = lessons
    tox = toxicity.fit(docs, labels)
    found = toxicity.score(odd, tox)
    assert set(found.columns) == set(odd.columns) and found.count() == odd.count()
    assert found.filter("toxicity not between 0 and 1 or toxicity is null").count() == 0
    told = toxicity.score(docs, tox).join(labels.filter("toxic is not null").distinct(), "doc_id").select("toxicity", "toxic").collect()
    assert np.mean([(r["toxicity"] >= 0.3) == (r["toxic"] == 1) for r in told]) > 0.9
    good = quality.score(odd, quality.fit(docs, labels))
    assert good.count() == odd.count() and good.filter("quality_score not between 0 and 1 or quality_score is null").count() == 0
    told = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(odd, langid.fit(docs)).collect()}
    for i, t in enumerate(ODD):
        assert (told[i] == ("und", 0.0)) == (t is None or not any(c.isalpha() for c in t)), t


def test_models_without_lessons(spark, odd, lessons):
    docs, labels = lessons
    none = labels.limit(0)
    assert {r["toxicity"] for r in toxicity.score(odd, toxicity.fit(docs, none)).collect()} == {0.5}
    assert {r["quality_score"] for r in quality.score(odd, quality.fit(docs.limit(0), labels.filter("quality = 1"))).collect()} == {1.0}
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(odd)).collect()} == {"und"}
    one = langid.fit(docs.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in langid.predict(docs, one).collect()} == {"xx"}
    assert toxicity.score(odd.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_related_languages_are_told_apart_in_their_family(spark):
    """Three languages of one family and one outside: the pairs within the family decide by votes."""
    words = {"nl": ["het", "een", "van", "ijs", "zijn"], "de": ["das", "ein", "von", "eis", "sein"], "sv": ["det", "ett", "av", "is", "vara"],
             "fr": ["le", "une", "de", "glace", "etre"]}
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(words[g]) for _ in range(20)), g) for i, g in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 160"))
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 3
    told = langid.predict(docs.filter("doc_id >= 160"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.95


def test_fractions_are_no_letters(spark):
    assert not any(langid.has_letter(t) for t in ("", "½ ² ①", "12 _ - .", "\U0001f600")) and langid.has_letter("½ é") and langid.has_letter("3 字")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the house of the lord"] * 3)] + [(9, "½ ² ①", None)], "doc_id long, text string, lang string")
    told = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert told == {0: "en", 1: "en", 2: "en", 9: "und"}


def test_few_toxic_texts_still_make_a_model(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    clean = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(120)]
    vile = [" ".join(draw.choice(["zoxxer", "vurq", *words[:20]]) for _ in range(60)) for _ in range(40)]
    for toxic_texts in (vile[:1], [t for t in vile if sum(t.encode()) % 2 == 0][:8]):
        texts = clean + toxic_texts
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i >= len(clean))) for i in range(len(texts))], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        assert len(model.weights) and len(np.unique(np.round(model.scores(clean[:20] + vile), 9))) > 5


def test_samples_of_a_hot_key_are_bounded(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) as key", "if(id % 9 = 0, 'same', cast(id as string)) as text", "id % 2 as label")
    got = common.stratified(rows, "label", "key", 50, "x")
    assert len(got) == 100 and len({(r["key"], r["text"], r["label"]) for r in got}) == 100
    assert sorted(map(str, got)) == sorted(map(str, common.stratified(rows.repartition(5), "label", "key", 50, "x")))
    found = common.texts_for([{"key": 7, "label": 1}, {"key": 1, "label": 0}], rows, "key", "text")
    assert [v for v, _ in found] == [0, 1]
