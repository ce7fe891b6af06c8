"""The pipeline's stages on a small corpus with planted cases, against plain versions."""

import pytest
from test_joins_and_scans import brute_jaccard, plain_spans

import __spark_entry__ as entry
import corpus_pipeline
from tidepool.llm import langid, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.filter("doc_id = 5").first()["text"]
    more = [(9001, text, "en", "src1", len(text)), (9002, text + " extra", "en", "src2", 0), (9003, "12345 !!! 678", None, None, None),
            (9004, None, "en", "src1", None), (9005, "", "en", "src1", 0), (9001, text, "en", "src1", len(text)),
            (9006, "the and of password=hunter2222 for that was with", "en", "src1", 48), (None, "the and of that was with no key", "en", None, 1)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """What goes into each stage and what comes out, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{corpus}/documents.parquet"), [spark.read.parquet(f"{corpus}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_columns_stay(stages):
    for frame in stages[1:-1]:
        assert frame.schema == stages[0].schema


def test_language_keeps_all_with_letters(stages):
    gone = {r["doc_id"]: r["text"] for r in stages[0].join(stages[1].select("doc_id").distinct(), "doc_id", "left_anti").collect()}
    assert {9003, 9004, 9005} <= set(gone)
    assert all(not t or not langid.LETTER.search(t) for i, t in gone.items() if i is not None)


def test_toxicity_drops_what_it_scores_toxic(spark, stages, corpus):
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    gone = stages[1].join(stages[2].select("doc_id").distinct(), "doc_id", "left_anti").join(labels, "doc_id").filter("toxic is not null").collect()
    clean = stages[1].join(labels.filter("toxic = 0"), "doc_id").count()
    assert sum(r["toxic"] == 0 for r in gone) <= 0.1 * clean


def test_one_of_each_class_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect() if r["doc_id"] is not None]
    want = {i for i, (c, _) in brute_jaccard(dict(rows).items()).items() if c == i}
    got = [r["doc_id"] for r in stages[3].collect() if r["doc_id"] is not None]
    assert sorted(got) == sorted(want) and not {9001, 9002} & set(got)


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(before) == set(after) and not any(plain_spans(r["text"]) for r in after.values())
    assert after[9006]["text"] == "the and of [SECRET] for that was with"
    same = [i for i, t in before.items() if not plain_spans(t)]
    assert sum(after[i]["text"] == before[i] for i in same) >= 0.97 * len(same)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_all_is_packed(stages):
    pieces = stages[5].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in stages[4].collect()}
    total = sum(r["length"] for r in pieces)
    assert len({r["sequence_id"] for r in pieces}) <= 1.02 * total / 1024 + 4


def test_run_and_registration(spark, corpus, stages):
    assert corpus_pipeline.run(spark, corpus).count() == stages[5].count()
    names = set(entry.queries())
    assert {"pipeline"} | set(queries.QUERIES) <= names and set(entry.oracle_sql()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_empty_corpus(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_text_keeps_a_representative(spark):
    """Ids on rows with different texts, one of which has a copy or a near copy elsewhere."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, c), (9, d), (11, c + " more"), (12, d), (12, d), (3, d + " end"), (7, None), (7, ""), (7, ""), (None, a)]
    rows += [(20, f"{i} " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(1, a), (5, b), (9, c), (3, d + " end"), (7, None), (7, ""), (None, a), *rows[14:]]
    assert sorted(got, key=str) == sorted(want, key=str)
