"""The corpus pipeline: language, toxicity, near duplicates, secrets, packing.

Each stage reads what the one before wrote.  All but the last return the columns of ``documents``:

1. ``language`` drops texts in no learned language (null, without a letter, or with both decisions close to a toss-up).
2. ``toxicity`` drops texts scored toxic, with the threshold of the operator's query.
3. ``near_duplicates`` keeps one text, of the smallest id, of each class of copies and near copies; repeated rows of it once.
   Texts are judged, not ids: an id on rows with different texts keeps those that have no copy at a smaller id.
4. ``secrets`` masks every secret in the texts and keeps all documents.
5. ``packing`` returns the pieces of all documents with their places in sequences.

The first two learn from the rows they see, with the columns ``lang`` and the table ``labels``.  Rows with a null id pass the first four
stages as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import langid, packing, queries, secrets, shingles, toxicity
from tidepool.llm.common import keep, table
from tidepool.session import ship_package

LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    told = langid.predict(docs, model)
    return told.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < queries.TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = keep(shingles.judge(docs), "classes")
    stay = (classes.filter("doc_id is not null and first").groupBy(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole"))
            .agg(F.count("*").alias("_rows")))
    kept = docs.withColumn("_text", shingles.whole(F.col("text"))).join(
        stay.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_whole")))
    once = kept.filter("_rows = 1").select(*docs.columns)
    repeated = kept.filter("_rows > 1").dropDuplicates(["_id", "_whole"]).select(*docs.columns)
    return once.unionByName(repeated).unionByName(docs.filter("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, keep(secrets.scan(docs), "secrets"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path(), capacity=1024, end_id=2)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack)]

# Fitted models and the rounding of a linear program have no SQL form; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, "stage")
    return docs
