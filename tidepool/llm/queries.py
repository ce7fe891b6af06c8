"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import fold_of, table

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import bpe

    return bpe.round_trip(table(spark, sf, "documents"), tokenizer_path())


def op3_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import vectordup

    return vectordup.near_duplicates(table(spark, sf, "embeddings"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import quality

    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels").filter(fold_of("doc_id", 3) != 1))
    return (quality.score(docs, model, keep=["doc_id"])
            .select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
                    (F.col("quality_score") >= 0.5).cast("int").alias("predicted")))


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings WHERE embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM classes LEFT JOIN counts USING (vec_id)"""


def op5_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import shingles

    return shingles.join(table(spark, sf, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\x0b\f]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE k / (p.n + q.n - k) >= 0.8),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
counts AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, doc_id = class_id AS kept FROM classes LEFT JOIN counts USING (doc_id)"""


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import secrets

    found = secrets.scan(table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.spans_text(F.col("found")).alias("spans"),
                        F.size(F.filter("found", lambda x: x["example"])).alias("n_examples"))


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import topk

    return topk.top_k(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


OP7_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def op8_langid(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import langid

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold_of("doc_id", 4) != 2))
    return (langid.predict(docs.drop("lang"), model, keep=["doc_id"])
            .select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")))


TOXIC_FROM = 0.3


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import toxicity

    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels").filter(fold_of("doc_id", 4) != 2))
    return (toxicity.score(docs, model, keep=["doc_id"])
            .select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"),
                    (F.col("toxicity") >= TOXIC_FROM).cast("int").alias("predicted")))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_urls(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import urlrules

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(repr, URL_RULES)) + " AS rules(host, path, verdict)")
    return urlrules.judge(table(spark, sf, "pages"), rules)


OP9_SQL = f"""
WITH rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES {", ".join(map(repr, URL_RULES))}),
found AS (SELECT c.*, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
          FROM cut c LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM found WHERE k = 1"""


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.llm import packing

    return packing.pack(table(spark, sf, "documents"), tokenizer_path(), capacity=1024, end_id=2)


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened components of every usable vector; exact sums and deviations."""
    from tidepool.llm import whitening

    return whitening.whiten(table(spark, sf, "embeddings"), wanted=32)


def op12_infill(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text cut in three and put in another order, and back, by digests."""
    from tidepool.llm import infill

    return infill.digests(table(spark, sf, "documents"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM d),
cut AS (SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
  OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
laid AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
  AS output_sha256, sha256(t) AS restored_sha256 FROM laid"""


def op13_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every whole text that stand in an earlier document, 50 at least in a row, taken out."""
    from tidepool.llm import repeats

    return repeats.remove(table(spark, sf, "documents"), content=False)


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS x FROM documents),
part AS (SELECT r, doc_id, 200 * c AS base, substr(x, 400 * c + 1, 498) AS p FROM (SELECT *, unnest(range(0, (len(x) // 2 + 150) // 200)) AS c FROM d)),
w AS (SELECT r, doc_id, base + i AS i, substr(p, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, len(p) // 2 - 49)) AS i FROM part)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
c AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (s) WHERE doc_id > least),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM c),
spans AS (SELECT r, min(i) AS low, max(i) + 50 AS high FROM g GROUP BY r, k),
gaps AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS was FROM spans),
cut AS (SELECT r, count(*) AS n, sum(high - low) AS gone, string_agg(substr(x, 2 * was + 1, 2 * (low - was)), '' ORDER BY low) AS kept, max(high) AS last
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)"""


QUERIES = {"op1_bpe": op1_bpe, "op2_toxicity": op2_toxicity, "op3_vectors": op3_vectors, "op4_quality": op4_quality, "op5_jaccard": op5_jaccard,
            "op6_secrets": op6_secrets, "op7_topk": op7_topk, "op8_langid": op8_langid, "op9_urls": op9_urls,
            "op10_packing": op10_packing, "op11_whitening": op11_whitening, "op12_infill": op12_infill, "op13_repeats": op13_repeats}
SQL: dict[str, str] = {"op3_vectors": OP3_SQL, "op5_jaccard": OP5_SQL, "op7_topk": OP7_SQL, "op9_urls": OP9_SQL,
                       "op12_infill": OP12_SQL, "op13_repeats": OP13_SQL}
