"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, decontam, fingerprints, langid, neardup, pii, quality, substrings, toxicity, urlfilter

RULES = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def fold(n: int) -> Column:
    """The rest of crc32(doc_id as text) by n, which deals labelled rows into those to learn from and those held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rules_from(RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.filter(fold(5) != 0))
    return langid.predict(documents.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), model)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold(4) != 2).select("doc_id", F.col("quality").alias("y"))
    model = quality.train(documents, labels)
    out = quality.scored(documents.select("doc_id", (fold(4) == 2).alias("held_out"), "text"), model, keep_text=False)
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold(5) != 0).select("doc_id", F.col("toxic").alias("y"))
    model = toxicity.train(documents, labels)
    out = toxicity.scored(documents.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_fingerprints, op2_url_filters, op3_substring_dedup, op4_near_duplicates, op5_language_id, op6_bpe, op7_quality, op8_decontamination, op9_pii, op10_toxicity)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = urlfilter.UPPER, urlfilter.LOWER

_OP2 = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT s.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""

_OP4 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
undirected AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT undirected.v, reach.root FROM reach JOIN undirected ON undirected.u = reach.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_WORDS8 = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(u=_UPPER, l=_LOWER)

_OP8 = f"""
WITH items AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
docs AS MATERIALIZED (SELECT doc_id, {_WORDS8} AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM docs, lengths, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) AS t(i) WHERE len(w) >= m),
hits AS MATERIALIZED (SELECT doc_id, i, m, item_id FROM places JOIN windows USING (m, s)),
hit_words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole result SQL can express."""
    return {"op2_url_filters": _OP2, "op4_near_duplicates": _OP4, "op8_decontamination": _OP8}
