"""The corpus pipeline: from raw documents to token counts, one written table a stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents. Null texts count as empty; empty tables pass
through all stages; rows that repeat doc_id and text are treated alike, and one of them is left by the near-duplicate stage;
columns beside doc_id and text pass through whatever their names (n_chars follows the text).
"""

from __future__ import annotations

import public_tokenizers
from matloom.llm import bpe, decontam, neardup, pii, quality
from matloom.session import prepare, table, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a lower quality score go.
LEAST_QUALITY = 0.7


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches LEAST_QUALITY, learned from the labels of all."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    model = quality.train(docs, labels)
    return quality.selected(docs, model, LEAST_QUALITY)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked at a similarity of 0.8 of five-word shingles."""
    return neardup.deduplicated(docs, k=5, percent=80)


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in benchmark windows."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of each document."""
    return bpe.encoded(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", by_quality),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_contamination),
    ("personal data", without_personal_data),
    ("byte-level BPE", tokenized),
]

#: The stages learn models and search approximately indexed sets: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again. The folder goes with the driver."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
