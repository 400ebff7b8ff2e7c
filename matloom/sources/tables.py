"""Reading and writing the engine's tables, manifests and documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def read_strings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all columns text; a byte order mark is dropped. columns: of the empty result where path is missing."""
    try:
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    except Exception as e:
        if columns is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """source_id, doi, title, pdf_url, local_pdf, enabled, notes, source_no; empty and repeated ids raise, with the line of the first."""
    raw = read_strings(spark, path).coalesce(1)
    col = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    out = raw.select(
        F.coalesce(F.nullif(col("source_id"), F.lit("")), col("key")).alias("source_id"), X.normalize_doi(col("doi")).alias("doi"), col("title").alias("title"), col("pdf_url").alias("pdf_url"),
        col("local_pdf").alias("local_pdf"), (~F.lower(col("enabled")).isin("0", "false", "no", "disabled")).alias("enabled"), col("notes").alias("notes"), F.monotonically_increasing_id().alias("source_no"),
    )
    # The header is line 1. A manifest is one small file, read as one partition, so the number is a row's place.
    bad = out.groupBy("source_id").agg(F.count("*").alias("count"), (F.min("source_no") + 2).alias("line")).filter("source_id = '' or count > 1").orderBy("line").limit(20).collect()
    if bad:
        raise ValueError("empty or repeated source ids: " + ", ".join(f"{r['source_id']!r} (line {r['line']})" for r in bad))
    return out


def paper_inputs(spark: SparkSession, reference: str | list) -> DataFrame:
    """Papers (paper_no, value, source_id, doi, title, notes, stable_id) from a list, a .csv, .json, .txt or .list file, or one reference."""
    if isinstance(reference, str):
        kind = Path(reference).suffix.lower()
        if kind == ".csv":
            reference = [r.asDict() for r in read_strings(spark, reference).toLocalIterator()]
        elif kind == ".json":
            raw = json.loads("".join(r["value"] for r in spark.read.text(reference, wholetext=True).collect()))
            reference = raw if isinstance(raw, list) else raw.get("papers") or raw.get("inputs") or []
        elif kind in (".txt", ".list"):
            reference = [r["value"].strip() for r in spark.read.text(reference).collect() if r["value"].strip()]
        else:
            reference = [reference]
    rows = []
    for item in reference:
        item = {"source": item} if isinstance(item, str) else item
        value = next((str(item[k]) for k in ("path", "file", "pdf", "url", "doi", "source") if item.get(k)), "")
        doi = item.get("doi") or (value if value.lower().startswith("doi:") else "")
        rows.append((value, str(item.get("source_id") or item.get("id") or ""), str(doi), str(item.get("title") or ""), str(item.get("notes") or "")))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "paper_no long, value string, source_id string, doi string, title string, notes string")
    df = df.withColumn("doi", X.normalize_doi(F.col("doi")))
    return df.withColumn("stable_id", X.stable_id(F.col("source_id"), F.col("doi"), F.col("value")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, sha256, is_pdf, text): bytes are decoded where they aren't a PDF, which needs a reader of its own."""
    df = spark.read.format("binaryFile").load(path)
    pdf = F.substr(F.col("content"), F.lit(1), F.lit(4)) == F.lit(b"%PDF")
    return df.select("path", F.sha2("content", 256).alias("sha256"), pdf.alias("is_pdf"), F.when(~pdf, F.decode("content", "UTF-8")).alias("text"))


def read_schema(spark: SparkSession, path: str | None) -> dict:
    """The extraction schema of a JSON file; the built-in one without a path."""
    from ..operators.agent import DEFAULT_SCHEMA

    if path is None:
        return DEFAULT_SCHEMA
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def read_numbers(spark: SparkSession, path: str, target: bool = False) -> DataFrame:
    """A CSV file of inferred types with row_id, a row's place in the file; of a target file the first column alone, as y.

    Rows of a feature file and of its target file belong together by their place, so join them on row_id. The file is read as one partition, which keeps the order.
    """
    df = spark.read.csv(path, header=True, inferSchema=True).coalesce(1)
    if target:
        df = df.select(F.col(f"`{df.columns[0]}`").cast("double").alias("y"))
    return df.withColumn("row_id", F.monotonically_increasing_id())


def replaced(df: DataFrame, path: str, columns: list[str], in_place: bool = False, backup: str = ".backup-agent") -> str | None:
    """Writes df as CSV with these columns. An existing path is an error, or with in_place is kept beside it under a name with `backup`, which is returned.

    The rows are written to another folder first, so path may be one that df reads.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    held = fs.exists(target)
    if held and not in_place:
        raise ValueError(f"refusing to overwrite {path} unless in_place is set")
    fresh = f"{path.rstrip('/')}.new"
    write_strings(df, fresh, columns)
    kept = f"{path.rstrip('/')}{backup}" if held else None
    if kept:
        fs.delete(jvm.org.apache.hadoop.fs.Path(kept), True)
        if not fs.rename(target, jvm.org.apache.hadoop.fs.Path(kept)):
            raise OSError(f"can't move {path} to {kept}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        raise OSError(f"can't move {fresh} to {path}")
    return kept


def write_strings(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with exactly these columns, missing ones and nulls empty. Refuses to overwrite."""
    df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns]).write.csv(path, header=True, mode="error", escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="error", ignoreNullFields=False)


def report(papers: DataFrame, counters: dict[str, int]) -> DataFrame:
    """One JSON row: the counters and an array of the papers."""
    rows = papers.agg(F.sort_array(F.collect_list(F.struct(*papers.columns))).alias("papers"))
    return rows.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in counters.items()], "papers")).alias("report"))
