"""Building the dataset: review rows, validation, duplicate keys, appending and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed names: the dataset's columns in order.
DATASET = ["Crystal_structure", "temperature", "N_type_carrier", "Crystal_form", "Direction"]
DEFAULT_RULES = {"required_elements": [], "temperature_K": [0, 2000], "mobility_cm2_Vs": [0, 10000], "Crystal_form": [], "Direction": []}


def projected(df: DataFrame, columns: list[str] = DATASET) -> DataFrame:
    """Only the columns, missing ones and nulls as empty text."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def numeric_key(cols: list[str] = DATASET) -> Column:
    """The review build's key: numbers by value (8 and 10 significant digits), what is no number as empty, formulas without white space, codes trimmed."""

    def number(c: str, digits: int) -> Column:
        v = X.parse_number(F.col(c))
        size = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(F.when(v != 0, v)))))
        scale = F.pow(F.lit(10.0), digits - 1 - size)
        return F.coalesce((F.round(v * scale) / scale).cast("string"), F.lit(""))

    formula, temperature, mobility, *codes = cols
    return F.concat_ws("\x1f", F.regexp_replace(F.coalesce(F.col(formula), F.lit("")), r"(?U)\s+", ""), number(temperature, 8), number(mobility, 10), *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in codes])


def string_key(cols: list[str] = DATASET) -> Column:
    """The agent's key: text without white space, so 300 and 300.0 differ."""
    return F.concat_ws("\x1f", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)\s+", "") for c in cols])


def accepted(base: DataFrame, new: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """new with `added`: true for the first row of a key (by order) that base lacks. A key is hashed once on either side."""
    known = base.select(key.alias("_key")).distinct().withColumn("_known", F.lit(True))
    rows = new.withColumn("_key", key).join(known, "_key", "left")
    first = F.row_number().over(W.partitionBy("_key").orderBy(*order)) == 1
    return rows.withColumn("added", F.col("_known").isNull() & first).drop("_key", "_known")


def approved(review: DataFrame) -> DataFrame:
    return review.filter(F.lower(F.trim("review_status")) == "approved")


def validation_notes(rules: dict | None = None, formula: str = DATASET[0], temperature: str = DATASET[1], mobility: str = DATASET[2]) -> Column:
    """Array of what is wrong with a row, in a fixed order; empty if nothing is."""
    rules = DEFAULT_RULES | (rules or {})
    f, c = F.col(formula), F.coalesce
    need = F.array(*[F.lit(x) for x in rules["required_elements"]]).cast("array<string>")
    (t0, t1), (m0, m1) = rules["temperature_K"], rules["mobility_cm2_Vs"]
    told = lambda t, m: [
        F.when(c(f, F.lit("")) == "", "chemical formula missing").when(F.size(F.array_except(need, X.elements_of(f))) > 0, f"formula does not contain required elements {sorted(rules['required_elements'])}"),
        F.when(f.rlike("[δxyz]"), "formula contains a symbolic stoichiometry variable"),
        F.when(t.isNull(), "temperature missing").when((t < t0) | (t > t1), "temperature outside configured range"),
        F.when(m.isNull(), "mobility missing").when((m <= m0) | (m > m1), "mobility outside configured range"),
    ]
    codes = []
    for name in ("Crystal_form", "Direction"):
        value, allowed = c(F.col(name).cast("string"), F.lit("")), [str(x) for x in rules[name]]
        codes.append(F.when(value == "", f"{name} missing").when(~value.isin(allowed) if allowed else F.lit(False), F.concat(F.lit(f"{name} has invalid code '"), value, F.lit("'"))))
    numbers = F.struct(X.parse_number(F.col(temperature)).alias("t"), X.parse_number(F.col(mobility)).alias("m"))
    return X.let(numbers, lambda n: F.array_compact(F.array(*told(n["t"], n["m"]), *codes)))


def best_candidates(df: DataFrame, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """The most confident row of each (source, formula, temperature, mobility, page), the first in emission order (seq) among equals; of each paper, if by names one."""
    key = [*(by or []), "source_id", F.regexp_replace("Crystal_structure", r"(?U)\s+", ""), "temperature", "N_type_carrier", "page"]
    best = W.partitionBy(*key).orderBy(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)).desc(), seq)
    rows = df.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    return rows.orderBy("source_id", F.coalesce(F.col("page").try_cast("int"), F.lit(0)), "candidate_id")


def refreshed(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """The review queue after a new extraction: decided or annotated rows keep their data, status and notes; those not found again stay if decided or manual.

    Of old rows of one id, the last by seq, where old has that column, decides on a new row; of those not found again each stays. Old rows without an id decide on none.
    """
    kept = [*DATASET, "review_status", "reviewer_notes"]
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    order = F.col(seq) if seq in old.columns else F.lit(0)
    last = old.filter(text("candidate_id") != "").groupBy("candidate_id").agg(F.max_by(F.struct(*old.columns), order).alias("o"))
    decided = text("o.review_status").isin("approved", "rejected") | (text("o.reviewer_notes") != "")
    found = new.select("candidate_id", F.struct(*new.columns).alias("n")).join(last, "candidate_id", "left")
    value = lambda c: F.when(decided, F.coalesce(f"o.{c}", f"n.{c}")).otherwise(F.col(f"n.{c}")) if c in kept else F.col(f"n.{c}")
    rows = found.select(*[value(c).alias(c) for c in new.columns], F.lit(0).alias("carried"))
    stays = (text("evidence_type") == "manual") | text("review_status").isin("approved", "rejected")
    rest = old.filter(stays).join(new.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return rows.unionByName(rest.select(*[F.col(c) if c in old.columns else F.lit("").alias(c) for c in new.columns], F.lit(1).alias("carried")))


def built(base: DataFrame, review: DataFrame, rules: dict | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(dataset, provenance, counters): base and the approved rows that are new. Any invalid approved row stops the build.

    base and review have a seq column that gives their order.
    """
    rows = approved(review)
    clean = rows.withColumn("Crystal_structure", F.regexp_replace("Crystal_structure", r"(?U)\s+", ""))
    wrong = clean.withColumn("notes", validation_notes(rules)).filter(F.size("notes") > 0)
    bad = wrong.select("candidate_id", "notes").limit(20).collect()
    if bad:
        raise ValueError("invalid approved rows: " + "; ".join(f"{r['candidate_id']}: {', '.join(r['notes'])}" for r in bad))
    marked = accepted(base, rows, numeric_key(), ["seq"])
    new = marked.filter("added")
    first = projected(base, DATASET).withColumn("seq", F.lit(0)) if "seq" not in base.columns else base.select(*projected(base).columns, "seq")
    dataset = first.select(*DATASET, F.lit(0).alias("part"), "seq").unionByName(new.select(*DATASET, F.lit(1).alias("part"), "seq"))
    extra = ["candidate_id", "source_id", "doi", "page", "evidence_type", "evidence", "reviewer_notes"]
    provenance = new.select(*DATASET, *extra, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("merged_at_utc"))
    told = marked.agg(F.count("*").alias("approved"), F.count_if("added").alias("added")).first()
    n = base.count()
    return dataset, provenance, {"base_rows": n, "approved_rows": told["approved"], "added_rows": told["added"], "duplicate_rows": told["approved"] - told["added"], "output_rows": n + told["added"]}


def merged(base: DataFrame, extracted: DataFrame, deduplicate: bool = True) -> DataFrame:
    """The agent's merge: extracted rows with `merged`, by the string key unless duplicates are kept."""
    marked = accepted(base, extracted, string_key(), ["seq"]).withColumnRenamed("added", "merged")
    return marked if deduplicate else marked.withColumn("merged", F.lit(True))


# Fixed pattern: what a relevant document mentions.
TARGET = r"(?i)\b(?:hall\s+)?mobility\b|\b(?:electron|carrier)\s+mobility\b|\bcarrier\s+concentration\b|\bmu\s*[_-]?\s*h\b"
# Fixed texts: the reasons of the three decisions.
REASONS = {
    "not_relevant": "no mobility or carrier-transport target mention",
    "mention_without_extractable_values": "mobility is discussed but no numeric sample-level value was extracted",
    "candidates_extracted": "sample-level mobility candidates found",
}


def judged(text: Column, candidates: Column) -> Column:
    """STRUCT(relevant, status, reason, candidate_count) of a document with so many candidates: only one with candidates is relevant."""
    found = F.coalesce(candidates.cast("long"), F.lit(0))
    status = F.when(~X.normalize_text(text).rlike(TARGET), "not_relevant").when(found == 0, "mention_without_extractable_values").otherwise("candidates_extracted")
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), status)
    relevant = status == "candidates_extracted"
    return F.struct(relevant.alias("relevant"), status.alias("status"), reason.alias("reason"), F.when(relevant, found).otherwise(0).alias("candidate_count"))


def extraction_status(has_file: Column, failed: Column, candidates: Column, mentions: Column) -> Column:
    return F.when(~has_file, "missing_pdf").when(failed, "extraction_failed").when(candidates > 0, "candidates_extracted").when(mentions > 0, "manual_digitization_required").otherwise("no_target_mention")


def fetch_status(present: Column, local: Column, downloaded: Column) -> Column:
    return F.when(present, "already_present").when(local, "missing_local_pdf").when(downloaded, "downloaded").otherwise("needs_manual_pdf")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """(status, n)."""
    return df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
