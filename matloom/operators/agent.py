"""From documents to dataset rows: the agent's run over papers, and the extraction run over a source manifest.

A document is a row of its paper's columns (paper_no, value, source_id, doi, title, notes, stable_id) with kind, pages (array of
texts), tables (array of (table_number, rows)) and error. Documents are read by read_papers(), or come from a reader of
the caller's own, such as one for PDF files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written
from . import extract
from .dataset import DATASET, accepted, best_candidates, extraction_status, judged, projected, refreshed, string_key

# The configuration that holds where none is given.
DEFAULT_SCHEMA = {
    "column_aliases": {
        "Crystal_structure": ["composition", "compound", "material", "sample", "chemical formula"],
        "temperature": ["temperature", "temp"],
        "N_type_carrier": ["mobility", "hall mobility", "electron mobility", "carrier mobility", "mu"],
        "Crystal_form": ["crystal form", "sample form", "morphology"],
        "Direction": ["direction", "orientation", "measurement direction"],
    },
    "categorical_mappings": {
        "Crystal_form": {"enabled": True, "values": {"polycrystalline": 0, "polycrystal": 0, "single crystal": 1, "single-crystalline": 1, "thin film": 1}},
        "Direction": {"enabled": True, "values": {"unspecified": 0, "parallel to pressing direction": 1, "perpendicular to pressing direction": 2, "in-plane": 1, "cross-plane": 2}},
    },
    "validation": {"required_elements": []},
}
# Fixed names: the columns of the extraction report.
EXTRACTION_REPORT = ["source_id", "doi", "pdf_path", "pages", "candidate_count", "status", "review_images", "message"]
# Fixed texts: what a report says of each status.
MESSAGES = {
    "missing_pdf": "Run fetch or provide local_pdf in sources.csv.",
    "candidates_extracted": "Review every candidate before approval.",
    "manual_digitization_required": "Mobility is discussed but no machine-readable value was found; inspect the exported pages, plots, captions, or supplementary data.",
    "no_target_mention": "No mobility mention was found in extracted PDF text.",
}
DOCUMENT = "kind string, pages array<string>, tables array<struct<table_number:string,rows:array<array<string>>>>, error string"

Judge = Callable[[Column, Column], Column]


def read_papers(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of papers (of sources.tables.paper_inputs) whose value is the path of one of the files (path, text, is_pdf).

    HTML files give their text as one page, with all tables and, where the paper has no title, their own. PDF files need a reader of the caller's; these and
    values without a file become documents with an error.
    """
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    numbered = papers if "paper_no" in papers.columns else papers.withColumn("paper_no", F.monotonically_increasing_id())
    both = numbered.join(files.select(plain(F.col("path")).alias("_path"), "text", "is_pdf"), plain(F.col("value")) == F.col("_path"), "left")
    parsed = extract.parsed_html(both.filter("not is_pdf and text is not null"), "paper_no", "text").withColumnRenamed("text", "_page")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), X.html_title(F.coalesce("text", F.lit(""))))
    tables = F.transform("tables", lambda rows, i: F.struct(F.concat(F.lit("html:"), i + 1).alias("table_number"), rows.alias("rows")))
    known = F.col("_page").isNotNull()
    return both.join(parsed, "paper_no", "left").select(
        "paper_no", "value", "source_id", "doi", title.alias("title"), "notes", "stable_id", F.when(known, "html").otherwise("").alias("kind"), F.when(known, F.array("_page")).otherwise(F.array().cast("array<string>")).alias("pages"),
        F.coalesce(tables, F.array().cast("array<struct<table_number:string,rows:array<array<string>>>>")).alias("tables"),
        F.when(F.coalesce("is_pdf", F.lit(False)), "PDF files need a reader of pages and tables").when(~known, F.concat(F.lit("paper input is not a local file: "), "value")).otherwise("").alias("error"),
    )


def document_candidates(documents: DataFrame, schema: dict) -> DataFrame:
    """The candidates of each document with paper_no, not yet deduplicated: those of all pages, then those of all tables."""
    papers = documents.filter("error = ''").select("paper_no", F.col("stable_id").alias("source_id"), "doi", "title", "kind", "pages", "tables")
    # The generators know a paper by its source_id; papers may repeat one, so they get the paper's number instead.
    own = papers.select(F.col("paper_no").cast("string").alias("source_id"), "doi", "title", "kind", "pages", "tables")
    pages = own.select("source_id", "doi", "title", F.posexplode("pages").alias("page", "text")).withColumn("page", F.col("page") + 1)
    number = F.regexp_extract("t.table_number", r"^(\d+)(?::|$)", 1).try_cast("int")
    page = F.coalesce(number, F.lit(1))
    context = F.coalesce(F.when(F.col("kind") == "pdf", F.get("pages", page - 1)), F.array_join("pages", "\n"))
    tables = own.select("source_id", "doi", "title", "kind", "pages", F.posexplode("tables").alias("part", "t")).select("source_id", "doi", "title", "part", page.alias("page"), F.col("t.table_number").alias("table_number"), F.col("t.rows").alias("rows"), context.alias("context"))
    found = extract.page_candidates(pages, schema).unionByName(extract.table_candidates(tables, schema, F.col("part")))
    found = found.withColumn("paper_no", F.col("source_id").cast("long")).drop("source_id", "candidate_id")
    found = found.join(papers.select("paper_no", "source_id"), "paper_no")
    identity = X.candidate_id(*[F.col(c) for c in ("source_id", "page", *DATASET[:3], "evidence_type", "evidence")])
    return found.withColumn("candidate_id", identity).select("paper_no", *extract.CANDIDATE, "table_number", "at")


@dataclass
class Run:
    """dataset: base rows and new ones in order (part, seq); provenance: a row a candidate; papers: one a document; counters: of the report."""

    dataset: DataFrame
    provenance: DataFrame
    papers: DataFrame
    counters: dict[str, int]


def agent_run(documents: DataFrame, base: DataFrame, schema: dict | None = None, deduplicate: bool = True, judge: Judge = judged) -> Run:
    """Extract, judge and merge.

    Candidates of a paper that the judge calls irrelevant give no rows, as do documents with an error, which get the status `error` and stop nothing.
    base: rows in order of seq, or with the order of a file that monotonically_increasing_id gives. judge: of a document's text and its count
    of candidates, STRUCT(relevant, status, reason, candidate_count).
    """
    schema = schema or DEFAULT_SCHEMA
    # The generators run once: what follows reads their rows.
    best = best_candidates(written(document_candidates(documents, schema), "candidates"), "at", ["paper_no"])
    counts = best.groupBy("paper_no").agg(F.count("*").alias("n"))
    text = F.array_join("pages", "\n")
    told = documents.join(counts, "paper_no", "left").withColumn("d", judge(text, F.coalesce("n", F.lit(0))))
    failed = F.col("error") != ""
    papers = told.select(
        "paper_no", F.col("stable_id").alias("source_id"), F.col("value").alias("source"), "doi", F.when(failed, "error").otherwise(F.col("d.status")).alias("status"), F.when(failed, F.col("error")).otherwise(F.col("d.reason")).alias("reason"),
        F.when(~failed & F.col("d.relevant"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("candidate_count"), "error", (~failed & F.col("d.relevant")).alias("_relevant"),
    )
    relevant = told.join(papers.filter("_relevant").select("paper_no"), "paper_no", "left_semi").select("paper_no", F.col("value").alias("source_input"), F.col("kind").alias("document_kind"))
    order = W.partitionBy("paper_no").orderBy(F.coalesce(F.col("page").try_cast("int"), F.lit(0)), "candidate_id")
    rows = best.join(relevant, "paper_no").withColumn("row_no", F.row_number().over(order))
    first = base if "seq" in base.columns else base.withColumn("seq", F.monotonically_increasing_id())
    first = projected(first, [*DATASET, "seq"]).withColumn("seq", F.col("seq").cast("long"))
    marked = accepted(first, rows, string_key(), ["paper_no", "row_no"])
    marked = written(marked if deduplicate else marked.withColumn("added", F.lit(True)), "marked")
    seq = F.struct(F.col("paper_no").cast("long").alias("paper_no"), F.col("row_no").cast("long").alias("row_no"))
    dataset = first.select(*DATASET, F.lit(0).alias("part"), F.struct(F.col("seq").alias("paper_no"), F.lit(0).cast("long").alias("row_no")).alias("seq")).unionByName(marked.filter("added").select(*DATASET, F.lit(1).alias("part"), seq.alias("seq")))
    provenance = marked.select(
        "paper_no", "row_no", "candidate_id", "source_id", "doi", "title", "source_input", "document_kind", "page", "table_number", F.lit("").alias("figure_number"), F.col("evidence").alias("source_text"),
        F.col("evidence_type").alias("extraction_method"), "confidence", "validation_notes", F.struct(*DATASET).alias("dataset_row"), F.col("added").alias("merged"),
    )
    n = marked.agg(F.count("*").alias("all"), F.count_if(F.col("added")).alias("added")).first()
    p = papers.agg(F.count("*").alias("all"), F.count_if(F.col("candidate_count") > 0).alias("some")).first()
    size = first.count()
    counters = {"input_count": p["all"], "base_rows": size, "papers_with_candidates": p["some"], "extracted_rows": n["all"], "added_rows": n["added"], "duplicate_rows": n["all"] - n["added"], "output_rows": size + n["added"]}
    return Run(dataset, provenance, papers.drop("_relevant"), counters)


def extraction_run(sources: DataFrame, pages: DataFrame, tables: DataFrame, schema: dict, review: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(review queue, report, pages to digitize) of the enabled sources.

    sources: of sources.tables.read_manifest with source_no, the place in the manifest; the first `limit` enabled ones are taken. pages: source_id, page, text, and
    pdf_path if known; tables: source_id, page, table_number, rows. A source without pages is missing its file. Pages that mention a mobility but give
    no candidate are to be digitized. review: the queue so far, whose decisions stay.
    """
    taken = sources.filter("enabled")
    if limit is not None:
        taken = taken.orderBy("source_no").limit(max(0, limit))
    about = taken.select("source_id", "doi", "title")
    own = pages.select("source_id", F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")).join(about, "source_id")
    cells = tables.select("source_id", F.col("page").cast("int").alias("page"), "table_number", "rows").join(own, ["source_id", "page"]).withColumnRenamed("text", "context")
    part = F.row_number().over(W.partitionBy("source_id", "page").orderBy("table_number"))
    found = extract.page_candidates(own, schema).unionByName(extract.table_candidates(cells.withColumn("part", part), schema, F.col("page") * 1000 + F.col("part")))
    # Tables follow the text of their page.
    found = written(found, "candidates")
    by_page = found.withColumn("seq", F.struct(F.col("page").cast("int"), F.col("at")))
    best = best_candidates(by_page)
    mentions = own.withColumn("mentions", F.regexp_count("text", F.lit(X.MENTION)))
    page_status = mentions.join(found.groupBy("source_id", F.col("page").cast("int").alias("page")).agg(F.count("*").alias("found")), ["source_id", "page"], "left")
    to_digitize = page_status.filter("mentions > 0 and found is null").select("source_id", "page", F.concat(X.safe_filename(F.col("source_id")), F.lit("_page_"), "page", F.lit(".png")).alias("image"))
    seen = mentions.groupBy("source_id").agg(F.count("*").alias("pages"), F.sum("mentions").alias("mentions"))
    images = to_digitize.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("page", "image"))).alias("images"))  # a source's pages
    rows = taken.join(seen, "source_id", "left").join(best.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").join(images, "source_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = extraction_status(F.col("pages").isNotNull(), F.lit(False), zero("n"), zero("mentions"))
    rows = rows.withColumn("status", status)
    message = F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), F.col("status"))
    report = rows.select("source_no", "source_id", "doi", F.col("local_pdf").alias("pdf_path"), zero("pages").cast("string").alias("pages"), zero("n").cast("string").alias("candidate_count"), "status", F.coalesce(F.array_join(F.transform("images", lambda x: x["image"]), " | "), F.lit("")).alias("review_images"), message.alias("message"))
    queue = best.select(*extract.CANDIDATE)
    if review is not None:
        queue = refreshed(review, queue).select(*extract.CANDIDATE)
    return queue, report, to_digitize


def output_rows(run: Run) -> DataFrame:
    """The merged dataset in order, with its five columns alone."""
    return run.dataset.orderBy("part", "seq").select(*DATASET)


def checked_target(base_path: str, output_path: str, in_place: bool) -> None:
    """Raises where the base would be overwritten unasked."""
    if base_path.rstrip("/") == output_path.rstrip("/") and not in_place:
        raise ValueError("refusing to overwrite the base dataset unless in_place is set")


def environment(spark: SparkSession) -> dict[str, str]:
    """What a run needs and what of it is there."""
    import importlib.util

    parts = {name: "found" if importlib.util.find_spec(name) else "missing" for name in ("numpy", "pandas", "pyarrow")}
    return {"spark": spark.version, **parts}
