"""Order-dependent logic as windows: capped prefixes, imprint passages, chat history, progress logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENING_CHARS, IMPRINT_CHUNKS, IMPRINT_CHARS, IMPRINT_WEIGHT = 6000, 4, 1200, 2
# Markers of imprints and citations, with their weights.
MARKERS = [
    (r"recommended citation", 3), (r"suggested citation", 3), (r"citation:", 2), (r"\bisbn\b", 2), (r"published by", 2),
    (r"all rights reserved", 1), (r"copyright", 1), (r"©", 1), (r"\bdoi\b|\b10\.\d{4,9}/", 1),
]
# The steps of a run.
STEPS = ["ingest", "extract", "verify", "score"]


def opening_segment(chunks: DataFrame, cap: int = OPENING_CHARS, first_pages: int = 2, limit: int = 8, fallback: int = 3) -> DataFrame:
    """Rows (doc_id, id, page, section, text) that make a document's opening, with pos, heading and cum.

    The first chunks of the first pages (of unknown page, too), or else the first
    chunks at all, while their length with headings stays within the cap; the first always.
    A section's heading counts where it is seen first.
    """
    by = Window.partitionBy("doc_id").orderBy("id")
    early = F.col("page").isNull() | (F.col("page") <= first_pages)
    rows = chunks.withColumn("_early", early).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_early").orderBy("id"))).withColumn("_any", F.row_number().over(by))
    rows = rows.withColumn("_has", F.max(F.col("_early").cast("int")).over(Window.partitionBy("doc_id")) == 1)
    rows = rows.where(F.when(F.col("_has"), F.col("_early") & (F.col("_n") <= limit)).otherwise(F.col("_any") <= fallback))
    rows = rows.withColumn("pos", F.row_number().over(by).cast("long"))
    seen = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("id")) == 1
    rows = rows.withColumn("heading", F.coalesce(F.col("section") != "", F.lit(False)) & seen)
    added = F.length("text") + 2 + F.when(F.col("heading"), F.length("section") + 5).otherwise(0)
    rows = rows.withColumn("cum", F.sum(added).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return rows.where((F.col("pos") == 1) | (F.col("cum") <= cap)).select(*chunks.columns, "pos", "heading", "cum")


def marker_weight(text: str, markers=MARKERS) -> Column:
    low = F.lower(text)
    return sum((F.when(low.rlike(m), w).otherwise(0) for m, w in markers), F.lit(0))


def imprint_passages(chunks: DataFrame, used: DataFrame | None = None, markers=MARKERS) -> DataFrame:
    """(doc_id, id, weight, rank, passage): up to four chunks per document that look like an imprint."""
    rows = chunks.select("doc_id", "id", marker_weight("text", markers).alias("weight"), F.substring("text", 1, IMPRINT_CHARS).alias("passage")).where(F.col("weight") >= IMPRINT_WEIGHT)
    if used is not None:
        rows = rows.join(used.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= IMPRINT_CHUNKS)


def metadata_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): opening segment and imprint passages as one text; documents without text raise an error."""
    opening = opening_segment(chunks)
    piece = F.concat(F.when(F.col("heading"), F.concat(F.lit("## "), "section", F.lit("\n\n"))).otherwise(""), "text")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), "\n\n")
    first = opening.groupBy("doc_id").agg(F.substring(joined(F.struct("pos", piece.alias("s"))), 1, OPENING_CHARS).alias("opening"))
    found = imprint_passages(chunks, opening).groupBy("doc_id").agg(joined(F.struct("rank", F.col("passage").alias("s"))).alias("imprint"))
    text = F.when(F.trim("opening") == "", F.raise_error(F.lit("a document without text")).cast("string")).otherwise(
        F.concat("opening", F.coalesce(F.concat(F.lit("\n\nLIKELY IMPRINT / CITATION PASSAGES:\n\n"), "imprint"), F.lit("")))
    )
    return first.join(found, "doc_id", "left").select("doc_id", text.alias("text"))


def trim_history(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation from their first user turn on; none for n <= 0."""
    w = Window.partitionBy("conv_id")
    rows = turns.withColumn("_back", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("_back") <= max(n, 0))
    rows = rows.withColumn("_first", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    return rows.where(F.col("turn") >= F.col("_first")).drop("_back", "_first")


def progress(log: DataFrame, *by: str) -> DataFrame:
    """The last status of each step of (step, status, seq, ...) rows, in the order of first entries (position from 1)."""
    latest = log.groupBy(*by, "step").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return latest.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("first_seq")).cast("long"))


def progress_feed(runs: DataFrame, latest: DataFrame, steps: list[str], key: str = "run_id") -> DataFrame:
    """Every fixed step of every run with its status, or pending."""
    every = runs.select(key).distinct().withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(s).alias("step")) for i, s in enumerate(steps)]))).select(key, "_s.ordinal", "_s.step")
    return every.join(latest.select(key, "step", "status"), [key, "step"], "left").select(key, F.col("ordinal").cast("long").alias("ordinal"), "step", F.coalesce("status", F.lit("pending")).alias("status"))


def resume_step(feed: DataFrame, key: str = "run_id") -> DataFrame:
    """The first step that is not done; runs that are done are left out."""
    return feed.where("status != 'done'").groupBy(key).agg(F.min_by("step", "ordinal").alias("resume_at"), F.min("ordinal").alias("ordinal"))
