"""Mechanical verification: a verdict stands only if its quote is found in the evidence shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scoring import CONTRADICTED, SUPPORTED, UNVERIFIABLE

MIN_QUOTE_CHARS = 10
NO_EVIDENCE = "No evidence retrieved from the source documents."


def check_verdicts(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verdict rows of answers (claim_id, year, verdict, quote, evidence_index) and evidence (claim_id, pos, chunk_id, text).

    A quote of ten characters or more counts as verified if the excerpt it names (pos
    from 1), or else the first that has it, holds it after normalisation.  SUPPORTED
    and CONTRADICTED without a verified quote become UNVERIFIABLE; raw_verdict keeps
    what was said.  year_flag: 0 if the quoted excerpt holds the claim's year, 1 if not, null
    if undecided or without year.
    """
    needle = T.normalize_quote(F.coalesce("quote", F.lit("")))
    rows = answers.withColumn("_needle", needle).withColumn("_long", F.length("_needle") >= MIN_QUOTE_CHARS)
    shown = rows.where("_long").select("claim_id", "_needle", "evidence_index").join(evidence, "claim_id").where(F.contains(T.normalize_quote("text"), F.col("_needle")))
    order = F.when(F.col("pos") == F.col("evidence_index"), F.lit(0)).otherwise(F.col("pos"))
    found = shown.groupBy("claim_id").agg(F.min_by(F.struct("chunk_id", "text"), order).alias("_hit"))
    ids = evidence.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("evidence_chunk_ids"))
    out = rows.join(found, "claim_id", "left").join(ids, "claim_id", "left")
    provable = F.col("verdict").isin(SUPPORTED, CONTRADICTED)
    verified = F.when(F.col("_hit").isNotNull(), 1).when(F.col("_long") | provable, 0)
    final = F.when(provable & ~F.coalesce(verified == 1, F.lit(False)), UNVERIFIABLE).otherwise(F.col("verdict"))
    flag = F.when(final.isin(SUPPORTED, CONTRADICTED), T.year_flag("year", F.col("_hit.text")))
    return out.select("claim_id", final.alias("verdict"), F.col("verdict").alias("raw_verdict"), "quote", verified.alias("quote_verified"), F.col("_hit.chunk_id").alias("quoted_chunk_id"), F.coalesce("evidence_chunk_ids", F.array().cast("array<bigint>")).alias("evidence_chunk_ids"), flag.alias("year_flag"))


def no_evidence_rows(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """Verdict rows of the claims for which nothing was retrieved."""
    left = claims.select("claim_id").join(hits.select("claim_id").distinct(), "claim_id", "left_anti")
    null = lambda kind: F.lit(None).cast(kind)
    return left.select("claim_id", F.lit(UNVERIFIABLE).alias("verdict"), F.lit(UNVERIFIABLE).alias("raw_verdict"), null("string").alias("quote"), null("int").alias("quote_verified"), null("long").alias("quoted_chunk_id"), F.array().cast("array<bigint>").alias("evidence_chunk_ids"), null("int").alias("year_flag"), F.lit(NO_EVIDENCE).alias("rationale"))


def evidence_prompts(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(claim_id, prompt): the claim and its excerpts, numbered from 1 in rank order."""
    block = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce(F.concat(F.lit("(p. "), F.col("page").cast("string"), F.lit(") ")), F.lit("")), F.col("text"))
    shown = hits.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("s")))), lambda x: x["s"]), "\n\n").alias("evidence"))
    return claims.join(shown, "claim_id").select("claim_id", F.concat(F.lit("CLAIM: "), F.col("text"), F.lit("\n\nEVIDENCE:\n\n"), F.col("evidence")).alias("prompt"))


def evidence_usage(verdicts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run_id, doc_id, usage): verdicts of any kind that quote a chunk of the document."""
    return verdicts.where("quoted_chunk_id is not null").join(chunks.select(F.col("chunk_id").alias("quoted_chunk_id"), "doc_id"), "quoted_chunk_id").groupBy("run_id", "doc_id").agg(F.count("*").alias("usage"))


def assert_fresh(rows: DataFrame, column: str, stamp: str) -> None:
    """Raises ValueError if any row was made with another prompt (null counts as another)."""
    stale = rows.where(~F.col(column).eqNullSafe(F.lit(stamp))).count()
    if stale:
        raise ValueError(f"{stale} rows are stale: {column} is not {stamp!r}")


def assert_some(rows: DataFrame, what: str) -> None:
    if not rows.limit(1).count():
        raise ValueError(f"no {what}")


def assert_one_report(documents: DataFrame) -> None:
    n = documents.where("kind = 'REPORT'").limit(2).count()
    if n != 1:
        raise ValueError("a run needs exactly one report" + (", it has none" if n == 0 else ", it has more"))
