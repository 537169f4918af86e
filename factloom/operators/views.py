"""Composite views that are served to users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scoring import is_downgraded

METRICS = ["accuracy", "coverage", "supported", "contradicted", "unverifiable", "total"]


def verdicts_with_evidence(verdicts: DataFrame, claims: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdicts with their claims and, where a chunk is quoted, its page and document."""
    c = chunks.select(F.col("chunk_id").alias("quoted_chunk_id"), F.col("page").alias("evidence_page"), F.col("doc_id").alias("evidence_doc_id"))
    d = documents.select(F.col("doc_id").alias("evidence_doc_id"), F.col("title").alias("evidence_doc_title"))
    return verdicts.join(claims, "claim_id").join(c, "quoted_chunk_id", "left").join(d, "evidence_doc_id", "left")


def compare(scores: DataFrame, a: str, b: str, key: str = "run_id") -> DataFrame:
    """(metric, a, b, a_label, b_label, delta_label) of two runs; fractions as percent."""
    long = scores.where(F.col(key).isin(a, b)).select(key, F.stack(F.lit(len(METRICS)), *[x for m in METRICS for x in (F.lit(m), F.col(m).cast("double"))]).alias("metric", "value"))
    both = long.groupBy("metric").agg(F.max(F.when(F.col(key) == a, F.col("value"))).alias("a"), F.max(F.when(F.col(key) == b, F.col("value"))).alias("b"))
    share = F.col("metric").isin("accuracy", "coverage")
    label = lambda c: F.when(share, T.percent_label(c)).otherwise(F.coalesce(F.col(c).cast("long").cast("string"), F.lit("—")))
    change = F.col("b") - F.col("a")
    number = F.coalesce(F.concat(F.when(change > 0, "+").otherwise(""), change.cast("long").cast("string")), F.lit("—"))
    return both.select("metric", "a", "b", label("a").alias("a_label"), label("b").alias("b_label"), F.when(share, T.delta_label("a", "b")).otherwise(number).alias("delta_label"))


def run_history(runs: DataFrame) -> DataFrame:
    """(position, id, created_at, label), newest first."""
    from pyspark.sql import Window

    label = F.when(F.col("status") == "DONE", "Finished").when(F.col("status") == "FAILED", "Failed").when(F.col("status") == "RUNNING", "Running").otherwise("Waiting")
    return runs.select(F.row_number().over(Window.partitionBy("report").orderBy(F.desc("created_at"), F.desc("id"))).cast("long").alias("position"), "report", "id", "created_at", label.alias("label"))


def chat_context(claims: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, context): a line per verdict in the order of (page, claim_id)."""
    line = F.concat(F.lit("- ["), "verdict", F.lit("]"), F.when(F.col("stance") == "disavowed", " (disavowed by the report)").otherwise(""), F.lit(' "'), "text", F.lit('"'))
    rows = claims.select(key, F.struct("page", "claim_id", line.alias("s")).alias("x"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n").alias("context"))


def report(claims: DataFrame, scores: DataFrame, sources: DataFrame, key: str = "run_id") -> DataFrame:
    """One nested row per run: stats, scores as fractions, claims and sources."""
    c = claims.withColumn("downgraded", is_downgraded()).groupBy(key).agg(
        F.struct(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE")], F.count_if("downgraded").alias("downgraded")).alias("stats"),
        F.array_sort(F.collect_list(F.struct("page", "claim_id", "text", "verdict", "quote", "downgraded"))).alias("claims"),
    )
    s = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("order"), "doc_id", "total", "tier"))).alias("sources"))
    f = scores.select(key, F.struct("accuracy", "coverage", T.fraction("credibility").alias("credibility"), T.fraction("validity").alias("validity")).alias("scores"))
    return c.join(f, key, "left").join(s, key, "left")


def search_lines(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, rank, line): hits (query_id, chunk_id, score, rank, channels) as lines with page, kind and the first 160 characters."""
    page = F.coalesce(F.concat(F.lit(" p."), F.col("page").cast("string")), F.lit(""))
    channels = F.replace("channels", F.lit(" "), F.lit(""))
    line = F.concat(F.format_string("[%.4f ", "score"), channels, page, F.lit(" "), "kind", F.lit("] "), F.substring("text", 1, 160))
    return hits.join(chunks.select("chunk_id", "page", "kind", "text"), "chunk_id").select("query_id", "rank", line.alias("line"))


def extraction_line(scores: DataFrame) -> DataFrame:
    """(set_id, line) of matching.extraction_score."""
    line = F.format_string("extraction recall %.2f (%d/%d golden found), precision %.2f (%d/%d extracted matched)", "recall", "matched", "golden", "precision", "matched", "extracted")
    return scores.select("set_id", line.alias("line"))


def baseline_lines(scores: DataFrame, recorded: DataFrame, metrics: list[str], key: str = "set_id") -> DataFrame:
    """(key, metric, value, recorded, line): each metric beside its recorded value; sets without a record have no line."""
    long = lambda df, name: df.select(key, F.stack(F.lit(len(metrics)), *[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))]).alias("metric", name))
    both = long(scores, "value").join(long(recorded, "recorded"), [key, "metric"], "left")
    line = F.format_string("baseline: %s %.2f (delta: %+.2f)", "metric", "recorded", F.col("value") - F.col("recorded"))
    return both.withColumn("line", F.when(F.col("recorded").isNotNull(), line))
