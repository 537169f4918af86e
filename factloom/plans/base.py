"""The test tables in the roles of the engine's tables, and SQL for the same roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import few  # noqa: F401, the queries take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as verdict rows: run = source, quality = verdict, toxic = stance."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") == 1, "SUPPORTED").when(F.col("quality") == 0, "CONTRADICTED").otherwise("UNVERIFIABLE")
    raw = F.when(F.col("quality").isNull() & (F.col("n_chars") % 3 == 0), "SUPPORTED").otherwise(verdict)
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("claim_id"), F.col("source").alias("run_id"), verdict.alias("verdict"), raw.alias("raw_verdict"),
        F.when(F.col("toxic") == 1, "disavowed").otherwise("asserted").alias("stance"),
        F.when(F.col("quality").isNotNull(), (F.col("n_chars") % 2).cast("int")).alias("year_flag"),
        F.when(F.col("n_chars") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id")).alias("evidence_chunk_ids"),
        F.col("lang"), F.col("n_chars"),
    )


VERDICTS = """v AS (SELECT d.doc_id AS claim_id, d.source AS run_id,
  CASE WHEN quality = 1 THEN 'SUPPORTED' WHEN quality = 0 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS verdict,
  CASE WHEN quality IS NULL AND n_chars % 3 = 0 THEN 'SUPPORTED' WHEN quality = 1 THEN 'SUPPORTED' WHEN quality = 0 THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS raw_verdict,
  CASE WHEN toxic = 1 THEN 'disavowed' ELSE 'asserted' END AS stance,
  CASE WHEN quality IS NOT NULL THEN n_chars % 2 END AS year_flag, n_chars % 7 = 0 AS bare, lang, n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as jobs: user = run, event type = status."""
    status = F.create_map(*[F.lit(x) for p in STATUS.items() for x in p])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("ts").alias("created_at"), F.coalesce(status[F.col("event_type")], F.lit("RUNNING")).alias("status"))


# What the event types stand for.
STATUS = {"view": "QUEUED", "click": "RUNNING", "purchase": "DONE", "error": "FAILED", "signup": "DONE"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'RUNNING' END"
JOBS = f"j AS (SELECT event_id AS id, user_id AS run_id, ts AS created_at, {STATUS_SQL} AS status FROM events)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put
