"""Jobs and runs as tables: pure transitions from one state of the table to the next.

The caller is the only writer and swaps the new table in (see sources.store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB_STATES = ("QUEUED", "RUNNING", "DONE", "FAILED")


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id"))


def latest_job(jobs: DataFrame, key: str = "run_id") -> DataFrame:
    """The job created last of each run; ties go to the greater id."""
    return jobs.groupBy(key).agg(F.max(F.struct("created_at", "id", "status")).alias("j")).select(key, F.col("j.id").alias("job_id"), F.col("j.created_at").alias("created_at"), F.col("j.status").alias("status"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job, or no row."""
    return jobs.where("status = 'QUEUED'").orderBy("created_at", "id").limit(1)


def claim_next(jobs: DataFrame) -> DataFrame:
    """The table with the oldest queued job running."""
    first = next_job(jobs).select(F.col("id").alias("_id"))
    return jobs.join(F.broadcast(first), jobs["id"] == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNotNull(), "RUNNING").otherwise(F.col("status"))).drop("_id")


def requeue_running(jobs: DataFrame) -> DataFrame:
    """After a restart: what was running is queued again; recovered marks it."""
    running = F.col("status") == "RUNNING"
    return jobs.withColumn("recovered", running).withColumn("status", F.when(running, "QUEUED").otherwise(F.col("status")))


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs are queued and their runs run again; all others keep their state."""
    failed = F.col("status") == "FAILED"
    return jobs.withColumn("run_status", F.when(failed, "RUNNING").otherwise(F.col("status"))).withColumn("status", F.when(failed, "QUEUED").otherwise(F.col("status")))


def finish(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Running jobs take the outcome (id, outcome) DONE or FAILED."""
    return jobs.join(outcomes, "id", "left").withColumn("status", F.when((F.col("status") == "RUNNING") & F.col("outcome").isin("DONE", "FAILED"), F.col("outcome")).otherwise(F.col("status"))).drop("outcome")


def merge_payload(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """payload (map) with the updates' keys (id, update) put in; a null value removes its key."""
    merged = F.map_filter(F.map_concat(F.map_filter("payload", lambda k, v: ~F.array_contains(F.map_keys(F.col("_u")), k)), F.col("_u")), lambda k, v: v.isNotNull())
    return jobs.join(updates.select("id", F.coalesce("update", F.create_map().cast("map<string,string>")).alias("_u")), "id", "left").withColumn("payload", F.when(F.col("_u").isNotNull(), merged).otherwise(F.col("payload"))).drop("_u")


def reconcile(uploads: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(upload_id, doc_id, action) after a torn ingest: done, redo (a document without chunks) or ingest."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = uploads.join(documents.select("upload_id", "doc_id"), "upload_id", "left").join(counted, "doc_id", "left")
    return rows.select("upload_id", "doc_id", F.when(F.col("n") > 0, "done").when(F.col("doc_id").isNotNull(), "redo").otherwise("ingest").alias("action"))


