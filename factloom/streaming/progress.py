"""The progress log as a stream: each step's last status, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(log: DataFrame, key: str = "run_id") -> DataFrame:
    """Streaming or batch (key, step, status, seq): the last status of each step; write in update or complete mode."""
    return log.groupBy(key, "step").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def claim_jobs(jobs: DataFrame, handle, checkpoint: str):
    """Each micro-batch of newly dropped jobs goes to handle(batch, id) once, oldest first."""

    def run(batch, batch_id):
        handle(batch.orderBy("created_at", "id"), batch_id)

    return jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
