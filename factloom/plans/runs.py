"""Queries over jobs, progress and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordered, state, views
from .base import JOBS, jobs, query, table

# Which event type stands for which step.
_STEP = {"view": "ingest", "click": "extract", "purchase": "verify", "signup": "score", "error": "error"}
_LOG = f"""l AS (SELECT user_id AS run_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _STEP.items())} END AS step, CASE WHEN value < 20 THEN 'done' ELSE 'running' END AS status, event_id AS seq FROM events)"""
_LATEST = f"""{_LOG}, p AS (SELECT run_id, step, arg_max(status, seq) AS status, min(seq) AS first_seq, max(seq) AS last_seq FROM l GROUP BY ALL)"""
_DIM = "(VALUES (0, 'ingest'), (1, 'extract'), (2, 'verify'), (3, 'score')) s(ordinal, step)"
_FEED = f"""{_LATEST}, f AS (SELECT r.run_id, CAST(s.ordinal AS BIGINT) AS ordinal, s.step, coalesce(p.status, 'pending') AS status FROM (SELECT DISTINCT run_id FROM l) r CROSS JOIN {_DIM} LEFT JOIN p ON p.run_id = r.run_id AND p.step = s.step)"""


def _log(spark, sf_dir):
    step = F.create_map(*[F.lit(x) for p in _STEP.items() for x in p])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), step[F.col("event_type")].alias("step"), F.when(F.col("value") < 20, "done").otherwise("running").alias("status"), F.col("event_id").alias("seq"))


@query(f"""WITH {JOBS} SELECT row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, id DESC) AS position, run_id AS report, id, created_at,
CASE status WHEN 'DONE' THEN 'Finished' WHEN 'FAILED' THEN 'Failed' WHEN 'RUNNING' THEN 'Running' ELSE 'Waiting' END AS label FROM j""")
def run_history(spark, sf_dir):
    return views.run_history(jobs(spark, sf_dir).withColumnRenamed("run_id", "report"))


@query(f"WITH {JOBS} SELECT run_id, id AS job_id, created_at, status FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, id DESC) AS n FROM j) WHERE n = 1")
def latest_job(spark, sf_dir):
    return state.latest_job(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT * FROM j WHERE status = 'QUEUED' ORDER BY created_at, id LIMIT 1")
def fifo_claim(spark, sf_dir):
    return state.next_job(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, run_id, created_at, CASE WHEN id = (SELECT id FROM j WHERE status = 'QUEUED' ORDER BY created_at, id LIMIT 1) THEN 'RUNNING' ELSE status END AS status FROM j")
def claim_transition(spark, sf_dir):
    return state.claim_next(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, run_id, created_at, CASE WHEN status = 'RUNNING' THEN 'QUEUED' ELSE status END AS status, status = 'RUNNING' AS recovered FROM j")
def requeue_transition(spark, sf_dir):
    return state.requeue_running(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, run_id, created_at, CASE WHEN status = 'FAILED' THEN 'QUEUED' ELSE status END AS status, CASE WHEN status = 'FAILED' THEN 'RUNNING' ELSE status END AS run_status FROM j")
def failed_retry(spark, sf_dir):
    return state.retry_failed(jobs(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_seq) AS position FROM p")
def progress_upsert(spark, sf_dir):
    return ordered.progress(_log(spark, sf_dir), "run_id")


@query(f"WITH {_FEED} SELECT * FROM f")
def progress_feed(spark, sf_dir):
    log = _log(spark, sf_dir)
    return ordered.progress_feed(log, ordered.progress(log, "run_id"), ordered.STEPS)


@query(f"WITH {_FEED} SELECT run_id, arg_min(step, ordinal) AS resume_at, min(ordinal) AS ordinal FROM f WHERE status <> 'done' GROUP BY run_id")
def resume_step(spark, sf_dir):
    log = _log(spark, sf_dir)
    return ordered.resume_step(ordered.progress_feed(log, ordered.progress(log, "run_id"), ordered.STEPS))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), k AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM b WHERE n <= 4)
SELECT conv_id, turn, role, text FROM k WHERE turn >= f""")
def history_trim(spark, sf_dir):
    return ordered.trim_history(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), 4)


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def chat_context(spark, sf_dir):
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))), lambda x: x["s"]), "\n").alias("context"))


@query("""WITH m AS (SELECT event_id, greatest(0, floor(date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') / 60.0 + 0.5))::BIGINT AS m FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))
SELECT event_id, CASE WHEN m < 1 THEN 'just started' WHEN m < 60 THEN 'running for ' || m || ' min' ELSE 'running for ' || m // 60 || ' h ' || m % 60 || ' min' END AS elapsed FROM m""")
def elapsed_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.elapsed_label("ts", F.lit("2024-02-01 00:00:00")).alias("elapsed"))


@query("""WITH d AS (SELECT o_orderkey AS doc_id, o_orderstatus FROM orders), c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT u.c_custkey AS upload_id, o.o_orderkey AS doc_id, CASE WHEN c.n > 0 THEN 'done' WHEN o.o_orderkey IS NOT NULL THEN 'redo' ELSE 'ingest' END AS action FROM customer u LEFT JOIN orders o ON o.o_custkey = u.c_custkey LEFT JOIN c ON c.doc_id = o.o_orderkey""")
def ingest_reconcile(spark, sf_dir):
    uploads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("upload_id"))
    documents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("upload_id"), F.col("o_orderkey").alias("doc_id"))
    chunks = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"))
    return state.reconcile(uploads, documents, chunks)
