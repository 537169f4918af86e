"""Queries over verdicts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, verify, views
from .base import VERDICTS, query, table, verdicts

_ACCURACY = f"""{VERDICTS}, c AS (SELECT run_id, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'CONTRADICTED') AS contradicted,
  count(*) FILTER (verdict = 'UNVERIFIABLE') AS unverifiable, count(*) AS total,
  count(*) FILTER (verdict = CASE WHEN stance = 'disavowed' THEN 'CONTRADICTED' ELSE 'SUPPORTED' END) AS correct, count(*) FILTER (stance = 'disavowed') AS disavowed
  FROM v GROUP BY run_id), a AS (SELECT *, supported + contradicted - correct AS incorrect,
  round_even(CAST(correct AS DOUBLE) / nullif(supported + contradicted, 0), 4) AS accuracy, round_even(CAST(supported + contradicted AS DOUBLE) / nullif(total, 0), 4) AS coverage FROM c)"""


@query(f"WITH {_ACCURACY} SELECT * FROM a")
def accuracy_by_run(spark, sf_dir):
    return scoring.accuracy(verdicts(spark, sf_dir), "run_id")


@query(f"""WITH {VERDICTS} SELECT run_id, count(*) AS total, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'CONTRADICTED') AS contradicted,
count(*) FILTER (verdict = 'UNVERIFIABLE') AS unverifiable, count(*) FILTER (raw_verdict <> verdict) AS downgraded, count(*) FILTER (year_flag = 1) AS year_flagged, count(*) FILTER (bare) AS no_evidence FROM v GROUP BY run_id""")
def verdict_summary(spark, sf_dir):
    return scoring.verdict_summary(verdicts(spark, sf_dir), "run_id")


@query(f"""WITH {VERDICTS} SELECT run_id, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict = 'CONTRADICTED') AS contradicted,
count(*) FILTER (verdict = 'UNVERIFIABLE') AS unverifiable, count(*) FILTER (raw_verdict <> verdict) AS downgraded FROM v GROUP BY run_id""")
def report_stats(spark, sf_dir):
    return scoring.report_stats(verdicts(spark, sf_dir), "run_id")


@query(f"""WITH {VERDICTS} SELECT f.filter, count(v.verdict) AS claims FROM (VALUES ('ALL'), ('SUPPORTED'), ('CONTRADICTED'), ('UNVERIFIABLE')) f(filter)
LEFT JOIN v ON f.filter = 'ALL' OR f.filter = v.verdict GROUP BY f.filter""")
def filter_counts(spark, sf_dir):
    return scoring.filter_counts(verdicts(spark, sf_dir))


def _label(c):
    return f"CASE WHEN metric IN ('accuracy', 'coverage') THEN coalesce(CAST(CAST(floor({c} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%', '—') ELSE coalesce(CAST(CAST({c} AS BIGINT) AS VARCHAR), '—') END"


@query(f"""WITH {_ACCURACY}, m AS (UNPIVOT (SELECT run_id, accuracy, coverage, CAST(supported AS DOUBLE) AS supported, CAST(contradicted AS DOUBLE) AS contradicted, CAST(unverifiable AS DOUBLE) AS unverifiable, CAST(total AS DOUBLE) AS total FROM a)
  ON accuracy, coverage, supported, contradicted, unverifiable, total INTO NAME metric VALUE value),
p AS (SELECT metric, max(value) FILTER (run_id = 'src0') AS a, max(value) FILTER (run_id = 'src1') AS b FROM m WHERE run_id IN ('src0', 'src1') GROUP BY metric)
SELECT metric, a, b, {_label('a')} AS a_label, {_label('b')} AS b_label, CASE WHEN metric IN ('accuracy', 'coverage') THEN
  coalesce(CASE WHEN floor(b * 100 + 0.5) - floor(a * 100 + 0.5) > 0 THEN '+' ELSE '' END || CAST(CAST(floor(b * 100 + 0.5) - floor(a * 100 + 0.5) AS BIGINT) AS VARCHAR), '—')
  ELSE coalesce(CASE WHEN b - a > 0 THEN '+' ELSE '' END || CAST(CAST(b - a AS BIGINT) AS VARCHAR), '—') END AS delta_label FROM p""")
def compare_runs(spark, sf_dir):
    # two runs are what the comparison takes
    return views.compare(scoring.accuracy(verdicts(spark, sf_dir), "run_id"), "src0", "src1")


@query(f"WITH {VERDICTS} SELECT verdict, claim_id, run_id FROM v WHERE verdict = 'CONTRADICTED'")
def claims_by_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir).where("verdict = 'CONTRADICTED'").select("verdict", "claim_id", "run_id")


@query("""SELECT n_regionkey AS run_id, l_suppkey AS doc_id, count(*) AS usage FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")
def evidence_usage(spark, sf_dir):
    chunks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_suppkey").alias("doc_id"), "s_nationkey")
    quoted = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("quoted_chunk_id"))
    run = chunks.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("doc_id", F.col("n_regionkey").alias("run_id"))
    used = verify.evidence_usage(quoted.withColumn("run_id", F.lit(0)), chunks).drop("run_id")
    return used.join(run, "doc_id").select("run_id", "doc_id", "usage")


@query("""WITH u AS (SELECT l_suppkey, count(*) AS usage FROM lineitem GROUP BY 1), s AS (SELECT s_nationkey AS run_id, s_acctbal AS total, coalesce(usage, 0) AS usage FROM supplier LEFT JOIN u ON s_suppkey = l_suppkey)
SELECT run_id, round_even(CASE WHEN sum(usage) > 0 THEN sum(total * usage) / sum(usage) ELSE avg(total) END, 1) AS score, CASE WHEN sum(usage) > 0 THEN 'usage_weighted_mean' ELSE 'unweighted_mean_no_usage' END AS method FROM s GROUP BY run_id""")
def usage_weighted_mean(spark, sf_dir):
    usage = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("usage"))
    rows = table(spark, sf_dir, "supplier").join(usage, "s_suppkey", "left").select(F.col("s_nationkey").alias("run_id"), F.col("s_acctbal").alias("total"), "usage")
    return scoring.usage_weighted_mean(rows, "run_id")


@query("""SELECT o_orderpriority AS run_id, CASE WHEN avg(greatest(0, 2004 - year(o_orderdate))) <= 2 THEN 100.0::DOUBLE WHEN avg(greatest(0, 2004 - year(o_orderdate))) <= 5 THEN 80.0::DOUBLE
WHEN avg(greatest(0, 2004 - year(o_orderdate))) <= 10 THEN 60.0::DOUBLE WHEN avg(greatest(0, 2004 - year(o_orderdate))) IS NOT NULL THEN 40.0::DOUBLE END AS recency FROM orders GROUP BY 1""")
def recency_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run_id"), F.year("o_orderdate").alias("year"))
    return scoring.recency_score(rows, 2004, "run_id")


_WEIGHTS = {"coverage": 0.25, "consistency": 0.25, "methodology": 0.2, "context": 0.15, "recency": 0.15}
# Which event type stands for which rubric component.
_COMPONENT = {"view": "coverage", "click": "consistency", "purchase": "methodology", "error": "context", "signup": "recency"}


@query(f"""WITH s AS (SELECT user_id AS run_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _COMPONENT.items())} END AS component, round_even(avg(value), 3) AS score FROM events GROUP BY ALL),
w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _WEIGHTS.items())}) t(component, weight))
SELECT run_id, round_even(sum(score * weight) / sum(weight), 1) AS validity FROM s JOIN w USING (component) WHERE score IS NOT NULL GROUP BY run_id""")
def validity_total(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for p in _COMPONENT.items() for x in p])
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), name[F.col("event_type")].alias("component")).agg(F.bround(F.avg("value"), 3).alias("score"))
    return scoring.validity_total(rows, _WEIGHTS, "run_id")


@query("""WITH c AS (SELECT doc_id AS claim_id, doc_id AS chunk, quality FROM labels) SELECT c.claim_id, c.quality, CAST(d.n_chars AS INTEGER) AS evidence_page, d.source AS evidence_doc_id, s.n AS evidence_doc_title
FROM c JOIN documents k ON k.doc_id = c.claim_id LEFT JOIN documents d ON d.doc_id = c.chunk AND c.quality = 1 LEFT JOIN (SELECT source, 'title of ' || source AS n FROM documents GROUP BY source) s ON s.source = d.source""")
def verdicts_with_evidence(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    v = lab.select(F.col("doc_id").alias("claim_id"), "quality", F.when(F.col("quality") == 1, F.col("doc_id")).alias("quoted_chunk_id"))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("int").alias("page"), F.col("source").alias("doc_id"))
    docs = d.select(F.col("source").alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("title of "), "doc_id").alias("title"))
    out = views.verdicts_with_evidence(v, d.select(F.col("doc_id").alias("claim_id")), chunks, docs)
    return out.select("claim_id", "quality", "evidence_page", "evidence_doc_id", "evidence_doc_title")


@query("""SELECT source AS doc_id, count(*) AS cited FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source""")
def source_claims(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("cited"))


@query(f"""WITH {VERDICTS}, c AS (SELECT run_id, string_agg('- [' || verdict || ']' || CASE WHEN stance = 'disavowed' THEN ' (disavowed by the report)' ELSE '' END || ' "' || lang || '"', chr(10) ORDER BY n_chars, claim_id) AS context FROM v GROUP BY run_id) SELECT * FROM c""")
def verdict_context(spark, sf_dir):
    rows = verdicts(spark, sf_dir).select("run_id", F.col("n_chars").alias("page"), "claim_id", "verdict", "stance", F.col("lang").alias("text"))
    return views.chat_context(rows)


@query(f"""WITH {_ACCURACY}, r AS (SELECT run_id, CASE WHEN accuracy * 100 >= 70 THEN 'good' WHEN accuracy * 100 >= 40 THEN 'fair' WHEN accuracy IS NULL THEN 'none' ELSE 'poor' END AS ring, round_even(coverage * 100 / 100, 4) AS share FROM a) SELECT * FROM r""")
def score_rings(spark, sf_dir):
    from ..functions import text as T

    a = scoring.accuracy(verdicts(spark, sf_dir), "run_id")
    return a.select("run_id", T.ring(F.col("accuracy") * 100).alias("ring"), T.fraction(F.col("coverage") * 100).alias("share"))


@query(f"""WITH {VERDICTS} SELECT run_id, CAST(count(*) AS BIGINT) AS claims, count(*) FILTER (raw_verdict <> verdict) AS downgraded,
to_json(list({{'claim_id': claim_id, 'verdict': verdict}} ORDER BY claim_id)) AS claims_json FROM v GROUP BY run_id""")
def report_payload(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("claim_id", "verdict")))
    return v.groupBy("run_id").agg(F.count("*").alias("claims"), F.count_if(scoring.is_downgraded()).alias("downgraded"), F.to_json(rows).alias("claims_json"))
