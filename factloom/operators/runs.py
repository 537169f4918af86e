"""Runs end to end over the store: claims, verdicts, scores, and the job that takes these steps in order.

Services come in as ports, functions from a table to a table, so each is called inside
tasks and nothing but counts and a run's few scores reaches the driver:

* embed(rows with text) -> the rows with embedding;
* extract(custom_id, prompt) -> text, stance and, if known, value, unit, year, page, subject;
* judge(custom_id, prompt, images) -> custom_id, verdict, quote, evidence_index, rationale;
* describe(doc_id, text) -> doc_id, title, authors, publisher, publication_date, doi, isbn;
* assess(custom_id, prompt) -> component, score, justification, quote.

What they answer is written down before it is used twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import Store, deterministic_id
from . import credibility, ordered, retrieval, scoring, verify

Port = Callable[[DataFrame], DataFrame]
#: Images of figures that a claim's judge sees.
MAX_IMAGES = 2
#: The components that a report is assessed by; recency is computed.
RUBRIC = ("coverage", "consistency", "methodology", "context")


def _sections(documents: DataFrame) -> DataFrame:
    """(no, title, page, text): the sections of a run's one report."""
    verify.assert_one_report(documents)
    report = documents.where("kind = 'REPORT'")
    return report.select(F.posexplode("metadata.sections").alias("no", "s")).select("no", "s.title", "s.page", "s.text")


def _joined(parts: DataFrame, head: str) -> DataFrame:
    """(prompt) of parts (kind, no, s): the head and the parts in order, an empty line between."""
    ordered_parts = F.transform(F.array_sort(F.collect_list(F.struct("kind", "no", "s"))), lambda x: x["s"])
    return parts.groupBy().agg(F.array_join(F.concat(F.array(F.lit(head)), ordered_parts), "\n\n").alias("prompt"))


def page_marker(page) -> Column:
    return F.coalesce(F.concat(F.lit("[page "), F.col(page).cast("string"), F.lit("]")), F.lit("[page unknown]"))


def extraction_prompt(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """(prompt) of one report: its sections (no, title, page, text) under their titles, then its tables (id, page, text)."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled section)"))
    prose = sections.select(F.lit(0).alias("kind"), F.col("no").cast("long").alias("no"), F.concat(page_marker("page"), F.lit(" ## "), title, F.lit("\n"), "text").alias("s"))
    tabled = tables.select(F.lit(1).alias("kind"), F.col("id").alias("no"), F.concat(page_marker("page"), F.lit(" ## TABLE\n"), "text").alias("s"))
    return _joined(prose.union(tabled), "Extract the checkable factual claims from this report.\n")


def extract_claims(store: Store, run_id: str, extract: Port, prompt_hash: str) -> int:
    """Claims of the run's report replace those before; none, or a report without text, is an error and changes nothing."""
    store.get_run(run_id)
    documents, chunks = store.read("documents", run_id), store.read("chunks", run_id)
    sections = _sections(documents)
    report = documents.where("kind = 'REPORT'").select(F.col("id").alias("doc_id"))
    tables = chunks.where("kind = 'table'").join(report, "doc_id", "left_semi")
    if not sections.limit(1).count() and not tables.limit(1).count():
        raise ValueError("a report without text")
    asked = extraction_prompt(sections, tables).select(F.lit(run_id).alias("custom_id"), "prompt")
    doc_id = report.first()[0]
    found = extract(asked).withColumns({"doc_id": F.lit(doc_id), "stance": F.coalesce("stance", F.lit("asserted")), "extraction_prompt_hash": F.lit(prompt_hash), "created_at": F.current_timestamp()})
    with store.scratch() as keep:
        found = keep(found)
        verify.assert_some(found, "claims in the report")
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "value", "unit", "year", "page", "subject", "stance") if c in found.columns]
        # equal claims are told apart by their number among themselves
        same = F.row_number().over(Window.partitionBy(*named).orderBy(F.lit(0))).cast("string")
        claims = keep(found.withColumn("_same", same).withColumn("id", deterministic_id(F.lit(run_id), *named, "_same")).drop("_same"))
        store.replace_claims(run_id, claims)
    return store.read("claims", run_id).count()


def retrieve_evidence(store: Store, run_id: str, claims: DataFrame, embed: Port, k: int = retrieval.EVIDENCE_K) -> DataFrame:
    """(claim_id, pos, chunk_id, page, kind, figure_id, text): each claim's k best chunks of the run's sources, pos from 1.

    Word statistics are those of all chunks in the store.  Claims for which nothing is found have no row.
    """
    if k < 1:
        raise ValueError(f"k is {k}: without evidence every verdict would be UNVERIFIABLE")
    pool = max(k, retrieval.POOL)
    kinds = store.read("documents").select("run_id", F.col("id").alias("doc_id"), F.col("kind").alias("doc_kind"))
    chunks = store.read("chunks").join(kinds, ["run_id", "doc_id"]).select(F.col("id").alias("chunk_id"), "run_id", "doc_kind", "text")
    asked = claims.select(F.xxhash64("id").alias("query_id"), F.col("id").alias("claim_id"), F.lit(run_id).alias("run_id"), F.lit("SOURCE").alias("doc_kind"), T.evidence_query("text", "year").alias("text"))
    vectors = store.read("vectors", run_id).where("doc_kind = 'SOURCE'").select("chunk_id", F.col("embedding").alias("vector"))
    near = retrieval.knn(vectors, embed(asked.select("query_id", "text")).select("query_id", F.col("embedding").alias("vector")), pool)
    hits = retrieval.fuse(near, retrieval.bm25(chunks, asked, pool, same=["run_id", "doc_kind"]), k)
    own = store.read("chunks", run_id).select(F.col("id").alias("chunk_id"), "page", "kind", "figure_id", "text")
    return hits.join(asked.select("query_id", "claim_id"), "query_id").join(own, "chunk_id").select("claim_id", F.col("rank").cast("int").alias("pos"), "chunk_id", "page", "kind", "figure_id", "text")


def images_for(hits: DataFrame, figures: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(claim_id, images): paths of the first MAX_IMAGES figures among a claim's hits, in their order.

    A figure without a row raises an error when it is computed, as does, where files (image_path) tells
    what is there, one whose file is not: a chart is not judged unseen.
    """
    pictures = figures.select(F.col("id").alias("figure_id"), "image_path")
    if files is not None:
        pictures = pictures.join(files.select("image_path").distinct(), "image_path", "left_semi")
    first = F.row_number().over(Window.partitionBy("claim_id").orderBy("pos"))
    seen = hits.where("kind = 'figure' and figure_id is not null").withColumn("_n", first).where(F.col("_n") <= MAX_IMAGES).join(pictures, "figure_id", "left")
    path = F.coalesce("image_path", F.raise_error(F.concat(F.lit("no image of figure "), "figure_id")).cast("string"))
    return seen.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", path.alias("path")))), lambda x: x["path"]).alias("images"))


def verify_run(store: Store, run_id: str, embed: Port, judge: Port, model: str, prompt_hash: str, k: int = retrieval.EVIDENCE_K, files: DataFrame | None = None) -> dict:
    """Verdicts of all of a run's claims replace those before; returns their counts.

    Unknown runs, runs without claims or without chunks of sources, and k < 1 are errors.
    A claim for which nothing is found is UNVERIFIABLE without asking the judge; a claim
    that the judge does not answer, or answers twice, is an error.  After an error nothing has changed.
    """
    if k < 1:
        raise ValueError(f"k is {k}: without evidence every verdict would be UNVERIFIABLE")
    store.get_run(run_id)
    claims = store.read("claims", run_id)
    verify.assert_some(claims, "claims: extract them first")
    sources = store.read("documents", run_id).where("kind = 'SOURCE'").select(F.col("id").alias("doc_id"))
    verify.assert_some(store.read("chunks", run_id).join(sources, "doc_id", "left_semi"), "text of sources: every verdict would be UNVERIFIABLE")
    with store.scratch() as keep:
        hits = keep(retrieve_evidence(store, run_id, claims, embed, k))
        named = claims.withColumnRenamed("id", "claim_id")
        asked = verify.evidence_prompts(named, hits).join(images_for(hits, store.read("figures", run_id), files), "claim_id", "left")
        asked = keep(asked.select(F.col("claim_id").alias("custom_id"), "prompt", F.coalesce("images", F.array().cast("array<string>")).alias("images")))
        answers = keep(judge(asked).select(F.col("custom_id").alias("claim_id"), "verdict", "quote", "evidence_index", "rationale"))
        n, m = asked.count(), answers.join(asked.select(F.col("custom_id").alias("claim_id")), "claim_id", "left_semi").select("claim_id").distinct().count()
        if n != m or answers.count() != n:
            raise ValueError(f"{n} claims to judge, {m} of them answered in {answers.count()} answers")
        checked = verify.check_verdicts(answers.join(named.select("claim_id", "year"), "claim_id"), hits).join(answers.select("claim_id", "rationale"), "claim_id")
        rows = checked.unionByName(verify.no_evidence_rows(named, hits))
        stamp = T.verdict_stamp(F.lit(prompt_hash), k)
        rows = rows.withColumns({"id": deterministic_id(F.lit(run_id), "claim_id"), "model": F.lit(model), "prompt_hash": stamp, "created_at": F.current_timestamp()})
        store.replace("verdicts", run_id, rows)
    return scoring.verdict_summary(store.read("verdicts", run_id)).first().asDict()


def validity_quotes(assessed: DataFrame, body: DataFrame) -> DataFrame:
    """assessed (component, score, justification, quote) with quote_verified: 1 if the report's text (body: prompt) holds the quote.

    A missing or empty quote is not verified either; the score stays whatever the quote is.
    """
    text = F.broadcast(body.select(T.normalize_quote("prompt").alias("_body")))  # one row: a report
    held = F.contains("_body", T.normalize_quote("quote")) & (F.col("quote") != "")
    return assessed.crossJoin(text).withColumn("quote_verified", F.coalesce(held, F.lit(False)).cast("int")).drop("_body")


@dataclass
class Scoring:
    """What scoring needs besides the run: ports, registries (see credibility.resolve_tiers) and settings."""

    describe: Port
    assess: Port
    works: DataFrame
    books: DataFrame
    weights: dict[str, float]
    current_year: int
    tier1: list[str] = field(default_factory=list)
    tier2: list[str] = field(default_factory=list)


def _json(df: DataFrame, *drop: str) -> str | None:
    row = df.select(F.to_json(F.struct(*[c for c in df.columns if c not in drop]), {"ignoreNullFields": "false"})).first()
    return row and row[0]


def score_run(store: Store, run_id: str, ports: Scoring, stamp: str, allow_stale: bool = False) -> dict[str, str]:
    """Accuracy, credibility and validity of a run, as JSON; they and the sources' scores are stored in one step at the end.

    Unknown runs, runs without verdicts, with verdicts of another prompt (unless allow_stale),
    without exactly one report, sources without text, a report without sections and components without any score are errors;
    after an error the scores before still stand.
    """
    store.get_run(run_id)
    verdicts, documents, chunks = store.read("verdicts", run_id), store.read("documents", run_id), store.read("chunks", run_id)
    verify.assert_some(verdicts, "verdicts: verify first")
    if not allow_stale:
        verify.assert_fresh(verdicts, "prompt_hash", stamp)
    sections = _sections(documents)
    verify.assert_some(sections, "sections of the report")
    stances = store.read("claims", run_id).select(F.col("id").alias("claim_id"), "stance")
    accuracy = _json(scoring.accuracy(verdicts.join(stances, "claim_id")))
    sources = documents.where("kind = 'SOURCE'").select(F.col("id").alias("doc_id"))
    texts = chunks.join(sources, "doc_id", "left_semi")
    bare = sources.join(texts.select("doc_id"), "doc_id", "left_anti").count()
    if bare:
        raise ValueError(f"{bare} sources without text")
    with store.scratch() as keep:
        described = keep(ports.describe(ordered.metadata_text(texts)))
        lost = sources.join(described, "doc_id", "left_anti").count()
        if lost:
            raise ValueError(f"{lost} sources were not described")
        resolved = credibility.merge_records(credibility.resolve_tiers(described, ports.works, ports.books))
        scored = keep(scoring.source_score(resolved, ports.tier1, ports.tier2, ports.current_year))
        usage = verify.evidence_usage(verdicts, chunks.select(F.col("id").alias("chunk_id"), "doc_id")).drop("run_id")
        rated = scored.join(usage, "doc_id", "left").withColumn("usage", F.coalesce("usage", F.lit(0)))
        # without sources the aggregate still gives one row
        cred = _json(scoring.usage_weighted_mean(rated))

        part = F.concat(F.lit("## "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")), F.lit("\n"), "text")
        body = keep(_joined(sections.select(F.lit(0).alias("kind"), "no", part.alias("s")), "REPORT:"))
        assessed = keep(validity_quotes(ports.assess(body.select(F.lit(run_id).alias("custom_id"), "prompt")).where(F.col("component").isin(*RUBRIC)), body))
        years = scored.select(T.year_of("publication_date").alias("year"))
        recency = scoring.recency_score(years, ports.current_year).select(F.lit("recency").alias("component"), F.col("recency").alias("score"))
        parts = assessed.withColumn("score", F.col("score").cast("double")).unionByName(recency, allowMissingColumns=True)
        total = scoring.validity_total(parts.withColumn("run_id", F.lit(run_id)), ports.weights, "run_id").select("run_id", F.col("validity").alias("score"))
        detail = parts.agg(F.array_sort(F.collect_list(F.struct("component", "score", "justification", "quote", "quote_verified"))).alias("components"))
        validity = _json(total.crossJoin(detail), "run_id")

        out = {"accuracy": accuracy, "credibility": cred, "validity": validity}
        scores = verdicts.sparkSession.range(1).select(F.current_timestamp().alias("created_at"), *[F.lit(v).alias(c) for c, v in out.items()])
        components = F.create_map(*[x for c in ("completeness", "authority", "recency", "verification") for x in (F.lit(c), F.col(c))])
        known = F.to_json(F.struct("title", "authors", "publisher", "publication_date", "doi", "isbn"), {"ignoreNullFields": "false"})
        rows = scored.select(deterministic_id(F.lit(run_id), "doc_id").alias("id"), "doc_id", known.alias("metadata"), components.alias("components"), "total", "tier", F.current_timestamp().alias("created_at"))
        store.write(run_id, replaced={"source_credibility": rows, "run_scores": scores})
    return out


def push_progress(jobs: DataFrame, job_id: str, step: str, label: str, status: str = "done") -> DataFrame:
    """jobs with the step's entry in the job's progress: in the place that the step has already, or at the end."""
    entry = F.struct(F.lit(step).alias("step"), F.lit(label).alias("label"), F.lit(status).alias("status"), F.current_timestamp().alias("ts"))
    log = F.coalesce("progress", F.array().cast(dict(jobs.dtypes)["progress"]))
    known = F.exists(log, lambda x: x["step"] == step)
    log = F.when(known, F.transform(log, lambda x: F.when(x["step"] == step, entry).otherwise(x))).otherwise(F.concat(log, F.array(entry)))
    this = F.col("id") == job_id
    return jobs.withColumn("progress", F.when(this, log).otherwise(F.col("progress"))).withColumn("updated_at", F.when(this, F.current_timestamp()).otherwise(F.col("updated_at")))


def recover(store: Store, run_id: str) -> list[str]:
    """The run's jobs that were running when their driver stopped are queued again, with an entry that says so."""
    jobs = store.read("jobs", run_id)
    ids = sorted(r[0] for r in jobs.where("status = 'RUNNING'").select("id").collect())
    for i in ids:
        jobs = push_progress(jobs, i, "recovered", "Re-queued after restart")
    if ids:
        store.replace("jobs", run_id, jobs.withColumn("status", F.when(F.col("id").isin(ids), "QUEUED").otherwise(F.col("status"))))
    return ids


def run_job(store: Store, run_id: str, job_id: str, steps: dict[str, Callable[[dict], str]]) -> str:
    """Take the job's steps from the first that is not done; the outcome, DONE or FAILED, goes to job and run in one write.

    steps: the functions of ordered.STEPS by name, from the job's payload to a label.  A step's error is recorded in
    job and run.  An error of the last write itself leaves the job RUNNING, and recover() queues it again.
    """
    found = store.read("jobs", run_id).where(F.col("id") == job_id).first()
    if found is None:
        raise LookupError(f"no job {job_id}")
    push = lambda *entry: store.replace("jobs", run_id, push_progress(store.read("jobs", run_id), job_id, *entry))
    outcome, error, now = "DONE", None, None
    done = {p["step"] for p in found["progress"] or [] if p["status"] == "done"}
    try:
        store.set_run_status(run_id, "RUNNING")
        for now in ordered.STEPS:
            if now not in done:
                push(now, now, "running")
                push(now, steps[now](found["payload"] or {}), "done")
    except Exception as e:  # recorded on job and run
        outcome, error = "FAILED", f"{type(e).__name__}: {e}"
        push(now or "start", now or "start", "failed")
    end = lambda df, this: df.withColumns({"status": F.when(this, outcome).otherwise(F.col("status")), "error": F.when(this, F.lit(error)).otherwise(F.col("error"))})
    store.write(run_id, replaced={"jobs": end(store.read("jobs", run_id), F.col("id") == job_id), "runs": end(store.get_run(run_id), F.lit(True))})
    return outcome
