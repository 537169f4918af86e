"""Runs end to end: claims, evidence, verdicts, scores, jobs with resume."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import runs
from factloom.sources import store

WORKS = "key string, doi string, titles array<string>, publisher string, families array<string>, year int"
BOOKS = "key string, isbn string, titles array<string>, publisher string, families array<string>, year int"
STAMP = "p:k=2"


def embed(df):
    # texts about rain point one way, all others the other
    wet = F.contains(F.lower("text"), F.lit("rain"))
    return df.withColumn("embedding", F.when(wet, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(1.0))).cast("array<float>"))


def judge(asked):
    """SUPPORTED with a quote that stands in the first excerpt for claims on rain, and with one that nobody wrote for the others."""
    wet = F.contains("prompt", F.lit("CLAIM: Rain"))
    quote = F.when(wet, "rain fell on twelve days").otherwise("a sentence that nobody wrote")
    return asked.select("custom_id", F.lit("SUPPORTED").alias("verdict"), quote.alias("quote"), F.lit(1).alias("evidence_index"), F.lit("why").alias("rationale"))


def extract(asked):
    rows = [("Rain fell in 2021", 2021, None), ("Snow was rare", None, "disavowed"), ("Snow was rare", None, "disavowed")]
    return asked.sparkSession.createDataFrame([(t, y, 1, s) for t, y, s in rows], "text string, year int, page int, stance string")


@pytest.fixture()
def db(spark, tmp_path):
    db = store.Store(spark, str(tmp_path / "db"), embedding_dim=2)
    uploads = spark.createDataFrame([("u", "REPORT", "f.pdf", "/f.pdf")], "id string, kind string, file_name string, path string")
    job = spark.createDataFrame([("j", "pipeline", "RUNNING", None)], store.SCHEMAS["jobs"].split(", run_id string")[0] + ", kind string, status string, payload map<string,string>")
    db.create_run("r", uploads, job)
    meta = {"sections": [{"title": "One", "page": 1, "text": "Rain fell in 2021."}, {"title": "", "page": None, "text": "Snow was rare."}]}
    db.replace("documents", "r", spark.createDataFrame([("rep", "REPORT", "R", meta), ("src", "SOURCE", "S", None)], "id string, kind string, title string, metadata struct<sections:array<struct<title:string,page:int,text:string>>>"))
    for doc, kind, first in (("rep", "REPORT", 1), ("src", "SOURCE", 11)):
        texts = ["In 2021 rain fell on twelve days.", "Nothing else is known of snow.", "A table of days"]
        chunks = spark.createDataFrame([(first + i, 1, "table" if i == 2 else "text", t) for i, t in enumerate(texts)], "id bigint, page int, kind string, text string")
        vectors = embed(chunks).select(F.col("id").alias("chunk_id"), F.lit(kind).alias("doc_kind"), "embedding")
        db.add_chunks("r", doc, chunks, vectors)
    # another run's source has the same words, and is never shown
    db.replace("documents", "x", spark.createDataFrame([("oth", "SOURCE")], "id string, kind string"))
    db.add_chunks("x", "oth", spark.createDataFrame([(99, "text", "Rain fell in 2021")], "id bigint, kind string, text string"), spark.createDataFrame([(99, "SOURCE", [1.0, 0.1])], "chunk_id bigint, doc_kind string, embedding array<float>"))
    return db


def ports(spark, **changed):
    def assess(asked):
        assert asked.first()["prompt"].startswith("REPORT:\n\n## One\nRain fell in 2021.\n\n## (untitled)\n")
        rows = [("coverage", 80, "j", "rain fell in 2021"), ("consistency", 60, "j", "not there at all"), ("methodology", 40, "j", None), ("context", 20, "j", "")]
        return asked.sparkSession.createDataFrame(rows, "component string, score int, justification string, quote string")

    def describe(texts):
        null = lambda k: F.lit(None).cast(k)
        return texts.select("doc_id", F.lit("A title").alias("title"), null("array<string>").alias("authors"), null("string").alias("publisher"), F.lit("2023").alias("publication_date"), null("string").alias("doi"), null("string").alias("isbn"))

    even = {c: 0.2 for c in (*runs.RUBRIC, "recency")}
    return runs.Scoring(**{"describe": describe, "assess": assess, "works": spark.createDataFrame([], WORKS), "books": spark.createDataFrame([], BOOKS), "weights": even, "current_year": 2024} | changed)


def test_extraction(spark, db):
    seen = []
    n = runs.extract_claims(db, "r", lambda asked: seen.append(asked.first()["prompt"]) or extract(asked), "h")
    assert n == 3 and db.read("claims", "r").select("id").distinct().count() == 3
    assert seen == ["Extract the checkable factual claims from this report.\n\n\n[page 1] ## One\nRain fell in 2021.\n\n[page unknown] ## (untitled section)\nSnow was rare.\n\n[page 1] ## TABLE\nA table of days"]
    with pytest.raises(ValueError, match="no claims"):
        runs.extract_claims(db, "r", lambda asked: extract(asked).limit(0), "h")
    assert db.read("claims", "r").count() == 3
    db.replace("documents", "r", db.read("documents", "r").where("kind = 'SOURCE'"))
    with pytest.raises(ValueError, match="report"):
        runs.extract_claims(db, "r", extract, "h")


def test_verification(spark, db):
    with pytest.raises(ValueError, match="no claims"):
        runs.verify_run(db, "r", embed, judge, "m", "p")
    runs.extract_claims(db, "r", extract, "h")
    with pytest.raises(ValueError, match="k is 0"):
        runs.verify_run(db, "r", embed, judge, "m", "p", k=0)
    with pytest.raises(LookupError):
        runs.verify_run(db, "unknown", embed, judge, "m", "p")
    hits = runs.retrieve_evidence(db, "r", db.read("claims", "r"), embed, 2).collect()
    assert len(hits) == 6 and {h["chunk_id"] for h in hits} <= {11, 12, 13}
    out = runs.verify_run(db, "r", embed, judge, "m", "p", k=2)
    assert (out["total"], out["supported"], out["unverifiable"], out["downgraded"], out["no_evidence"]) == (3, 1, 2, 2, 0)
    rows = db.read("verdicts", "r").collect()
    good = next(r for r in rows if r["verdict"] == "SUPPORTED")
    assert (good["quoted_chunk_id"], good["quote_verified"], good["year_flag"], good["model"], good["prompt_hash"], good["rationale"]) == (11, 1, 0, "m", STAMP, "why")
    for bad in (lambda a: judge(a).limit(1), lambda a: judge(a).union(judge(a))):
        with pytest.raises(ValueError, match="to judge"):
            runs.verify_run(db, "r", embed, bad, "m", "p")
    assert {r["id"] for r in db.read("verdicts", "r").collect()} == {r["id"] for r in rows}
    db.delete_chunks("r", "src")
    with pytest.raises(ValueError, match="no text of sources"):
        runs.verify_run(db, "r", embed, judge, "m", "p")


def test_images(spark):
    hits = spark.createDataFrame([("a", i, "figure", f"f{i}") for i in (1, 2, 3)] + [("a", 4, "text", None), ("b", 1, "figure", None)], "claim_id string, pos int, kind string, figure_id string")
    figures = spark.createDataFrame([(f"f{i}", f"/{i}.png") for i in (1, 2, 3)], "id string, image_path string")
    assert [tuple(r) for r in runs.images_for(hits, figures).collect()] == [("a", ["/1.png", "/2.png"])]
    with pytest.raises(Exception, match="no image of figure f2"):
        runs.images_for(hits, figures, spark.createDataFrame([("/1.png",)], "image_path string")).collect()
    with pytest.raises(Exception, match="no image of figure"):
        runs.images_for(hits, figures.limit(0)).collect()


def test_scoring(spark, db):
    with pytest.raises(ValueError, match="no verdicts"):
        runs.score_run(db, "r", ports(spark), STAMP)
    runs.extract_claims(db, "r", extract, "h")
    runs.verify_run(db, "r", embed, judge, "m", "p", k=2)
    with pytest.raises(ValueError, match="stale"):
        runs.score_run(db, "r", ports(spark), "other:k=2")
    out = {k: json.loads(v) for k, v in runs.score_run(db, "r", ports(spark), STAMP).items()}
    assert (out["accuracy"]["accuracy"], out["accuracy"]["coverage"]) == (1.0, 0.3333)
    # title and date of five fields: 12; recency 20; stated but not found anywhere: 5
    assert out["credibility"] == {"score": 37.0, "method": "usage_weighted_mean"}
    # (80 + 60 + 40 + 20 + 100) / 5, the last for a source one year old
    assert out["validity"]["score"] == 60.0
    assert {c["component"]: c["quote_verified"] for c in out["validity"]["components"]} == {"coverage": 1, "consistency": 0, "methodology": 0, "context": 0, "recency": None}
    assert db.run_scores("r").first()["validity"] is not None and [r["total"] for r in db.sources_by_total("r").collect()] == [37.0]
    before = db.run_scores("r").first()
    with pytest.raises(Exception, match="no validity component"):
        runs.score_run(db, "r", ports(spark, weights={"recency": 0.0}), "any", allow_stale=True)
    assert db.run_scores("r").first() == before
    db.replace("documents", "r", db.read("documents", "r").where("kind = 'REPORT'"))
    out = {k: json.loads(v) for k, v in runs.score_run(db, "r", ports(spark), STAMP).items()}
    assert out["credibility"] == {"score": None, "method": "no_sources"} and out["validity"]["score"] == 50.0


def test_job_resumes(spark, db):
    taken = []

    def step(name, fails=False):
        def take(payload):
            taken.append(name)
            if fails:
                raise ValueError("why not")
            return f"{name} taken"

        return take

    steps = {s: step(s) for s in ("ingest", "extract", "verify", "score")}
    assert runs.run_job(db, "r", "j", steps | {"verify": step("verify", True)}) == "FAILED"
    job, run = db.read("jobs", "r").first(), db.get_run("r").first()
    assert [(p["step"], p["status"]) for p in job["progress"]] == [("ingest", "done"), ("extract", "done"), ("verify", "failed")]
    assert job["status"] == run["status"] == "FAILED" and job["error"] == run["error"] == "ValueError: why not"
    db.replace("jobs", "r", db.read("jobs", "r").withColumn("status", F.lit("RUNNING")))
    assert runs.recover(db, "r") == ["j"] and runs.recover(db, "r") == []
    job = db.read("jobs", "r").first()
    assert job["status"] == "QUEUED" and job["progress"][-1]["step"] == "recovered"
    taken.clear()
    assert runs.run_job(db, "r", "j", steps) == "DONE" and taken == ["verify", "score"]
    job, run = db.read("jobs", "r").first(), db.get_run("r").first()
    assert [p["label"] for p in job["progress"] if p["step"] == "score"] == ["score taken"]
    assert (job["status"], job["error"], run["status"], run["error"]) == ("DONE", None, "DONE", None)
    with pytest.raises(LookupError):
        runs.run_job(db, "r", "unknown", steps)
