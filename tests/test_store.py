"""The versioned store: whole steps, guards, look-ups."""

import pytest
from pyspark.sql import functions as F

from factloom.sources import store


@pytest.fixture()
def db(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "db"), embedding_dim=2)


def claims(spark, *rows):
    return spark.createDataFrame([(i, d, p, "t", "asserted") for i, d, p in rows], "id string, doc_id string, page int, text string, stance string")


def ids(df):
    return [r[0] for r in df.select("id").collect()]


def test_a_writer_that_stops_changes_nothing(spark, db, monkeypatch):
    db.replace("claims", "r", claims(spark, ("a", "d", 1)))
    verdict = spark.createDataFrame([("v", "a", "SUPPORTED")], "id string, claim_id string, verdict string")
    db.replace("verdicts", "r", verdict)

    def stop(manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(db, "_save", stop)
    with pytest.raises(KeyboardInterrupt):
        db.replace_claims("r", claims(spark, ("b", "d", 1)))
    monkeypatch.undo()
    again = store.Store(spark, db.root)
    assert ids(again.read("claims", "r")) == ["a"] and ids(again.read("verdicts", "r")) == ["v"]
    again.replace_claims("r", claims(spark, ("b", "d", 1)))
    assert ids(again.read("claims", "r")) == ["b"] and ids(again.read("verdicts", "r")) == []


def test_two_writers(spark, db):
    late = db._load()
    db.replace("claims", "r", claims(spark, ("a", "d", 1)))
    with pytest.raises(OSError, match="someone else"):
        db._save(late)
    assert ids(db.read("claims", "r")) == ["a"]


def test_claims_of_one_document(spark, db):
    db.replace("claims", "r", claims(spark, ("a", "d", 2), ("b", "e", None), ("c", "e", 1)))
    db.replace_claims("r", claims(spark, ("x", "e", 5)), doc_id="e")
    assert ids(db.list_claims("r")) == ["a", "x"] and ids(db.list_claims("r", "e")) == ["x"]
    with pytest.raises(Exception, match="another document"):
        db.replace_claims("r", claims(spark, ("y", "d", 5)), doc_id="e")
    with pytest.raises(Exception, match="a row of run"):
        db.replace("claims", "r", claims(spark, ("z", "d", 1)).withColumn("run_id", F.lit("other")))


def test_chunks_and_vectors(spark, db):
    db.replace("documents", "r", spark.createDataFrame([("d", "SOURCE", "T")], "id string, kind string, title string"))
    chunks = spark.createDataFrame([(1, "text", "a"), (2, "text", "b")], "id bigint, kind string, text string")
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0])], "chunk_id bigint, embedding array<float>")
    for bad in (lambda: db.add_chunks("r", "x", chunks, vectors), lambda: db.add_chunks("r", "d", chunks, vectors.limit(1)), lambda: db.add_chunks("r", "d", chunks.limit(0), vectors.limit(0))):
        with pytest.raises(ValueError):
            bad()
    assert not db.read("chunks", "r").count()
    db.add_chunks("r", "d", chunks, vectors)
    assert sorted(ids(db.read("chunks", "r"))) == [1, 2] and db.read("vectors", "r").count() == 2
    db.delete_chunks("r", "d")
    assert not db.read("chunks", "r").count() and not db.read("vectors", "r").count()


def test_runs(spark, db):
    uploads = spark.createDataFrame([("u", "REPORT", "f.pdf", "/f.pdf")], "id string, kind string, file_name string, path string")
    job = spark.createDataFrame([("j", "verify", "QUEUED")], "id string, kind string, status string")
    with pytest.raises(Exception, match="cannot be"):
        db.create_run("r", uploads.withColumn("kind", F.lit("ODD")), job)
    with pytest.raises(LookupError):
        db.get_run("r")
    db.create_run("r", uploads, job)
    with pytest.raises(ValueError):
        db.create_run("r", uploads, job)
    db.set_run_status("r", "FAILED", "why")
    run = db.get_run("r").first()
    assert (run["status"], run["error"]) == ("FAILED", "why") and run["created_at"] is not None
    db.replace("documents", "r", spark.createDataFrame([("d", "u", "A"), ("e", None, "B")], "id string, upload_id string, title string"))
    assert {(r["id"], r["file_name"]) for r in db.uploaded_documents("r").collect()} == {("d", "f.pdf"), ("e", None)}
    db.replace("source_credibility", "r", spark.createDataFrame([("1", "d", 5.0), ("2", "e", 9.0)], "id string, doc_id string, total double"))
    assert [r["title"] for r in db.sources_by_total("r").collect()] == ["B", "A"]
    db.replace("verdicts", "r", spark.createDataFrame([("1", "m2"), ("2", None), ("3", "m1"), ("4", "m1")], "id string, model string"))
    assert db.models("r") == ["m1", "m2"] and db.run_scores("r").count() == 0
