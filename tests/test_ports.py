"""Batches of a service that can be taken up again; lines that are shown."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import views
from factloom.sources import readers


class Service:
    def __init__(self, spark, answers, state="ended", count=2):
        self.spark, self.answers, self.state, self.count, self.submitted = spark, answers, state, count, 0

    def submit(self, requests):
        self.submitted += 1
        self.count = requests.count()
        return "new"

    def status(self, batch_id):
        return None if batch_id == "gone" else (self.state, self.count)

    def results(self, batch_id):
        return self.spark.createDataFrame(self.answers, "custom_id string, json string")


GOOD = [("a", '{"v": 1}'), ("b", '{"v": 2}')]


def judged(spark, service, retry=None, **more):
    requests = spark.createDataFrame([("a", "p"), ("b", "q")], "custom_id string, prompt string")
    out = readers.judge_batch(requests, service, "v int", retry or (lambda left: left.select("custom_id", F.lit(None).cast("string").alias("json"))), poll=0, **more)
    return {r["custom_id"]: r["answer"]["v"] for r in out.collect()}


def test_batches(spark):
    seen = []
    assert judged(spark, Service(spark, GOOD), remember=seen.append) == {"a": 1, "b": 2} and seen == ["new"]
    held = Service(spark, GOOD)
    assert judged(spark, held, batch_id="old") == {"a": 1, "b": 2} and held.submitted == 0
    for other in (dict(batch_id="gone"), dict(batch_id="old")):
        service = Service(spark, GOOD, count=3)
        assert judged(spark, service, **other) == {"a": 1, "b": 2} and service.submitted == 1
    with pytest.raises(TimeoutError):
        judged(spark, Service(spark, GOOD, state="in_progress"), deadline=0)
    with pytest.raises(readers.StaleBatch):
        judged(spark, Service(spark, [("x", '{"v": 1}')]))


def test_failures_are_asked_once_more(spark):
    torn = Service(spark, [("a", '{"v": 1}'), ("b", None)])
    asked = []

    def retry(left):
        asked.extend(r[0] for r in left.select("custom_id").collect())
        return left.select("custom_id", F.lit('{"v": 5}').alias("json"))

    assert judged(spark, torn, retry) == {"a": 1, "b": 5} and asked == ["b"]
    asked.clear()
    assert judged(spark, Service(spark, [("a", '{"v": 1}'), ("b", '{"v": 2')]), retry) == {"a": 1, "b": 5} and asked == ["b"]
    with pytest.raises(Exception, match="no response to b"):
        judged(spark, torn)


def test_lines(spark):
    hits = spark.createDataFrame([(1, 7, 0.03252, 1, "vector+keyword"), (1, 8, 0.01, 2, "vector")], "query_id long, chunk_id long, score double, rank long, channels string")
    chunks = spark.createDataFrame([(7, 3, "text", "x" * 200), (8, None, "table", "y")], "chunk_id long, page int, kind string, text string")
    lines = [r["line"] for r in views.search_lines(hits, chunks).orderBy("rank").collect()]
    assert lines == ["[0.0325 vector+keyword p.3 text] " + "x" * 160, "[0.0100 vector table] y"]
    scores = spark.createDataFrame([("dev", 4, 5, 3, 0.75, 0.6), ("other", 1, 1, 0, 0.0, 0.0)], "set_id string, golden long, extracted long, matched long, recall double, precision double")
    assert views.extraction_line(scores).first()["line"] == "extraction recall 0.75 (3/4 golden found), precision 0.60 (3/5 extracted matched)"
    recorded = spark.createDataFrame([("dev", 0.8, 0.5)], "set_id string, recall double, precision double")
    got = {(r["set_id"], r["metric"]): r["line"] for r in views.baseline_lines(scores, recorded, ["recall", "precision"]).collect()}
    assert got == {("dev", "recall"): "baseline: recall 0.80 (delta: -0.05)", ("dev", "precision"): "baseline: precision 0.50 (delta: +0.10)", ("other", "recall"): None, ("other", "precision"): None}
