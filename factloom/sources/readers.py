"""Readers and ports: what comes in as files or from services, as tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "text string, value double, unit string, year int, expected_verdict string, stance string, note string"
PDF_BYTES = 50 * 1024 * 1024


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set in JSON Lines; blank lines are skipped, damaged ones raise an error."""
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path).where("text is not null")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def pdfs(spark: SparkSession, path: str, max_bytes: int = PDF_BYTES) -> DataFrame:
    """(path, content, valid): files of a folder; valid ones are named .pdf, begin like one and are not too long."""
    files = spark.read.format("binaryFile").load(path)
    fine = F.lower("path").endswith(".pdf") & (F.col("length") <= max_bytes) & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    return files.select("path", "content", fine.alias("valid"))


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed(df: DataFrame, make: Callable[[], Embedder], text_col: str = "text", batch: int = 64) -> DataFrame:
    """df with embedding; the embedder is made once per task and called with batches of texts."""
    schema = df.drop("embedding").schema.add("embedding", "array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = embedder.embed([t or "" for t in part[text_col].to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{part.num_rows} texts, {len(vectors)} vectors")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return df.drop("embedding").mapInArrow(run, schema)


def judge_replay(requests: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """requests (custom_id, ...) with answer, parsed from the recorded responses (custom_id, json).

    Requests without a response, and responses that do not fit, raise an error when computed;
    so do responses to requests that were never made.
    """
    foreign = responses.join(requests, "custom_id", "left_anti").limit(1).count()
    if foreign:
        raise ValueError("a response to a request that was not made")
    joined = requests.join(responses, "custom_id", "left")
    answer = F.from_json("json", schema, {"mode": "FAILFAST"})
    return joined.withColumn("answer", F.when(F.col("json").isNull(), F.raise_error(F.concat(F.lit("no response to "), "custom_id")).cast(schema if schema.startswith("struct") else f"struct<{schema_fields(schema)}>")).otherwise(answer)).drop("json")


def schema_fields(ddl: str) -> str:
    """'a int, b string' as 'a:int,b:string'."""
    return ",".join(":".join(part.split(None, 1)) for part in ddl.split(", "))


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests to send again."""
    return requests.join(responses.where("json is not null"), "custom_id", "left_anti")


class Batches(Protocol):
    """A service that answers requests in batches, as a table."""

    def submit(self, requests: DataFrame) -> str:
        """The id of a new batch."""

    def status(self, batch_id: str) -> tuple[str, int] | None:
        """Its state (ended or another) and the number of its requests; None if it is unknown or its answers have expired."""

    def results(self, batch_id: str) -> DataFrame:
        """(custom_id, json): json is null where a request failed."""


class StaleBatch(ValueError):
    """A remembered batch belongs to other requests."""


def judge_batch(
    requests: DataFrame, service: Batches, schema: str, retry: Callable[[DataFrame], DataFrame], batch_id: str | None = None,
    remember: Callable[[str], None] | None = None, poll: float = 10, deadline: float = 3600,
) -> DataFrame:
    """requests (custom_id, ...) with answer, by a batch of the service: all of them or an error.

    A remembered batch_id is taken up again if the service still has it and it has as many
    requests; else a new batch is submitted, and remember() told its id at once.  After
    deadline seconds a TimeoutError is raised; the batch goes on and can be taken up.  Answers to other requests
    raise StaleBatch.  Requests without a whole answer go to retry() once, as (custom_id, ...) to (custom_id, json).
    """
    held = service.status(batch_id) if batch_id else None
    if held is None or held[1] != requests.count():
        batch_id = service.submit(requests)
        if remember is not None:
            remember(batch_id)
    end = time.monotonic() + deadline
    while (state := service.status(batch_id)) is None or state[0] != "ended":
        if time.monotonic() >= end:
            raise TimeoutError(f"batch {batch_id} has not ended after {deadline} s; it can be taken up again")
        time.sleep(poll)
    found = service.results(batch_id)
    if found.join(requests, "custom_id", "left_anti").limit(1).count():
        raise StaleBatch(f"batch {batch_id} answers other requests")
    whole = found.where(F.from_json("json", schema, {"mode": "PERMISSIVE"}).isNotNull() & (F.coalesce(F.json_array_length(F.concat(F.lit("["), "json", F.lit("]"))), F.lit(0)) == 1))
    left = unanswered(requests, whole)
    answers = whole.select("custom_id", "json")
    if left.limit(1).count():
        answers = answers.unionByName(retry(left).select("custom_id", "json"))
    return judge_replay(requests, answers, schema)
