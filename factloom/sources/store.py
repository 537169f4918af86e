"""Run-partitioned tables on plain Parquet: each write is a new version, and a manifest says which one counts.

Partitions of a run are written to folders of their own first.  Then one small file is added,
the next manifest in number; readers take the highest number there is.  No manifest is
ever overwritten, and the one before stays, so readers see the old versions or the new ones of all
tables that were written together, whenever a writer stops.  Of two drivers that write
at once, one gets an error.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

#: Columns of the stored tables.
SCHEMAS = {
    "runs": "id string, created_at timestamp, status string, error string",
    "uploads": "id string, kind string, file_name string, path string, created_at timestamp",
    "documents": "id string, run_id string, upload_id string, kind string, title string, metadata struct<sections:array<struct<title:string,page:int,text:string>>>",
    "chunks": "id bigint, run_id string, doc_id string, page int, section string, kind string, text string, figure_id string",
    "vectors": "chunk_id bigint, run_id string, doc_kind string, embedding array<float>",
    "figures": "id string, run_id string, doc_id string, page int, image_path string, caption string, description string",
    "claims": "id string, run_id string, doc_id string, page int, text string, value double, unit string, year int, subject string, stance string, extraction_prompt_hash string, created_at timestamp",
    "verdicts": "id string, run_id string, claim_id string, verdict string, raw_verdict string, quote string, quote_verified int, quoted_chunk_id bigint, evidence_chunk_ids array<bigint>, year_flag int, rationale string, model string, prompt_hash string, created_at timestamp",
    "run_scores": "run_id string, accuracy string, credibility string, validity string, created_at timestamp",
    "source_credibility": "id string, run_id string, doc_id string, metadata string, components map<string,double>, total double, tier string, created_at timestamp",
    "jobs": "id string, run_id string, kind string, status string, payload map<string,string>, progress array<struct<step:string,label:string,status:string,ts:timestamp>>, error string, created_at timestamp, updated_at timestamp",
}
#: What enumerated columns may hold.
VOCABULARIES = {
    ("runs", "status"): ["CREATED", "RUNNING", "DONE", "FAILED"],
    ("uploads", "kind"): ["SOURCE", "REPORT"],
    ("chunks", "kind"): ["text", "table", "figure"],
    ("claims", "stance"): ["asserted", "disavowed"],
    ("jobs", "status"): ["QUEUED", "RUNNING", "DONE", "FAILED"],
}


def deterministic_id(*columns) -> F.Column:
    """An id from a row's natural key: the same row gets the same id when a task runs again."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *columns), 256), 1, 32)


class Store:
    def __init__(self, spark: SparkSession, root: str, embedding_dim: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        manifest = self._load()
        if manifest["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {manifest['schema_version']}, this library knows {SCHEMA_VERSION}")
        if embedding_dim is not None and manifest.get("embedding_dim") not in (None, embedding_dim):
            raise ValueError(f"the store holds vectors of {manifest['embedding_dim']} dimensions, not {embedding_dim}")
        if embedding_dim is not None and manifest.get("embedding_dim") is None:
            manifest["embedding_dim"] = embedding_dim
            self._save(manifest)
        self.embedding_dim = manifest.get("embedding_dim")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, root = self._fs(), self._path("")
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def _load(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"schema_version": SCHEMA_VERSION, "number": 0, "tables": {}}
        stream = self._fs().open(self._path(f"manifest-{numbers[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, manifest: dict) -> None:
        fs, number = self._fs(), manifest["number"] + 1
        draft, name = self._path(f"draft-{uuid.uuid4().hex}.json"), self._path(f"manifest-{number:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest | {"number": number}, sort_keys=True).encode()))
        out.close()
        if fs.exists(name) or not fs.rename(draft, name):
            fs.delete(draft, False)
            raise OSError(f"manifest {number} was written by someone else")
        manifest["number"] = number
        for old in self._numbers()[:-2]:
            fs.delete(self._path(f"manifest-{old:012d}.json"), False)

    def _checked(self, name: str, run_id: str, df: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], SCHEMAS[name])
        out = want.unionByName(df, allowMissingColumns=True)
        if "run_id" in out.columns:
            own = F.coalesce("run_id", F.lit(run_id))
            out = out.withColumn("run_id", F.when(own == run_id, own).otherwise(F.raise_error(F.concat(F.lit(f"{name}: a row of run "), own)).cast("string")))
        if extra := set(out.columns) - set(want.columns):
            raise ValueError(f"{name} has no columns {sorted(extra)}")
        for (table, column), known in VOCABULARIES.items():
            if table == name:
                fine = F.col(column).isin(known)
                out = out.withColumn(column, F.when(fine, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{name}.{column} cannot be "), F.coalesce(column, F.lit("null")))).cast("string")))
        if name == "vectors":
            fine = F.size("embedding") == F.lit(self.embedding_dim) if self.embedding_dim else F.lit(True)
            norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
            unit = F.transform("embedding", lambda x: (x / norm).cast("float"))
            out = out.withColumn("embedding", F.when(~fine, F.raise_error(F.lit("a vector of another dimension")).cast("array<float>")).when(norm > 0, unit).otherwise(F.raise_error(F.lit("a zero vector")).cast("array<float>")))
        return out

    def write(self, run_id: str, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None) -> None:
        """The run's rows of the replaced tables are these from now on, and those of the appended ones come to it: all of it or nothing."""
        manifest = self._load()
        for tables, new in ((replaced or {}, True), (appended or {}, False)):
            for name, df in tables.items():
                version = uuid.uuid4().hex
                self._checked(name, run_id, df).write.parquet(f"{self.root}/{name}/run_id={run_id}/v={version}")
                held = manifest["tables"].setdefault(name, {})
                held[run_id] = [version] if new else [*held.get(run_id, []), version]
        self._save(manifest)

    @contextmanager
    def scratch(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """A function that writes a step's table beside the store's and reads it back; all of them go at the end."""
        folder = f"scratch/{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            path = f"{self.root}/{folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield keep
        finally:
            self._fs().delete(self._path(folder), True)

    def replace(self, name: str, run_id: str, df: DataFrame) -> None:
        """The run's rows of the table are df's rows from now on."""
        self.write(run_id, replaced={name: df})

    def append(self, name: str, run_id: str, df: DataFrame) -> None:
        self.write(run_id, appended={name: df})

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        """The table, of one run or of all; only the run's files are listed."""
        runs = self._load()["tables"].get(name, {})
        paths = [f"{self.root}/{name}/run_id={r}/v={v}" for r, versions in sorted(runs.items()) if run_id in (None, r) for v in versions]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths)

    def replace_claims(self, run_id: str, df: DataFrame, doc_id: str | None = None) -> None:
        """New claims of a run, or of one of its documents; verdicts of claims that are gone go with them, in the same step."""
        if doc_id is not None:
            wrong = F.raise_error(F.lit("claims: a row of another document")).cast("string")
            df = df.withColumn("doc_id", F.when(F.col("doc_id") == doc_id, F.col("doc_id")).otherwise(wrong))
            df = self.read("claims", run_id).where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))).unionByName(df, allowMissingColumns=True)
        verdicts = self.read("verdicts", run_id).join(df.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
        self.write(run_id, replaced={"claims": df, "verdicts": verdicts})

    def add_chunks(self, run_id: str, doc_id: str, chunks: DataFrame, vectors: DataFrame) -> None:
        """Chunks of a known document with a vector each, or a ValueError and no change."""
        if not self.read("documents", run_id).where(F.col("id") == doc_id).limit(1).count():
            raise ValueError(f"run {run_id} has no document {doc_id}")
        ids, with_vector = chunks.select("id"), vectors.select(F.col("chunk_id").alias("id"))
        n, m = ids.count(), with_vector.count()
        if n != m or ids.join(with_vector, "id", "left_anti").limit(1).count():
            raise ValueError(f"{n} chunks, {m} vectors: each chunk needs its own")
        if not n:
            raise ValueError(f"document {doc_id} has no text")
        self.write(run_id, appended={"chunks": chunks.withColumn("doc_id", F.lit(doc_id)), "vectors": vectors})

    def delete_chunks(self, run_id: str, doc_id: str) -> None:
        """A document's chunks go, and their vectors with them."""
        chunks = self.read("chunks", run_id)
        gone = chunks.where(F.col("doc_id") == doc_id).select(F.col("id").alias("chunk_id"))
        kept = self.read("vectors", run_id).join(gone, "chunk_id", "left_anti")
        self.write(run_id, replaced={"chunks": chunks.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))), "vectors": kept})

    def create_run(self, run_id: str, uploads: DataFrame, job: DataFrame) -> None:
        """A run with its uploads and its first job: all of it or nothing."""
        if self.read("runs", run_id).limit(1).count():
            raise ValueError(f"run {run_id} exists")
        run = self.spark.range(1).select(F.lit(run_id).alias("id"), F.current_timestamp().alias("created_at"), F.lit("CREATED").alias("status"))
        self.write(run_id, replaced={"runs": run, "uploads": uploads, "jobs": job})

    def set_run_status(self, run_id: str, status: str, error: str | None = None) -> None:
        run = self.get_run(run_id)
        self.replace("runs", run_id, run.withColumn("status", F.lit(status)).withColumn("error", F.lit(error).cast("string")))

    def get_run(self, run_id: str) -> DataFrame:
        run = self.read("runs", run_id)
        if not run.limit(1).count():
            raise LookupError(f"no run {run_id}")
        return run

    def list_claims(self, run_id: str, doc_id: str | None = None) -> DataFrame:
        """A run's claims by page (those without one last) and id."""
        claims = self.read("claims", run_id)
        claims = claims if doc_id is None else claims.where(F.col("doc_id") == doc_id)
        return claims.orderBy(F.asc_nulls_last("page"), "id")

    def run_scores(self, run_id: str) -> DataFrame:
        """The latest scores of a run: one row or none."""
        return self.read("run_scores", run_id).orderBy(F.desc("created_at")).limit(1)

    def uploaded_documents(self, run_id: str) -> DataFrame:
        """Documents with file_name and path of the upload they came from (null where it is gone)."""
        uploads = self.read("uploads", run_id).select(F.col("id").alias("upload_id"), "file_name", "path")
        return self.read("documents", run_id).join(uploads, "upload_id", "left")

    def sources_by_total(self, run_id: str) -> DataFrame:
        """Source credibility with the documents' titles, the best first."""
        titles = self.read("documents", run_id).select(F.col("id").alias("doc_id"), "title")
        return self.read("source_credibility", run_id).join(titles, "doc_id").orderBy(F.desc_nulls_last("total"), "doc_id")

    def models(self, run_id: str) -> list[str]:
        """The models that a run's verdicts name."""
        return sorted(r[0] for r in self.read("verdicts", run_id).select("model").where("model is not null").distinct().limit(1000).collect())
