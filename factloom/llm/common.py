"""What the operators of this subpackage share: the shared folder, materialised steps, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast as a list of keys; beyond it the join shuffles.
MAX_BROADCAST_KEYS = 1_000_000
#: Links that one task may tie together; beyond it components are found step by step.
MAX_TASK_LINKS = 1_000_000
#: The folder for local sessions that name none, as in tests.
OWN_DIR = "/tmp/checkpoints/factloom"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or OWN_DIR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_scan(df: DataFrame) -> bool:
    """Whether df reads files and only projects: its partitions then hold the same rows in the same order each time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().apply(0)
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/factloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are written: it does so only once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    """Remove what materialise() wrote, if the session is still there; a folder that stays is only lost space."""
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone before us
            if path.startswith(OWN_DIR):
                shutil.rmtree(path, ignore_errors=True)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS else keys


def with_keys(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """df joined with keys on df.<on> <=> keys.<key> (null equals null); keys are broadcast only if few."""
    key = key or on
    hidden = keys.withColumnRenamed(key, "_key")
    return df.join(_few(hidden), F.col(on).eqNullSafe(F.col("_key"))).drop("_key")


def without_keys(df: DataFrame, keys: DataFrame, on: str, key: str = "_id") -> DataFrame:
    """df's rows that have no partner in keys; keys are broadcast only if few."""
    return df.join(_few(keys.select(F.col(key).alias("_key"))), F.col(on) == F.col("_key"), "left_anti")


def lean(run):
    """run over Arrow batches, after which the worker gives back what it has allocated: workers outlive the stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return wrapped


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's signed longs."""
    return x.view(np.int64)


class Forest:
    """Union-find over whatever long keys it meets; keeps the links that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        r = x
        while (up := p.get(r, r)) != r:
            r = up
        while p.get(x, x) != r:
            p[x], x = r, p[x]
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        kept = [(a, b) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True) if forest.join(a, b)]
        if kept:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([x for _, x in kept], pa.int64())})


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            forest.join(a, b)
    nodes = sorted({*forest.parent, *forest.parent.values()})
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pa.RecordBatch.from_pydict({"node": pa.array(part, pa.int64()), "root": pa.array([forest.root(x) for x in part], pa.int64())})


def components(edges: DataFrame, max_task_links: int = MAX_TASK_LINKS) -> DataFrame:
    """(node, root) for each node of the edges (a, b: long), root the least node it is connected with.

    Each partition first keeps a spanning forest of its own edges.  If no more than
    max_task_links are left, one task ties them together.  Otherwise large-star and
    small-star steps alternate until nothing changes; each step is an aggregate
    (combined before its shuffle) and a join, and is written to the shared folder; the
    driver sees one count and one checksum a step.  Null or equal ends are no edges.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b")
    edges = materialise(edges.mapInArrow(_forests, "a long, b long"), "forest")
    if edges.limit(max_task_links + 1).count() <= max_task_links:
        return materialise(edges.coalesce(1).mapInArrow(_roots, "node long, root long"), "roots")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = None
    while True:
        # large star: every larger neighbour of u goes to the least neighbour of u
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u's smaller neighbours and u itself go to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(edges, "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
