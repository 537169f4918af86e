"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, from the
multivariate hypergeometric distribution, so that column sums are the exact shard
sizes.  Every partition deals its rows out in random order, the rows are exchanged
once, and each shard is permuted again.  Shards are cut in blocks (further
columns of the matrix), so that no shard is sorted in one task.

The matrix is never held anywhere.  The partitions are halved again and again; at each
halving, how much of every column falls to the first half is drawn with a seed
that only depends on the place of the halving.  A task walks down to its own partition
and so draws its own row, the same in every attempt; what travels to it is one number
a partition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, is_scan, materialise

#: Rows of a block of a shard, and blocks of all shards at most; beyond their product blocks grow, and their sort spills.
BLOCK_ROWS, MAX_BLOCKS = 16_384, 16_384
#: Urns up to this size are drawn from by NumPy.
_NUMPY_URN = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n drawn without replacement; for urns of any size.

    Inverse transform over the values within 14 standard deviations of the mean (the
    rest has a probability under 1e-40).
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    if total < _NUMPY_URN:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * good / total
    sd = math.sqrt(max(mean * (bad / total) * ((total - n) / max(total - 1, 1)), 0.0))
    lo, hi = max(low, math.floor(mean - 14 * sd - 14)), min(high, math.ceil(mean + 14 * sd + 14))
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def split(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn without replacement belong to each column."""
    total = int(columns.sum())
    if total < _NUMPY_URN:
        return rng.multivariate_hypergeometric(columns, n, method="marginals")
    out = np.zeros_like(columns)
    for c, size in enumerate(columns.tolist()):
        total -= size
        out[c] = x = hypergeometric(rng, size, total, n) if total else n
        n -= x
    return out


def matrix_row(before: np.ndarray, sizes: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the matrix with these column sums; before: the rows of all partitions up to each one, 0 first.

    All rows together are distributed as in a uniform shuffle, and add up to sizes.
    """
    lo, hi, columns = 0, len(before) - 1, sizes
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = split(np.random.default_rng((seed, lo, hi)), columns, int(before[mid] - before[lo]))
        if p < mid:
            hi, columns = mid, first
        else:
            lo, columns = mid, columns - first
    return columns


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 13, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Every assignment with shard sizes at most one apart is equally likely, in every
    order.  Rows of equal text are dealt one by one like any others, so they can land in
    different shards: a uniform shuffle cannot keep them together.  The result depends on
    the seed and the input's partitions alone; an input that is no plain scan of files is
    written to the shared folder first, so that a task run again sees its rows again.

    Rows are never looked into: nulls, empty and very long texts and repeated rows are
    dealt like any other.  An empty table gives no rows.  Columns named shard or slot are
    replaced, all others stay, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    docs = docs.drop("shard", "slot")
    if not is_scan(docs):
        docs = materialise(docs, "rows")
    counts = sorted((r[0], r[1]) for r in docs.groupBy(F.spark_partition_id().alias("p")).count().collect())
    total = sum(n for _, n in counts)
    blocks = max(1, min(-(-total // (n_shards * block_rows)), MAX_BLOCKS // n_shards))

    def even(n: int, parts: int) -> list[int]:
        return [n // parts + (i < n % parts) for i in range(parts)]

    sizes = np.array([b for s in even(total, n_shards) for b in even(s, blocks)], np.int64)
    before = np.concatenate(([0], np.cumsum(np.array([n for _, n in counts], np.int64))))
    numbers = np.array([p for p, _ in counts], np.int64)
    held: dict[int, np.ndarray] = {}

    @F.arrow_udf("int")
    def cell(row: pa.Array) -> pa.Array:
        x = row.to_numpy(zero_copy_only=False)
        out = np.empty(len(x), np.int32)
        part, place = x >> 33, x & ((1 << 33) - 1)
        for p in np.unique(part).tolist():
            if p not in held:
                held.clear()
                mine = matrix_row(before, sizes, int(np.searchsorted(numbers, p)), seed)
                held[p] = np.random.default_rng((seed, 1, p)).permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), mine))
            of = part == p
            out[of] = held[p][place[of]]
        return pa.array(out)

    row_name, cell_name = fresh(docs, "row"), fresh(docs, "cell")
    dealt = docs.withColumn(row_name, F.monotonically_increasing_id()).withColumn(cell_name, cell(row_name))
    c = F.col(cell_name)
    # sizes of shards, and of blocks in them, are at most one apart: where a block starts follows by arithmetic
    shard_no, block_no = F.floor(c / blocks), c % blocks
    size = F.lit(total // n_shards) + (shard_no < total % n_shards).cast("long")
    start = block_no * F.floor(size / blocks) + F.least(block_no, size % blocks)
    order = F.row_number().over(Window.partitionBy(cell_name).orderBy(F.xxhash64(F.lit(seed), row_name), row_name))
    return dealt.select(*[F.col(f"`{n}`") for n in docs.columns], shard_no.cast("int").alias("shard"), (start + order - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder shard=<n> each, its files in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
