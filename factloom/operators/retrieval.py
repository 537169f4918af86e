"""Retrieval: BM25 over phrases, nearest vectors inside partitions, and their fusion by reciprocal ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sizes import is_few

# BM25 and fusion constants.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, POOL, EVIDENCE_K = 60, 20, 8
#: Vectors of a block that is held in memory.
BLOCK_ROWS = 20_000


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, pos) of every word of (chunk_id, text)."""
    return chunks.select("chunk_id", F.posexplode(T.fold_words("text")).alias("pos", "term"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int | None = POOL, same: list[str] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks (chunk_id, text) by queries (query_id, text).

    Each whitespace-separated token of a query is a phrase of its words, and any phrase
    may match; a phrase that a query repeats counts again.  Document frequencies, the
    number of chunks and their mean length are those of all chunks, whatever ``same``
    (columns that chunk and query must share) lets through afterwards.  Ties go to the
    smaller chunk_id, scores being rounded to nine places.  Only postings of query terms
    are shuffled, those of single words as counts.
    """
    same = same or []
    asked = queries.select("query_id", *[F.col(c).alias(f"_q_{c}") for c in same], F.explode(T.search_phrases("text")).alias("p"))
    asked = asked.groupBy("query_id", *[f"_q_{c}" for c in same], F.array_join("p", " ").alias("phrase")).agg(F.count("*").alias("times"))
    # distinct phrases and their words are no more than a bounded multiple of what is asked: a broadcast only if that is few
    small = is_few(asked)
    near = F.broadcast if small else (lambda df: df)
    phrases = asked.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("p"))
    whole = chunks.select("chunk_id", *same, T.fold_words("text").alias("w")).withColumn("dl", F.size("w"))
    stats = chunks.select(T.n_words("text").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    # outer, and nulls dropped after it: the plain generator makes the optimizer split each text once more, to see if it has words
    posted = whole.select("chunk_id", *same, "dl", F.posexplode_outer("w").alias("pos", "term")).where("term is not null")
    place = ["chunk_id", "dl", *same]
    # a phrase of one word is counted before anything is shuffled; only longer ones need places
    single = posted.join(near(phrases.where(F.size("p") == 1).select("phrase", F.col("p")[0].alias("term"))), "term").groupBy("phrase", *place).agg(F.count("*").alias("tf"))
    terms = phrases.where(F.size("p") > 1).select("phrase", F.size("p").alias("words"), F.posexplode("p").alias("i", "term"))
    starts = posted.join(near(terms), "term").groupBy("phrase", "words", *place, (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("m")).where("m = words")
    tf = single.union(starts.groupBy("phrase", *place).agg(F.count("*").alias("tf")))
    # asks for tf, so that the exchange below it is the same as the other one's, and done once
    df = tf.groupBy("phrase").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("phrase", "avgdl", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR)).alias("idf"))
    weight = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = tf.join(near(asked), "phrase").join(near(idf), "phrase")
    for c in same:
        rows = rows.where(F.col(c) == F.col(f"_q_{c}"))
    scored = rows.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"))
    return _ranked(scored, F.desc(F.round("score", 9)), k)


def _ranked(scored: DataFrame, order, k: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "chunk_id")).cast("long")
    out = scored.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def _scan(k: int):
    """Rows (block, kind, id, vector) sorted by block and kind: vectors, then queries -> the block's k nearest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, unit = None, [], [], None
        for batch in batches:
            key, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            if not len(key):
                continue
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if key[lo] != block:
                    block, ids, rows, unit = key[lo], [], [], None
                x = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                own = part["id"].to_numpy()
                if kind[lo] == 0:
                    ids.append(own)
                    rows.append(x)
                    continue
                if not ids:
                    continue
                if unit is None:
                    all_ids, unit = np.concatenate(ids), np.concatenate(rows)
                    order = np.argsort(all_ids, kind="stable")
                    all_ids, unit = all_ids[order], unit[order]
                for a in range(0, len(x), 256):
                    score = np.round(x[a : a + 256] @ unit.T, 9)
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(own[a : a + 256], top.shape[1]), "chunk_id": all_ids[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = POOL, partition: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k vectors (chunk_id, vector) of largest cosine for each query (query_id, vector).

    With partition columns, both sides are compared inside equal values only.  Vectors
    are cut in blocks of bounded size; each query meets each block of its partition
    once and leaves with k rows, which are merged.  Cosines are rounded to nine places and ties
    go to the smaller chunk_id.  A zero vector raises an error.
    """
    by = partition or []
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    safe = F.when(norm > 0, F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.lit("a zero vector")).cast("array<double>"))
    base = vectors.select(*by, F.col("chunk_id").cast("long").alias("id"), safe.alias("vector"))
    sizes = base.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes) if by else F.broadcast(base.agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    attach = lambda df: df.join(sizes, by) if by else df.crossJoin(sizes)
    key = lambda n: F.xxhash64(*by, n)
    index = attach(base).select(key(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("block"), F.lit(0).alias("kind"), "id", "vector")
    asked = queries.select(*by, F.col("query_id").cast("long").alias("id"), safe.alias("vector"))
    asked = attach(asked).select(F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), key)).alias("block"), F.lit(1).alias("kind"), "id", "vector")
    dealt = index.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    found = dealt.mapInArrow(_scan(k), "query_id long, chunk_id long, score double")
    return _ranked(found, F.desc("score"), k)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank, channels): sums of 1 / (60 + rank) over both channels.

    Ties: vector hits by their rank come before hits of keywords alone by theirs.
    """
    v = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("v"))
    w = keyword_hits.select("query_id", "chunk_id", F.col("rank").alias("w"))
    both = v.join(w, ["query_id", "chunk_id"], "full_outer")
    term = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", term("v") + term("w")).withColumn("tie", F.coalesce("v", F.col("w") + 10**9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "tie")).cast("long")
    channels = F.when(F.col("w").isNull(), "vector").when(F.col("v").isNull(), "keyword").otherwise("vector+keyword")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", channels.alias("channels"))


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, same: list[str] | None = None) -> DataFrame:
    """Both channels' fusion for chunks (chunk_id, text, vector) and queries (query_id, text, vector)."""
    pool = max(k, POOL)
    return fuse(knn(chunks, queries, pool, same), bm25(chunks, queries, pool, same), k)


def embed_fake(df: DataFrame, text_col: str = "text", dim: int = 8) -> DataFrame:
    """df with a deterministic unit vector per text, seeded by its crc32: a stand-in for an embedding service."""

    @F.pandas_udf("array<float>")
    def vector(crc):
        import pandas as pd

        out = []
        for c in crc:
            x = np.random.default_rng(int(c)).standard_normal(dim)
            out.append((x / math.sqrt(float((x * x).sum()))).astype(np.float32))
        return pd.Series(out)

    return df.withColumn("vector", vector(F.crc32(F.col(text_col).cast("binary"))))
