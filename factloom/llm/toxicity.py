"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a character n-gram; its value is log2(1 + number of the text's distinct
words that hold it), times the n-gram's log-count ratio.  Several insults of one stem
thus weigh more than one word that happens to look like it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

_WORD = re.compile(r"[^\W_]+")
#: Words of which a worker remembers the features, and (far larger) all n-grams.
_REMEMBERED, _REMEMBERED_GRAMS = 50_000, 10_000
HELD_OUT_OF = 5


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def word_ngrams(word: str, low: int, high: int) -> set[str]:
    """Character n-grams of a word between marks of its begin and end."""
    w = f"\x02{word}\x03"
    return {w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)}


@dataclass(frozen=True)
class Model:
    """weights: of each n-gram, its log-count ratio times its coefficient; bias: of every text."""

    weights: dict[str, float]
    bias: float
    low: int = 3
    high: int = 5


def _logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ratio: np.ndarray, prior: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Coefficients of the scaled features by accelerated gradient descent; prior: share of class 1 outside the sample."""
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r, _ in rows])
    cols = np.concatenate([r for r, _ in rows])
    value = np.log2(1 + np.concatenate([v for _, v in rows]).astype(np.float32)) * ratio[cols].astype(np.float32)
    share = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    norm = np.bincount(owner, value * value, len(y)) + 1
    rate = 1 / (0.25 * float((share * norm).sum()) + l2)
    w, b = np.zeros(len(ratio)), 0.0
    vw, vb = w.copy(), b
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * vw[cols], len(y)) + vb, -40, 40)))
        g = share * (p - y)
        nw = vw - rate * (np.bincount(cols, value * g[owner], len(ratio)) + l2 * vw)
        nb = vb - rate * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"y": batch["y"], "words": pa.array([" ".join(sorted(word_set(t))) for t in batch["text"].to_pylist()], pa.string())})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, low: int = 3, high: int = 5, min_rows: int = 3, max_features: int = 10_000, significance: float = 4.0, l2: float = 1e-5, steps: int = 300) -> Model:
    """Fit on at most max_rows labelled texts, half of them of each class where there are enough.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from.  The
    sample has the least hashes of doc_id of each class, so it does not depend on
    row order.  Features are the n-grams, of at least min_rows texts, whose log-count
    ratio is significance standard errors or more from 0.  A label is toxic if any of the document's labels is.  Without rows
    of both classes the model gives every text the share of toxic labels (0 if none).
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF != 0)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("y") == c).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    words = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(lean(_words_of), "y int, words string"), "words")
    size = {r[0]: r[1] for r in words.groupBy("y").count().collect()}
    if len(size) < 2:
        share = min(max(float(max(size, default=0)), 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))), low, high)
    n1, n0 = size[1] + 2, size[0] + 2
    counts = words.mapInArrow(lean(_count(low, high)), "gram string, p long, q long").groupBy("gram").agg((F.sum("p") + 1).alias("p"), (F.sum("q") + 1).alias("q")).where(F.col("p") + F.col("q") >= min_rows + 2)
    ratio = F.log(F.col("p") / n1) - F.log(F.col("q") / n0)
    error = F.sqrt(1 / F.col("p") - 1 / n1 + 1 / F.col("q") - 1 / n0)
    best = counts.select("gram", ratio.alias("r"), F.abs(ratio / error).alias("z")).where(F.col("z") >= significance).orderBy(F.desc("z"), "gram").limit(max_features)
    named = sorted((r[0], r[1]) for r in best.collect())
    names, ratios = [g for g, _ in named], np.array([r for _, r in named])
    # packed, at most max_rows texts: four bytes a feature and two a count
    rows = words.mapInArrow(lean(_features(names, low, high)), "y int, ids binary, words binary").toArrow()
    known = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    features = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.uint16)) for i, n in zip(rows["ids"], rows["words"], strict=True)]
    w, b = _logistic(features, rows["y"].to_numpy().astype(np.float64), ratios, known[1] / (known[0] + known[1]), l2, steps)
    return Model({g: float(x) for g, x in zip(names, w * ratios, strict=True) if x}, float(b), low, high)


def _grams_of(words: str, low: int, high: int, known: dict[str, set[str]]) -> set[str]:
    own: set[str] = set()
    for w in words.split():
        if w not in known:
            if len(known) > _REMEMBERED_GRAMS:
                known.clear()
            known[w] = word_ngrams(w, low, high)
        own |= known[w]
    return own


def _count(low: int, high: int):
    """Rows (y, words) -> (gram, rows of class 1, rows of class 0), counted within the partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for batch in batches:
            n = (Counter(), Counter())
            for y, words in zip(batch["y"].to_pylist(), batch["words"].to_pylist(), strict=True):
                n[y].update(_grams_of(words, low, high, known))
            names = list(n[0] | n[1])
            for lo in range(0, len(names), 50_000):
                part = names[lo : lo + 50_000]
                yield pa.RecordBatch.from_pydict({"gram": pa.array(part, pa.string()), "p": pa.array([n[1][g] for g in part], pa.int64()), "q": pa.array([n[0][g] for g in part], pa.int64())})

    return run


def _found(words: set[str], place: dict[str, int], low: int, high: int, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the distinct words, ascending, and how many of these words hold each."""
    if len(known) > _REMEMBERED:
        known.clear()
    for w in words.difference(known):
        known[w] = tuple(map(place.__getitem__, place.keys() & word_ngrams(w, low, high)))
    held = np.bincount(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int64))
    ids = np.flatnonzero(held)
    return ids, held[ids]


def _features(names: list[str], low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {g: i for i, g in enumerate(names)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [_found(set(w.split()), place, low, high, known) for w in batch["words"].to_pylist()]
            packed = {"ids": [i.astype(np.int32).tobytes() for i, _ in found], "words": [np.minimum(n, 65_535).astype(np.uint16).tobytes() for _, n in found]}
            yield pa.RecordBatch.from_pydict({"y": batch["y"]} | {k: pa.array(v, pa.binary()) for k, v in packed.items()})

    return run


def _score(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(model.weights)
        place = {g: i for i, g in enumerate(names)}
        weights = np.array([model.weights[g] for g in names])
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for i, t in enumerate(batch["_scored"]):
                ids, n = _found(word_set(t.as_py()), place, model.low, model.high, known)
                z[i] += (weights[ids] * np.log2(1 + n)).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*batch.schema.names[:-1], name])

    return run


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns keep of docs and name, from 0 to 1, of each whole text; null counts as empty (score of the bias alone)."""
    rows = docs.select(*keep, F.col("text").alias("_scored"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{name}` double"])
    return rows.mapInArrow(lean(_score(model, name)), schema)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold; columns as they were."""
    return score(docs, model, docs.columns, "_toxicity").where(F.col("_toxicity") < threshold).select(*docs.columns)
