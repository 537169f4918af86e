"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A test item is a small set of shingles, a document may hold many thousands, so
their Jaccard similarity says little; containment in the document is what counts.
Items are partitioned by the size of their set; each partition has its own
sketch size k, and an item's sketch is its k least shingle hashes (bottom-k
MinHash).  With k = n - ceil(t n) + 1 for the partition's largest n, an item of
which the part t occurs in a document has a sketch value there, so the search
loses nothing.  Documents look their shingles up in the sketches; hits are
verified by counting the item's shingles that the document has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import lean, materialise, without_keys

#: Characters of test items that go to the tasks at once; more items make more blocks, each a pass over the documents.
BLOCK_CHARS = 32_000_000
#: Punctuation outside ASCII that parts words like ASCII punctuation.
PUNCTUATION = " ¡«·»¿‐‑‒–—―‘’‚“”„…•　、。"
_PUNCTUATION = re.compile(f"[{PUNCTUATION}]")


def normalise(text: str | None) -> str:
    """Lower case; punctuation outside ASCII becomes a space (ASCII punctuation parts words anyway)."""
    if not text:
        return ""
    text = text.lower()
    return text if text.isascii() else _PUNCTUATION.sub(" ", text)


def _sets(texts: list[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    for _, held in hashing.chunks([normalise(t) for t in texts]):
        h, b = hashing.words(held, hashing.NON_ALNUM, lower=False)
        yield h, b, width


class Index:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int, num: int, den: int) -> None:
        self.ids, self.sets, self.widths = [], [], []
        self.width, self.num, self.den = width, num, den
        for item, text in items:
            h, b, _ = next(_sets([text], width), (np.empty(0, np.uint64), np.zeros(2, np.int64), width))
            if not len(h):
                continue
            w = min(width, len(h))  # a shorter item is one shingle of all its words
            self.ids.append(item)
            self.widths.append(w)
            self.sets.append(np.unique(hashing.shingles(h, b, w)[0]))
        sizes = np.array([len(s) for s in self.sets], np.int64)
        part = np.floor(np.log2(np.maximum(sizes, 1))).astype(int)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in sorted(set(self.widths)):
            token, owner = [], []
            for p in sorted({part[i] for i in range(len(sizes)) if self.widths[i] == w}):
                mine = [i for i in range(len(sizes)) if self.widths[i] == w and part[i] == p]
                n = max(sizes[i] for i in mine)
                k = int(n - -(-num * n // den) + 1)
                for i in mine:
                    token.append(self.sets[i][:k])
                    owner.append(np.full(len(token[-1]), i))
            t, o = np.concatenate(token), np.concatenate(owner)
            order = np.argsort(t, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[t >> np.uint64(44)] = True
            self.by_width[w] = (t[order], o[order], seen)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(position of the text, item, its shingles, those that the text has)"""
        first = 0
        for h, b, _ in _sets(texts, self.width):
            for w, (token, owner, seen) in self.by_width.items():
                s, sb = hashing.shingles(h, b, w)
                at = np.flatnonzero(seen[s >> np.uint64(44)])
                lo, hi = np.searchsorted(token, s[at], "left"), np.searchsorted(token, s[at], "right")
                at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
                found: dict[int, set[int]] = {}
                for text, i, j in zip((np.searchsorted(sb, at, "right") - 1).tolist(), lo.tolist(), hi.tolist(), strict=True):
                    found.setdefault(text, set()).update(owner[i:j].tolist())
                for text, items in found.items():
                    own = np.unique(s[sb[text] : sb[text + 1]])
                    for i in sorted(items):
                        x = self.sets[i]
                        common = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum())
                        if self.den * common >= self.num * len(x):
                            yield first + text, i, len(x), common
            first += len(b) - 1


def _search(index: Index, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(index.search(batch["text"].to_pylist()))
            rows = batch.select(keep).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())],
                names=[*keep, "item_id", "item_shingles", "common_shingles"],
            )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    held, size = [], 0
    for r in items.toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id") -> DataFrame:
    """(<id_col>, item_id, item_shingles, common_shingles, containment) of each document row and item it contains.

    Words are runs of letters and digits, lower-cased; a document contains an item if
    it has num / den or more of the item's distinct shingles of ``width`` words (an item
    with fewer words is one shingle, its whole sequence).  Items without words, and
    null or empty documents, give nothing.  Repeated rows count each for themselves;
    null ids stay null.  The whole of every text is searched.  Items are taken in
    blocks of bounded size, one pass over the documents each.
    """
    src = docs.select(F.col(id_col).alias("id"), "text")
    kind = dict(src.dtypes)["id"]
    out = None
    for items in _blocks(benchmark.select(F.col("item_id").cast("long"), "text")):
        part = src.mapInArrow(lean(_search(Index(items, width, num, den), ["id"])), f"id {kind}, item_id long, item_shingles long, common_shingles long")
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {kind}, item_id long, item_shingles long, common_shingles long")
    return out.select(F.col("id").alias(id_col), "item_id", "item_shingles", "common_shingles", (F.col("common_shingles") / F.col("item_shingles")).alias("containment"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows whose document contains a benchmark item; columns as they were.

    Rows with the same id go together; rows without id stay.
    """
    hits = materialise(leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("_id")).where("_id is not null").distinct(), "leaks")
    return without_keys(docs, hits, id_col)
