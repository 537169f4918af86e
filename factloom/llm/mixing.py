"""Mixing sources to target weights: temperature weights, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The permuted order of each source is cut in 2 ** BLOCK_BITS blocks, or in the square root of its rows if that is more; only one of them is ordered row by row.
BLOCK_BITS = 12
MAX_SOURCES = 100_000


def weights(tokens: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent, normalised; a source without tokens has weight 0."""
    total = sum(tokens)
    raised = [(t / total) ** exponent if t > 0 else 0.0 for t in tokens]
    s = sum(raised)
    return [r / s for r in raised] if s else raised


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repetition(tokens: list[float], w: list[float]) -> float:
    """How often the most repeated source is run through while the least repeated one is run through once."""
    per = [x / t for x, t in zip(w, tokens, strict=True) if t > 0]
    return max(per) / min(per) if per else 1.0


def find_exponent(tokens: list[float], target_entropy: float | None = None, repetition_limit: float | None = None, steps: int = 60) -> float:
    """Bisection on [0, 1]: the largest exponent whose weights reach the entropy (nats), or else the least one that keeps the limit.

    Entropy falls and repetition falls as the exponent grows from 0 (uniform) to 1
    (as the corpus).  An entropy beyond reach gives 0, one below that of the corpus 1.
    With both, the limit goes first.
    """
    if repetition_limit is None and target_entropy is None:
        return 1.0

    def bisect(good_is_low, good):
        lo, hi = 0.0, 1.0
        if good(1.0 if good_is_low else 0.0):
            return 1.0 if good_is_low else 0.0
        if not good(0.0 if good_is_low else 1.0):
            return 0.0 if good_is_low else 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) == good_is_low else (lo, mid)
        return lo if good_is_low else hi

    least = bisect(False, lambda a: repetition(tokens, weights(tokens, a)) <= repetition_limit) if repetition_limit is not None else 0.0
    if target_entropy is None:
        return least
    return max(least, bisect(True, lambda a: entropy(weights(tokens, a)) >= target_entropy))


def n_tokens(text) -> F.Column:
    """Words (runs of non-blank characters) of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def plan(docs: DataFrame, source_col: str = "source", target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: int | None = None) -> list[tuple]:
    """(source, tokens, weight, epochs, rows) of each source; epochs: how often the budget runs through it.

    Without a budget, it is the least with which each source is run through once.
    A source without tokens is run through once.
    """
    rows = docs.select(F.col(source_col).alias("s"), n_tokens(F.col("text")).alias("t")).groupBy("s").agg(F.sum("t").alias("t"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(((r["s"], float(r["t"]), r["n"]) for r in rows), key=lambda r: (r[0] is not None, r[0]))
    tokens = [t for _, t, _ in rows]
    w = weights(tokens, find_exponent(tokens, target_entropy, repetition_limit)) if sum(tokens) else [0.0] * len(tokens)
    budget = budget_tokens if budget_tokens is not None else max((t / x for t, x in zip(tokens, w, strict=True) if t > 0), default=0.0)
    # a whole number that rounding missed is that number
    near = lambda e: float(round(e)) if abs(e - round(e)) < 1e-9 else e
    return [(s, int(t), x, near(x * budget / t) if t > 0 else 1.0, n) for (s, t, n), x in zip(rows, w, strict=True)]


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", seed: int = 7, annotate: bool = True, **target) -> DataFrame:
    """docs' rows as often as the plan says, with epoch (int), mix_weight and mix_position (double, from 0 to about 1).

    Every epoch of a source is a fresh random permutation of its rows.  All but the
    last are whole; the last takes rows in permuted order while the tokens before
    them are fewer than what is left of the source's budget.  Ordering by mix_position
    interleaves the sources in proportion to their weights.

    Blocks of the permuted order that the budget wholly includes or excludes are
    decided by their token sums alone (combined before the shuffle); only the one
    block per source in which it ends is ordered, and blocks become more as the source
    grows: a block has about the square root of the source's rows.

    Null sources are one source of their own; null or empty texts have 0 tokens and come
    with every epoch they are reached in.  Repeated rows are rows of their own; equal
    ones share a place in the order, and which of them comes first is left open.  An
    empty table gives no rows.  Columns named as the added ones are replaced; without
    annotate none is added, and all of docs' columns stay as they are, whatever their names.
    """
    spark = docs.sparkSession
    mark = "_mix"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    s, w, e, rest, k, t, b, run, before, epoch, end, ends_of = (f"{mark}_{x}" for x in ("s", "w", "e", "rest", "k", "t", "b", "run", "before", "epoch", "end", "ends_of"))
    cols = [c for c in docs.columns if not annotate or c.lower() not in ("epoch", "mix_weight", "mix_position")]
    quotas = plan(docs, source_col, **target)
    bits = max([BLOCK_BITS, *(math.ceil(math.log2(q[4]) / 2) for q in quotas if q[4])])
    kind = docs.schema[source_col].dataType.simpleString()
    quota = F.broadcast(spark.createDataFrame([(q[0], q[2], q[3], float((q[3] - math.floor(q[3])) * q[1])) for q in quotas], f"`{s}` {kind}, `{w}` double, `{e}` double, `{rest}` double"))
    rows = docs.select(*[F.col(f"`{c}`") for c in cols]).join(quota, F.col(source_col).eqNullSafe(F.col(s)))
    whole, part = F.floor(e).cast("int"), F.col(e) > F.floor(e)

    def key(n):
        return F.xxhash64(F.lit(seed), n, F.col(id_col), F.xxhash64("text"))

    full = rows.where(whole > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), whole - 1))).withColumn(k, key(F.col(epoch)))
    last = rows.where(part).withColumn(epoch, whole).withColumn(k, key(whole))
    block = F.shiftrightunsigned(k, 64 - bits).cast("int")
    # where each source's budget ends: token sums of blocks
    sums = last.select(s, rest, block.alias(b), n_tokens(F.col("text")).alias(t)).groupBy(s, b).agg(F.sum(t).alias(t), F.first(rest).alias(rest))
    so_far = F.sum(t).over(Window.partitionBy(s).orderBy(b)) - F.col(t)
    ends = sums.withColumn(before, so_far).where(F.col(before) < F.col(rest)).groupBy(F.col(s).alias(ends_of)).agg(F.max(b).alias(end), F.max_by(before, b).alias(before))
    last = last.withColumn(b, block).join(F.broadcast(ends), F.col(s).eqNullSafe(F.col(ends_of))).where(F.col(b) <= F.col(end))
    inside = last.where(F.col(b) < F.col(end))
    edge = last.where(F.col(b) == F.col(end)).withColumn(t, n_tokens(F.col("text")))
    running = F.sum(t).over(Window.partitionBy(s).orderBy(k).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(t)
    edge = edge.withColumn(run, F.col(before) + running).where(F.col(run) < F.col(rest))
    names = [*(F.col(f"`{c}`") for c in cols), epoch, w, k, e]
    out = full.select(*names).unionByName(inside.select(*names)).unionByName(edge.select(*names))
    if not annotate:
        return out.select(*names[: len(cols)])
    unit = F.shiftrightunsigned(k, 11) / F.lit(float(1 << 53))
    return out.select(*names[: len(cols)], F.col(epoch).alias("epoch"), F.col(w).alias("mix_weight"), ((F.col(epoch) + unit) / F.greatest(e, F.lit(1e-12))).alias("mix_position"))
