"""Matching claims with a golden set: candidates by shared tokens or values, then one-to-one greedy pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def candidates(golden: DataFrame, rows: DataFrame) -> DataFrame:
    """(set_id, g, r, shared, quality) of golden rows and rows that match, both (set_id, id, text, value, year).

    They match if their values agree and their years do not differ, or if the smaller
    token set is shared to 60 % or more.  Token pairs come from an inverted index; pairs
    by value from a join on buckets of the logarithm of the value.
    """
    side = lambda df, p: df.select("set_id", F.col("id").alias(p), T.tokens("text").alias(f"t{p}"), F.col("value").cast("double").alias(f"v{p}"), F.col("year").alias(f"y{p}"))
    g, r = side(golden, "g"), side(rows, "r")
    by_token = g.select("set_id", "g", F.explode("tg").alias("t")).join(r.select("set_id", "r", F.explode("tr").alias("t")), ["set_id", "t"]).groupBy("set_id", "g", "r").agg(F.count("*").alias("shared"))
    sizes_g, sizes_r = g.select("set_id", "g", F.size("tg").alias("ng"), "vg", "yg"), r.select("set_id", "r", F.size("tr").alias("nr"), "vr", "yr")
    # values within 0.1 % lie in the same bucket of width 1 % or in neighbouring ones
    bucket = lambda v: F.when(v == 0, F.lit(None)).otherwise(F.floor(F.log(F.abs(v)) * 100))
    near = sizes_g.where("vg is not null").withColumn("b", F.explode(F.when(F.col("vg") == 0, F.array(F.lit(-(10**9)).cast("long"))).otherwise(F.array(*[bucket(F.col("vg")) + d for d in (-1, 0, 1)]))))
    by_value = near.join(r.where("vr is not null").select("set_id", "r", "vr", F.coalesce(bucket(F.col("vr")), F.lit(-(10**9)).cast("long")).alias("b")), ["set_id", "b"]).where(T.values_match("vg", "vr")).select("set_id", "g", "r", F.lit(0).cast("long").alias("shared"))
    pairs = by_token.unionByName(by_value).groupBy("set_id", "g", "r").agg(F.max("shared").alias("shared"))
    full = pairs.join(sizes_g, ["set_id", "g"]).join(sizes_r, ["set_id", "r"])
    share = F.coalesce(F.try_divide(F.col("shared"), F.least("ng", "nr")), F.lit(0.0))
    same = T.values_match("vg", "vr")
    years = F.col("yg").isNull() | F.col("yr").isNull() | (F.col("yg") == F.col("yr"))
    return full.where((same & years) | (share >= T.OVERLAP_THRESHOLD)).select("set_id", "g", "r", "shared", (share + F.when(same, 0.5).otherwise(0.0)).alias("quality"))


def greedy_pairs(pairs: DataFrame, best_fit: bool = True) -> DataFrame:
    """(set_id, g, r): golden rows in order take the best (or first) row that is still free.

    Each set is one sequence of decisions, so it is one group; a set is a golden file
    against a run and small by nature.  Ties go to the smaller row.
    """
    schema = "set_id string, g long, r long"

    def pair(pdf):
        import pandas as pd

        taken: set[int] = set()
        out = []
        pdf = pdf.sort_values(["g", "quality", "r"], ascending=[True, False, True]) if best_fit else pdf.sort_values(["g", "r"])
        for g, part in pdf.groupby("g", sort=False):
            free = next((r for r in part["r"] if r not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((str(part["set_id"].iloc[0]), g, free))
        return pd.DataFrame(out, columns=["set_id", "g", "r"])

    return pairs.groupBy("set_id").applyInPandas(pair, schema)


def extraction_score(golden: DataFrame, rows: DataFrame, paired: DataFrame) -> DataFrame:
    """(set_id, golden, extracted, matched, recall, precision)."""
    n = lambda df, name: df.groupBy("set_id").agg(F.count("*").alias(name))
    out = n(golden, "golden").join(n(rows, "extracted"), "set_id", "full_outer").join(n(paired, "matched"), "set_id", "left").na.fill(0, ["golden", "extracted", "matched"])
    return out.withColumns({"recall": F.coalesce(F.try_divide("matched", "golden"), F.lit(0.0)), "precision": F.coalesce(F.try_divide("matched", "extracted"), F.lit(0.0))})


def confusion(labelled: DataFrame, classes: list[str]) -> DataFrame:
    """A row per expected class with counts of each predicted class and OTHER, from (expected, predicted)."""
    named = labelled.withColumn("predicted", F.when(F.col("predicted").isin(classes), F.col("predicted")).otherwise("OTHER"))
    return named.groupBy("expected").pivot("predicted", [*classes, "OTHER"]).agg(F.count(F.lit(1))).na.fill(0)


def missed(golden: DataFrame, paired: DataFrame) -> DataFrame:
    """Golden rows (set_id, id, text) that no row was paired with."""
    return golden.select("set_id", "id", "text").join(paired.select("set_id", F.col("g").alias("id")), ["set_id", "id"], "left_anti")


def _expected(golden: DataFrame, rows: DataFrame, paired: DataFrame, column: str) -> DataFrame:
    """(set_id, g, text, expected, paired, actual): every golden row with the column of the row it is paired with."""
    g = golden.select("set_id", F.col("id").alias("g"), "text", F.col(column).alias("expected"))
    actual = paired.select("set_id", "g", "r").join(rows.select("set_id", F.col("id").alias("r"), F.col(column).alias("actual")), ["set_id", "r"])
    return g.join(actual.withColumn("paired", F.lit(True)), ["set_id", "g"], "left").withColumn("paired", F.coalesce("paired", F.lit(False))).drop("r")


def verdict_classes(golden: DataFrame, rows: DataFrame, paired: DataFrame) -> DataFrame:
    """(set_id, expected, golden, total, correct): golden rows of each expected verdict, how many are paired, and how many of these agree."""
    right = F.col("paired") & F.col("actual").eqNullSafe(F.col("expected"))
    return _expected(golden, rows, paired, "verdict").groupBy("set_id", "expected").agg(F.count("*").alias("golden"), F.count_if("paired").alias("total"), F.count_if(right).alias("correct"))


def verdict_score(classes: DataFrame) -> DataFrame:
    """(set_id, golden, matched, correct, accuracy, coverage) from verdict_classes(); shares of nothing are 0."""
    out = classes.groupBy("set_id").agg(F.sum("golden").alias("golden"), F.sum("total").alias("matched"), F.sum("correct").alias("correct"))
    return out.withColumns({"accuracy": F.coalesce(F.try_divide("correct", "matched"), F.lit(0.0)), "coverage": F.coalesce(F.try_divide("matched", "golden"), F.lit(0.0))})


def _stances(golden: DataFrame, rows: DataFrame, paired: DataFrame) -> DataFrame:
    """Golden rows with a stance; a paired row without one is asserted."""
    return _expected(golden, rows, paired, "stance").where("expected IS NOT NULL").withColumn("actual", F.coalesce(F.when(F.col("actual") != "", F.col("actual")), F.lit("asserted")))


def stance_score(golden: DataFrame, rows: DataFrame, paired: DataFrame) -> DataFrame:
    """(set_id, agreed, labelled, unpaired) over golden rows with a stance: those paired with the same, paired, and not paired."""
    agree = F.col("paired") & (F.col("actual") == F.col("expected"))
    return _stances(golden, rows, paired).groupBy("set_id").agg(F.count_if(agree).alias("agreed"), F.count_if("paired").alias("labelled"), F.count_if(~F.col("paired")).alias("unpaired"))


def stance_disagreements(golden: DataFrame, rows: DataFrame, paired: DataFrame) -> DataFrame:
    """(set_id, g, claim, expected, actual) of pairs whose stances differ; claim has the text's first 80 characters."""
    return _stances(golden, rows, paired).where("paired AND actual != expected").select("set_id", "g", F.substring("text", 1, 80).alias("claim"), "expected", "actual")
