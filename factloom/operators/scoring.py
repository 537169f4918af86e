"""Scores of runs and sources: conditional aggregates, weighted means and step ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SUPPORTED, CONTRADICTED, UNVERIFIABLE = VERDICTS = ("SUPPORTED", "CONTRADICTED", "UNVERIFIABLE")
#: Points of a source's verification tier.
TIER_POINTS = {"VERIFIED_DOI": 20.0, "VERIFIED_TITLE": 15.0, "VERIFIED_ISBN": 12.0, "METADATA_ONLY": 5.0, "NONE": 0.0}


def is_downgraded(raw: str = "raw_verdict", final: str = "verdict") -> Column:
    """The judge's verdict was not kept."""
    return F.col(raw).isNotNull() & ~F.col(raw).eqNullSafe(F.col(final))


def is_correct() -> Column:
    """Asserted claims agree with SUPPORTED, disavowed ones with CONTRADICTED; no stance is asserted."""
    agreeing = F.when(F.coalesce("stance", F.lit("asserted")) == "disavowed", CONTRADICTED).otherwise(SUPPORTED)
    return F.col("verdict") == agreeing


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def accuracy(verdicts: DataFrame, *by: str) -> DataFrame:
    """Stance-aware agreement: counts, accuracy (null if nothing is decided) and coverage (null without rows)."""
    decided = F.col("verdict").isin(SUPPORTED, CONTRADICTED)
    counts = verdicts.groupBy(*by).agg(
        _n(F.col("verdict") == SUPPORTED).alias("supported"), _n(F.col("verdict") == CONTRADICTED).alias("contradicted"), _n(F.col("verdict") == UNVERIFIABLE).alias("unverifiable"),
        F.count("*").alias("total"), _n(is_correct()).alias("correct"), _n(decided).alias("decided"), _n(F.col("stance") == "disavowed").alias("disavowed"),
    )
    return counts.withColumns({
        "incorrect": F.col("decided") - F.col("correct"),
        "accuracy": F.bround(F.try_divide("correct", "decided"), 4),
        "coverage": F.bround(F.try_divide("decided", "total"), 4),
    }).drop("decided")


def verdict_summary(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by).agg(
        F.count("*").alias("total"), *[_n(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], _n(is_downgraded()).alias("downgraded"),
        _n(F.col("year_flag") == 1).alias("year_flagged"), _n(F.size("evidence_chunk_ids") == 0).alias("no_evidence"),
    )


def report_stats(verdicts: DataFrame, *by: str) -> DataFrame:
    return verdicts.groupBy(*by).agg(*[_n(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], _n(is_downgraded()).alias("downgraded"))


def filter_counts(verdicts: DataFrame) -> DataFrame:
    """(filter, claims): ALL and each verdict, also those that no claim has."""
    spark = verdicts.sparkSession
    names = spark.createDataFrame([(n,) for n in ("ALL", *VERDICTS)], "filter string")
    counted = verdicts.rollup("verdict").agg(F.count("*").alias("n"), F.grouping("verdict").alias("all")).select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("verdict")).alias("filter"), "n")
    return F.broadcast(names).join(counted, "filter", "left").select("filter", F.coalesce("n", F.lit(0)).cast("long").alias("claims"))


def usage_weighted_mean(sources: DataFrame, *by: str) -> DataFrame:
    """(score, method) over (total, usage): weighted by usage, or the plain mean if nothing is used."""
    used = F.sum(F.coalesce("usage", F.lit(0)))
    weighted = F.try_divide(F.sum(F.col("total") * F.coalesce("usage", F.lit(0))), used)
    return sources.groupBy(*by).agg(
        F.bround(F.when(used > 0, weighted).otherwise(F.avg("total")), 1).alias("score"),
        F.when(F.count("*") == 0, "no_sources").when(used > 0, "usage_weighted_mean").otherwise("unweighted_mean_no_usage").alias("method"),
    )


def recency_score(sources: DataFrame, current_year: int, *by: str) -> DataFrame:
    """Step score of the mean age of dated sources; null without dates."""
    age = F.avg(F.when(F.col("year").isNotNull(), F.greatest(F.lit(0), current_year - F.col("year"))))
    return sources.groupBy(*by).agg(F.when(age <= 2, 100.0).when(age <= 5, 80.0).when(age <= 10, 60.0).when(age.isNotNull(), 40.0).alias("recency"))


def validity_total(components: DataFrame, weights: dict[str, float], *by: str) -> DataFrame:
    """Weighted mean of (component, score) rows with a score; weights of missing components are left out.

    A group in which nothing can be weighed raises an error when it is computed.
    """
    table = components.sparkSession.createDataFrame(sorted(weights.items()), "component string, weight double")
    rows = components.where("score is not null").join(F.broadcast(table), "component")
    groups = components.select(*by).distinct()
    total = rows.groupBy(*by).agg(F.bround(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")), 1).alias("validity"))
    out = groups.join(total, list(by), "left")
    return out.withColumn("validity", F.coalesce("validity", F.raise_error(F.lit("no validity component can be weighed")).cast("double")))


def source_score(sources: DataFrame, tier1: list[str], tier2: list[str], current_year: int) -> DataFrame:
    """Adds completeness, authority, recency, verification and total to rows of source metadata and tier."""
    present = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("title", "publisher", "publication_date", "doi")] + [F.coalesce(F.size("authors") > 0, F.lit(False))]
    completeness = 30.0 * sum((p.cast("int") for p in present), F.lit(0)) / 5
    year = T.year_of("publication_date")
    age = F.greatest(F.lit(0), current_year - year)  # null is skipped by greatest
    recency = F.when(year.isNull(), 0.0).when(age <= 2, 20.0).when(age <= 5, 12.0).when(age <= 10, 6.0).otherwise(3.0)
    points = F.coalesce(F.create_map(*[F.lit(x) for p in TIER_POINTS.items() for x in p])[F.col("tier")], F.lit(0.0))
    out = sources.withColumns({"completeness": completeness, "authority": T.publisher_authority("publisher", tier1, tier2), "recency": recency, "verification": points})
    return out.withColumn("total", F.bround(F.col("completeness") + F.col("authority") + F.col("recency") + F.col("verification"), 1))
