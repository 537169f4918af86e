"""Credibility of sources: identity against registries, and gaps filled from their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RECORD = "struct<key:string,titles:array<string>,publisher:string,families:array<string>,year:int>"


def _record() -> F.Column:
    return F.struct(F.col("key"), F.col("titles"), F.col("publisher"), F.col("families"), F.col("year"))


def record_titles(title, subtitle) -> F.Column:
    """A record's titles, and its first title with its first subtitle."""
    t, s = F.filter(F.coalesce(title, F.array().cast("array<string>")), lambda x: x != ""), F.filter(F.coalesce(subtitle, F.array().cast("array<string>")), lambda x: x != "")
    return F.when((F.size(t) > 0) & (F.size(s) > 0), F.concat(t, F.array(F.concat_ws(" ", F.try_element_at(t, F.lit(1)), F.try_element_at(s, F.lit(1)))))).otherwise(t)


def resolve_tiers(sources: DataFrame, works: DataFrame, books: DataFrame) -> DataFrame:
    """sources with tier and record: found by DOI, by title and one more field, by ISBN and title or publisher, or not.

    sources: doc_id, title, authors (array), publisher, publication_date, doi, isbn.
    works: key, doi, titles, publisher, families, year.  books: key, isbn, titles, publisher, families, year.
    """
    doi = works.where("doi is not null").select(T.clean_doi("doi").alias("_doi"), _record().alias("r_doi")).groupBy("_doi").agg(F.min_by("r_doi", "r_doi.key").alias("r_doi"))
    rows = sources.withColumns({"_doi": T.clean_doi("doi"), "_title": T.normalize_title(F.coalesce("title", F.lit(""))), "_isbn": T.clean_isbn("isbn")})
    rows = rows.join(doi, "_doi", "left")
    titled = works.select(F.explode(F.array_distinct(F.transform("titles", T.normalize_title))).alias("_title"), _record().alias("w")).where("_title != ''")
    year, families = T.year_of("publication_date"), T.family_names("authors")
    close = ~F.coalesce(F.col("_title").rlike(r"(?U)\b(19|20)\d{2}\b"), F.lit(False)) & F.coalesce(F.abs(year - F.col("w.year")) <= 1, F.lit(False))
    people = F.coalesce(F.arrays_overlap(families, F.transform(F.col("w.families"), F.lower)), F.lit(False))
    by_title = rows.select("doc_id", "_title", "publication_date", "authors", "publisher").join(titled, "_title").where(close | people | T.publishers_agree("publisher", "w.publisher")).groupBy("doc_id").agg(F.min_by("w", "w.key").alias("r_title"))
    rows = rows.join(by_title, "doc_id", "left")
    core = lambda c: F.coalesce(T.isbn_core(c), c)
    booked = books.select(core(T.clean_isbn("isbn")).alias("_core"), _record().alias("b")).where("_core is not null").groupBy("_core").agg(F.min_by("b", "b.key").alias("b"))
    rows = rows.withColumn("_core", core(F.col("_isbn"))).join(booked, "_core", "left")
    corroborated = F.coalesce((F.col("_title") != "") & F.array_contains(F.transform(F.col("b.titles"), T.normalize_title), F.col("_title")), F.lit(False)) | F.coalesce(T.publishers_agree("publisher", "b.publisher"), F.lit(False))
    some = F.coalesce(F.col("title") != "", F.lit(False)) | F.coalesce(F.size("authors") > 0, F.lit(False))
    for c in ("publisher", "publication_date", "doi", "isbn"):
        some |= F.col(c).isNotNull()
    tier = F.when(F.col("r_doi").isNotNull(), "VERIFIED_DOI").when(F.col("r_title").isNotNull(), "VERIFIED_TITLE").when(F.col("b").isNotNull() & corroborated, "VERIFIED_ISBN").when(some, "METADATA_ONLY").otherwise("NONE")
    rows = rows.withColumn("tier", tier)
    record = F.coalesce("r_doi", "r_title", F.when(F.col("tier") == "VERIFIED_ISBN", F.col("b")))
    return rows.withColumn("record", record).select(*sources.columns, "tier", "record")


def merge_records(resolved: DataFrame) -> DataFrame:
    """Empty publisher, date and title filled from the record; what the document states is kept."""
    fill = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return resolved.withColumns({"publisher": fill("publisher", F.col("record.publisher")), "publication_date": fill("publication_date", F.col("record.year").cast("string")), "title": fill("title", F.try_element_at(F.col("record.titles"), F.lit(1)))})
