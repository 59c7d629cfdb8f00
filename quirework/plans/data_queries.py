"""Driver queries of the core's data-preparation operators: packed values (p4) and written dates (p5)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.packed_values import split_packed, vocabulary
from quirework.operators.timestamps import estimate_zones, normalise_dates, same_history
from quirework.runtime import spread, table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of an element of subjects or authors that holds more than one."""
    terms = vocabulary(table(spark, folder, "subject_terms"), "term")
    books = spread(table(spark, folder, "epub_metadata", "harvest_id", "subjects", "authors"), "harvest_id").dropDuplicates(["harvest_id"])
    parts = split_packed(books, "harvest_id", "subjects", terms).unionByName(split_packed(books, "harvest_id", "authors", people=True))
    return parts.where("n_parts > 1").select("harvest_id", "field", "elem_pos", "part_pos", "part_text")


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values of subjects with their counts, after splitting: one row per value."""
    terms = vocabulary(table(spark, folder, "subject_terms"), "term")
    books = spread(table(spark, folder, "epub_metadata", "harvest_id", "subjects"), "harvest_id").dropDuplicates(["harvest_id"])
    parts = split_packed(books, "harvest_id", "subjects", terms)
    return parts.groupBy("part_text").agg(
        F.count("*").alias("n"), F.sum((F.col("n_parts") > 1).cast("bigint")).alias("n_packed"), F.sum((F.col("flag") == "malformed_quote").cast("bigint")).alias("n_malformed")
    )


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    books = table(spark, folder, "epub_metadata", "harvest_id", "feed_id", "publication_date", "harvested_at", "ingested_at")
    feeds = table(spark, folder, "feeds", "feed_id", F.col("tz").alias("feed_tz"), "date_order")
    return spread(books.where("publication_date IS NOT NULL"), "harvest_id").join(feeds, "feed_id", "left")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Harvests whose publication date names one valid date and isn't in its normal form.

    A feed without a zone in ``feeds`` gets the one estimated from its own local times and ingestion times.
    """
    dated = _dated(spark, folder)
    guessed = estimate_zones(dated.where("feed_tz IS NULL"), "feed_id", "publication_date", "ingested_at", order="date_order")
    dated = dated.join(guessed.select("feed_id", F.col("tz").alias("guess")), "feed_id", "left")
    forms = normalise_dates(dated, "publication_date", "date_order", F.coalesce("feed_tz", "guess"))
    return forms.where("normal_form <> publication_date").select("harvest_id", "normal_form").distinct()


def p5_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many harvests of each feed have which precision, or why there is no normal form."""
    forms = normalise_dates(_dated(spark, folder).dropDuplicates(["harvest_id"]), "publication_date", "date_order", "feed_tz")
    return forms.groupBy("feed_id", "date_status").agg(F.count("*").alias("n"))


def p5_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Every feed's zone as estimated with ``feeds.tz`` hidden, once from the local times of its harvests and once from its publication dates, beside the given one.

    Harvests are written as their feed wrote them, in local time without a zone, in order of arrival and ingested later; publication dates
    are taken as they are. ``agrees`` and ``publication_agrees`` tell whether the estimate has the given zone's offset history.
    """
    books = table(spark, folder, "epub_metadata", "harvest_id", "feed_id", "publication_date", "harvested_at", "ingested_at")
    feeds = table(spark, folder, "feeds", "feed_id", "tz", "date_order")
    rows = spread(books, "harvest_id").dropDuplicates(["harvest_id"]).join(feeds, "feed_id")
    local = rows.withColumn("local", F.date_format(F.from_utc_timestamp("harvested_at", F.col("tz")), "yyyy-MM-dd HH:mm:ss"))
    arrived = estimate_zones(local.drop("tz"), "feed_id", "local", "ingested_at", sequence="harvested_at", order="date_order")
    written = estimate_zones(local.drop("tz"), "feed_id", "publication_date", "ingested_at", order="date_order")

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_history(x, y) for x, y in zip(a, b)], dtype=bool)

    out = feeds.select("feed_id", "tz").join(arrived.select("feed_id", F.col("tz").alias("estimated"), "n_violations", "n_local"), "feed_id", "left")
    out = out.join(written.select("feed_id", F.col("tz").alias("by_publication"), F.col("n_local").alias("n_publication")), "feed_id", "left")
    return out.withColumn("agrees", same("tz", "estimated")).withColumn("publication_agrees", same("tz", "by_publication"))


QUERIES = {"p5_zones": p5_zones, "p4_found": p4_found, "p4_values": p4_values, "p5_found": p5_found, "p5_status": p5_status}
SQL: dict[str, str] = {}
