"""Citation counts, venue totals, histograms and simple statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from citestat.functions import text as X
from citestat.operators.tables import last_value_map


def citations_per_article(citations: DataFrame, cited: str = "cited") -> DataFrame:
    return (
        citations.filter(F.col(cited).isNotNull())
        .groupBy(F.col(cited).alias("article_omid"))
        .agg(F.count(F.lit(1)).alias("citedby_count"))
    )


def attach_citations(articles: DataFrame, counts: DataFrame) -> DataFrame:
    """Articles with their count; an uncited article keeps NULL."""
    return articles.join(counts, "article_omid", "left")


def venue_totals(articles: DataFrame, venue: str = "venue_internal_id", article: str = "article_omid",
                 citations: str = "citedby_count", prefix: str = "oc") -> DataFrame:
    """Per venue: articles, citations, ratio. Rows without venue are dropped, no count adds 0."""
    return (
        articles.filter(F.col(venue).isNotNull())
        .groupBy(venue)
        .agg(
            F.count(article).alias(f"{prefix}_articles_counted"),
            F.coalesce(F.sum(citations), F.lit(0)).cast("bigint").alias(f"{prefix}_citations_counted"),
        )
        .withColumn(
            f"{prefix}_citation_article_ratio",
            F.try_divide(f"{prefix}_citations_counted", f"{prefix}_articles_counted"),
        )
    )


def articles_per_venue(articles: DataFrame, venue: str, name: str) -> DataFrame:
    """Rows per venue, a missing venue being counted too."""
    return articles.groupBy(venue).agg(F.count(F.lit(1)).alias(name))


def attach_venue_totals(journals: DataFrame, totals: DataFrame) -> DataFrame:
    return journals.join(totals, "venue_internal_id", "left")


def citation_histogram(articles: DataFrame, keys: Sequence[str] = (), article: str = "article_omid",
                       value: str = "citedby_count") -> DataFrame:
    """Distinct articles per citation count, missing count = 0."""
    counts = articles.select(*keys, article, F.coalesce(value, F.lit(0)).alias(value))
    return counts.groupBy(*keys, value).agg(F.count_distinct(article).alias("article_count"))


def mean_median(articles: DataFrame, keys: Sequence[str], value: str = "citedby_count") -> DataFrame:
    """Mean and median citations as a key/value table.

    The values are counted first, so the exact median works on distinct values only.
    """
    cells = (
        articles.select(*keys, F.coalesce(value, F.lit(0)).cast("double").alias("v"))
        .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    )
    return cells.groupBy(*keys).agg(
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_citations"),
        F.percentile("v", 0.5, F.col("c")).alias("median_citations"),
    )


def venue_publisher_counts(articles: DataFrame) -> DataFrame:
    """Rows per (venue, publisher name): raw material of the curated allow-list."""
    return (
        articles.groupBy(
            F.col("venue_name").alias("journal"), X.venue_name("publisher").alias("publisher")
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def issns_of_omids(issn_omid: DataFrame) -> DataFrame:
    """(issn -> omids) turned into (omid -> sorted issns)."""
    return (
        issn_omid.select("issn", F.explode("omids").alias("venue_omid"))
        .filter(F.col("venue_omid").isNotNull())
        .groupBy("venue_omid")
        .agg(F.array_sort(F.collect_set("issn")).alias("issns"))
    )


def omid_titles(journals: DataFrame) -> DataFrame:
    """omid -> title; the last journal listing an omid wins."""
    flat = journals.select("internal_id", "title", F.explode("omids").alias("venue_omid"))
    return last_value_map(flat, "venue_omid", "title", "internal_id")


def issn_to_internal_id(journals: DataFrame) -> DataFrame:
    """ISSN and e-ISSN -> journal id; e-ISSN entries override, later journals override."""
    flat = journals.select(
        "internal_id",
        F.posexplode(F.array("issn", "e_issn")).alias("which", "issn"),
    )
    return last_value_map(flat, "issn", "internal_id", F.struct("which", "internal_id"))
