"""Venue and ISSN census of a metadata dump, countries, grouped reductions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from citestat.functions import text as X
from citestat.operators.tables import first_non_null


def venue_rows(dump: DataFrame) -> DataFrame:
    """Name, ids and ISSN of every dump row whose venue has an ISSN; keeps ``file`` and ``type``."""
    ids = X.venue_ids("venue")
    return (
        dump.filter(F.col("venue").contains("issn"))
        .select(
            "file", X.venue_name("venue").alias("venue_name"), ids.alias("venue_ids"), "type",
            X.extract_issn(ids).alias("issn"),
        )
        .filter(F.col("issn").isNotNull())
    )


def venue_variants(dump: DataFrame) -> DataFrame:
    """Per file: distinct (name, ids, type, issn) with the rows of that ISSN in the file.

    Rows are first counted per variant, so the ISSN total is taken over variants only.
    """
    variants = venue_rows(dump).groupBy("file", "issn", "venue_name", "venue_ids", "type").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    totals = variants.groupBy("file", "issn").agg(F.sum("n_rows").alias("issn_count"))
    return variants.join(totals, ["file", "issn"])


def issn_census(dump: DataFrame) -> DataFrame:
    """Per ISSN: first name, ids and type, and the rows of the dump.

    ``issn_count`` counts every row once. ``issn_count_legacy`` adds the per-file total once
    per spelling variant and so overcounts ISSNs with several spellings.
    """
    variants = venue_variants(dump)
    order = F.struct("file", "venue_name", "venue_ids", "type")
    firsts = first_non_null(variants, ["issn"], order, ["venue_name", "venue_ids", "type"])
    sums = variants.groupBy("issn").agg(
        F.sum("n_rows").alias("issn_count"), F.sum("issn_count").alias("issn_count_legacy")
    )
    return firsts.join(sums, "issn")


def attach_country(census: DataFrame, issn_country: DataFrame) -> DataFrame:
    """Country of every ISSN and how many ISSNs that country has (NULL is a country too)."""
    tagged = census.join(issn_country, "issn", "left")
    sizes = issn_country.groupBy("country").agg(F.count(F.lit(1)).alias("country_counter"))
    sizes = sizes.withColumnRenamed("country", "_country")
    return tagged.join(sizes, F.col("country").eqNullSafe(F.col("_country")), "left").drop("_country")


def reduce_titles(journals: DataFrame, order: str, joined: str = "discipline", key: str = "title",
                  delimiter: str = "|", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per title (a missing title too): first non-null values, disciplines joined sorted."""
    rest = [c for c in (columns or journals.columns) if c not in (key, joined)]
    position = F.col(order)
    return journals.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in rest],
        F.array_join(F.array_sort(F.collect_set(joined)), delimiter).alias(joined),
    )
