"""Job: the linked article table to all comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citestat.operators import compare, corr, metrics
from citestat.operators.selection import status_flags
from citestat.operators.tables import ordered
from citestat.session import save_and_reload
from citestat.sources import write_result


def comparison_tables(master: DataFrame) -> dict[str, DataFrame]:
    """The 24 result tables by name.

    Written once: the flagged articles, which every table reads, and the venue master, which
    the ranked lists and correlations read.
    """
    m = save_and_reload(status_flags(master), "flagged")
    names = save_and_reload(compare.preferred_names(m), "names")
    matched = compare.matched_pairs(m)
    overlap = compare.journal_overlap(m, names)
    by_venue = compare.matched_by_venue(matched, names)
    profiles = save_and_reload(
        metrics.venue_profiles(m, names.withColumnRenamed("venue_name_preferred", "venue_name")), "profiles"
    )
    profile_comparison = metrics.profile_deltas(metrics.pivot_profiles(profiles))
    doi_venue = compare.doi_shares_by_venue(m, names)
    venues = save_and_reload(
        compare.journal_types(compare.journal_master(overlap, by_venue, profile_comparison, doi_venue)), "venues"
    )
    return {
        "global_coverage": compare.global_coverage(m),
        "global_overlap": compare.global_overlap(m),
        "journal_overlap": ordered(overlap, compare.OVERLAP_ORDER, ["venue_internal_id"]),
        "matched_global_summary": compare.matched_summary(matched),
        "matched_delta_distribution": compare.delta_distribution(matched),
        "matched_journal_comp": by_venue,
        "profiles_long": profiles,
        "profiles_comparison": profile_comparison,
        "profiles_global_summary": metrics.profile_summary(profiles),
        "year_coverage": compare.year_coverage(m).orderBy("year_preferred"),
        "year_matched_counts": compare.matched_by_year(matched).orderBy("year_preferred"),
        "doi_global": compare.doi_shares(m),
        "doi_journal": doi_venue,
        "journal_master": venues,
        **compare.top_lists(venues),
        "corr_spearman": corr.correlation_matrix(venues, compare.CORRELATION_VARIABLES, "spearman"),
        "corr_pearson": corr.correlation_matrix(venues, compare.CORRELATION_VARIABLES, "pearson"),
        "matched_articles_export": compare.export_articles(matched, names, compare.MATCHED_EXPORT),
        "coverage_export": compare.export_articles(m, names, compare.COVERAGE_EXPORT),
    }


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        write_result(df, f"{path}/{name}", fmt=fmt)
