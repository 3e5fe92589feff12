"""Coverage, overlap and distribution comparison of two linked article sources.

Input is the master table of `citestat.operators.link`, with the flags of
`citestat.operators.selection.status_flags`. NULL venues and years are groups of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from citestat.operators import corr, metrics
from citestat.operators.metrics import quantile
from citestat.operators.selection import first_match
from citestat.operators.tables import top_n
from citestat.session import save_and_reload

UNKNOWN_JOURNAL = "UNKNOWN JOURNAL"


def preferred_names(master: DataFrame, key: str = "venue_internal_id", name: str = "venue_name") -> DataFrame:
    """Most frequent name per id; ties alphabetically; ids without any name get a fixed text."""
    counts = (
        master.filter(F.col(key).isNotNull())
        .groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.when(F.col(name).isNotNull(), F.struct((-F.col("n")).alias("o"), F.col(name).alias("v"))))
    return counts.groupBy(key).agg(
        F.coalesce(best["v"], F.lit(UNKNOWN_JOURNAL)).alias("venue_name_preferred")
    )


def _with_names(df: DataFrame, names: DataFrame, key: str = "venue_internal_id") -> DataFrame:
    side = names.select(F.col(key).alias("_k"), F.col("venue_name_preferred").alias("venue_name"))
    return df.join(side, F.col(key) == F.col("_k"), "left").drop("_k")


def _long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row frame to (metric, value) rows."""
    return df.select(
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
        )
    )


def _share(cond: Column) -> Column:
    """Share of true among all rows; NULL counts as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def _share_within(cond: Column, subset: Column) -> Column:
    """Share of true within a subset, NULL when the subset is empty."""
    return F.avg(F.when(subset, F.coalesce(cond, F.lit(False)).cast("double")))


def global_coverage(master: DataFrame) -> DataFrame:
    counts = master.agg(
        F.count_if("is_both").alias("both"),
        F.count_if("is_oc_only").alias("open_citations_only"),
        F.count_if("is_scopus_only").alias("scopus_only"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("category"), F.col(c).alias("n_articles")) for c in counts.columns]
            )
        )
    )


def global_overlap(master: DataFrame) -> DataFrame:
    both, a, b = F.count_if("is_both"), F.count_if("is_oc_only"), F.count_if("is_scopus_only")
    one = master.agg(
        F.try_divide(both, F.count(F.lit(1))).alias("overlap_share_of_total"),
        F.try_divide(both, both + a).alias("overlap_relative_to_oc"),
        F.try_divide(both, both + b).alias("overlap_relative_to_scopus"),
        F.try_divide(both, both + a + b).alias("jaccard_index"),
    )
    return _long(one, one.columns)


def journal_overlap(master: DataFrame, names: DataFrame) -> DataFrame:
    counts = master.groupBy("venue_internal_id").agg(
        F.count_if("is_both").alias("n_both"),
        F.count_if("is_oc_only").alias("n_oc_only"),
        F.count_if("is_scopus_only").alias("n_scopus_only"),
    )
    both = F.col("n_both")
    return (
        _with_names(counts, names)
        .withColumns(
            {
                "n_oc_total": both + F.col("n_oc_only"),
                "n_scopus_total": both + F.col("n_scopus_only"),
                "n_union": both + F.col("n_oc_only") + F.col("n_scopus_only"),
            }
        )
        .withColumns(
            {
                "share_both_in_oc": F.try_divide(both, F.col("n_oc_total")),
                "share_both_in_scopus": F.try_divide(both, F.col("n_scopus_total")),
                "jaccard_index": F.try_divide(both, F.col("n_union")),
            }
        )
    )


OVERLAP_ORDER = ["jaccard_index", "share_both_in_scopus", "share_both_in_oc"]


def matched_pairs(master: DataFrame) -> DataFrame:
    """Articles in both sources with signed, absolute and relative citation differences."""
    oc, sc = F.col("citedby_count_oc"), F.col("citedby_count_scopus")
    delta = sc - oc
    return master.filter("is_both").withColumns(
        {
            "citation_delta_scopus_minus_oc": delta,
            "citation_abs_delta": F.abs(delta),
            # the base is at least 1; a missing base stays missing
            "citation_relative_delta_scopus_base": F.try_divide(delta, F.when(sc < 1, 1.0).otherwise(sc)),
        }
    )


def _pair_cells(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, c): articles per pair of counts, NULL counts kept."""
    return matched.groupBy(
        *keys,
        F.col("citedby_count_oc").cast("double").alias("x"),
        F.col("citedby_count_scopus").cast("double").alias("y"),
    ).agg(F.count(F.lit(1)).alias("c"))


def _wavg(value: Column) -> Column:
    c = F.when(value.isNotNull(), F.col("c"))
    return F.try_divide(F.sum(value * F.col("c")), F.sum(c))


def _wshare(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("c")).otherwise(0)) / F.sum("c")


def _wmedian(value: Column) -> Column:
    return F.percentile(value, 0.5, F.when(value.isNotNull(), F.col("c")).otherwise(1))


def _matched_aggregates(n_name: str, full: bool) -> list[Column]:
    x, y = F.col("x"), F.col("y")
    out = [
        F.sum("c").alias(n_name),
        _wavg(x).alias("mean_citations_oc"),
        _wavg(y).alias("mean_citations_scopus"),
        _wmedian(x).alias("median_citations_oc"),
        _wmedian(y).alias("median_citations_scopus"),
        _wavg(y - x).alias("mean_delta_scopus_minus_oc"),
        _wshare(x == y).alias("share_equal_counts"),
    ]
    if full:
        out += [
            _wmedian(y - x).alias("median_delta_scopus_minus_oc"),
            _wshare(x > y).alias("share_oc_higher"),
            _wshare(y > x).alias("share_scopus_higher"),
        ]
    return out


def matched_summary(matched: DataFrame) -> DataFrame:
    """14 figures of the matched articles as (metric, value)."""
    cells = save_and_reload(_pair_cells(matched, []), "pairs")
    one = cells.agg(
        *_matched_aggregates("n_matched_articles", full=True),
        _wavg(F.abs(F.col("y") - F.col("x"))).alias("mean_abs_delta"),
    )
    coefficients = corr.correlations_of_cells(cells.dropna().withColumn("_all", F.lit(1)), [])
    names = [
        "n_matched_articles", "mean_citations_oc", "mean_citations_scopus", "median_citations_oc",
        "median_citations_scopus", "mean_delta_scopus_minus_oc", "median_delta_scopus_minus_oc",
        "mean_abs_delta", "share_equal_counts", "share_oc_higher", "share_scopus_higher",
    ]
    return _long(one, names).unionByName(_long(coefficients, coefficients.columns))


def delta_distribution(matched: DataFrame) -> DataFrame:
    """Exact quantiles of the signed and absolute differences as (metric, value)."""
    hist = metrics.histogram(matched, [], "citation_delta_scopus_minus_oc")
    absolute = metrics.histogram(matched, [], "citation_abs_delta")
    signed = hist.agg(
        *[quantile(q / 100).alias(f"delta_q{q:02d}") for q in (1, 5, 25, 50, 75, 95, 99)]
    )
    size = absolute.agg(*[quantile(q / 100).alias(f"abs_delta_q{q:02d}") for q in (95, 99)])
    return _long(signed, signed.columns).unionByName(_long(size, size.columns))


def matched_by_venue(matched: DataFrame, names: DataFrame) -> DataFrame:
    keys = ["venue_internal_id"]
    cells = save_and_reload(_pair_cells(matched, keys), "pairs")
    stats = cells.groupBy(*keys).agg(*_matched_aggregates("n_matched_articles", full=True))
    coefficients = corr.correlations_of_cells(cells.dropna(subset=["x", "y"]), keys)
    side = coefficients.withColumnRenamed("venue_internal_id", "_k")
    out = stats.join(side, F.col("venue_internal_id").eqNullSafe(F.col("_k")), "left").drop("_k")
    return _with_names(out, names)


def year_coverage(master: DataFrame) -> DataFrame:
    both, a, b = F.col("n_both"), F.col("n_oc_only"), F.col("n_scopus_only")
    return (
        master.groupBy("year_preferred")
        .agg(
            F.count_if("is_both").alias("n_both"),
            F.count_if("is_oc_only").alias("n_oc_only"),
            F.count_if("is_scopus_only").alias("n_scopus_only"),
            F.count_if("has_doi").alias("n_with_doi"),
            F.count(F.lit(1)).alias("n_total"),
        )
        .withColumns(
            {
                "share_both_total": F.try_divide(both, F.col("n_total")),
                "share_both_in_oc": F.try_divide(both, both + a),
                "share_both_in_scopus": F.try_divide(both, both + b),
                "share_with_doi": F.try_divide(F.col("n_with_doi"), F.col("n_total")),
            }
        )
    )


def matched_by_year(matched: DataFrame) -> DataFrame:
    return _pair_cells(matched, ["year_preferred"]).groupBy("year_preferred").agg(
        *_matched_aggregates("n_matched", full=False)
    )


def doi_shares(master: DataFrame) -> DataFrame:
    doi, both = F.col("has_doi"), F.col("is_both")
    one = master.agg(
        _share(doi).alias("share_with_doi_total"),
        _share_within(doi, both).alias("share_with_doi_both"),
        _share_within(doi, F.col("is_oc_only")).alias("share_with_doi_oc_only"),
        _share_within(doi, F.col("is_scopus_only")).alias("share_with_doi_scopus_only"),
        _share_within(F.col("matched_by_doi"), both).alias("share_matches_by_doi_among_both"),
        _share_within(F.col("matched_by_title_exact"), both).alias("share_matches_by_title_exact_among_both"),
        _share_within(F.col("matched_by_fuzzy"), both).alias("share_matches_by_fuzzy_among_both"),
        _share_within(F.col("matched_manual"), both).alias("share_matches_manual_among_both"),
    )
    return _long(one, one.columns)


def doi_shares_by_venue(master: DataFrame, names: DataFrame) -> DataFrame:
    doi, both = F.col("has_doi"), F.col("is_both")
    out = master.groupBy("venue_internal_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        _share(doi).alias("share_with_doi_total"),
        _share_within(doi, both).alias("share_with_doi_both"),
        _share_within(doi, F.col("is_oc_only")).alias("share_with_doi_oc_only"),
        _share_within(doi, F.col("is_scopus_only")).alias("share_with_doi_scopus_only"),
        _share_within(F.col("matched_by_doi"), both).alias("share_matches_by_doi"),
        _share_within(F.col("matched_by_title_exact"), both).alias("share_matches_by_title_exact"),
        _share_within(F.col("matched_by_fuzzy"), both).alias("share_matches_by_fuzzy"),
        _share_within(F.col("matched_manual"), both).alias("share_matches_manual"),
    )
    return _with_names(out, names)


def journal_master(overlap: DataFrame, matched: DataFrame, profiles: DataFrame, doi: DataFrame) -> DataFrame:
    """All venue tables side by side; the venue-less group joins too."""
    out = overlap
    for part in (matched, profiles, doi):
        side = part.withColumnsRenamed({"venue_internal_id": "_id", "venue_name": "_name"})
        same = F.col("venue_internal_id").eqNullSafe(F.col("_id")) & F.col("venue_name").eqNullSafe(F.col("_name"))
        out = out.join(side, same, "left").drop("_id", "_name")
    return out


def journal_types(master: DataFrame) -> DataFrame:
    """Typology by overlap and citation divergence (fixed thresholds and labels)."""
    jaccard = F.col("jaccard_index")
    full_delta = F.col("mean_citations__delta_full_scopus_minus_oc")
    matched_delta = F.col("mean_delta_scopus_minus_oc")
    label = first_match(
        [
            ((jaccard >= 0.70) & (F.abs(full_delta) <= 0.25), "high_overlap_low_distortion"),
            ((jaccard < 0.40) & (full_delta < -0.25), "low_overlap_oc_more_citation_dense"),
            ((jaccard >= 0.50) & (F.abs(matched_delta) > 0.50), "moderate_overlap_high_count_divergence"),
            (jaccard < 0.30, "low_overlap_structural_gap"),
        ],
        "mixed",
    )
    return master.withColumn("journal_type", label)


# the six ranked lists: name -> (column, ascending)
TOP_LISTS = {
    "top_low_overlap": ("jaccard_index", True),
    "top_high_overlap": ("jaccard_index", False),
    "top_scopus_advantage": ("mean_citations__delta_full_scopus_minus_oc", False),
    "top_oc_advantage": ("mean_citations__delta_full_scopus_minus_oc", True),
    "top_uncited_gap": ("share_uncited__delta_full_scopus_minus_oc", False),
    "top_gini_gap": ("gini_citations__delta_full_scopus_minus_oc", False),
}


def top_lists(master: DataFrame, n: int = 15) -> dict[str, DataFrame]:
    return {
        name: top_n(master, column, n, ["venue_internal_id"], ascending)
        for name, (column, ascending) in TOP_LISTS.items()
    }


CORRELATION_VARIABLES = [
    "jaccard_index", "share_both_in_oc", "share_both_in_scopus", "share_with_doi_total",
    "share_matches_by_doi", "mean_citations__delta_full_scopus_minus_oc",
    "share_uncited__delta_full_scopus_minus_oc", "gini_citations__delta_full_scopus_minus_oc",
    "top_10pct_citation_share__delta_full_scopus_minus_oc", "n_oc_total", "n_scopus_total",
]

MATCHED_EXPORT = [
    "venue_internal_id", "venue_name", "article_id_oc", "article_id_scopus", "title_preferred",
    "year_preferred", "doi_norm", "citedby_count_oc", "citedby_count_scopus",
    "citation_delta_scopus_minus_oc", "citation_abs_delta",
    "citation_relative_delta_scopus_base", "match_method",
]
COVERAGE_EXPORT = [
    "venue_internal_id", "venue_name", "article_id_oc", "article_id_scopus", "title_preferred",
    "year_preferred", "doi_norm", "source_status", "match_method", "citedby_count_oc",
    "citedby_count_scopus",
]


def export_articles(articles: DataFrame, names: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Article rows with the preferred venue name in place of their own."""
    return _with_names(articles.drop("venue_name"), names).select(*columns)


def stage_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
