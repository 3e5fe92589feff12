"""Queries of the source comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from citestat.operators import compare, corr, metrics
from citestat.operators.selection import status_flags
from citestat.operators.tables import head, ordered, top_n
from citestat.plans.catalog_counts import (
    DELTA, DELTAS, KENDALL, LONG, PEARSON_EXPR, PIVOTED_DOUBLES, RANKS, WITH_M, profiles, venue_names,
)
from citestat.plans.domain import master
from citestat.plans.registry import register, rounded, rounded_sql
from citestat.session import save_and_reload

BOTH, A_ONLY, B_ONLY = (f"source_status = '{s}'" for s in ("both", "open_citations_only", "scopus_only"))


def n_if(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)::BIGINT"


def unpivot(one_row: str, names: list[str]) -> str:
    """(metric, value) rows of a one-row statement."""
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, {n}::DOUBLE AS value FROM {one_row}" for n in names)


@register(
    "A18_global_coverage",
    f"""{WITH_M} SELECT 'both' AS category, {n_if(BOTH)} AS n_articles FROM m
    UNION ALL SELECT 'open_citations_only', {n_if(A_ONLY)} FROM m
    UNION ALL SELECT 'scopus_only', {n_if(B_ONLY)} FROM m UNION ALL SELECT 'total', count(*) FROM m""",
)
def global_coverage(spark, sf):
    return compare.global_coverage(master(spark, sf))


OVERLAP_METRICS = ["overlap_share_of_total", "overlap_relative_to_oc", "overlap_relative_to_scopus", "jaccard_index"]


@register(
    "A19_overlap_indices",
    rounded_sql(
        f"""{WITH_M}, c AS (SELECT {n_if(BOTH)} AS n, {n_if(A_ONLY)} AS a, {n_if(B_ONLY)} AS bb, count(*) AS t FROM m),
        o AS (SELECT n / t AS overlap_share_of_total, n / (n + a) AS overlap_relative_to_oc,
              n / (n + bb) AS overlap_relative_to_scopus, n / (n + a + bb) AS jaccard_index FROM c)
        {unpivot('o', OVERLAP_METRICS)}""",
        ["value"],
    ),
)
def global_overlap(spark, sf):
    return rounded(compare.global_overlap(master(spark, sf)))


OVERLAP = f"""jo AS (
  SELECT venue_internal_id, max(pname) AS venue_name, n_both, n_oc_only, n_scopus_only,
         n_both + n_oc_only AS n_oc_total, n_both + n_scopus_only AS n_scopus_total,
         n_both + n_oc_only + n_scopus_only AS n_union,
         n_both / nullif(n_both + n_oc_only, 0) AS share_both_in_oc,
         n_both / nullif(n_both + n_scopus_only, 0) AS share_both_in_scopus,
         n_both / nullif(n_both + n_oc_only + n_scopus_only, 0) AS jaccard_index
  FROM (SELECT venue_internal_id, {n_if(BOTH)} AS n_both, {n_if(A_ONLY)} AS n_oc_only, {n_if(B_ONLY)} AS n_scopus_only
        FROM m GROUP BY 1) LEFT JOIN nm ON nid = venue_internal_id GROUP BY ALL)"""
OVERLAP_SHARES = ["share_both_in_oc", "share_both_in_scopus", "jaccard_index"]


def journal_overlap_of(m):
    return compare.journal_overlap(m, compare.preferred_names(m))


@register("A20_journal_overlap", rounded_sql(f"{WITH_M}, {OVERLAP} SELECT * FROM jo", OVERLAP_SHARES))
def journal_overlap(spark, sf):
    out = journal_overlap_of(master(spark, sf))
    return rounded(ordered(out, compare.OVERLAP_ORDER, ["venue_internal_id"]))


DELTA_COLUMNS = [
    "citation_delta_scopus_minus_oc", "citation_abs_delta", "citation_relative_delta_scopus_base",
]
DELTA_SELECT = "d AS citation_delta_scopus_minus_oc, abs(d) AS citation_abs_delta, d / greatest(sc, 1) AS citation_relative_delta_scopus_base"


@register(
    "A21_matched_deltas",
    rounded_sql(f"{WITH_M} SELECT article_id_oc, {DELTA_SELECT} FROM b", DELTA_COLUMNS),
)
def matched_deltas(spark, sf):
    return rounded(compare.matched_pairs(master(spark, sf)).select("article_id_oc", *DELTA_COLUMNS))


MATCHED = {
    "mean_citations_oc": "avg(oc)", "mean_citations_scopus": "avg(sc)",
    "median_citations_oc": "quantile_cont(oc, 0.5)", "median_citations_scopus": "quantile_cont(sc, 0.5)",
    "mean_delta_scopus_minus_oc": "avg(d)", "median_delta_scopus_minus_oc": "quantile_cont(d, 0.5)",
    "share_equal_counts": "avg((oc = sc)::INT)", "share_oc_higher": "avg((oc > sc)::INT)",
    "share_scopus_higher": "avg((sc > oc)::INT)",
}
MATCHED_SELECT = ", ".join(f"{e} AS {n}" for n, e in MATCHED.items())
COEFFICIENTS = ["pearson_r", "spearman_rho", "kendall_tau"]
SUMMARY_NAMES = ["n_matched_articles", *MATCHED, "mean_abs_delta", *COEFFICIENTS]


@register(
    "A22_matched_summary",
    rounded_sql(
        f"""{WITH_M},
        g AS (SELECT 1 AS venue_internal_id, oc, sc, d FROM b),
        {KENDALL.replace("FROM b GROUP BY ALL", "FROM g GROUP BY ALL")},
        o AS (SELECT count(*) AS n_matched_articles, {MATCHED_SELECT}, avg(abs(d)) AS mean_abs_delta,
              {PEARSON_EXPR.format(x='oc', y='sc')} AS pearson_r,
              (SELECT {PEARSON_EXPR.format(x='rx', y='ry')} FROM {RANKS.format(k='venue_internal_id', x='oc', y='sc', src='g')}) AS spearman_rho,
              (SELECT max(kendall_tau) FROM tau) AS kendall_tau FROM g)
        {unpivot('o', SUMMARY_NAMES)}""",
        ["value"],
    ),
)
def matched_summary(spark, sf):
    return rounded(compare.matched_summary(compare.matched_pairs(master(spark, sf))))


QUANTILES = {f"delta_q{q:02d}": ("d", q / 100) for q in (1, 5, 25, 50, 75, 95, 99)} | {
    f"abs_delta_q{q:02d}": ("abs(d)", q / 100) for q in (95, 99)
}


@register(
    "A8_delta_quantiles",
    rounded_sql(
        f"""{WITH_M}, o AS (SELECT {', '.join(f'quantile_cont({x}, {p}) AS {n}' for n, (x, p) in QUANTILES.items())} FROM b)
        {unpivot('o', list(QUANTILES))}""",
        ["value"],
    ),
)
def delta_quantiles(spark, sf):
    return rounded(compare.delta_distribution(compare.matched_pairs(master(spark, sf))))


MATCHED_BY_VENUE = f"""{KENDALL},
mv AS (
  SELECT v.*, pname AS venue_name, kendall_tau FROM (
    SELECT venue_internal_id, count(*)::BIGINT AS n_matched_articles, {MATCHED_SELECT},
           {PEARSON_EXPR.format(x='oc', y='sc')} AS pearson_r, {PEARSON_EXPR.format(x='rx', y='ry')} AS spearman_rho
    FROM {RANKS.format(k='venue_internal_id', x='oc', y='sc', src='b')} GROUP BY 1) AS v
  LEFT JOIN tau ON tau.k IS NOT DISTINCT FROM v.venue_internal_id LEFT JOIN nm ON nid = v.venue_internal_id)"""
MATCHED_DOUBLES = [*MATCHED, *COEFFICIENTS]


@register(
    "A22_matched_by_venue", rounded_sql(f"{WITH_M}, {MATCHED_BY_VENUE} SELECT * FROM mv", MATCHED_DOUBLES)
)
def matched_by_venue(spark, sf):
    m = master(spark, sf)
    return rounded(compare.matched_by_venue(compare.matched_pairs(m), compare.preferred_names(m)))


YEAR_SHARES = ["share_both_total", "share_both_in_oc", "share_both_in_scopus", "share_with_doi"]


@register(
    "A23_year_coverage",
    rounded_sql(
        f"""{WITH_M}, y AS (SELECT year_preferred, {n_if(BOTH)} AS n_both, {n_if(A_ONLY)} AS n_oc_only,
              {n_if(B_ONLY)} AS n_scopus_only, {n_if('doi_norm IS NOT NULL')} AS n_with_doi, count(*)::BIGINT AS n_total
              FROM m GROUP BY 1)
        SELECT *, n_both / n_total AS share_both_total, n_both / nullif(n_both + n_oc_only, 0) AS share_both_in_oc,
               n_both / nullif(n_both + n_scopus_only, 0) AS share_both_in_scopus, n_with_doi / n_total AS share_with_doi
        FROM y""",
        YEAR_SHARES,
    ),
)
def year_coverage(spark, sf):
    return rounded(compare.year_coverage(master(spark, sf)))


BY_YEAR = [
    "mean_citations_oc", "mean_citations_scopus", "median_citations_oc", "median_citations_scopus",
    "mean_delta_scopus_minus_oc", "share_equal_counts",
]


@register(
    "A24_matched_by_year",
    rounded_sql(
        f"""{WITH_M} SELECT year_preferred, count(*)::BIGINT AS n_matched,
        {', '.join(f'{MATCHED[n]} AS {n}' for n in BY_YEAR)} FROM b GROUP BY 1""",
        BY_YEAR,
    ),
)
def matched_by_year(spark, sf):
    return rounded(compare.matched_by_year(compare.matched_pairs(master(spark, sf))))


def share(cond: str, subset: str | None = None) -> str:
    inner = f"({cond})::INT"
    return f"avg(CASE WHEN {subset} THEN {inner} END)" if subset else f"avg({inner})"


DOI = "doi_norm IS NOT NULL"
DOI_SHARES = {
    "share_with_doi_total": share(DOI), "share_with_doi_both": share(DOI, BOTH),
    "share_with_doi_oc_only": share(DOI, A_ONLY), "share_with_doi_scopus_only": share(DOI, B_ONLY),
}
METHOD_SHARES = {
    "doi": share("match_method = 'doi_exact'", BOTH),
    "title_exact": share("match_method = 'title_exact_year'", BOTH),
    "fuzzy": share("match_method = 'title_fuzzy_year_auto'", BOTH),
}
MANUAL = share("match_method = 'manual_confirmed'", BOTH)
DOI_GLOBAL = (
    DOI_SHARES
    | {f"share_matches_by_{k}_among_both": v for k, v in METHOD_SHARES.items()}
    | {"share_matches_manual_among_both": MANUAL}
)
DOI_VENUE = DOI_SHARES | {f"share_matches_by_{k}": v for k, v in METHOD_SHARES.items()} | {"share_matches_manual": MANUAL}


@register(
    "A25_doi_shares",
    rounded_sql(
        f"""{WITH_M}, o AS (SELECT {', '.join(f'{e} AS {n}' for n, e in DOI_GLOBAL.items())} FROM m)
        {unpivot('o', list(DOI_GLOBAL))}""",
        ["value"],
    ),
)
def doi_shares(spark, sf):
    return rounded(compare.doi_shares(master(spark, sf)))


DOI_BY_VENUE = f"""dv AS (
  SELECT q.*, pname AS venue_name FROM (
    SELECT venue_internal_id, count(*)::BIGINT AS n_total, {', '.join(f'{e} AS {n}' for n, e in DOI_VENUE.items())}
    FROM m GROUP BY 1) AS q LEFT JOIN nm ON nid = venue_internal_id)"""


@register("A25_doi_shares_by_venue", rounded_sql(f"{WITH_M}, {DOI_BY_VENUE} SELECT * FROM dv", list(DOI_VENUE)))
def doi_shares_by_venue(spark, sf):
    m = master(spark, sf)
    return rounded(compare.doi_shares_by_venue(m, compare.preferred_names(m)))


@register(
    "A30_preferred_names", f"{WITH_M} SELECT nid AS venue_internal_id, pname AS venue_name_preferred FROM nm"
)
def preferred_names(spark, sf):
    return compare.preferred_names(master(spark, sf))


# ---- venue master -----------------------------------------------------------------------


def journal_master_of(spark, sf):
    # four aggregations read the linked articles, so they are written once
    m = save_and_reload(master(spark, sf), "master")
    names = compare.preferred_names(m)
    profile = metrics.profile_deltas(metrics.pivot_profiles(metrics.venue_profiles(m, venue_names(m))))
    table = compare.journal_master(
        compare.journal_overlap(m, names),
        compare.matched_by_venue(compare.matched_pairs(m), names),
        profile,
        compare.doi_shares_by_venue(m, names),
    )
    return compare.journal_types(table)


def _left(alias: str) -> str:
    same = "x.{c} IS NOT DISTINCT FROM jo.{c}"
    return (
        f"LEFT JOIN {alias} ON {same.format(c='venue_internal_id').replace('x.', alias + '.')} "
        f"AND {same.format(c='venue_name').replace('x.', alias + '.')}"
    )


JM = f"""{DELTA}, {OVERLAP}, {MATCHED_BY_VENUE}, {DOI_BY_VENUE},
jm0 AS (
  SELECT jo.*, mv.* EXCLUDE (venue_internal_id, venue_name), dlt.* EXCLUDE (venue_internal_id, venue_name),
         dv.* EXCLUDE (venue_internal_id, venue_name)
  FROM jo {_left('mv')} {_left('dlt')} {_left('dv')}),
jm AS (
  SELECT *, CASE
    WHEN jaccard_index >= 0.70 AND abs(mean_citations__delta_full_scopus_minus_oc) <= 0.25 THEN 'high_overlap_low_distortion'
    WHEN jaccard_index < 0.40 AND mean_citations__delta_full_scopus_minus_oc < -0.25 THEN 'low_overlap_oc_more_citation_dense'
    WHEN jaccard_index >= 0.50 AND abs(mean_delta_scopus_minus_oc) > 0.50 THEN 'moderate_overlap_high_count_divergence'
    WHEN jaccard_index < 0.30 THEN 'low_overlap_structural_gap' ELSE 'mixed' END AS journal_type
  FROM jm0)"""
JM_DOUBLES = [*OVERLAP_SHARES, *MATCHED_DOUBLES, *PIVOTED_DOUBLES, *DELTAS, *DOI_VENUE]


@register("J10_journal_master", rounded_sql(f"{JM} SELECT * FROM jm", JM_DOUBLES))
def journal_master(spark, sf):
    return rounded(journal_master_of(spark, sf))


@register("P15_journal_types", f"{JM} SELECT venue_internal_id, journal_type FROM jm")
def journal_types(spark, sf):
    return journal_master_of(spark, sf).select("venue_internal_id", "journal_type")


TOP_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS list, venue_internal_id, value FROM (
      SELECT venue_internal_id, round({column}, 9) AS value FROM jm
      ORDER BY {column} {'ASC' if asc else 'DESC'} NULLS LAST, venue_internal_id ASC NULLS LAST LIMIT 15)"""
    for name, (column, asc) in compare.TOP_LISTS.items()
)


@register("W7_top_lists", rounded_sql(f"{JM} {TOP_SQL}", ["value"]))
def top_lists(spark, sf):
    table = save_and_reload(journal_master_of(spark, sf), "venues")
    out = None
    for name, part in compare.top_lists(table).items():
        column = compare.TOP_LISTS[name][0]
        part = part.select(F.lit(name).alias("list"), "venue_internal_id", F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


VARS = compare.CORRELATION_VARIABLES
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM jm WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for a in VARS for b in VARS
)
ALL_PAIRS = "SELECT a.v AS row_var, b.v AS col_var FROM ({0}) AS a CROSS JOIN ({0}) AS b".format(
    " UNION ALL ".join(f"SELECT '{v}' AS v" for v in VARS)
)


@register(
    "A29_correlation_matrix_pearson",
    rounded_sql(
        f"""{JM}, u AS ({PAIRS_SQL}), ap AS ({ALL_PAIRS}),
        r AS (SELECT i, j, {PEARSON_EXPR.format(x='x', y='y')} AS value FROM u GROUP BY 1, 2)
        SELECT row_var, col_var, value FROM ap LEFT JOIN r ON i = row_var AND j = col_var""",
        ["value"], 6,
    ),
)
def matrix_pearson(spark, sf):
    table = save_and_reload(journal_master_of(spark, sf), "venues")
    return rounded(corr.correlation_matrix(table, VARS, "pearson"), 6)


@register(
    "A29_correlation_matrix_spearman",
    rounded_sql(
        f"""{JM}, u0 AS ({PAIRS_SQL}),
        u AS (SELECT i, j, round(x, 9) AS x, round(y, 9) AS y FROM u0), ap AS ({ALL_PAIRS}),
        r AS (SELECT i, j, {PEARSON_EXPR.format(x='rx', y='ry')} AS value
              FROM {RANKS.format(k='i, j', x='x', y='y', src='u')} GROUP BY 1, 2)
        SELECT row_var, col_var, value FROM ap LEFT JOIN r ON i = row_var AND j = col_var""",
        ["value"], 6,
    ),
)
def matrix_spearman(spark, sf):
    # ranks would tell apart values that differ by rounding noise only
    table = save_and_reload(rounded(journal_master_of(spark, sf)), "venues")
    return rounded(corr.correlation_matrix(table, VARS, "spearman"), 6)


# ---- article exports and flags ----------------------------------------------------------

EXPORT_SQL = {"matched": ", ".join(compare.MATCHED_EXPORT), "coverage": ", ".join(compare.COVERAGE_EXPORT)}


@register(
    "P22_matched_export",
    rounded_sql(
        f"""{WITH_M} SELECT {EXPORT_SQL['matched']} FROM (
        SELECT b.* EXCLUDE (venue_name), pname AS venue_name, {DELTA_SELECT} FROM b LEFT JOIN nm ON nid = venue_internal_id)""",
        ["citation_relative_delta_scopus_base"],
    ),
)
def matched_export(spark, sf):
    m = master(spark, sf)
    out = compare.export_articles(compare.matched_pairs(m), compare.preferred_names(m), compare.MATCHED_EXPORT)
    return rounded(out)


@register(
    "P22_coverage_export",
    f"""{WITH_M} SELECT {EXPORT_SQL['coverage']} FROM (
    SELECT m.* EXCLUDE (venue_name), pname AS venue_name FROM m LEFT JOIN nm ON nid = venue_internal_id)""",
)
def coverage_export(spark, sf):
    m = master(spark, sf)
    return compare.export_articles(m, compare.preferred_names(m), compare.COVERAGE_EXPORT)


FLAGS = {
    "is_both": BOTH, "is_oc_only": A_ONLY, "is_scopus_only": B_ONLY, "has_doi": "doi_norm IS NOT NULL",
    "matched_by_doi": "match_method = 'doi_exact'", "matched_by_title_exact": "match_method = 'title_exact_year'",
    "matched_by_fuzzy": "match_method = 'title_fuzzy_year_auto'", "matched_manual": "match_method = 'manual_confirmed'",
}


@register(
    "P16_status_flags",
    f"{WITH_M} SELECT title_preferred, {', '.join(f'({e}) AS {n}' for n, e in FLAGS.items())} FROM m",
)
def flags(spark, sf):
    return master(spark, sf).select("title_preferred", *FLAGS)


@register("P17_preferred_fields", f"{WITH_M} SELECT title_preferred, venue_name, year_preferred FROM m")
def preferred_fields(spark, sf):
    m = master(spark, sf)
    # only the one-sided names and years are given; the preferred ones must be found again
    bare = m.withColumns({"venue_name": F.lit(None).cast("string"), "year_preferred": F.lit(None).cast("bigint")})
    return status_flags(bare).select("title_preferred", "venue_name", "year_preferred")


@register(
    "A38_stage_counts",
    f"""{WITH_M} SELECT 'match_method' AS what, match_method AS value, count(*)::BIGINT AS n FROM m GROUP BY 2
    UNION ALL SELECT 'source_status', source_status, count(*) FROM m GROUP BY 2""",
)
def stage_counts(spark, sf):
    m = master(spark, sf)
    parts = [
        compare.stage_counts(m, c).select(F.lit(c).alias("what"), F.col(c).alias("value"), "n")
        for c in ("match_method", "source_status")
    ]
    return parts[0].unionByName(parts[1])


OC_PROFILE = f"{LONG}, oc AS (SELECT * FROM prof WHERE profile_type = 'oc_full')"
OUTLIER = ["mean_citations", "median_citations", "gini_citations"]
OUTLIER_2 = ["share_uncited", "top_10pct_citation_share", "mean_citations"]


def _mask(columns: list[str]) -> str:
    return " OR ".join(f"round({c}, 9) >= (SELECT quantile_cont(round({c}, 9), 0.9) FROM oc)" for c in columns)


def oc_profile(spark, sf):
    return rounded(profiles(spark, sf).filter("profile_type = 'oc_full'"))


@register(
    "W9_outlier_labels",
    f"""{OC_PROFILE} SELECT 'first' AS mask, venue_internal_id FROM oc WHERE {_mask(OUTLIER)}
    UNION ALL SELECT 'second', venue_internal_id FROM oc WHERE {_mask(OUTLIER_2)}""",
)
def outlier_labels(spark, sf):
    p = oc_profile(spark, sf)
    parts = [
        metrics.label_outliers(p, cols).select(F.lit(name).alias("mask"), "venue_internal_id")
        for name, cols in (("first", OUTLIER), ("second", OUTLIER_2))
    ]
    return parts[0].unionByName(parts[1])


@register(
    "W10_reference_lines",
    rounded_sql(
        f"""{OC_PROFILE} SELECT quantile_cont(share_uncited, 0.5) AS median_share_uncited,
        quantile_cont(top_10pct_citation_share, 0.5) AS median_top_10pct_citation_share FROM oc""",
        ["median_share_uncited", "median_top_10pct_citation_share"], 8,
    ),
)
def reference_lines(spark, sf):
    return rounded(metrics.reference_lines(oc_profile(spark, sf), ["share_uncited", "top_10pct_citation_share"]), 8)


@register(
    "W8_ordered_metrics",
    rounded_sql(f"{OC_PROFILE} SELECT venue_internal_id, mean_citations, median_citations FROM oc",
                ["mean_citations", "median_citations"]),
)
def ordered_metrics(spark, sf):
    p = profiles(spark, sf).filter("profile_type = 'oc_full'")
    p = p.select("venue_internal_id", "mean_citations", "median_citations")
    return rounded(ordered(p, ["mean_citations", "median_citations"], ["venue_internal_id"]))


@register(
    "P21_head_sample",
    f"""{WITH_M} SELECT title_preferred, year_preferred FROM m
    ORDER BY year_preferred, title_preferred LIMIT 20""",
)
def head_sample(spark, sf):
    return head(master(spark, sf).select("title_preferred", "year_preferred"), ["year_preferred", "title_preferred"], 20)


@register(
    "W7_top_cited_articles",
    f"""{WITH_M} SELECT article_id_oc, citedby_count_oc FROM m
    ORDER BY citedby_count_oc DESC NULLS LAST, article_id_oc NULLS LAST LIMIT 20""",
)
def top_cited(spark, sf):
    return top_n(master(spark, sf).select("article_id_oc", "citedby_count_oc"), "citedby_count_oc", 20, ["article_id_oc"])
