"""Queries of the counting, histogram and profile operators (A1-A17, A39) and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from citestat.operators import compare, corr, counts, metrics
from citestat.operators.tables import ordered
from citestat.plans.domain import ARTICLES_SQL, MASTER_SQL, articles, citations, master
from citestat.plans.registry import register, rounded, rounded_sql

WITH_ART = f"WITH {ARTICLES_SQL}"
WITH_M = f"WITH {MASTER_SQL}"
# one row per article of a venue with its count, missing = 0
X = f"""{WITH_ART},
x AS (SELECT venue_internal_id AS k, coalesce(citedby_count, 0)::DOUBLE AS v FROM art WHERE venue_internal_id IS NOT NULL),
ranked AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS i, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS j,
         count(*) OVER (PARTITION BY k) AS n, sum(v) OVER (PARTITION BY k) AS s, avg(v) OVER (PARTITION BY k) AS mean
  FROM x)"""


def profile_select(key: str = "k", source: str = "ranked") -> str:
    """The 16 metrics from row-level formulas (not the histogram form the library uses)."""
    return f"""
  SELECT {key}, count(*)::BIGINT AS n_articles, sum(v) AS total_citations, avg(v) AS mean_citations,
         quantile_cont(v, 0.5) AS median_citations, avg(v) - quantile_cont(v, 0.5) AS mean_median_gap,
         avg((v = 0)::INT) AS share_uncited, avg((v >= 1)::INT) AS share_ge_1, avg((v >= 2)::INT) AS share_ge_2,
         avg((v >= 5)::INT) AS share_ge_5, avg((v >= 10)::INT) AS share_ge_10,
         quantile_cont(v, 0.95) AS p95_citations, quantile_cont(v, 0.99) AS p99_citations,
         stddev_samp(v) AS std_citations,
         CASE WHEN avg(v) = 0 THEN (CASE WHEN stddev_samp(v) > 0 THEN NULL ELSE 0.0 END)
              ELSE stddev_samp(v) / avg(v) END AS cv_citations,
         CASE WHEN sum(v) = 0 THEN 0.0 ELSE 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) END
           AS gini_citations,
         CASE WHEN sum(v) = 0 THEN 0.0 ELSE avg(CASE WHEN v > 0 THEN v / mean * ln(v / mean) END) END AS theil_citations,
         CASE WHEN sum(v) = 0 THEN 0.0
              ELSE sum(CASE WHEN j <= greatest(1, ceil(n / 10.0)) THEN v ELSE 0 END) / sum(v) END
           AS top_10pct_citation_share
  FROM {source} GROUP BY {key}"""


@register("A1_citations_per_article", f"{WITH_ART} SELECT article_omid, citedby_count FROM art")
def citations_per_article(spark, sf):
    counted = counts.citations_per_article(citations(spark, sf).filter("in_a"))
    base = articles(spark, sf).select("article_omid")
    return counts.attach_citations(base, counted)


A2_SQL = rounded_sql(
    f"""{WITH_ART} SELECT venue_internal_id, count(article_omid)::BIGINT AS oc_articles_counted,
    coalesce(sum(citedby_count), 0)::BIGINT AS oc_citations_counted,
    sum(citedby_count) / count(article_omid) AS oc_citation_article_ratio
    FROM art WHERE venue_internal_id IS NOT NULL GROUP BY 1""",
    ["oc_citation_article_ratio"],
)


@register("A2_venue_totals", A2_SQL)
def venue_totals(spark, sf):
    return rounded(counts.venue_totals(articles(spark, sf)))


A3_SQL = rounded_sql(
    f"""{WITH_ART}, t AS (
      SELECT venue_internal_id, count(*)::BIGINT AS scopus_articles_counted,
             coalesce(sum(citedby_count_b), 0)::BIGINT AS s FROM art GROUP BY 1)
    SELECT venue_internal_id, scopus_articles_counted,
           CASE WHEN venue_internal_id IS NOT NULL THEN s END AS scopus_citations_counted,
           CASE WHEN venue_internal_id IS NOT NULL THEN s / scopus_articles_counted END AS scopus_citation_article_ratio
    FROM t""",
    ["scopus_citation_article_ratio"],
)


@register("A3_second_source_totals", A3_SQL)
def second_totals(spark, sf):
    a = articles(spark, sf)
    sizes = counts.articles_per_venue(a, "venue_internal_id", "scopus_articles_counted")
    totals = counts.venue_totals(a, citations="citedby_count_b", prefix="scopus").drop("scopus_articles_counted")
    return rounded(sizes.join(totals, "venue_internal_id", "left"))


@register(
    "A4_citation_histogram",
    f"""{WITH_ART} SELECT coalesce(citedby_count, 0)::BIGINT AS citedby_count,
    count(DISTINCT article_omid)::BIGINT AS article_count FROM art GROUP BY 1""",
)
def global_histogram(spark, sf):
    return counts.citation_histogram(articles(spark, sf))


@register(
    "A5_venue_histograms",
    f"""{WITH_ART} SELECT venue_name, coalesce(citedby_count_b, 0)::BIGINT AS citedby_count_b,
    count(DISTINCT article_omid)::BIGINT AS article_count FROM art GROUP BY 1, 2""",
)
def venue_histograms(spark, sf):
    return counts.citation_histogram(articles(spark, sf), ["venue_name"], value="citedby_count_b")


@register(
    "A6_mean_median_global",
    rounded_sql(f"""{WITH_ART} SELECT avg(coalesce(citedby_count, 0)) AS mean_citations,
    quantile_cont(coalesce(citedby_count, 0)::DOUBLE, 0.5) AS median_citations FROM art""",
                ["mean_citations", "median_citations"]),
)
def mean_median_global(spark, sf):
    return rounded(counts.mean_median(articles(spark, sf), []))


@register(
    "A6_mean_median_by_venue",
    rounded_sql(f"""{WITH_ART} SELECT venue_name, avg(coalesce(citedby_count, 0)) AS mean_citations,
    quantile_cont(coalesce(citedby_count, 0)::DOUBLE, 0.5) AS median_citations FROM art GROUP BY 1""",
                ["mean_citations", "median_citations"]),
)
def mean_median_by_venue(spark, sf):
    return rounded(counts.mean_median(articles(spark, sf), ["venue_name"]))


def _metric_query(name: str, wanted: list[str]) -> None:
    sql = rounded_sql(
        f"{X} SELECT k AS venue_internal_id, n_articles, {', '.join(wanted)} FROM ({profile_select()})", wanted
    )

    @register(name, sql)
    def run(spark, sf):
        a = articles(spark, sf).filter("venue_internal_id IS NOT NULL")
        return rounded(
            metrics.citation_profile(a, ["venue_internal_id"], missing_as_zero=True, metrics=wanted)
        )


_metric_query("A7_threshold_shares", ["share_uncited", "share_ge_1", "share_ge_2", "share_ge_5", "share_ge_10"])
_metric_query("A8_exact_quantiles", ["p95_citations", "p99_citations"])
_metric_query("A9_spread", ["std_citations", "cv_citations", "mean_median_gap"])
_metric_query("A10_gini_by_venue", ["gini_citations"])
_metric_query("A12_top_decile_share", ["top_10pct_citation_share"])


@register(
    "A11_theil_by_venue",
    rounded_sql(
        f"""{X} SELECT k AS venue_internal_id, count(*)::BIGINT AS n_articles,
        avg(CASE WHEN v > 0 THEN v / mean * ln(v / mean) END) AS theil_citations,
        sum(CASE WHEN v > 0 THEN v / mean * ln(v / mean) END) / count(*) AS theil_textbook
        FROM ranked GROUP BY 1""",
        ["theil_citations", "theil_textbook"],
    ),
)
def theil(spark, sf):
    a = articles(spark, sf).filter("venue_internal_id IS NOT NULL")
    return rounded(
        metrics.citation_profile(
            a, ["venue_internal_id"], missing_as_zero=True, metrics=["theil_citations"], textbook_theil=True
        )
    )


PROFILE_SQL = rounded_sql(
    f"{X} SELECT k AS venue_internal_id, * EXCLUDE (k) FROM ({profile_select()})", metrics.PROFILE_METRICS
)


@register("A13_profile_by_venue", PROFILE_SQL)
def profile_by_venue(spark, sf):
    a = articles(spark, sf).filter("venue_internal_id IS NOT NULL")
    return rounded(metrics.citation_profile(a, ["venue_internal_id"], missing_as_zero=True))


@register(
    "A13_profile_global",
    rounded_sql(
        f"""{WITH_ART}, x AS (SELECT 1 AS k, coalesce(citedby_count, 0)::DOUBLE AS v FROM art),
        ranked AS (SELECT k, v, row_number() OVER (ORDER BY v) AS i, row_number() OVER (ORDER BY v DESC) AS j,
                   count(*) OVER () AS n, avg(v) OVER () AS mean FROM x)
        SELECT * EXCLUDE (k) FROM ({profile_select()})""",
        metrics.PROFILE_METRICS,
    ),
)
def profile_global(spark, sf):
    return rounded(metrics.citation_profile(articles(spark, sf), [], missing_as_zero=True))


# four populations, one row per venue, population and article
LONG = f"""{WITH_M},
lng AS (
  SELECT venue_internal_id, 'oc_full' AS p, citedby_count_oc AS v FROM m WHERE source_status IN ('both', 'open_citations_only')
  UNION ALL SELECT venue_internal_id, 'scopus_full', citedby_count_scopus FROM m WHERE source_status IN ('both', 'scopus_only')
  UNION ALL SELECT venue_internal_id, 'oc_matched', citedby_count_oc FROM m WHERE source_status = 'both'
  UNION ALL SELECT venue_internal_id, 'scopus_matched', citedby_count_scopus FROM m WHERE source_status = 'both'),
kv AS (SELECT venue_internal_id || '|' || p AS k, v FROM lng WHERE venue_internal_id IS NOT NULL AND v IS NOT NULL),
ranked AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS i, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS j,
         count(*) OVER (PARTITION BY k) AS n, avg(v) OVER (PARTITION BY k) AS mean FROM kv),
prof AS (
  SELECT nid AS venue_internal_id, pname AS venue_name, t.p AS profile_type,
         coalesce(q.n_articles, 0)::BIGINT AS n_articles, q.* EXCLUDE (k, n_articles)
  FROM nm CROSS JOIN (VALUES ('oc_full'), ('scopus_full'), ('oc_matched'), ('scopus_matched')) AS t(p)
  LEFT JOIN ({profile_select()}) AS q ON q.k = nid || '|' || t.p)"""

PIVOT_PAIRS = [(a, p) for a in metrics.PIVOT_METRICS for p in metrics.PROFILE_TYPES]
PIVOT_SELECT = ", ".join(
    f"max(CASE WHEN profile_type = '{p}' THEN {a} END) AS {a}__{p}" for a, p in PIVOT_PAIRS
)
PIVOT = f"{LONG}, piv AS (SELECT venue_internal_id, venue_name, {PIVOT_SELECT} FROM prof GROUP BY 1, 2)"
DELTAS = {
    f"{a}__{name}": f"{a}__{x} - {a}__{y}"
    for a in metrics.DELTA_METRICS
    for name, (x, y) in {
        "delta_full_scopus_minus_oc": ("scopus_full", "oc_full"),
        "delta_matched_scopus_minus_oc": ("scopus_matched", "oc_matched"),
        "selection_effect_scopus": ("scopus_matched", "scopus_full"),
        "selection_effect_oc": ("oc_matched", "oc_full"),
    }.items()
}
DELTA = f"{PIVOT}, dlt AS (SELECT piv.*, {', '.join(f'{e} AS {n}' for n, e in DELTAS.items())} FROM piv)"


def venue_names(m):
    return compare.preferred_names(m).withColumnRenamed("venue_name_preferred", "venue_name")


def profiles(spark, sf):
    m = master(spark, sf)
    return metrics.venue_profiles(m, venue_names(m))


@register("A14_four_profiles", rounded_sql(f"{LONG} SELECT * FROM prof", metrics.PROFILE_METRICS))
def four_profiles(spark, sf):
    return rounded(profiles(spark, sf))


PIVOTED_DOUBLES = [f"{a}__{p}" for a, p in PIVOT_PAIRS if a != "n_articles"]


@register("A15_pivoted_profiles", rounded_sql(f"{PIVOT} SELECT * FROM piv", PIVOTED_DOUBLES))
def pivoted(spark, sf):
    return rounded(metrics.pivot_profiles(profiles(spark, sf)))


@register(
    "A16_deltas_and_selection_effects",
    rounded_sql(f"{DELTA} SELECT venue_internal_id, {', '.join(DELTAS)} FROM dlt", list(DELTAS)),
)
def deltas(spark, sf):
    out = metrics.profile_deltas(metrics.pivot_profiles(profiles(spark, sf)))
    return rounded(out.select("venue_internal_id", *DELTAS))


SUMMARY = {
    "mean_of_mean_citations": "avg(mean_citations)", "median_of_mean_citations": "quantile_cont(mean_citations, 0.5)",
    "mean_of_median_citations": "avg(median_citations)", "median_of_median_citations": "quantile_cont(median_citations, 0.5)",
    "mean_share_uncited": "avg(share_uncited)", "median_share_uncited": "quantile_cont(share_uncited, 0.5)",
    "mean_gini": "avg(gini_citations)", "median_gini": "quantile_cont(gini_citations, 0.5)",
    "mean_top10_share": "avg(top_10pct_citation_share)", "median_top10_share": "quantile_cont(top_10pct_citation_share, 0.5)",
}


@register(
    "A17_profile_summary",
    rounded_sql(
        f"{LONG} SELECT profile_type, {', '.join(f'{e} AS {n}' for n, e in SUMMARY.items())} FROM prof GROUP BY 1",
        list(SUMMARY),
    ),
)
def profile_summary(spark, sf):
    return rounded(metrics.profile_summary(profiles(spark, sf)))


# ---- correlations of the two counts of matched articles, per venue ----------------------

PEARSON_EXPR = "CASE WHEN count(*) < 2 OR stddev_pop({x}) = 0 OR stddev_pop({y}) = 0 THEN NULL ELSE corr({x}, {y}) END"
RANKS = """(SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0 AS ry FROM {src})"""
KENDALL = """
ce AS (SELECT venue_internal_id AS k, oc AS x, sc AS y, count(*) AS c FROM b GROUP BY ALL),
pq AS (SELECT p.k, sum(CASE WHEN p.x < q.x AND p.y < q.y THEN p.c * q.c ELSE 0 END)::DOUBLE AS conc,
              sum(CASE WHEN p.x < q.x AND p.y > q.y THEN p.c * q.c ELSE 0 END)::DOUBLE AS disc
       FROM ce p JOIN ce q ON p.k IS NOT DISTINCT FROM q.k GROUP BY 1),
tx AS (SELECT k, sum(t * (t - 1) / 2.0) AS tx FROM (SELECT k, x, sum(c) AS t FROM ce GROUP BY ALL) GROUP BY 1),
ty AS (SELECT k, sum(t * (t - 1) / 2.0) AS ty FROM (SELECT k, y, sum(c) AS t FROM ce GROUP BY ALL) GROUP BY 1),
nn AS (SELECT k, sum(c) * (sum(c) - 1) / 2.0 AS n0 FROM ce GROUP BY 1),
tau AS (SELECT pq.k, CASE WHEN n0 - tx = 0 OR n0 - ty = 0 THEN NULL
               ELSE (conc - disc) / (sqrt(n0 - tx) * sqrt(n0 - ty)) END AS kendall_tau
        FROM pq JOIN tx ON pq.k IS NOT DISTINCT FROM tx.k JOIN ty ON pq.k IS NOT DISTINCT FROM ty.k
        JOIN nn ON pq.k IS NOT DISTINCT FROM nn.k)"""


def _cells(spark, sf):
    matched = compare.matched_pairs(master(spark, sf))
    return corr.contingency(matched, ["venue_internal_id"], "citedby_count_oc", "citedby_count_scopus")


@register(
    "A26_pearson_by_venue",
    rounded_sql(f"{WITH_M} SELECT venue_internal_id, {PEARSON_EXPR.format(x='oc', y='sc')} AS pearson_r FROM b GROUP BY 1",
                ["pearson_r"]),
)
def pearson(spark, sf):
    return rounded(corr.pearson(_cells(spark, sf), ["venue_internal_id"]))


SPEARMAN_SRC = RANKS.format(k="venue_internal_id", x="oc", y="sc", src="b")


@register(
    "A27_spearman_by_venue",
    rounded_sql(f"{WITH_M} SELECT venue_internal_id, {PEARSON_EXPR.format(x='rx', y='ry')} AS spearman_rho "
                f"FROM {SPEARMAN_SRC} GROUP BY 1", ["spearman_rho"]),
)
def spearman(spark, sf):
    return rounded(corr.spearman(_cells(spark, sf), ["venue_internal_id"]))


@register(
    "A28_kendall_by_venue",
    rounded_sql(f"{WITH_M}, {KENDALL} SELECT k AS venue_internal_id, kendall_tau FROM tau", ["kendall_tau"]),
)
def kendall(spark, sf):
    return rounded(corr.kendall(_cells(spark, sf), ["venue_internal_id"]))


@register(
    "A39_venue_publisher_counts",
    f"""{WITH_ART} SELECT venue_name AS journal, o_orderpriority AS publisher, count(*)::BIGINT AS count
    FROM art GROUP BY 1, 2""",
)
def venue_publishers(spark, sf):
    a = articles(spark, sf).withColumn(
        "publisher", F.concat(F.col("o_orderpriority"), F.lit(" [crossref:1]"))
    )
    return ordered(counts.venue_publisher_counts(a), ["count"], ["journal", "publisher"])
