"""Citation profiles: distribution metrics per group, all taken from one histogram.

A histogram holds one row per distinct citation count, at most about the square root of
twice the citations of the group, so the per-group windows below stay small however many
articles a venue has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PROFILE_METRICS = [
    "total_citations", "mean_citations", "median_citations", "mean_median_gap",
    "share_uncited", "share_ge_1", "share_ge_2", "share_ge_5", "share_ge_10",
    "p95_citations", "p99_citations", "std_citations", "cv_citations",
    "gini_citations", "theil_citations", "top_10pct_citation_share",
]


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, c): rows per value, NULL values dropped."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _annotated(hist: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Histogram rows with group size, total, and the counts below and above the value."""
    keys = list(keys)
    if not keys:
        hist = hist.withColumn("_all", F.lit(1))
        keys = ["_all"]
    group = W.partitionBy(*keys)
    below = group.orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    out = hist.withColumns(
        {
            "n": F.sum("c").over(group),
            "total": F.sum(F.col("c") * F.col("v")).over(group),
            "lower": F.coalesce(F.sum("c").over(below), F.lit(0)),
        }
    )
    out = out.withColumns(
        {
            "higher": F.col("n") - F.col("lower") - F.col("c"),
            "mean": F.col("total") / F.col("n"),
            # exact ceiling of a tenth, at least one
            "n_top": F.greatest(F.lit(1), F.floor((F.col("n") + 9) / 10)),
        }
    )
    return out, keys


def _guarded(metric: Column, name: str) -> Column:
    """Inequality metrics refuse negative values."""
    message = F.lit(f"{name} is not defined for negative values")
    return F.when(F.min("v") < 0, F.raise_error(message).cast("double")).otherwise(metric)


def _gini() -> Column:
    c, v, lower = F.col("c"), F.col("v"), F.col("lower")
    # the c equal values take the ranks lower+1 .. lower+c
    rank_sum = c * lower + c * (c + 1) / 2
    n, total = F.max("n"), F.max("total")
    gini = F.try_divide(F.sum(v * rank_sum) * 2, n * total) - (n + 1) / n
    return _guarded(F.when(total == 0, 0.0).otherwise(gini), "Gini coefficient")


def _theil(textbook: bool = False) -> Column:
    c, v = F.col("c"), F.col("v")
    ratio = F.try_divide(v, F.col("mean"))
    term = F.when(v > 0, c * ratio * F.ln(ratio))
    base = F.max("n") if textbook else F.sum(F.when(v > 0, c))
    theil = F.try_divide(F.sum(term), base)
    return _guarded(F.when(F.max("total") == 0, 0.0).otherwise(theil), "Theil index")


def _top_share() -> Column:
    taken = F.greatest(F.lit(0), F.least(F.col("c"), F.col("n_top") - F.col("higher")))
    total = F.max("total")
    return F.when(total == 0, 0.0).otherwise(F.try_divide(F.sum(F.col("v") * taken), total))


def _share(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("c")).otherwise(0)) / F.sum("c")


def _std() -> Column:
    spread = F.sum(F.col("c") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
    return F.sqrt(F.try_divide(spread, F.max("n") - 1))


def quantile(p: float) -> Column:
    """Exact quantile with linear interpolation over a histogram."""
    return F.percentile("v", p, F.col("c"))


def profile_of_histogram(hist: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None,
                         textbook_theil: bool = False) -> DataFrame:
    """Group size and the requested metrics (all 16 by default) from a (keys, v, c) histogram."""
    rows, group = _annotated(hist, keys)
    mean = F.max("mean")
    std = _std()
    v = F.col("v")
    available = {
        "total_citations": F.max("total"),
        "mean_citations": mean,
        "median_citations": quantile(0.5),
        "mean_median_gap": mean - quantile(0.5),
        "share_uncited": _share(v == 0),
        "share_ge_1": _share(v >= 1),
        "share_ge_2": _share(v >= 2),
        "share_ge_5": _share(v >= 5),
        "share_ge_10": _share(v >= 10),
        "p95_citations": quantile(0.95),
        "p99_citations": quantile(0.99),
        "std_citations": std,
        # one article alone has no spread, which counts as 0 when its mean is 0
        "cv_citations": F.when(mean == 0, F.when(std > 0, F.lit(None)).otherwise(0.0)).otherwise(
            F.try_divide(std, mean)
        ),
        "gini_citations": _gini(),
        "theil_citations": _theil(),
        "top_10pct_citation_share": _top_share(),
    }
    wanted = list(PROFILE_METRICS if metrics is None else metrics)
    columns = [available[m].alias(m) for m in wanted]
    if textbook_theil:
        columns.append(_theil(textbook=True).alias("theil_textbook"))
    out = rows.groupBy(*group).agg(F.max("n").alias("n_articles"), *columns)
    return out.select(*keys, "n_articles", *wanted, *(["theil_textbook"] if textbook_theil else []))


def citation_profile(articles: DataFrame, keys: Sequence[str], value: str = "citedby_count",
                     missing_as_zero: bool = False, metrics: Sequence[str] | None = None,
                     textbook_theil: bool = False) -> DataFrame:
    """Profile of every group of ``keys`` (none: of the whole table)."""
    if missing_as_zero:
        articles = articles.withColumn(value, F.coalesce(value, F.lit(0)))
    return profile_of_histogram(histogram(articles, keys, value), keys, metrics, textbook_theil)


# the four populations of a linked article table: name -> (statuses, citation column)
PROFILE_TYPES = {
    "oc_full": (("both", "open_citations_only"), "citedby_count_oc"),
    "scopus_full": (("both", "scopus_only"), "citedby_count_scopus"),
    "oc_matched": (("both",), "citedby_count_oc"),
    "scopus_matched": (("both",), "citedby_count_scopus"),
}


def venue_profiles(master: DataFrame, venues: DataFrame) -> DataFrame:
    """Four profiles per venue of ``venues(venue_internal_id, venue_name)``.

    One pass: every article carries the list of populations it belongs to. A venue without
    articles in a population gets n_articles = 0 and NULL metrics.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("profile_type"),
                F.when(F.col("source_status").isin(*statuses), F.col(column)).cast("double").alias("value"),
            )
            for name, (statuses, column) in PROFILE_TYPES.items()
        ]
    )
    long = (
        master.filter(F.col("venue_internal_id").isNotNull())
        .select("venue_internal_id", F.inline(entries))
        .filter(F.col("value").isNotNull())
    )
    keys = ["venue_internal_id", "profile_type"]
    metrics = citation_profile(long, keys, "value")
    wanted = venues.select(
        "venue_internal_id", "venue_name",
        F.explode(F.array(*[F.lit(p) for p in PROFILE_TYPES])).alias("profile_type"),
    )
    return (
        wanted.join(metrics, keys, "left")
        .withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    )


PIVOT_METRICS = [
    "n_articles", "total_citations", "mean_citations", "median_citations", "share_uncited",
    "share_ge_1", "share_ge_2", "share_ge_5", "share_ge_10", "p95_citations", "p99_citations",
    "gini_citations", "theil_citations", "top_10pct_citation_share",
]
DELTA_METRICS = [
    "mean_citations", "median_citations", "share_uncited", "gini_citations",
    "top_10pct_citation_share",
]


def pivot_profiles(profiles: DataFrame) -> DataFrame:
    """One row per venue, columns ``metric__profile``; all 56 columns always exist."""
    pairs = [(m, p) for m in PIVOT_METRICS for p in PROFILE_TYPES]
    return profiles.groupBy("venue_internal_id", "venue_name").agg(
        *[
            F.max(F.when(F.col("profile_type") == p, F.col(m))).alias(f"{m}__{p}")
            for m, p in pairs
        ]
    )


def profile_deltas(pivoted: DataFrame) -> DataFrame:
    """Source differences and selection effects of five metrics."""
    new = {}
    for m in DELTA_METRICS:
        oc, sc = F.col(f"{m}__oc_full"), F.col(f"{m}__scopus_full")
        oc_m, sc_m = F.col(f"{m}__oc_matched"), F.col(f"{m}__scopus_matched")
        new[f"{m}__delta_full_scopus_minus_oc"] = sc - oc
        new[f"{m}__delta_matched_scopus_minus_oc"] = sc_m - oc_m
        new[f"{m}__selection_effect_scopus"] = sc_m - sc
        new[f"{m}__selection_effect_oc"] = oc_m - oc
    return pivoted.withColumns(new)


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Mean and median over venues of five metrics, per population."""
    names = {
        "mean_citations": ("mean_of_mean_citations", "median_of_mean_citations"),
        "median_citations": ("mean_of_median_citations", "median_of_median_citations"),
        "share_uncited": ("mean_share_uncited", "median_share_uncited"),
        "gini_citations": ("mean_gini", "median_gini"),
        "top_10pct_citation_share": ("mean_top10_share", "median_top10_share"),
    }
    aggs = []
    for m, (mean, median) in names.items():
        aggs += [F.avg(m).alias(mean), F.percentile(m, 0.5).alias(median)]
    return profiles.groupBy("profile_type").agg(*aggs)


def label_outliers(metrics: DataFrame, columns: Sequence[str], p: float = 0.90) -> DataFrame:
    """Rows at or above the p-quantile of any of the columns."""
    limits = metrics.agg(*[F.percentile(c, p).alias(f"_{c}") for c in columns])
    mask = F.lit(False)
    for c in columns:
        mask = mask | F.coalesce(F.col(c) >= F.col(f"_{c}"), F.lit(False))
    # the limits are one row
    return metrics.join(F.broadcast(limits)).filter(mask).select(metrics.columns)


def reference_lines(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    return metrics.agg(*[F.percentile(c, 0.5).alias(f"median_{c}") for c in columns])
