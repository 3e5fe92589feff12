import random

import pytest

import models
from citestat.operators import compare, corr, metrics, selection


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b, abs=1e-9))


def groups_frame(spark, groups):
    data = [(k, v) for k, vs in groups.items() for v in vs]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "k string, citedby_count double").repartition(3)


def test_profile_edge_groups(spark):
    groups = {
        "single": [3.0], "single_zero": [0.0], "zeros": [0.0] * 7, "one_positive": [0.0] * 8 + [5.0],
        "n9": [float(i % 4) for i in range(9)], "n10": [float(i % 4) for i in range(10)],
        "n11": [float(i % 4) for i in range(11)], "n100": [float(i * i % 17) for i in range(100)],
    }
    rng = random.Random(5)
    for i in range(12):
        groups[f"r{i}"] = [float(rng.choice([0, 0, 1, 2, rng.randint(0, 60)])) for _ in range(rng.randint(1, 80))]
    got = metrics.citation_profile(groups_frame(spark, groups), ["k"]).collect()
    assert len(got) == len(groups)
    for r in got:
        want = models.profile(groups[r.k])
        for name, value in want.items():
            assert close(r[name], value), (r.k, name, r[name], value)
        assert 0 <= r.gini_citations < 1


def test_profile_drops_nulls_and_rejects_negatives(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "k string, citedby_count double")
    got = {r.k: r.n_articles for r in metrics.citation_profile(df, ["k"]).collect()}
    assert got == {"a": 1}
    got = {r.k: r.n_articles for r in metrics.citation_profile(df, ["k"], missing_as_zero=True).collect()}
    assert got == {"a": 2, "b": 1}
    bad = spark.createDataFrame([("a", -1.0)], "k string, citedby_count double")
    for metric in ("gini_citations", "theil_citations"):
        with pytest.raises(Exception, match="not defined for negative"):
            metrics.citation_profile(bad, ["k"], metrics=[metric]).collect()


def test_theil_variants(spark):
    df = groups_frame(spark, {"a": [0.0, 0.0, 2.0, 4.0]})
    r = metrics.citation_profile(df, ["k"], textbook_theil=True).first()
    assert r.theil_textbook == pytest.approx(r.theil_citations / 2)


@pytest.mark.parametrize("seed", range(4))
def test_correlations(spark, seed):
    rng = random.Random(seed)
    groups = {"const": [(1, i) for i in range(4)], "one": [(1, 1)], "two": [(1, 2), (2, 1)], "ties": [(1, 1)] * 3}
    for i in range(10):
        groups[f"g{i}"] = [(rng.randint(0, 6), rng.randint(0, 9)) for _ in range(rng.randint(2, 40))]
    data = [(k, float(x), float(y)) for k, ps in groups.items() for x, y in ps]
    data += [("one", None, 2.0), ("nothing", None, 1.0), (None, 1.0, 2.0), (None, 2.0, 3.0)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    got = {r.k: r for r in corr.correlations(df, ["k"], "x", "y").collect()}
    assert "nothing" not in got and got[None].kendall_tau == pytest.approx(1)
    for k, ps in groups.items():
        assert close(got[k].pearson_r, models.pearson(ps)), k
        assert close(got[k].spearman_rho, models.spearman(ps)), k
        assert close(got[k].kendall_tau, models.tau_b(ps)), k


def test_matrix_pairwise_deletion(spark):
    rng = random.Random(3)
    data = [tuple(float(rng.randint(0, 5)) if rng.random() > 0.2 else None for _ in range(3)) + (1.0,) for _ in range(40)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    for method, model in (("pearson", models.pearson), ("spearman", models.spearman), ("kendall", models.tau_b)):
        got = {(r.row_var, r.col_var): r.value for r in corr.correlation_matrix(df, names, method).collect()}
        assert len(got) == 16
        for i, x in enumerate(names):
            for j, y in enumerate(names):
                pairs = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
                assert close(got[x, y], model(pairs)), (method, x, y)


MASTER = (
    "article_id_oc string, article_id_scopus string, venue_internal_id long, venue_name string, venue_name_oc string, "
    "venue_name_scopus string, title_preferred string, year_preferred long, year_oc long, year_sc long, doi_norm string, "
    "source_status string, match_method string, citedby_count_oc double, citedby_count_scopus double"
)


def master_rows(spark):
    def row(i, venue, name, status, method, oc, sc, doi=None, year=2000):
        return (f"o{i}", f"s{i}", venue, name, name, None, f"t{i}", year, None, None, doi, status, method, oc, sc)

    return selection.status_flags(
        spark.createDataFrame(
            [
                row(1, 1, "B", "both", "doi_exact", 4.0, 4.0, "10.1/x"), row(2, 1, "A", "both", "title_exact_year", 0.0, 2.0, " "),
                row(3, 1, "A", "open_citations_only", "oc_only", 1.0, None), row(4, 1, "B", "scopus_only", "scopus_only", None, 3.0),
                row(5, 2, None, "open_citations_only", "oc_only", 2.0, None, year=None),
                row(6, None, "N", "both", "manual_confirmed", 1.0, None), row(7, 3, "C", "scopus_only", "scopus_only", None, 0.0),
            ],
            MASTER,
        )
    )


def test_names_and_overlap(spark):
    m = master_rows(spark)
    names = compare.preferred_names(m)
    assert {r[0]: r[1] for r in names.collect()} == {1: "A", 2: compare.UNKNOWN_JOURNAL, 3: "C"}
    got = {r.venue_internal_id: r for r in compare.journal_overlap(m, names).collect()}
    assert (got[1].n_both, got[1].n_union, got[1].jaccard_index) == (2, 4, 0.5)
    assert got[2].share_both_in_scopus is None and got[3].share_both_in_oc is None
    assert got[None].venue_name is None and got[None].jaccard_index == 1.0
    assert {r.category: r.n_articles for r in compare.global_coverage(m).collect()} == {
        "both": 3, "open_citations_only": 2, "scopus_only": 2, "total": 7
    }


def test_matched_deltas(spark):
    got = {r.article_id_oc: r for r in compare.matched_pairs(master_rows(spark)).collect()}
    assert got["o2"].citation_relative_delta_scopus_base == 1.0
    assert got["o6"].citation_relative_delta_scopus_base is None and got["o6"].citation_abs_delta is None
    summary = {r.metric: r.value for r in compare.matched_summary(compare.matched_pairs(master_rows(spark))).collect()}
    assert summary["n_matched_articles"] == 3 and summary["share_equal_counts"] == pytest.approx(1 / 3)
    assert summary["mean_citations_scopus"] == 3.0 and summary["median_delta_scopus_minus_oc"] == 1.0


def test_empty_profiles_and_pivot(spark):
    m = master_rows(spark)
    names = compare.preferred_names(m).withColumnRenamed("venue_name_preferred", "venue_name")
    profiles = metrics.venue_profiles(m, names)
    got = {(r.venue_internal_id, r.profile_type): r for r in profiles.collect()}
    assert len(got) == 12
    assert got[2, "scopus_full"].n_articles == 0 and got[2, "scopus_full"].gini_citations is None
    wide = metrics.profile_deltas(metrics.pivot_profiles(profiles)).collect()
    one = next(r for r in wide if r.venue_internal_id == 1)
    assert one["mean_citations__delta_matched_scopus_minus_oc"] == 1.0
    assert one["mean_citations__selection_effect_oc"] == pytest.approx(2 - 5 / 3)


def test_doi_flags(spark):
    got = {r.metric: r.value for r in compare.doi_shares(master_rows(spark)).collect()}
    assert got["share_with_doi_both"] == pytest.approx(1 / 3) and got["share_with_doi_oc_only"] == 0.0


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(i), 1.0 if i else None) for i in range(11)], "id int, a double, b double")
    assert sorted(r.id for r in metrics.label_outliers(df, ["a"]).collect()) == [9, 10]
    assert len(metrics.label_outliers(df, ["a", "b"]).collect()) == 10
