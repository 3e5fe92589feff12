"""Inputs in which one key holds a large share of the rows; pairing it would never finish."""

from pyspark.sql import functions as F

from citestat.operators import corr, dedup, link, metrics, tables

N = 30_000


def hot_sources(spark):
    """A third of all articles share venue, DOI, title and year; the rest are distinct."""
    n = F.col("id")
    hot = n % 3 == 0
    base = spark.range(N).select(
        F.lpad(n.cast("string"), 6, "0").alias("key"), F.lit(1).cast("long").alias("venue_internal_id"),
        F.when(hot, "Editorial").otherwise(F.concat(F.lit("Title no "), n)).alias("title"),
        F.when(hot, "10.1/hot").otherwise(F.concat(F.lit("10.1/"), n)).alias("doi"),
        F.when(hot, "2000").otherwise((1700 + n % 400).cast("string")).alias("year"),
    )
    a = base.select(
        F.concat(F.lit("a"), "key").alias("article_omid"), "venue_internal_id", F.lit("J").alias("venue_name"), "title",
        F.col("year").alias("pub_date"), F.concat(F.lit("doi:"), "doi").alias("id"), F.lit("1").alias("citedby_count"),
    )
    b = base.select(
        F.concat(F.lit("b"), "key").alias("eid"), "venue_internal_id", F.lit("J").alias("publication_name"), "title", "doi",
        F.col("year").alias("cover_date"), F.lit("1").alias("citedby_count"),
    )
    return link.prepare_a(a), link.prepare_b(b)


def test_exact_stages_do_not_pair_a_hot_key(spark):
    a, b = hot_sources(spark)
    distinct = N - N // 3 + 1
    for found in (link.match_doi(a, b), link.match_title_year(a, b)):
        assert found.count() == distinct
        hot = found.filter("title_oc = 'Editorial'").collect()
        assert [(r.article_id_oc, r.article_id_scopus) for r in hot] == [("a000000", "b000000")]


def test_fuzzy_stage_scores_copies_once(spark):
    a, b = hot_sources(spark)
    hot_a = a.filter("title_oc = 'Editorial'")
    b = b.filter("title_scopus = 'Editorial'").withColumn("title_norm", F.lit("editorials"))
    found = link.fuzzy_candidates(hot_a, b)
    # two equal best candidates: no gap, so all go to review with the first article named
    assert found.count() == N // 3
    assert found.select("article_id_scopus", "score_gap").distinct().collect() == [("b000000", 0.0)]


def test_keep_first_and_duplicates(spark):
    rows = spark.range(N).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    assert tables.keep_first(rows, ["k"], ["id"]).count() == N - N // 3 + 1
    copies = spark.range(N).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    report = tables.duplicate_report(copies, chunk=1000)
    assert report.count() == N // 3 and report.distinct().count() == 1


def test_profile_and_tau_of_a_hot_venue(spark):
    rows = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("venue"),
        (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 23).cast("double").alias("y"),
    )
    profile = {r.venue: r for r in metrics.citation_profile(rows, ["venue"], "x").collect()}
    assert profile["hot"].n_articles == N // 3 and 0 < profile["hot"].gini_citations < 1
    taus = {r.venue: r.kendall_tau for r in corr.correlations(rows, ["venue"], "x", "y").collect()}
    assert abs(taus["hot"]) < 0.1


def test_deduplication_of_copies(spark):
    n = F.col("id")
    null = F.lit(None).cast("string")
    records = spark.range(3000).select(
        n.alias("identifier"), F.lit(1).alias("reference_index"),
        F.when(n % 3 == 0, "10.1/hot").alias("doi"), null.alias("doi_enriched"),
        F.when(n % 3 == 0, F.concat(F.lit("variant "), n % 5)).otherwise("the same title").alias("title"),
        F.lit("nowak").alias("author"), F.lit("2000").alias("pub_date"), F.when(n % 3 == 0, "v").otherwise("other journal").alias("venue"),
        *[null.alias(c) for c in ("volume", "issue", "page", "raw_reference")],
    )
    out = dedup.deduplicate(records, ["identifier", "reference_index"])
    heads = out.filter("dedup_status = 'new_canonical'").orderBy("position").collect()
    assert [h.identifier for h in heads] == [0, 1]
    assert out.count() == 3000
