from pyspark.sql import functions as F

from citestat.operators import enrich, link, refs
from citestat.plans import bibliography, comparing, counting
from test_link import sources


def test_counting_job(spark):
    journals = spark.createDataFrame(
        [(1, "J One", "1111-0001", "1111-0002"), (2, "J Two", None, "2222-0002"), (3, "J Three", "3333-0001", None)],
        "internal_id long, title string, issn string, e_issn string",
    )
    issn_omid = spark.createDataFrame(
        [("1111-0001", ["br/1"]), ("1111-0002", ["br/1", "br/9"]), ("2222-0002", ["br/2"]), ("3333-0001", None)],
        "issn string, omids array<string>",
    )
    row = lambda i, v, p: (f"doi:x omid:br/a{i}", f"t{i}", None, "2001", v, " 1 ", None, None, "journal article", p, None)
    dump_rows = [
        row(1, "J [omid:br/1]", "P [x]"), row(1, "J [omid:br/1]", "P [x]"), row(2, "J [omid:br/9]", "P [x]"),
        row(3, "K [omid:br/2]", "Q [x]"), row(4, "K [omid:br/7]", "P [x]"), row(5, "K [omid:br/2]", "bad [x]"),
    ]
    columns = "id title author pub_date venue volume issue page type publisher editor".split()
    dump = spark.createDataFrame(dump_rows, ", ".join(f"{c} string" for c in columns))
    cites = spark.createDataFrame(
        [("c1", "omid:br/z", "omid:br/a1"), ("c2", "omid:br/a3", "omid:br/a1"), ("c3", "omid:br/a1", "omid:br/a1"),
         ("c4", "omid:br/z", "omid:br/a3"), ("c5", "omid:br/z", "omid:br/other")], "id string, citing string, cited string",
    )
    curated = spark.createDataFrame(
        [("J One", "P", 3, None), ("J Two", "Q", 1, None), ("J Two", "bad", 1, "x")],
        "journal string, publisher string, count long, false_info string",
    )
    out = counting.count_citations(journals, issn_omid, dump, cites, curated)
    assert {r.article_omid: (r.venue_internal_id, r.citedby_count) for r in out.articles.collect()} == {
        "br/a1": (1, 2), "br/a2": (1, None), "br/a3": (2, 1)
    }
    assert out.duplicates.count() == 2 and out.citations.count() == 3
    assert [r.id for r in out.self_citations.collect()] == ["c3"]
    j = {r.internal_id: r for r in out.journals.collect()}
    assert (j[1].in_index, j[1].omids, j[1].oc_articles_counted, j[1].oc_citations_counted, j[1].oc_citation_article_ratio) == (
        True, ["br/1", "br/9"], 2, 2, 1.0
    )
    assert j[3].in_index is False and j[3].oc_articles_counted is None
    other = spark.createDataFrame(
        [("e1", "11110001", None, 5.0), ("e2", None, "22220002", 0.0), ("e3", None, None, 1.0)],
        "eid string, issn_returned string, eissn_returned string, citedby_count double",
    )
    second = {r.internal_id: r for r in counting.second_source_counts(out.journals, other).collect()}
    assert (second[1].scopus_articles_counted, second[1].scopus_citations_counted) == (1, 5)
    assert (second[1].oc_more_articles, second[1].oc_more_citations, second[2].oc_more_citations) == (True, False, True)


def test_comparison_job(spark, tmp_path):
    left = [("a1", 1, "same", "2000", "d1"), ("a2", 1, "title two", "2001", None), ("a3", 2, "alone", "2001", None)]
    right = [("b1", 1, "x", "2000", "d1"), ("b2", 1, "Title Two", "2001", None), ("b3", 3, "other", "2002", None)]
    found = link.link_sources(*sources(spark, left, right))
    out = comparing.comparison_tables(found.master)
    assert len(out) == 24
    assert {r.category: r.n_articles for r in out["global_coverage"].collect()} == {
        "both": 2, "open_citations_only": 1, "scopus_only": 1, "total": 4
    }
    assert out["journal_master"].count() == 3 and out["profiles_long"].count() == 12
    comparing.write_tables({k: out[k] for k in ("global_coverage", "top_low_overlap")}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "global_coverage")).count() == 4


def test_bibliography_job(spark):
    person = "array<struct<surname:string,given_names:string,full_name:string,orcid:string>>"
    jobs = spark.createDataFrame(
        [("i1", "p1", "10.1/A", "Art", "pl", "J", "2", "2001", "1", "9", [("S", "G", "G S", None)])],
        "identifier string, publisher_id string, doi string, article_title string, lang string, journal_title string, "
        f"issue string, year string, fpage string, lpage string, authors {person}",
    )
    book = '{"title":["A long enough title"],"author":[{"family":"Nowak"}],"date":["1999"],"container-title":["V"]}'
    parsed = spark.createDataFrame(
        [("i1", "pl", 1, "raw one", book), ("i1", "pl", 2, "raw two", book), ("i1", "pl", 3, "raw three", "{bad")],
        "identifier string, lang string, reference_index int, raw_reference string, parsed_json string",
    )
    query = refs.parsed_fields(parsed).select(F.md5(enrich.query_text())).first()[0]
    answers = spark.createDataFrame(
        [(query, [("10.2/B", "A long enough title", "Nowak", "1999", "V", "book", 1.0)], None)],
        f"query_key string, candidates array<{enrich.CANDIDATE}>, error string",
    )
    out = bibliography.export_bibliography(jobs, parsed, answers)
    assert [tuple(r) for r in out.citations.collect()] == [("doi:10.1/a", "doi:10.2/b")]
    meta = {r.id: r for r in out.metadata.collect()}
    assert set(meta) == {"doi:10.1/a", "doi:10.2/b"} and meta["doi:10.1/a"].page == "1-9"
    assert sorted(r.dedup_status for r in out.mapping.collect()) == ["matched_existing", "new_canonical"]
    assert [r.raw_reference for r in out.errors.collect()] == ["raw three"]
    assert out.diagnostics.count() == 2
