"""Job: journals and bulk dumps to articles, citations and venue counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from citestat.functions import text as X
from citestat.operators import counts, selection, tables
from citestat.session import save_and_reload


@dataclass
class Counted:
    journals: DataFrame
    articles: DataFrame
    duplicates: DataFrame
    citations: DataFrame
    self_citations: DataFrame


def journals_with_ids(journals: DataFrame, issn_omid: DataFrame) -> DataFrame:
    """Venue ids of both ISSNs, their sorted union, and whether the index knows the journal."""
    out = tables.lookup(journals, "issn", issn_omid, "issn", "omids", "omids_issn")
    out = tables.lookup(out, "e_issn", issn_omid, "issn", "omids", "omids_eissn")
    return (
        out.withColumn("omids", selection.merged_omids("omids_issn", "omids_eissn"))
        .withColumn("in_index", selection.presence("omids"))
        .drop("omids_issn", "omids_eissn")
    )


def venue_articles(journals: DataFrame, issn_omid: DataFrame, dump: DataFrame,
                   curated: DataFrame | None = None) -> DataFrame:
    """Dump rows of the journals' venues, named, with ISSNs; only curated pairs if given."""
    titles = counts.omid_titles(journals)
    rows = selection.rows_of_venues(dump, titles)
    rows = tables.lookup(rows, "venue_omid", titles, "venue_omid", "title", "venue_name")
    rows = tables.lookup(rows, "venue_omid", counts.issns_of_omids(issn_omid), "venue_omid", "issns", "issn")
    rows = rows.withColumn("publisher_name", X.venue_name("publisher")).withColumn("volume", X.clean_text("volume"))
    return selection.allowed_pairs(rows, curated) if curated is not None else rows


def count_citations(journals: DataFrame, issn_omid: DataFrame, dump: DataFrame, citation_index: DataFrame,
                    curated: DataFrame | None = None) -> Counted:
    """Run the whole job. ``journals`` carries internal_id; all inputs are tables.

    The filtered articles and citations are small parts of the dumps and are read several
    times, so each is written once.
    """
    journals = journals_with_ids(journals, issn_omid)
    found = save_and_reload(venue_articles(journals, issn_omid, dump, curated), "articles")
    articles = found.distinct().withColumn("article_omid", X.extract_omid("id"))
    ids = articles.select(F.concat(F.lit("omid:"), F.col("article_omid")).alias("cited"))
    cited = save_and_reload(selection.cited_in(citation_index, ids, "cited", "cited"), "citations")
    kept, own = selection.split_self_citations(cited)
    kept = kept.withColumn("article_omid", X.extract_omid("cited"))
    flat = journals.select("internal_id", F.explode("omids").alias("venue_omid"))
    venue_ids = tables.last_value_map(flat, "venue_omid", "internal_id", "internal_id")
    articles = tables.lookup(articles, "venue_omid", venue_ids, "venue_omid", "internal_id", "venue_internal_id")
    articles = counts.attach_citations(articles, counts.citations_per_article(kept, "article_omid"))
    totals = counts.venue_totals(articles)
    journals = tables_with_totals(journals, totals)
    return Counted(journals, articles, tables.duplicate_report(found), kept, own)


def tables_with_totals(journals: DataFrame, totals: DataFrame) -> DataFrame:
    side = totals.withColumnRenamed("venue_internal_id", "_venue")
    return journals.join(side, journals["internal_id"] == side["_venue"], "left").drop("_venue")


def second_source_counts(journals: DataFrame, articles: DataFrame) -> DataFrame:
    """Journals with the counts of a second source and which source has more of each."""
    key = F.coalesce(X.format_issn("issn_returned"), X.format_issn("eissn_returned"))
    tagged = tables.lookup(
        articles.withColumn("_issn", key), "_issn", counts.issn_to_internal_id(journals), "issn",
        "internal_id", "venue_internal_id",
    )
    totals = counts.venue_totals(tagged, article="eid", prefix="scopus")
    return tables_with_totals(journals, totals).withColumns(
        {
            "oc_more_articles": selection.more_in_first("oc_articles_counted", "scopus_articles_counted"),
            "oc_more_citations": selection.more_in_first("oc_citations_counted", "scopus_citations_counted"),
        }
    )
