"""Filters and per-row columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from citestat.functions import text as X


def select_renamed(df: DataFrame, layout: Mapping[str, str], numeric: Sequence[str] = ()) -> DataFrame:
    """Project onto canonical names: ``layout`` maps new name to source column."""
    return df.select(
        *[(X.number_or_zero(src) if new in numeric else F.col(src)).alias(new) for new, src in layout.items()]
    )


def country_and_keyword(df: DataFrame, country_col: str, country: str, keyword_col: str, stem: str) -> DataFrame:
    """Case-sensitive substring in the keywords and an exact country; NULL is not kept."""
    return df.filter((F.col(country_col) == country) & F.col(keyword_col).contains(stem))


def rows_of_venues(dump: DataFrame, venue_ids: DataFrame, venue_col: str = "venue") -> DataFrame:
    """Rows of a metadata dump whose venue id is in ``venue_ids(venue_omid)``."""
    tagged = dump.withColumn("venue_omid", X.extract_venue_omid(venue_col))
    return tagged.join(venue_ids.select("venue_omid").distinct(), "venue_omid", "left_semi")


def allowed_pairs(articles: DataFrame, curated: DataFrame) -> DataFrame:
    """Rows whose (venue_name, publisher_name) is in the curated list.

    Curated rows flagged as wrong (``false_info`` not NULL) are ignored.
    """
    good = curated.filter(F.col("false_info").isNull()).select(
        F.trim("journal").alias("venue_name"), F.trim("publisher").alias("publisher_name")
    )
    return articles.join(good, ["venue_name", "publisher_name"], "left_semi")


def cited_in(citations: DataFrame, articles: DataFrame, cited: str = "cited", key: str = "article_omid") -> DataFrame:
    """Citations whose cited side is one of the articles."""
    ids = articles.select(F.col(key).alias(cited))
    return citations.join(ids, cited, "left_semi")


def split_self_citations(citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, self-citations) by citing = cited."""
    return (
        citations.filter(F.col("citing") != F.col("cited")),
        citations.filter(F.col("citing") == F.col("cited")),
    )


def in_languages(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    """Rows whose language array holds any accepted code."""
    return df.filter(F.arrays_overlap(F.col(column), F.array(*[F.lit(c) for c in codes])))


def since_year(df: DataFrame, column: str, year: int) -> DataFrame:
    return df.filter(F.col(column) >= year)


def with_any_element(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.filter(X.any_contains(column, needle))


def with_at_least(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.filter(F.size(column) >= n)


def overlapping_keys(df: DataFrame, id_col: str, array_col: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows with any array element in the key table."""
    hits = (
        df.select(F.col(id_col).alias("_id"), F.explode(array_col).alias("_e"))
        .join(keys.select(F.col(key).alias("_e")), "_e", "left_semi")
        .select("_id")
        .distinct()
    )
    return df.join(hits, df[id_col] == hits["_id"], "left_semi")


def manually_accepted(df: DataFrame, flag: str = "the same") -> DataFrame:
    return df.filter(F.lower(F.trim(F.col(f"`{flag}`"))) == "x")


def first_match(conditions: Sequence[tuple[Column, str]], default: str) -> Column:
    """First true condition wins; NULL counts as false."""
    out = None
    for cond, choice in conditions:
        out = F.when(cond, choice) if out is None else out.when(cond, choice)
    return out.otherwise(default)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def status_flags(master: DataFrame) -> DataFrame:
    """Boolean flags of source status and match method, and the preferred fields."""
    status, method, doi = F.col("source_status"), F.col("match_method"), F.col("doi_norm")
    return master.withColumns(
        {
            "is_both": flag(status == "both"),
            "is_oc_only": flag(status == "open_citations_only"),
            "is_scopus_only": flag(status == "scopus_only"),
            "has_doi": flag(F.trim(doi) != ""),
            "matched_by_doi": flag(method == "doi_exact"),
            "matched_by_title_exact": flag(method == "title_exact_year"),
            "matched_by_fuzzy": flag(method == "title_fuzzy_year_auto"),
            "matched_manual": flag(method == "manual_confirmed"),
            "venue_name": F.coalesce("venue_name", "venue_name_oc", "venue_name_scopus"),
            "year_preferred": F.coalesce("year_preferred", "year_oc", "year_sc"),
        }
    )


def journal_category(in_index: Column | str, citations: Column | str) -> Column:
    """Not indexed, indexed without citations, or cited (fixed labels)."""
    i = F.col(in_index) if isinstance(in_index, str) else in_index
    c = F.col(citations) if isinstance(citations, str) else citations
    return (
        F.when(~i, "no data in OpenCitations")
        .when(c == 0, "in OpenCitations but 0 citations")
        .otherwise("cited in OpenCitations")
    )


def more_in_first(a: str, b: str) -> Column:
    """``a > b`` with a missing count below every count."""
    return F.coalesce(F.col(a), F.lit(-1)) > F.coalesce(F.col(b), F.lit(-1))


def presence(omids: str) -> Column:
    return F.coalesce(F.size(omids) > 0, F.lit(False))


def merged_omids(a: str, b: str) -> Column:
    """Sorted union of two id lists, NULL when both are missing."""
    empty = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))
    return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), both)


def preferred_omid(journals: DataFrame) -> DataFrame:
    """Single-id variant: id of the ISSN, else of the e-ISSN; equality flag; presence."""
    return journals.withColumns(
        {
            "omids_identical": F.col("omid_issn") == F.col("omid_eissn"),
            "omid": F.coalesce("omid_issn", "omid_eissn"),
            "in_index": F.coalesce(F.coalesce("omid_issn", "omid_eissn") != "", F.lit(False)),
        }
    )


def zero_cited_journals(journals: DataFrame, responses: DataFrame) -> DataFrame:
    """One ISSN per journal (ISSN, else e-ISSN), the responses for those, and how many count 0."""
    chosen = journals.select(F.coalesce("issn", "e_issn").alias("issn")).distinct()
    return responses.join(chosen, "issn", "left_semi").agg(
        F.count(F.lit(1)).alias("n_journals"),
        F.count_if(F.col("citation_count") == 0).alias("n_zero_cited"),
    )
