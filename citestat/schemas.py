"""Explicit schemas (DDL) of the input and result tables. NULL is the only missing value."""

from __future__ import annotations

JOURNALS = (
    "internal_id bigint, title string, issn string, e_issn string, discipline string, "
    "country string, keywords string"
)
ISSN_OMID = ("issn string, omids array<string>")
META_DUMP = (
    "id string, title string, author string, pub_date string, venue string, volume string, "
    "issue string, page string, type string, publisher string, editor string"
)
CITATION_INDEX = ("id string, citing string, cited string")
VENUE_PUBLISHER = ("journal string, publisher string, count bigint, false_info string")
SEARCH_ENTRY = (
    "struct<`eid`:string,`dc:title`:string,`prism:doi`:string,`prism:publicationName`:string,"
    "`prism:coverDate`:string,`prism:issn`:string,`prism:eIssn`:string,`citedby-count`:string>"
)
SEARCH_PAGE = (
    "struct<`search-results`:struct<`opensearch:totalResults`:string,"
    f"`entry`:array<{SEARCH_ENTRY}>>>"
)
AUTHOR = "struct<surname:string,given_names:string,full_name:string,orcid:string>"
REFERENCE = "struct<ref_id:string,citation:string>"
HARVESTED = (
    "identifier string, publisher_id string, doi string, journal_title string, "
    "article_title string, year string, issue string, fpage string, lpage string, "
    "abstract string, keywords array<string>, "
    f"authors array<{AUTHOR}>, pdf_urls array<string>, article_urls array<string>, "
    f"references array<{REFERENCE}>"
)
MANIFEST = (
    "identifier string, publisher_id string, doi string, article_title string, "
    + ", ".join(
        f"{lang}_{field} string"
        for lang in ("pl", "en")
        for field in ("view_url", "direct_pdf_url", "status", "filename", "server_filename", "path")
    )
)
CROSSREF_ITEM = (
    "struct<`DOI`:string,`title`:array<string>,`container-title`:array<string>,"
    "`author`:array<struct<given:string,family:string>>,`type`:string,`score`:double,"
    + ",".join(
        f"`{k}`:struct<`date-parts`:array<array<int>>>"
        for k in ("published-print", "published-online", "published", "issued")
    )
    + ">"
)
OC_METADATA_COLUMNS = [
    "id", "title", "author", "pub_date", "venue", "volume", "issue", "page", "type",
    "publisher", "editor",
]
CITATION_PAIR_COLUMNS = ["citing_id", "cited_id"]
DATED_CITATION_COLUMNS = [
    "citing_id", "citing_publication_date", "cited_id", "cited_publication_date",
]
MANIFEST_REQUIRED = [
    "identifier", "publisher_id", "doi", "article_title",
    "pl_status", "pl_path", "en_status", "en_path",
]
