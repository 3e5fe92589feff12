"""Bibliography jobs: nested article records, JATS and TEI documents, parsed references."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from xml.etree.ElementTree import Element

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from citestat.functions import text as X
from citestat.functions import xml as M
from citestat.operators.tables import union_all
from citestat.schemas import OC_METADATA_COLUMNS, SEARCH_PAGE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LANGUAGES = ("pl", "en")
COMPLETENESS = ["author", "title", "pub_date", "venue", "volume", "issue", "page"]


# ---- harvested XML records -------------------------------------------------------------


def split_malformed(df: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(readable rows, error rows). Error rows keep all columns and say why."""
    ok = M.well_formed(xml)
    bad = df.filter(~ok).withColumn(
        "error", F.when(F.col(xml).isNull(), "no document").otherwise("document is not well-formed XML")
    )
    return df.filter(ok), bad


_JATS = (
    "struct<journal_title:string,article_title:string,doi:string,publisher_id:string,year:string,issue:string,fpage:string,lpage:string,"
    "abstract:string,keywords:array<string>,authors:array<struct<surname:string,given_names:string,orcid:string>>,"
    "pdf_urls:array<string>,article_urls:array<string>,references:array<struct<ref_id:string,citation:string>>>"
)


def _read_jats(root: Element) -> dict:
    def of(name: str) -> str | None:
        return M.text(M.first(M.inside(root, name)))

    def article_id(kind: str) -> str | None:
        return M.text(M.first(M.filled(e for e in M.inside(root, "article-id") if e.get("pub-id-type") == kind)))

    def author(e: Element) -> dict:
        orcids = [M.text(i) for i in M.inside(e, "contrib-id") if i.get("contrib-id-type") == "orcid"]
        names = {n: M.text(M.first(M.inside(e, n.replace("_", "-")))) for n in ("surname", "given_names")}
        return names | {"orcid": orcids[-1] if orcids else None}

    def links(pdf: bool) -> list[str]:
        found = [e for e in M.inside(root, "self-uri") if (e.get("content-type") == "application/pdf") == pdf]
        return [v for e in found for k, v in e.items() if k.rpartition("}")[2] == "href" and v]

    groups = M.outermost(root, "contrib-group", content_type="author")
    years = [y for d in M.inside(root, "pub-date") for y in M.children(d, "year")[:1]]
    return {
        "journal_title": of("journal-title"), "article_title": of("article-title"),
        "doi": article_id("doi"), "publisher_id": article_id("publisher-id"), "year": M.text(M.first(M.filled(iter(years)))),
        **{n: of(n) for n in ("issue", "fpage", "lpage", "abstract")},
        "keywords": [M.text(e) for e in M.outermost(root, "kwd")],
        "authors": [author(e) for g in groups for e in M.outermost(g, "contrib")],
        "pdf_urls": links(True), "article_urls": links(False),
        "references": [
            {"ref_id": e.get("id"), "citation": M.text(M.first(M.inside(e, "mixed-citation")))} for e in M.outermost(root, "ref")
        ],
    }


def parse_jats(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Article row of every JATS document (use `split_malformed` first)."""
    plain = ["journal_title", "article_title", "doi", "publisher_id", "year", "issue", "fpage", "lpage", "abstract"]

    def person(a: Column) -> Column:
        surname, given = X.clean_text(a["surname"]), X.clean_text(a["given_names"])
        full = F.nullif(F.trim(F.concat_ws(" ", given, surname)), F.lit(""))
        return F.struct(
            surname.alias("surname"), given.alias("given_names"), full.alias("full_name"), X.clean_text(a["orcid"]).alias("orcid")
        )

    def reference(r: Column) -> Column:
        return F.struct(F.nullif(r["ref_id"], F.lit("")).alias("ref_id"), X.clean_text(r["citation"]).alias("citation"))

    rows = df.select("identifier", M.parsed(xml, _read_jats, _JATS).alias("_x")).select("identifier", "_x.*")
    return rows.select(
        "identifier", *[X.clean_text(c).alias(c) for c in plain], M.cleaned_texts(F.col("keywords")).alias("keywords"),
        F.transform("authors", person).alias("authors"), "pdf_urls", "article_urls",
        F.filter(F.transform("references", reference), lambda r: r["citation"].isNotNull()).alias("references"),
    )


def document_language(xml: str = "xml") -> Column:
    """``xml:lang`` of the article element as a one-element list."""
    lang = F.nullif(
        F.regexp_extract(F.col(xml), r"<(?:[\w.-]+:)?article\s[^>]*?xml:lang\s*=\s*[\"']([^\"']*)[\"']", 1),
        F.lit(""),
    )
    return F.array(lang)


def project_records(df: DataFrame, keys: Sequence[str], source: Column | str | None = None) -> DataFrame:
    """Chosen keys of live records that have any of them, with their source."""
    live = df.filter(~F.col("deleted"))
    has_any = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    tag = F.col("source") if source is None else source
    return live.filter(has_any).select("identifier", *[k for k in keys if k != "identifier"], tag.alias("source"))


def record_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live records and those with metadata."""
    has_any = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    return df.filter(~F.col("deleted")).agg(
        F.count(F.lit(1)).alias("n_articles"), F.count_if(has_any).alias("n_with_metadata")
    )


# ---- TEI documents ---------------------------------------------------------------------


_PEOPLE = "array<struct<surname:string,forename:string,whole:string>>"
_ENTRY = (
    f"struct<analytic_title:string,journal_title:string,monogr_title:string,doi:string,raw_reference:string,first_authors:{_PEOPLE},"
    f"authors:{_PEOPLE},date:string,volume:string,issue:string,page:string,page_from:string,page_to:string,analytic:boolean,"
    f"monogr:boolean,publisher:string,editors:{_PEOPLE}>"
)


def _people_in(e: Element | None, name: str) -> list[dict]:
    if e is None:
        return []

    def part(p: Element, name: str) -> str | None:
        return M.text(M.first(s for n in M.children(p, "persName") for s in M.children(n, name)))

    return [{"surname": part(p, "surname"), "forename": part(p, "forename"), "whole": M.text(p)} for p in M.outermost(e, name)]


def _people(found: Column | str) -> Column:
    """``Surname, Forename; ...``, or the whole text of a person without a name."""
    def name(p: Column) -> Column:
        parts = F.concat_ws(", ", X.clean_text(p["surname"]), X.clean_text(p["forename"]))
        return F.coalesce(F.nullif(parts, F.lit("")), X.clean_text(p["whole"]))

    names = F.filter(F.transform(found, name), lambda n: n.isNotNull())
    return F.nullif(F.array_join(names, "; "), F.lit(""))


def _doi_inside(e: Element) -> str | None:
    return M.text(M.first(M.filled(i for i in M.inside(e, "idno") if (i.get("type") or "").lower() == "doi")))


def _date(e: Element | None) -> str | None:
    """Attribute ``when`` of a date, else its text."""
    return None if e is None else e.get("when") or M.text(e)


def _read_header(root: Element) -> dict:
    statement = M.first(M.inside(root, "titleStmt"))
    sources = [s for d in M.inside(root, "fileDesc") for s in M.children(d, "sourceDesc")]
    return {
        "title": None if statement is None else M.text(M.first(M.children(statement, "title"))),
        "doi": next((d for d in map(_doi_inside, sources) if d), None), "authors": _people_in(statement, "author"),
        "date": _date(M.first(d for p in M.inside(root, "publicationStmt") for d in M.children(p, "date"))),
    }


def tei_header(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Title, DOI, authors and date of every TEI document."""
    keep = [c for c in df.columns if c != xml]
    rows = df.select(*keep, M.parsed(xml, _read_header, f"struct<title:string,doi:string,authors:{_PEOPLE},date:string>").alias("_x"))
    return rows.select(
        *keep, X.clean_text("_x.title").alias("tei_title"), F.lower(X.clean_text("_x.doi")).alias("tei_doi"),
        _people("_x.authors").alias("tei_author"), X.clean_text("_x.date").alias("tei_pub_date"),
    )


def _entries(root: Element) -> list[Element]:
    """References of the bibliographies; a reference inside another one belongs to it."""
    return [b for found in M.outermost(root, "listBibl") for b in M.outermost(found, "biblStruct")]


def _read_entry(b: Element) -> dict:
    analytic, monogr = M.children(b, "analytic"), M.children(b, "monogr")
    titles = [t for m in monogr for t in M.children(m, "title")]

    def scope(unit: str) -> Element | None:
        found = [s for s in M.inside(b, "biblScope") if s.get("unit") == unit]
        return found[-1] if found else None

    page = scope("page")
    imprints = list(M.inside(b, "imprint"))
    return {
        "analytic_title": M.text(M.first(t for a in analytic for t in M.children(a, "title"))),
        "journal_title": M.text(M.first(t for t in titles if t.get("level") == "j")), "monogr_title": M.text(M.first(titles)),
        "doi": _doi_inside(b),
        "raw_reference": M.text(M.first(n for n in M.inside(b, "note") if n.get("type") == "raw_reference")),
        "first_authors": _people_in(M.first(M.inside(b, "analytic")), "author"), "authors": _people_in(M.first(M.inside(b, "monogr")), "author"),
        "date": _date(M.first(d for i in imprints for d in M.inside(i, "date"))),
        "volume": M.text(scope("volume")), "issue": M.text(scope("issue")), "page": M.text(page),
        "page_from": None if page is None else page.get("from"), "page_to": None if page is None else page.get("to"),
        "analytic": bool(analytic), "monogr": bool(monogr),
        "publisher": M.text(M.first(p for i in imprints for p in M.children(i, "publisher"))), "editors": _people_in(b, "editor"),
    }


def reference_type(b: Column) -> Column:
    """Kind of a reference from the parts that exist."""
    return (
        F.when(b["analytic"] & b["journal_title"].isNotNull(), "journal article")
        .when(b["analytic"] & b["monogr"], "book chapter")
        .when(b["monogr"], "book")
        .otherwise("other")
    )


def tei_references(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per reference of a TEI document, in document order."""
    keep = [c for c in df.columns if c != xml]
    entries = M.parsed(xml, lambda root: [_read_entry(b) for b in _entries(root)], f"array<{_ENTRY}>")
    rows = df.select(*keep, F.posexplode(entries).alias("_pos", "_bibl"))
    b = F.col("_bibl")
    page_from, page_to = F.nullif(b["page_from"], F.lit("")), F.nullif(b["page_to"], F.lit(""))
    rows = rows.withColumns(
        {
            "raw_reference": X.clean_text(b["raw_reference"]),
            "title": F.coalesce(X.clean_text(b["analytic_title"]), X.clean_text(b["monogr_title"])),
            "venue": F.coalesce(X.clean_text(b["journal_title"]), X.clean_text(b["monogr_title"])),
            "author": F.coalesce(_people(b["first_authors"]), _people(b["authors"])),
            "doi": F.lower(X.clean_text(b["doi"])),
            "volume": X.clean_text(b["volume"]),
            "issue": X.clean_text(b["issue"]),
            "page": F.when(page_from.isNotNull(), F.concat_ws("-", page_from, page_to)).otherwise(X.clean_text(b["page"])),
            "type": reference_type(b),
            "publisher": X.clean_text(b["publisher"]),
            "editor": _people(b["editors"]),
            "tei_ref_position": F.col("_pos") + 1,
        }
    )
    rows = rows.withColumn("pub_date", F.coalesce(X.clean_text(b["date"]), X.extract_year("raw_reference")))
    temp = X.stable_id(None, "title", "author", "pub_date", "venue", "page", "raw_reference")
    rows = rows.withColumn("id", F.coalesce(F.concat(F.lit("doi:"), F.col("doi")), temp))
    return rows.select(*keep, *OC_METADATA_COLUMNS, "raw_reference", "tei_ref_position")


def _read_raw(root: Element) -> dict:
    return {
        "notes": [M.text(n) for n in M.outermost(root, "note", type="raw_reference")], "entries": [M.text(b) for b in _entries(root)]
    }


def raw_references(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Raw reference notes of a TEI document, else the text of each entry."""
    keep = [c for c in df.columns if c != xml]
    rows = df.select(*keep, M.parsed(xml, _read_raw, "struct<notes:array<string>,entries:array<string>>").alias("_x"))
    rows = rows.select(*keep, M.cleaned_texts(F.col("_x.notes")).alias("_notes"), M.cleaned_texts(F.col("_x.entries")).alias("_entries"))
    chosen = F.when(F.size("_notes") > 0, F.col("_notes")).otherwise(F.col("_entries"))
    return rows.select(*keep, F.posexplode(chosen).alias("_pos", "raw_reference")).select(
        *keep, (F.col("_pos") + 1).alias("reference_index"), "raw_reference"
    )


# ---- article tables and jobs -----------------------------------------------------------


def jobs(merged: DataFrame, languages: Sequence[str] = LANGUAGES, only_ok: bool = True) -> DataFrame:
    """One job per article and language with a stored path (and status ok)."""
    fields = ("status", "path", "filename", "view_url", "direct_pdf_url")
    per_language = F.array(
        *[
            F.struct(F.lit(lang).alias("lang"), *[F.trim(f"{lang}_{f}").alias(f) for f in fields])
            for lang in languages
        ]
    )
    flat = {f"{lang}_{f}" for lang in LANGUAGES for f in (*fields, "server_filename")}
    keep = [c for c in merged.columns if c not in flat]
    out = merged.select(*keep, F.inline(per_language)).filter(F.col("path") != "")
    if only_ok:
        out = out.filter(F.lower("status") == "ok")
    return out.withColumnsRenamed(
        {"status": "pdf_status", "path": "pdf_rel_path", "filename": "pdf_filename", "references": "references_gold"}
    )


def gold_references(df: DataFrame, references: str = "references_gold", keep: Sequence[str] = ()) -> DataFrame:
    """(index, text, ref id) per non-empty reference; empty ones still count for the index.

    Items may be (ref_id, citation) structs or plain texts.
    """
    item = F.col("_item")
    plain = dict(df.dtypes)[references] == "array<string>"
    text = X.clean_text(item if plain else item["citation"])
    ref_id = F.lit(None).cast("string") if plain else X.clean_text(item["ref_id"])
    rows = df.select(*keep, F.posexplode(references).alias("_pos", "_item"))
    return rows.select(
        *keep, (F.col("_pos") + 1).alias("reference_index"),
        text.alias("raw_reference"), ref_id.alias("gold_ref_id"),
    ).filter(F.col("raw_reference").isNotNull())


def extracted_vs_gold(df: DataFrame, extracted: str, gold: str, keep: Sequence[str]) -> DataFrame:
    """Reference counts of both lists, their difference and ratio (NULL without gold)."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return df.select(
        *keep, size(extracted).alias("pdf_reference_count"), size(gold).alias("gold_reference_count"),
        (size(extracted) - size(gold)).alias("difference_pdf_minus_gold"),
        F.try_divide(size(extracted), size(gold)).alias("pdf_gold_ratio"),
    )


def citing_id() -> Column:
    return X.stable_id("doi", "identifier", "publisher_id", "article_title", "lang")


def citing_rows(jobs_df: DataFrame, header: bool = False) -> DataFrame:
    """Metadata row of every citing article; ``header`` adds the four TEI fields."""
    none = F.lit(None).cast("string")
    extra = ["tei_title", "tei_doi", "tei_author", "tei_pub_date"] if header else []
    return jobs_df.select(
        citing_id().alias("id"),
        X.clean_text("article_title").alias("title"),
        X.authors_string("authors", orcid=True).alias("author"),
        X.clean_text("year").alias("pub_date"),
        X.venue_with_issue("journal_title", "issue").alias("venue"),
        none.alias("volume"),
        X.clean_text("issue").alias("issue"),
        X.page_range("fpage", "lpage").alias("page"),
        F.lit("journal article").alias("type"),
        none.alias("publisher"),
        none.alias("editor"),
        *extra,
    )


def citation_rows(jobs_df: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(citing, date, cited, date) of every TEI reference; ``keys`` name the job on both sides."""
    citing = jobs_df.select(
        *keys, citing_id().alias("citing_id"), X.clean_text("year").alias("citing_publication_date")
    )
    cited = refs.select(
        *keys, F.col("id").alias("cited_id"), F.col("pub_date").alias("cited_publication_date")
    )
    return citing.join(cited, list(keys)).select(
        "citing_id", "citing_publication_date", "cited_id", "cited_publication_date"
    )


def reference_diagnostics(jobs_df: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """17 columns: the job, the raw reference and the parsed fields."""
    job = jobs_df.select(
        *keys, *[c for c in ("publisher_id", "doi", "pdf_filename") if c not in keys],
        F.col("article_title").alias("citing_title"),
    )
    parsed = refs.select(
        *keys, "tei_ref_position", "raw_reference",
        *[
            F.col(c).alias(f"parsed_{c}")
            for c in ("id", "title", "author", "pub_date", "venue", "volume", "issue", "page", "type")
        ],
    )
    return job.join(parsed, list(keys)).select(
        "identifier", "publisher_id", "doi", "lang", "pdf_filename", "citing_title", "tei_ref_position",
        "raw_reference", "parsed_id", "parsed_title", "parsed_author", "parsed_pub_date", "parsed_venue",
        "parsed_volume", "parsed_issue", "parsed_page", "parsed_type",
    )


def harvest_manifest(articles: DataFrame, downloads: DataFrame) -> DataFrame:
    """One row per article with the download result of its Polish and English link.

    ``downloads`` has one row per view_url: direct_pdf_url, status, filename,
    server_filename, path. A language without link has the status ``missing``.
    """
    base = ["identifier", "publisher_id", "doi", "article_title"]
    fields = ["direct_pdf_url", "status", "filename", "server_filename", "path"]
    out = articles.select(*base, X.split_by_last_number("pdf_urls").alias("_l"))
    out = out.withColumns({f"{lang}_view_url": F.col(f"_l.{lang}") for lang in LANGUAGES}).drop("_l")
    for lang in LANGUAGES:
        side = downloads.select(
            F.col("view_url").alias("_url"), *[F.col(f).alias(f"{lang}_{f}") for f in fields]
        )
        out = out.join(side, F.col(f"{lang}_view_url") == F.col("_url"), "left").drop("_url")
        no_result = F.when(F.col(f"{lang}_view_url").isNull(), "missing").otherwise("direct_pdf_not_found")
        out = out.withColumn(f"{lang}_status", F.coalesce(f"{lang}_status", no_result))
    order = [f"{lang}_{f}" for lang in LANGUAGES for f in ("view_url", *fields)]
    return out.select(*base, *order)


def manifest_status_counts(manifest: DataFrame) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(lang).alias("lang"), F.col(f"{lang}_status").alias("status")) for lang in LANGUAGES]
    )
    return manifest.select(F.inline(pairs)).groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"))


# ---- parsed references -----------------------------------------------------------------


def split_unparsed(df: DataFrame, json: str = "parsed_json") -> tuple[DataFrame, DataFrame]:
    """(rows with readable JSON, error rows with their ids, raw text and message)."""
    parsed = F.try_parse_json(F.col(json))
    bad = df.filter(parsed.isNull()).withColumn(
        "error", F.when(F.col(json).isNull(), "no parser output").otherwise("parser output is not JSON")
    )
    return df.filter(parsed.isNotNull()), bad


def _first_value(v: Column, field: str) -> Column:
    """First element of a list, or the plain value."""
    at = f"$['{field}']"
    items = F.try_variant_get(v, at, "array<string>")
    return X.clean_text(
        F.when(items.isNotNull(), F.try_element_at(items, F.lit(1))).otherwise(
            F.try_variant_get(v, at, "string")
        )
    )


def parsed_fields(df: DataFrame, json: str = "parsed_json") -> DataFrame:
    """Columns of a parsed reference given as JSON (`split_unparsed` removes bad rows)."""
    v = F.col("_v")

    def author(a: Column) -> Column:
        family = X.clean_text(F.try_variant_get(a, "$.family", "string"))
        given = X.clean_text(F.try_variant_get(a, "$.given", "string"))
        named = F.nullif(F.concat_ws(", ", family, given), F.lit(""))
        plain = X.clean_text(F.try_variant_get(a, "$", "string"))
        return F.when(F.schema_of_variant(a) == "STRING", plain).otherwise(named)

    people = F.transform(F.try_variant_get(v, "$.author", "array<variant>"), author)
    names = F.array_join(F.filter(people, lambda n: n.isNotNull()), "; ")
    mapped = {
        "title": _first_value(v, "title"),
        "author": F.nullif(names, F.lit("")),
        "pub_date": _first_value(v, "date"),
        "venue": _first_value(v, "container-title"),
        "volume": _first_value(v, "volume"),
        "issue": _first_value(v, "issue"),
        "page": _first_value(v, "pages"),
        "type": X.clean_text(F.try_variant_get(v, "$.type", "string")),
    }
    return df.withColumn("_v", F.try_parse_json(F.col(json))).withColumns(mapped).drop("_v")


def completeness(df: DataFrame) -> DataFrame:
    """0/1 flag per field."""
    return df.withColumns({f"has_{c}": F.col(c).isNotNull().cast("int") for c in COMPLETENESS})


def compare_sources(parts: dict[str, DataFrame], json: str = "parsed_json") -> DataFrame:
    """Parsed references of several sources in one table: source tag, fields, flags, error.

    Rows the parser could not read keep their text and an error; all their flags are 0.
    """
    rows = union_all(
        *[df.withColumn("source_type", F.lit(name)) for name, df in parts.items()]
    )
    readable = F.try_parse_json(F.col(json)).isNotNull()
    error = F.when(~readable, F.lit("parser output is not JSON"))
    return completeness(parsed_fields(rows, json)).withColumn("error", error)


RATES = {"title": "title", "author": "author", "date": "pub_date", "venue": "venue"}


def completeness_rates(compared: DataFrame, articles: DataFrame, sources: dict[str, str],
                       key: str = "identifier") -> DataFrame:
    """Per article: references and completeness rates of every source (none = 0.0).

    ``sources`` maps a column prefix to a source_type. Fixed pivot values, one pass.
    """
    aggs = []
    for prefix, source in sources.items():
        mine = F.col("source_type") == source
        aggs.append(F.count_if(mine).alias(f"{prefix}_reference_count"))
        aggs += [
            F.avg(F.when(mine, F.col(f"has_{field}"))).alias(f"{prefix}_has_{name}_rate")
            for name, field in RATES.items()
        ]
    rates = compared.groupBy(key).agg(*aggs)
    out = articles.join(rates, key, "left")
    zero = {c: (0 if c.endswith("_count") else 0.0) for c in rates.columns if c != key}
    return out.fillna(zero)


# ---- stored service responses ----------------------------------------------------------


def search_rows(pages: DataFrame, page: str = "page_json") -> DataFrame:
    """Article rows of stored search pages: rows without eid and the query dropped, distinct."""
    parsed = F.from_json(F.col(page), SEARCH_PAGE)
    rows = pages.select(F.explode_outer(parsed["search-results"]["entry"]).alias("e"))
    e = F.col("e")
    return rows.select(
        e["eid"].alias("eid"), e["dc:title"].alias("title"), e["prism:doi"].alias("doi"),
        e["prism:publicationName"].alias("publication_name"), e["prism:coverDate"].alias("cover_date"),
        e["prism:issn"].alias("issn_returned"), e["prism:eIssn"].alias("eissn_returned"),
        e["citedby-count"].try_cast("double").alias("citedby_count"),
    ).filter(F.col("eid").isNotNull()).distinct()


def search_totals(pages: DataFrame, query: str = "issn_query", page: str = "page_json") -> DataFrame:
    """Number of results each query declares."""
    parsed = F.from_json(F.col(page), SEARCH_PAGE)
    return pages.groupBy(query).agg(
        F.max(parsed["search-results"]["opensearch:totalResults"].try_cast("bigint")).alias("total")
    )


def omids_of_responses(responses: DataFrame, single: bool = False) -> DataFrame:
    """(issn, ids) responses to (issn, omids): all ``omid:`` tokens sorted, NULL if none.

    ``single`` takes the first token of the first id text instead.
    """
    if single:
        return responses.select(
            "issn", X.extract_omid(F.try_element_at("ids", F.lit(1))).alias("omid")
        )
    tokens = F.flatten(F.transform("ids", lambda t: F.coalesce(X.extract_omids(t), F.array().cast("array<string>"))))
    rows = responses.select("issn", F.explode_outer(tokens).alias("omid"))
    return rows.groupBy("issn").agg(F.array_sort(F.collect_list("omid")).alias("omids")).select(
        "issn", F.when(F.size("omids") > 0, F.col("omids")).alias("omids")
    )
