"""Queries of the bibliography jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from citestat.functions import text as X
from citestat.operators import refs, tables
from citestat.plans.catalog_tables import LINES_SQL, document_lines, harvested_records
from citestat.plans.catalog_text import clean_sql
from citestat.plans.registry import register, rounded, rounded_sql
from citestat.session import save_and_reload
from citestat.sources import read_table

# One article per document; its lines are the references. Where two readings are compared, the
# even lines are one and the odd ones the other. The same fields in SQL, to check what is read back from XML or JSON.
ART = f"""t AS (SELECT doc_id AS conv_id, i AS turn, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, line AS text,
  {clean_sql('line')} AS txt FROM {LINES_SQL}),
c AS (SELECT conv_id, 'oai:' || conv_id AS identifier, 'p' || conv_id AS publisher_id,
      CASE WHEN conv_id % 3 <> 0 THEN '10.7/C' || conv_id END AS doi, 'Journal of ' || (conv_id % 7) AS journal_title,
      'Article ' || conv_id AS article_title, (1990 + conv_id % 30)::VARCHAR AS year,
      CASE WHEN conv_id % 2 = 0 THEN (conv_id % 5)::VARCHAR END AS issue,
      CASE WHEN conv_id % 4 <> 0 THEN conv_id::VARCHAR END AS fpage, CASE WHEN conv_id % 8 < 6 THEN (conv_id + 9)::VARCHAR END AS lpage
      FROM (SELECT doc_id AS conv_id FROM documents)),
r AS (SELECT conv_id, turn, txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM t)"""
PAGE_SQL = "CASE WHEN fpage IS NULL THEN NULL WHEN lpage IS NULL THEN fpage ELSE fpage || '-' || lpage END"
CITING_SQL = "coalesce('doi:' || lower(doi), 'temp:' || substr(md5(concat_ws(' | ', identifier, publisher_id, article_title{extra})), 1, 16))"


def _escape(c):
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _tag(name, value, attributes=""):
    """Element with a value; NULL gives NULL, which concat_ws leaves out."""
    return F.concat(F.lit(f"<{name}{attributes}>"), value, F.lit(f"</{name}>"))


def jats_documents(spark, sf):
    """JATS records assembled from the conversations: a default namespace, nested markup in the title."""
    h = harvested_records(spark, sf)
    person = lambda a: F.concat(
        F.lit("<contrib><contrib-id contrib-id-type=\"orcid\">"), F.coalesce(a["orcid"], F.lit("")),
        F.lit("</contrib-id><name><surname>"), a["surname"], F.lit("</surname><given-names>"), a["given_names"],
        F.lit("</given-names></name></contrib>"),
    )
    reference = lambda r: F.concat(
        F.lit("<ref id=\""), r["ref_id"], F.lit("\"><label>1</label><mixed-citation>"), _escape(r["citation"]),
        F.lit("</mixed-citation></ref>"),
    )
    link = lambda u: F.concat(
        F.lit("<self-uri content-type=\"application/pdf\" xlink:href=\""), u, F.lit("\"/>")
    )
    xml = F.concat(
        F.lit('<?xml version="1.0"?><article xmlns="http://jats" xmlns:xlink="http://www.w3.org/1999/xlink" xml:lang="pl"><front>'),
        F.concat_ws(
            "",
            _tag("journal-title", F.col("journal_title")),
            F.concat(F.lit("<article-id pub-id-type=\"doi\">"), F.col("doi"), F.lit("</article-id>")),
            F.concat(F.lit("<article-id pub-id-type=\"publisher-id\">"), F.col("publisher_id"), F.lit("</article-id>")),
            F.concat(F.lit("<article-title>Article <italic>"), F.col("conv"), F.lit("</italic></article-title>")),
            F.lit("<contrib-group content-type=\"editor\"><contrib><name><surname>Ed</surname></name></contrib></contrib-group>"),
            F.lit("<contrib-group content-type=\"author\">"), F.array_join(F.transform("authors", person), ""),
            F.lit("</contrib-group><pub-date><month>5</month></pub-date><pub-date>"), _tag("year", F.col("year")), F.lit("</pub-date>"),
            _tag("issue", F.col("issue")), _tag("fpage", F.col("fpage")), _tag("lpage", F.col("lpage")),
            F.array_join(F.transform("pdf_urls", link), ""),
            F.concat(F.lit("<self-uri xlink:href=\""), F.element_at("article_urls", 1), F.lit("\"/>")),
            F.lit("<kwd-group>"), F.array_join(F.transform("keywords", lambda k: _tag("kwd", k)), ""), F.lit("</kwd-group>"),
        ),
        F.lit("</front><back><ref-list>"), F.array_join(F.transform("references", reference), ""),
        F.lit("<ref id=\"empty\"><mixed-citation> </mixed-citation></ref></ref-list></back></article>"),
    )
    return h.withColumn("conv", F.expr("substring(identifier, 5)")).select("identifier", xml.alias("xml"))


@register(
    "N1_jats_articles",
    f"WITH {ART} SELECT identifier, journal_title, article_title, doi, publisher_id, year, issue, fpage, lpage, 'kw|' || conv_id AS keywords FROM c",
)
def jats_articles(spark, sf):
    return refs.parse_jats(jats_documents(spark, sf)).select(
        "identifier", "journal_title", "article_title", "doi", "publisher_id", "year", "issue", "fpage", "lpage",
        F.array_join("keywords", "|").alias("keywords"),
    )


@register(
    "N2_jats_authors",
    f"""WITH {ART} SELECT identifier, 'S' || conv_id AS surname, 'G' || conv_id AS given_names, 'G' || conv_id || ' S' || conv_id AS full_name,
    CASE WHEN conv_id % 2 = 0 THEN 'https://orcid.org/0000-' || conv_id END AS orcid FROM c""",
)
def jats_authors(spark, sf):
    return refs.parse_jats(jats_documents(spark, sf)).select("identifier", F.inline("authors"))


@register("N3_jats_references", f"WITH {ART} SELECT 'oai:' || conv_id AS identifier, 'R' || turn AS ref_id, md5(txt) AS citation FROM r")
def jats_references(spark, sf):
    rows = refs.parse_jats(jats_documents(spark, sf)).select("identifier", F.inline("references"))
    return rows.withColumn("citation", F.md5("citation"))


@register(
    "N4_jats_links",
    f"""WITH {ART} SELECT identifier, array_to_string(list_transform(range(1, conv_id % 3 + 2), lambda i: 'https://x.org/view/' || conv_id || '/' || (100 - i)), ' ') AS pdf_urls,
    'https://x.org/a/' || conv_id AS article_urls FROM c""",
)
def jats_links(spark, sf):
    return refs.parse_jats(jats_documents(spark, sf)).select(
        "identifier", F.array_join("pdf_urls", " ").alias("pdf_urls"), F.array_join("article_urls", " ").alias("article_urls")
    )


def _gold(spark, sf):
    """References with every third text emptied, which the index must still count."""
    h = harvested_records(spark, sf)
    emptied = F.transform(
        "references",
        lambda r, i: F.struct(r["ref_id"].alias("ref_id"), F.when(i % 3 != 1, r["citation"]).otherwise(" ").alias("citation")),
    )
    return h.withColumn("references_gold", emptied)


@register(
    "N5_gold_references",
    f"WITH {ART} SELECT 'oai:' || conv_id AS identifier, pos AS reference_index, md5(txt) AS raw_reference, 'R' || turn AS gold_ref_id FROM r WHERE pos % 3 <> 2",
)
def gold_references(spark, sf):
    rows = refs.gold_references(_gold(spark, sf), keep=["identifier"])
    return rows.withColumns({"raw_reference": F.md5("raw_reference"), "reference_index": F.col("reference_index").cast("bigint")})


# ---- TEI --------------------------------------------------------------------------------

# by position: journal article, chapter, book, only a raw note

def tei_documents(spark, sf):
    h = harvested_records(spark, sf)

    def entry(r, i):
        kind = (i + 1) % 4
        n = (i + 1).cast("string")
        analytic = F.concat(
            F.lit("<analytic><title>T"), n, F.lit("</title><author><persName><forename>F"), n,
            F.lit("</forename><surname>S"), n, F.lit("</surname></persName></author><author>Group &amp; Co</author></analytic>"),
        )
        imprint = F.concat(
            F.lit("<imprint><publisher>P"), n, F.lit("</publisher><date when=\"2001-0"), n, F.lit("\">x</date>"),
            F.lit("<biblScope unit=\"volume\">"), n, F.lit("</biblScope><biblScope unit=\"page\" from=\""), n, F.lit("\""),
            F.when(kind == 0, F.concat(F.lit(" to=\""), (i + 9).cast("string"), F.lit("\""))).otherwise(""),
            F.lit("/></imprint>"),
        )
        level = F.when(kind == 0, " level=\"j\"").otherwise("")
        monogr = F.concat(
            F.lit("<monogr><title"), level, F.lit(">M"), n,
            F.lit("</title><author><persName><surname>MS</surname></persName></author><editor><persName><forename>E</forename><surname>D</surname></persName></editor>"),
            imprint, F.when(kind == 0, F.concat(F.lit("<idno type=\"DOI\">10.6/A"), n, F.lit("</idno>"))).otherwise(""),
            F.lit("</monogr>"),
        )
        return F.concat(
            F.lit("<biblStruct>"), F.when(kind < 2, analytic).otherwise(""), F.when(kind < 3, monogr).otherwise(""),
            F.lit("<note type=\"raw_reference\">"), _escape(r["citation"]), F.lit("</note></biblStruct>"),
        )

    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt>'),
        _tag("title", F.col("article_title")),
        F.lit("<author><persName><forename>A</forename><surname>B</surname></persName></author><author>C  D</author></titleStmt>"),
        F.lit("<publicationStmt><date when=\""), F.col("year"), F.lit("\"/></publicationStmt><sourceDesc><biblStruct><idno type=\"DOI\">"),
        F.coalesce("doi", F.lit("")), F.lit("</idno></biblStruct></sourceDesc></fileDesc></teiHeader><text><back><listBibl>"),
        F.array_join(F.transform("references", entry), ""), F.lit("</listBibl></back></text></TEI>"),
    )
    return h.select("identifier", xml.alias("xml"))


TEI_SQL = f"""WITH {ART},
tk AS (SELECT 'oai:' || conv_id AS identifier, pos, pos % 4 AS k, txt, nullif(regexp_extract(txt, '(1[6-9]\\d{{2}}|20\\d{{2}}|21\\d{{2}})', 1), '') AS ty FROM r),
te AS (SELECT identifier, pos AS tei_ref_position, txt AS raw_reference,
  CASE k WHEN 0 THEN 'T' || pos WHEN 1 THEN 'T' || pos WHEN 2 THEN 'M' || pos END AS title,
  CASE WHEN k < 2 THEN 'S' || pos || ', F' || pos || '; Group & Co' WHEN k = 2 THEN 'MS' END AS author,
  CASE WHEN k < 3 THEN '2001-0' || pos ELSE ty END AS pub_date, CASE WHEN k < 3 THEN 'M' || pos END AS venue,
  CASE WHEN k < 3 THEN pos::VARCHAR END AS volume, CASE WHEN k = 0 THEN pos || '-' || (pos + 8) WHEN k < 3 THEN pos::VARCHAR END AS page,
  CASE k WHEN 0 THEN 'journal article' WHEN 1 THEN 'book chapter' WHEN 2 THEN 'book' ELSE 'other' END AS type,
  CASE WHEN k < 3 THEN 'P' || pos END AS publisher, CASE WHEN k < 3 THEN 'D, E' END AS editor,
  CASE WHEN k = 0 THEN 'doi:10.6/a' || pos END AS doi_id FROM tk),
tr AS (SELECT identifier, tei_ref_position, coalesce(doi_id, 'temp:' || substr(md5(coalesce(nullif(concat_ws(' | ', title, author, pub_date, venue, page, raw_reference), ''), 'empty')), 1, 16)) AS id,
  title, author, pub_date, venue, volume, page, type, publisher, editor, md5(raw_reference) AS raw_reference FROM te)"""


def _tei_rows(spark, sf):
    rows = refs.tei_references(tei_documents(spark, sf))
    return rows.withColumns(
        {"raw_reference": F.md5("raw_reference"), "tei_ref_position": F.col("tei_ref_position").cast("bigint")}
    )


@register("N6_tei_references", f"{TEI_SQL} SELECT * FROM tr")
def tei_references(spark, sf):
    return _tei_rows(spark, sf).drop("issue")


@register("F18_reference_types", f"{TEI_SQL} SELECT type, count(*)::BIGINT AS n FROM tr GROUP BY 1")
def reference_types(spark, sf):
    return refs.tei_references(tei_documents(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "N7_tei_headers",
    f"WITH {ART} SELECT identifier, article_title AS tei_title, lower(doi) AS tei_doi, 'B, A; C D' AS tei_author, year AS tei_pub_date FROM c",
)
def tei_headers(spark, sf):
    return refs.tei_header(tei_documents(spark, sf))


@register("N8_raw_references", f"WITH {ART} SELECT 'oai:' || conv_id AS identifier, pos AS reference_index, md5(txt) AS raw_reference FROM r")
def raw_references(spark, sf):
    rows = refs.raw_references(tei_documents(spark, sf))
    return rows.withColumns({"raw_reference": F.md5("raw_reference"), "reference_index": F.col("reference_index").cast("bigint")})


# ---- parsed references ------------------------------------------------------------------


def parsed_json(spark, sf, role=None):
    """Parser output per line (of one role): lists for the title, plain values elsewhere, some not JSON."""
    lines = document_lines(spark, sf).select(F.col("doc_id").alias("conv_id"), F.posexplode("lines").alias("turn", "text"))
    t = lines if role is None else lines.filter(F.col("turn") % 2 == (0 if role == "user" else 1))
    family = F.concat(F.lit("Fam"), F.col("turn"))
    parsed = F.struct(
        F.when(F.col("turn") % 5 != 4, F.array(F.col("text"), F.lit("second"))).alias("title"),
        F.when(
            F.col("conv_id") % 3 != 0,
            F.array(F.struct(family.alias("family"), F.when(F.col("conv_id") % 2 == 0, "Giv").alias("given"))),
        ).alias("author"),
        F.array((2000 + F.col("conv_id") % 9).cast("string")).alias("date"),
        F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("Venue "), F.col("conv_id"))).alias("container-title"),
        F.col("turn").cast("string").alias("volume"), F.lit("article-journal").alias("type"),
    )
    json = F.when(F.col("conv_id") % 10 == 9, F.lit("{broken")).otherwise(F.to_json(parsed))
    return t.select(
        F.concat(F.lit("oai:"), F.col("conv_id")).alias("identifier"), F.col("turn").cast("bigint").alias("reference_index"),
        F.col("text").alias("raw_reference"), json.alias("parsed_json"),
    )


def _parsed_sql(role: str | None = None) -> str:
    of_role = f"role = '{role}' AND " if role else ""
    return f"""SELECT conv_id, 'oai:' || conv_id AS identifier, turn AS reference_index,
    CASE WHEN turn % 5 <> 4 THEN txt END AS title,
    CASE WHEN conv_id % 3 <> 0 THEN 'Fam' || turn || CASE WHEN conv_id % 2 = 0 THEN ', Giv' ELSE '' END END AS author,
    (2000 + conv_id % 9)::VARCHAR AS pub_date, CASE WHEN conv_id % 4 <> 0 THEN 'Venue ' || conv_id END AS venue,
    turn::VARCHAR AS volume FROM t WHERE {of_role}conv_id % 10 <> 9"""


@register(
    "N9_parsed_references",
    f"""WITH {ART}, p AS ({_parsed_sql()}) SELECT identifier, reference_index, md5(title) AS title, author, pub_date, venue, volume,
    NULL::VARCHAR AS issue, 'article-journal' AS type FROM p""",
)
def parsed_references(spark, sf):
    good, _ = refs.split_unparsed(parsed_json(spark, sf))
    return refs.parsed_fields(good).select(
        "identifier", "reference_index", F.md5("title").alias("title"), "author", "pub_date", "venue", "volume", "issue", "type"
    )


@register(
    "N16_error_rows",
    f"WITH {ART} SELECT 'oai:' || conv_id AS identifier, turn AS reference_index, md5(text) AS raw_reference, 'parser output is not JSON' AS error FROM t WHERE conv_id % 10 = 9",
)
def error_rows(spark, sf):
    _, bad = refs.split_unparsed(parsed_json(spark, sf))
    return bad.select("identifier", "reference_index", F.md5("raw_reference").alias("raw_reference"), "error")


@register("N16_malformed_documents", f"WITH {ART} SELECT identifier, 'document is not well-formed XML' AS error FROM c WHERE conv_id % 4 = 1")
def malformed(spark, sf):
    """Every fourth document loses its end; the others stay readable."""
    docs = jats_documents(spark, sf)
    number = F.expr("cast(substring(identifier, 5) as bigint)")
    cut = docs.withColumn("xml", F.when(number % 4 == 1, F.substring("xml", 1, 200)).otherwise(F.col("xml")))
    return refs.split_malformed(cut)[1].select("identifier", "error")


SOURCES = {"grobid": "grobid_raw_reference", "gold": "gold_pickle_reference"}


def compared(spark, sf):
    return refs.compare_sources(
        {SOURCES["gold"]: parsed_json(spark, sf, "user"), SOURCES["grobid"]: parsed_json(spark, sf, "assistant")}
    )


COMPARED_SQL = f"""WITH {ART}, p AS (
 SELECT *, '{SOURCES["gold"]}' AS source_type FROM ({_parsed_sql('user')}) UNION ALL SELECT *, '{SOURCES["grobid"]}' FROM ({_parsed_sql('assistant')})),
 s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '{SOURCES["gold"]}' ELSE '{SOURCES["grobid"]}' END AS source_type FROM t WHERE role <> 'system'),
 cmp AS (SELECT 'oai:' || s.conv_id AS identifier, s.turn AS reference_index, s.source_type, (title IS NOT NULL)::BIGINT AS has_title,
   (author IS NOT NULL)::BIGINT AS has_author, (pub_date IS NOT NULL)::BIGINT AS has_pub_date, (venue IS NOT NULL)::BIGINT AS has_venue,
   (volume IS NOT NULL)::BIGINT AS has_volume, CASE WHEN p.identifier IS NULL THEN 'parser output is not JSON' END AS error
   FROM s LEFT JOIN p ON p.conv_id = s.conv_id AND p.reference_index = s.turn AND p.source_type = s.source_type)"""


@register("N13_two_source_comparison", f"{COMPARED_SQL} SELECT * FROM cmp")
def two_source(spark, sf):
    flags = [F.col(f"has_{c}").cast("bigint").alias(f"has_{c}") for c in ("title", "author", "pub_date", "venue", "volume")]
    return compared(spark, sf).select("identifier", "reference_index", "source_type", *flags, "error")


RATE_SQL = ", ".join(
    f"sum(CASE WHEN source_type = '{s}' THEN 1 ELSE 0 END)::BIGINT AS {p}_reference_count, "
    + ", ".join(f"coalesce(avg(CASE WHEN source_type = '{s}' THEN has_{f} END), 0.0) AS {p}_has_{n}_rate" for n, f in refs.RATES.items())
    for p, s in SOURCES.items()
)
RATE_COLUMNS = [f"{p}_has_{n}_rate" for p in SOURCES for n in refs.RATES]


@register(
    "A36_completeness_rates",
    rounded_sql(f"{COMPARED_SQL} SELECT c.identifier, {RATE_SQL} FROM c LEFT JOIN cmp ON cmp.identifier = c.identifier GROUP BY 1", RATE_COLUMNS),
)
def completeness_rates(spark, sf):
    articles = harvested_records(spark, sf).select("identifier")
    return rounded(refs.completeness_rates(compared(spark, sf), articles, SOURCES))


@register(
    "A37_extracted_vs_gold",
    rounded_sql(
        f"""WITH {ART} SELECT 'oai:' || conv_id AS identifier, sum((role = 'assistant')::INT)::BIGINT AS pdf_reference_count,
        sum((role = 'user')::INT)::BIGINT AS gold_reference_count, (sum((role = 'assistant')::INT) - sum((role = 'user')::INT))::BIGINT AS difference_pdf_minus_gold,
        sum((role = 'assistant')::INT) / nullif(sum((role = 'user')::INT), 0) AS pdf_gold_ratio FROM t GROUP BY 1""",
        ["pdf_gold_ratio"],
    ),
)
def extracted_vs_gold(spark, sf):
    lists = document_lines(spark, sf).select(
        F.concat(F.lit("oai:"), F.col("doc_id")).alias("identifier"),
        F.filter("lines", lambda t, i: i % 2 == 1).alias("extracted"), F.filter("lines", lambda t, i: i % 2 == 0).alias("gold"),
    )
    out = refs.extracted_vs_gold(lists, "extracted", "gold", ["identifier"])
    return rounded(out.select("identifier", *[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes if c != "identifier"]))


# ---- jobs and citing rows ---------------------------------------------------------------


def downloads(spark, sf):
    """Stored download result per view link; some failed."""
    urls = harvested_records(spark, sf).select("identifier", F.explode("pdf_urls").alias("view_url"))
    ok = X.last_number("view_url") % 2 == 1
    return urls.select(
        "view_url", F.replace(F.col("view_url"), F.lit("view"), F.lit("download")).alias("direct_pdf_url"),
        F.when(ok, "ok").otherwise("http_404").alias("status"),
        F.when(ok, F.concat("identifier", F.lit(".pdf"))).alias("filename"),
        F.lit(None).cast("string").alias("server_filename"),
        F.when(ok, F.concat(F.lit("pdf/"), "identifier", F.lit(".pdf"))).alias("path"),
    )


def manifest(spark, sf):
    return refs.harvest_manifest(harvested_records(spark, sf), downloads(spark, sf))


# links end in 99, 98, 97 for one, two or three links: the smallest is Polish
MAN_SQL = f"""WITH {ART},
l AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 99 WHEN 1 THEN 98 ELSE 97 END AS pl, CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 99 ELSE 98 END AS en FROM c),
man AS (SELECT *, CASE WHEN pl % 2 = 1 THEN 'ok' ELSE 'http_404' END AS pl_status,
        CASE WHEN en IS NULL THEN 'missing' WHEN en % 2 = 1 THEN 'ok' ELSE 'http_404' END AS en_status FROM l)"""


@register(
    "N14_harvest_manifest",
    f"""{MAN_SQL} SELECT identifier, publisher_id, doi, article_title, 'https://x.org/view/' || conv_id || '/' || pl AS pl_view_url, pl_status,
    CASE WHEN pl_status = 'ok' THEN 'pdf/' || identifier || '.pdf' END AS pl_path,
    'https://x.org/view/' || conv_id || '/' || en AS en_view_url, en_status, CASE WHEN en_status = 'ok' THEN 'pdf/' || identifier || '.pdf' END AS en_path
    FROM man""",
)
def harvest_manifest(spark, sf):
    return manifest(spark, sf).select(
        "identifier", "publisher_id", "doi", "article_title", "pl_view_url", "pl_status", "pl_path",
        "en_view_url", "en_status", "en_path",
    )


@register(
    "N14_status_counts",
    f"{MAN_SQL} SELECT 'pl' AS lang, pl_status AS status, count(*)::BIGINT AS n FROM man GROUP BY 2 UNION ALL SELECT 'en', en_status, count(*) FROM man GROUP BY 2",
)
def status_counts(spark, sf):
    return refs.manifest_status_counts(manifest(spark, sf))


def job_table(spark, sf):
    keys = ["identifier", "publisher_id", "doi", "article_title"]
    # read by the check of its keys and by the join
    found = save_and_reload(manifest(spark, sf), "manifest")
    merged = tables.validated_left_join(found, harvested_records(spark, sf), keys)
    return refs.jobs(merged)


def reference_jobs(spark, sf):
    """The job table without the records' own references, saved: it is read more than once, or joined with all TEI references."""
    jobs = job_table(spark, sf)
    return save_and_reload(jobs.select("identifier", "publisher_id", "doi", "article_title", "lang", "pdf_filename", "year"), "jobs")


JOBS_SQL = f"""{MAN_SQL},
jb AS (SELECT *, 'pl' AS lang, pl AS num FROM man WHERE pl_status = 'ok' UNION ALL SELECT *, 'en', en FROM man WHERE en_status = 'ok')"""


@register(
    "N12_job_table",
    f"""{JOBS_SQL} SELECT identifier, lang, 'ok' AS pdf_status, identifier || '.pdf' AS pdf_filename, journal_title, year, issue,
    (SELECT count(*) FROM r WHERE r.conv_id = jb.conv_id)::BIGINT AS n_references FROM jb""",
)
def jobs_query(spark, sf):
    return job_table(spark, sf).select(
        "identifier", "lang", "pdf_status", "pdf_filename", "journal_title", "year", "issue",
        F.size("references_gold").cast("bigint").alias("n_references"),
    )


@register("W13_wide_to_long", f"{JOBS_SQL} SELECT lang, count(*)::BIGINT AS n FROM jb GROUP BY 1")
def wide_to_long(spark, sf):
    return job_table(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


CITING_ROW_SQL = f"""SELECT {CITING_SQL.format(extra=', lang')} AS id, article_title AS title,
 'G' || conv_id || ' S' || conv_id || CASE WHEN conv_id % 2 = 0 THEN ' [orcid:0000-' || conv_id || ']' ELSE '' END AS author,
 year AS pub_date, journal_title || CASE WHEN issue IS NULL THEN '' ELSE ' [issue:' || issue || ']' END AS venue, issue, {PAGE_SQL} AS page,
 'journal article' AS type FROM jb"""


@register("N10_citing_rows", f"{JOBS_SQL} {CITING_ROW_SQL}")
def citing_rows(spark, sf):
    return refs.citing_rows(job_table(spark, sf)).select("id", "title", "author", "pub_date", "venue", "issue", "page", "type")


N11_SQL = f"{JOBS_SQL}, {TEI_SQL.split(ART + ',', 1)[1]}"


@register(
    "N11_citation_rows",
    f"""{N11_SQL} SELECT {CITING_SQL.format(extra=', lang').replace('identifier', 'jb.identifier')} AS citing_id, jb.year AS citing_publication_date,
    tr.id AS cited_id, tr.pub_date AS cited_publication_date FROM jb JOIN tr ON tr.identifier = jb.identifier""",
)
def citation_rows(spark, sf):
    jobs = reference_jobs(spark, sf)
    found = refs.tei_references(tei_documents(spark, sf))
    return refs.citation_rows(jobs, found, ["identifier"])


@register(
    "N11_reference_diagnostics",
    f"""{N11_SQL} SELECT jb.identifier, publisher_id, doi, lang, article_title AS citing_title, tei_ref_position, raw_reference, id AS parsed_id,
    title AS parsed_title, tr.type AS parsed_type FROM jb JOIN tr ON tr.identifier = jb.identifier""",
)
def diagnostics(spark, sf):
    jobs = reference_jobs(spark, sf)
    found = _tei_rows(spark, sf).join(jobs.select("identifier", "lang"), "identifier")
    return refs.reference_diagnostics(jobs, found, ["identifier", "lang"]).select(
        "identifier", "publisher_id", "doi", "lang", "citing_title", "tei_ref_position", "raw_reference", "parsed_id",
        "parsed_title", "parsed_type",
    )


# ---- records and stored responses -------------------------------------------------------


@register("N15_language_fill", f"WITH {ART} SELECT identifier, 'pl' AS language FROM c")
def language_fill(spark, sf):
    return jats_documents(spark, sf).select("identifier", F.array_join(refs.document_language(), ",").alias("language"))


RESPONSES = {"n": "p_partkey % 3", "eid": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE 'e' || p_partkey END"}


def search_pages(spark, sf):
    """Stored search pages of 25 articles, the declared total on each; some pages were stored twice."""
    e = F.struct(
        F.expr(RESPONSES["eid"]).alias("eid"), F.col("p_name").alias("dc:title"), F.lit(None).cast("string").alias("prism:doi"),
        F.col("p_brand").alias("prism:publicationName"), F.concat((F.lit(2000) + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("prism:coverDate"),
        F.lit("12345678").alias("prism:issn"), F.lit(None).cast("string").alias("prism:eIssn"),
        F.when(F.col("p_size") != 2, F.col("p_size").cast("string")).otherwise("n/a").alias("citedby-count"),
    )
    page = F.floor(F.col("p_partkey") / 25)
    rows = read_table(spark, sf, "part").groupBy(page.alias("page")).agg(F.collect_list(e).alias("entry"))
    body = F.struct(F.struct(F.lit("25").alias("opensearch:totalResults"), "entry").alias("search-results"))
    copies = F.sequence(F.lit(1), F.when(F.col("page") % 4 == 0, 2).otherwise(1))
    return rows.select(
        (F.col("page") % 10).cast("string").alias("issn_query"), F.to_json(body).alias("page_json"), F.explode(copies).alias("_i")
    ).drop("_i")


@register(
    "N17_search_rows",
    """SELECT 'e' || p_partkey AS eid, p_name AS title, p_brand AS publication_name, (2000 + p_size) || '-01-01' AS cover_date,
    CASE WHEN p_size = 2 THEN NULL ELSE p_size::DOUBLE END AS citedby_count FROM part WHERE p_size % 9 <> 0""",
)
def search_rows(spark, sf):
    return refs.search_rows(search_pages(spark, sf)).select("eid", "title", "publication_name", "cover_date", "citedby_count")


@register("N17_search_totals", "SELECT DISTINCT ((p_partkey // 25) % 10)::VARCHAR AS issn_query, 25::BIGINT AS total FROM part")
def search_totals(spark, sf):
    return refs.search_totals(search_pages(spark, sf))


@register(
    "N18_id_responses",
    """SELECT 'i' || s_suppkey AS issn, CASE WHEN s_suppkey % 5 <> 0 THEN 'br/' || s_nationkey || ',br/' || s_nationkey || 'x' END AS omids,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'br/' || s_nationkey || 'x' END AS first_omid FROM supplier""",
)
def id_responses(spark, sf):
    """Stored id answers: two id texts per ISSN; some have no venue id."""
    def ids(suffix):
        omid = F.concat(F.lit("omid:br/"), F.col("s_nationkey"), F.lit(suffix))
        return F.concat(F.lit("doi:10.1/x "), F.when(F.col("s_suppkey") % 5 != 0, omid).otherwise("x:1"))

    answers = read_table(spark, sf, "supplier").select(
        F.concat(F.lit("i"), F.col("s_suppkey")).alias("issn"), F.array(ids("x"), ids("")).alias("ids")
    )
    lists = refs.omids_of_responses(answers).select("issn", F.array_join("omids", ",").alias("omids"))
    first = refs.omids_of_responses(answers, single=True).withColumnRenamed("omid", "first_omid")
    return lists.join(first, "issn")


@register(
    "N19_country_label",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN n_name END AS country FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def country_label(spark, sf):
    nation = read_table(spark, sf, "nation")
    node = lambda i, label: F.struct(i.alias("@id"), label.alias("label"))
    path = F.when(F.col("s_suppkey") % 4 != 0, "http://id.loc.gov/vocabulary/countries/x").otherwise("urn:other")
    graph = F.array(node(F.lit("urn:issn"), F.lit("first")), node(path, F.col("n_name")))
    text = F.to_json(F.struct(graph.alias("@graph")))
    parsed = F.from_json(text, "struct<`@graph`:array<struct<`@id`:string,label:string>>>")["@graph"]
    nodes = F.transform(parsed, lambda n: F.struct(n["@id"].alias("id"), n["label"].alias("label")))
    rows = read_table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", X.country_label(nodes).alias("country"))


def _oai(spark, sf):
    d = read_table(spark, sf, "documents")
    keep = lambda c, m: F.when(F.col("doc_id") % m != 0, F.array(c))
    return d.select(
        F.col("doc_id").cast("string").alias("identifier"), keep("lang", 3).alias("title"), keep("source", 2).alias("subject"),
        (F.col("doc_id") % 7 == 0).alias("deleted"), "source",
    )


@register(
    "N20_projected_records",
    """SELECT doc_id::VARCHAR AS identifier, CASE WHEN doc_id % 3 <> 0 THEN lang END AS title, CASE WHEN doc_id % 2 <> 0 THEN source END AS subject, 'repository' AS source
    FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 3 <> 0 OR doc_id % 2 <> 0)""",
)
def projected(spark, sf):
    rows = refs.project_records(_oai(spark, sf), ["title", "subject"], F.lit("repository"))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("title", "subject")})


@register(
    "N20_record_counts",
    """SELECT count(*)::BIGINT AS n_articles, sum((doc_id % 3 <> 0 OR doc_id % 2 <> 0)::INT)::BIGINT AS n_with_metadata FROM documents WHERE doc_id % 7 <> 0""",
)
def record_counts(spark, sf):
    return refs.record_counts(_oai(spark, sf), ["title", "subject"])
