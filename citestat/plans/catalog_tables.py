"""Queries of filters, joins, census and table operators (P, J, W, A31-A35, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citestat import sources
from citestat.functions import text as X
from citestat.operators import census, counts, selection, tables
from citestat.plans.catalog_counts import WITH_ART
from citestat.plans.catalog_text import extract_sql
from citestat.plans.domain import articles, citations
from citestat.plans.registry import register, rounded, rounded_sql
from citestat.session import scratch_path, spread
from citestat.sources import read_table

# ---- journals made from suppliers: ISSNs, discipline, country, venue ids ----------------

JOURNAL_FIELDS = {
    "internal_id": "s_suppkey + 1",
    "title": "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'Journal ' || (s_suppkey % 37) END",
    "issn": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE lpad('' || s_suppkey, 4, '0') || '-0001' END",
    "e_issn": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lpad('' || (s_suppkey % 50), 4, '0') || '-0002' END",
    "discipline": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'D' || (s_suppkey % 6) END",
    "country": "n_name",
    "keywords": "CASE WHEN s_suppkey % 2 = 0 THEN 'literature, language' WHEN s_suppkey % 3 = 0 THEN 'quality' ELSE 'law' END",
}
JOURNALS_SQL = f"""j AS (SELECT {', '.join(f'{e} AS {n}' for n, e in JOURNAL_FIELDS.items())}
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
# stored answers of the id service: ISSNs with an even journal number have one or two venue ids
RESPONSES_SQL = """resp AS (SELECT issn, min(internal_id) AS num FROM (
 SELECT issn, internal_id FROM j WHERE issn IS NOT NULL UNION ALL SELECT e_issn, internal_id FROM j WHERE e_issn IS NOT NULL) GROUP BY 1),
 om AS (SELECT issn, num, CASE WHEN num % 2 = 0 THEN CASE WHEN num % 3 = 0
   THEN ['br/0' || (num % 40), 'br/9' || num] ELSE ['br/0' || (num % 40)] END END AS omids FROM resp)"""


def journals(spark, sf):
    nation = read_table(spark, sf, "nation")
    supplier = read_table(spark, sf, "supplier")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        *[F.expr(e).alias(n) for n, e in JOURNAL_FIELDS.items()]
    )


def issn_omid(spark, sf):
    j = journals(spark, sf)
    numbers = (
        j.select("internal_id", F.explode(F.array("issn", "e_issn")).alias("issn"))
        .filter("issn IS NOT NULL").groupBy("issn").agg(F.min("internal_id").alias("num"))
    )
    first = F.concat(F.lit("br/0"), F.col("num") % 40)
    second = F.concat(F.lit("br/9"), F.col("num"))
    return numbers.select(
        "issn", "num",
        F.when(F.col("num") % 2 == 0, F.when(F.col("num") % 3 == 0, F.array(first, second)).otherwise(F.array(first))).alias("omids"),
    )


# ---- sources ----------------------------------------------------------------------------


@register("S1_journal_list", f"WITH {JOURNALS_SQL} SELECT * FROM j")
def journal_list(spark, sf):
    """Journals written as CSV and read back with their schema."""
    path = scratch_path(spark, "journals")
    sources.write_result(journals(spark, sf), path)
    return sources.read_journals(spark, path)


DUMP_FIELDS = {
    "id": "'omid:br/06' || p_partkey || ' doi:10.5/' || p_partkey",
    "title": "p_name", "author": "p_brand", "pub_date": "'' || (2000 + p_size)",
    "venue": "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type || CASE WHEN p_partkey % 4 = 0 THEN ' Online' ELSE '' END || ' [omid:br/07' || p_size || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' issn:1234-' || lpad('' || p_size, 4, '0') END || ']' END",
    "volume": "'' || (p_size % 4)", "issue": "CAST(NULL AS STRING)", "page": "'1-' || p_size",
    "type": "CASE WHEN p_size % 2 = 0 THEN 'journal article' ELSE 'book chapter' END",
    "publisher": "p_brand || ' [crossref:' || p_size || ']'", "editor": "CAST(NULL AS STRING)",
}
DUMP_SQL = f"dump AS (SELECT {', '.join(f'{e} AS {n}' for n, e in DUMP_FIELDS.items())}, p_brand AS file FROM part)".replace("STRING", "VARCHAR")


def dump_rows(spark, sf):
    part = read_table(spark, sf, "part")
    return part.select(*[F.expr(e).alias(n) for n, e in DUMP_FIELDS.items()], F.col("p_brand").alias("file"))


@register(
    "S2_metadata_dump",
    f"WITH {DUMP_SQL} SELECT id, title, venue, issue, page, publisher FROM dump",
)
def metadata_dump(spark, sf):
    """A dump of many CSV files with a name prefix; other files in the folder are ignored."""
    path = scratch_path(spark, "dump")
    dump_rows(spark, sf).drop("file").write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    citations(spark, sf).select("citing").write.json(f"{path}/other")
    return sources.read_metadata_dump(spark, path, "part").select("id", "title", "venue", "issue", "page", "publisher")


@register(
    "S3_citation_index",
    "SELECT 'oci:' || l_partkey || '-' || l_orderkey AS id, 'omid:br/' || l_partkey AS citing, 'omid:br/' || l_orderkey AS cited FROM lineitem",
)
def citation_index(spark, sf):
    """Citations written to a tree of folders and read recursively."""
    path = scratch_path(spark, "index")
    rows = citations(spark, sf).select(
        F.concat_ws("-", F.concat(F.lit("oci:"), F.col("citing")), "cited").alias("id"),
        F.concat(F.lit("omid:br/"), F.col("citing")).alias("citing"),
        F.concat(F.lit("omid:br/"), F.col("cited")).alias("cited"), "in_a",
    )
    rows.write.partitionBy("in_a").option("header", True).csv(path)
    return sources.read_citation_index(spark, path)


@register("S4_rows_per_source_file", "SELECT 'part.parquet' AS file, count(*)::BIGINT AS n FROM part")
def rows_per_file(spark, sf):
    return (
        read_table(spark, sf, "part").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
        .groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    )


def document_lines(spark, sf):
    """Documents with the list of their lines; even lines are references, odd ones a second reading."""
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.split("text", "\n").alias("lines"))


LINES_SQL = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"""


def harvested_records(spark, sf):
    """Documents as nested article records; the references come from the record itself."""
    n = F.col("doc_id")
    key = n.cast("string")
    numbered = F.transform("lines", lambda t, i: F.struct(F.concat(F.lit("R"), i).alias("ref_id"), t.alias("citation")))
    return document_lines(spark, sf).select(
        F.concat(F.lit("oai:"), key).alias("identifier"), F.concat(F.lit("p"), key).alias("publisher_id"),
        F.when(n % 3 != 0, F.concat(F.lit("10.7/C"), key)).alias("doi"),
        F.concat(F.lit("Journal of "), n % 7).alias("journal_title"),
        F.concat(F.lit("Article "), key).alias("article_title"),
        (F.lit(1990) + n % 30).cast("string").alias("year"),
        F.when(n % 2 == 0, n % 5).cast("string").alias("issue"),
        F.when(n % 4 != 0, n).cast("string").alias("fpage"),
        F.when(n % 8 < 6, n + 9).cast("string").alias("lpage"),
        F.lit(None).cast("string").alias("abstract"), F.array(F.lit("kw"), key).alias("keywords"),
        F.array(
            F.struct(
                F.concat(F.lit("S"), key).alias("surname"), F.concat(F.lit("G"), key).alias("given_names"),
                F.concat(F.lit("G"), key, F.lit(" S"), key).alias("full_name"),
                F.when(n % 2 == 0, F.concat(F.lit("https://orcid.org/0000-"), key)).alias("orcid"),
            )
        ).alias("authors"),
        F.transform(F.sequence(F.lit(1), (n % 3 + 1).cast("int")),
                    lambda i: F.concat(F.lit("https://x.org/view/"), key, F.lit("/"), F.lit(100) - i)).alias("pdf_urls"),
        F.array(F.concat(F.lit("https://x.org/a/"), key)).alias("article_urls"),
        numbered.alias("references"),
    )


@register(
    "S5_nested_records",
    f"""SELECT 'oai:' || doc_id AS identifier, (1990 + doc_id % 30)::VARCHAR AS year, count(*)::BIGINT AS n_references,
    md5(string_agg(line, '|' ORDER BY i)) AS citations FROM {LINES_SQL} GROUP BY doc_id""",
)
def nested_records(spark, sf):
    """Nested article records written as JSON lines and read back with the nested schema."""
    path = scratch_path(spark, "harvested")
    sources.write_result(harvested_records(spark, sf), path, fmt="json")
    return sources.read_harvested(spark, path).select(
        "identifier", "year", F.size("references").cast("bigint").alias("n_references"),
        F.md5(F.array_join(F.transform("references", lambda r: r["citation"]), "|")).alias("citations"),
    )


@register("S6_required_columns", "SELECT count(*)::BIGINT AS n FROM orders")
def required_columns(spark, sf):
    orders = sources.require_columns(read_table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"], "orders")
    return orders.agg(F.count(F.lit(1)).alias("n"))


@register(
    "S7_xml_records",
    "SELECT item_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS text FROM benchmark",
)
def xml_records(spark, sf):
    """Records written as XML and read back by row tag."""
    path = scratch_path(spark, "xml")
    read_table(spark, sf, "benchmark").write.format("xml").option("rowTag", "record").option("rootTag", "records").save(path)
    rows = sources.read_xml_records(spark, path, "record", "item_id bigint, text string")
    return rows.select("item_id", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))


@register(
    "S8_written_results",
    f"""{WITH_ART} SELECT '' || article_omid AS article_omid, coalesce(venue_name, '') AS venue_name,
    coalesce('' || venue_internal_id, '') AS venue_internal_id FROM art""",
)
def written_results(spark, sf):
    """A result table written as CSV (missing = '') and read back as text."""
    path = scratch_path(spark, "result")
    columns = ["article_omid", "venue_name", "venue_internal_id"]
    sources.write_result(articles(spark, sf), path, columns)
    schema = ", ".join(f"{c} string" for c in columns)
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


# ---- projections and filters ------------------------------------------------------------


@register(
    "P1_canonical_columns",
    """SELECT o_orderkey AS article_id, o_custkey AS venue_internal_id, o_orderpriority AS venue_name,
    coalesce(o_totalprice, 0) AS citedby_count FROM orders""",
)
def canonical_columns(spark, sf):
    layout = {
        "article_id": "o_orderkey", "venue_internal_id": "o_custkey", "venue_name": "o_orderpriority",
        "citedby_count": "o_totalprice",
    }
    return selection.select_renamed(read_table(spark, sf, "orders"), layout, ["citedby_count"])


@register(
    "P2_numeric_coercion",
    """SELECT event_id, coalesce(try_cast(CASE WHEN event_type = 'error' THEN event_type ELSE '' || value END AS DOUBLE), 0.0) AS value FROM events""",
)
def numeric_coercion(spark, sf):
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("value").cast("string"))
    return read_table(spark, sf, "events").select("event_id", X.number_or_zero(raw).alias("value"))


@register(
    "P3_country_and_keyword",
    f"WITH {JOURNALS_SQL} SELECT internal_id, title FROM j WHERE country = 'NATION_7' AND keywords LIKE '%lit%'",
)
def country_and_keyword(spark, sf):
    out = selection.country_and_keyword(journals(spark, sf), "country", "NATION_7", "keywords", "lit")
    return out.select("internal_id", "title")


# venue ids of the dump are br/07<size>; the wanted ones are those of small sizes
WANTED_SQL = "SELECT DISTINCT 'br/07' || n_nationkey AS venue_omid FROM nation"


@register(
    "P4_venue_filter",
    f"""WITH {DUMP_SQL}, w AS ({WANTED_SQL}),
    d AS (SELECT *, {extract_sql('venue', 'omid:(br/[0-9]+)')} AS venue_omid FROM dump)
    SELECT id, venue_omid FROM d WHERE venue_omid IN (SELECT venue_omid FROM w)""",
)
def venue_filter(spark, sf):
    wanted = read_table(spark, sf, "nation").select(F.concat(F.lit("br/07"), F.col("n_nationkey")).alias("venue_omid"))
    return selection.rows_of_venues(dump_rows(spark, sf), wanted).select("id", "venue_omid")


@register(
    "P5_curated_pairs",
    f"""{WITH_ART}, cur AS (SELECT venue_name, o_orderpriority, count(*) AS n FROM art GROUP BY ALL)
    SELECT article_omid, venue_name, o_orderpriority AS publisher_name FROM art
    WHERE (venue_name, o_orderpriority) IN (SELECT (venue_name, o_orderpriority) FROM cur WHERE n % 2 = 0)""",
)
def curated_pairs(spark, sf):
    a = articles(spark, sf).withColumn("publisher", F.concat(F.col("o_orderpriority"), F.lit(" [crossref:1]")))
    curated = counts.venue_publisher_counts(a).select(
        F.concat(F.lit(" "), F.col("journal")).alias("journal"), "publisher", "count",
        F.when(F.col("count") % 2 == 1, "x").alias("false_info"),
    )
    tagged = a.withColumn("publisher_name", X.venue_name("publisher"))
    return selection.allowed_pairs(tagged, curated).select("article_omid", "venue_name", "publisher_name")


@register(
    "P6_cited_in_set",
    "SELECT l_partkey AS citing, l_orderkey AS cited FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
)
def cited_in_set(spark, sf):
    ours = read_table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return selection.cited_in(citations(spark, sf), ours, "cited", "o_orderkey").select("citing", "cited")


@register(
    "P7_self_citations",
    """SELECT CASE WHEN l_partkey = l_orderkey THEN 'self' ELSE 'kept' END AS part, count(*)::BIGINT AS n,
    sum(l_partkey)::BIGINT AS checksum FROM lineitem GROUP BY 1""",
)
def self_citations(spark, sf):
    kept, own = selection.split_self_citations(citations(spark, sf))
    return tables.union_all(
        *[
            df.agg(F.count(F.lit(1)).alias("n"), F.sum("citing").alias("checksum")).select(F.lit(k).alias("part"), "n", "checksum")
            for k, df in (("kept", kept), ("self", own))
        ]
    )


# records with list columns: one per document source
CODES_SQL = "CASE lang WHEN 'en' THEN 'pol' WHEN 'fr' THEN 'pl_PL' ELSE lang END"


def language_records(spark, sf):
    """Documents grouped by source and length class, with the list of their languages."""
    lang = F.expr(CODES_SQL)
    return read_table(spark, sf, "documents").groupBy(F.col("n_chars").alias("record")).agg(
        F.array_sort(F.collect_set(lang)).alias("language"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("doc_id").alias("first_doc"),
    )


RECORDS_SQL = f"rec AS (SELECT n_chars AS record, list_sort(list(DISTINCT {CODES_SQL})) AS language, list_sort(list(DISTINCT source)) AS sources, min(doc_id) AS first_doc FROM documents GROUP BY 1)"


@register(
    "P8_language_filter",
    f"""WITH {RECORDS_SQL} SELECT 'journals' AS repository, record FROM rec WHERE list_has_any(language, {X.POLISH_CODES_JOURNALS})
    UNION ALL SELECT 'library', record FROM rec WHERE list_has_any(language, {X.POLISH_CODES_LIBRARY})""",
)
def language_filter(spark, sf):
    r = language_records(spark, sf)
    parts = [
        selection.in_languages(r, "language", codes).select(F.lit(name).alias("repository"), "record")
        for name, codes in (("journals", X.POLISH_CODES_JOURNALS), ("library", X.POLISH_CODES_LIBRARY))
    ]
    return tables.union_all(*parts)


@register(
    "P9_year_floor",
    "SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) >= 2000",
)
def year_floor(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("year"))
    return selection.since_year(o, "year", 2000)


@register("P10_any_element_contains", f"WITH {RECORDS_SQL} SELECT record FROM rec WHERE len(list_filter(sources, lambda s: contains(s, 'c1'))) > 0")
def any_element(spark, sf):
    return selection.with_any_element(language_records(spark, sf), "sources", "c1").select("record")


@register("P11_array_size", f"WITH {RECORDS_SQL} SELECT record, len(sources)::BIGINT AS n FROM rec WHERE len(sources) >= 2")
def array_size(spark, sf):
    out = selection.with_at_least(language_records(spark, sf), "sources", 2)
    return out.select("record", F.size("sources").cast("bigint").alias("n"))


@register("P12_first_matching_element", f"WITH {RECORDS_SQL} SELECT record, list_filter(sources, lambda s: contains(s, 'c1'))[1] AS hit FROM rec")
def first_matching(spark, sf):
    return language_records(spark, sf).select("record", X.first_containing("sources", "c1").alias("hit"))


@register(
    "P13_overlapping_keys",
    f"WITH {RECORDS_SQL} SELECT record FROM rec WHERE list_has_any(sources, (SELECT list('src' || n_nationkey) FROM nation WHERE n_regionkey = 1))",
)
def overlapping(spark, sf):
    keys = read_table(spark, sf, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("key"))
    return selection.overlapping_keys(language_records(spark, sf), "record", "sources", keys, "key").select("record")


@register("P14_manual_accept", "SELECT doc_id FROM labels WHERE quality = 1")
def manual_accept(spark, sf):
    marked = read_table(spark, sf, "labels").withColumn(
        "the same", F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, " X ").otherwise("x")).otherwise("no")
    )
    return selection.manually_accepted(marked).select("doc_id")


@register(
    "P18_journal_category",
    f"""{WITH_ART}, t AS (SELECT venue_internal_id, sum(citedby_count) AS c FROM art GROUP BY 1)
    SELECT n_nationkey::BIGINT AS venue_internal_id, CASE WHEN venue_internal_id IS NULL THEN 'no data in OpenCitations'
      WHEN coalesce(c, 0) = 0 THEN 'in OpenCitations but 0 citations' ELSE 'cited in OpenCitations' END AS category
    FROM nation LEFT JOIN t ON n_nationkey = venue_internal_id""",
)
def category(spark, sf):
    totals = counts.venue_totals(articles(spark, sf))
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("venue_internal_id"))
    both = n.join(totals.withColumn("hit", F.lit(True)), "venue_internal_id", "left")
    return both.select(
        "venue_internal_id",
        selection.journal_category(F.col("hit").isNotNull(), F.coalesce("oc_citations_counted", F.lit(0))).alias("category"),
    )


@register(
    "P19_more_in_first",
    f"""{WITH_ART} SELECT article_omid, coalesce(citedby_count, -1) > coalesce(citedby_count_b, -1) AS oc_more_citations FROM art""",
)
def more_in_first(spark, sf):
    return articles(spark, sf).select(
        "article_omid", selection.more_in_first("citedby_count", "citedby_count_b").alias("oc_more_citations")
    )


def journals_with_ids(spark, sf):
    ids = issn_omid(spark, sf)
    out = tables.lookup(journals(spark, sf), "issn", ids, "issn", "omids", "omids_issn")
    return tables.lookup(out, "e_issn", ids, "issn", "omids", "omids_eissn")


JOURNAL_IDS_SQL = f"""{JOURNALS_SQL}, {RESPONSES_SQL},
ji AS (SELECT j.*, a.omids AS omids_issn, b.omids AS omids_eissn FROM j LEFT JOIN om a ON a.issn = j.issn LEFT JOIN om b ON b.issn = j.e_issn)"""


@register(
    "P20_presence_flag",
    f"""WITH {JOURNAL_IDS_SQL}, f AS (SELECT internal_id, omids_issn[1] AS a, omids_eissn[1] AS b, omids_issn, omids_eissn FROM ji)
    SELECT internal_id, array_to_string(list_sort(list_distinct(coalesce(omids_issn, []) || coalesce(omids_eissn, []))), ',') AS omids,
    (omids_issn IS NOT NULL OR omids_eissn IS NOT NULL) AS in_index, coalesce(a, b) AS omid, a = b AS omids_identical FROM f""",
)
def presence(spark, sf):
    j = journals_with_ids(spark, sf)
    j = j.withColumn("omids", selection.merged_omids("omids_issn", "omids_eissn"))
    single = selection.preferred_omid(
        j.withColumns({k: F.try_element_at(f"omids_{v}", F.lit(1)) for k, v in (("omid_issn", "issn"), ("omid_eissn", "eissn"))})
    )
    return single.select(
        "internal_id", F.coalesce(F.array_join("omids", ","), F.lit("")).alias("omids"),
        selection.presence("omids").alias("in_index"), "omid", "omids_identical",
    )


@register(
    "P23_zero_cited_journals",
    f"""WITH {JOURNAL_IDS_SQL}, r AS (SELECT issn, num % 3 AS c FROM om)
    SELECT count(*)::BIGINT AS n_journals, sum(CASE WHEN c = 0 THEN 1 ELSE 0 END)::BIGINT AS n_zero_cited
    FROM r WHERE issn IN (SELECT coalesce(issn, e_issn) FROM j WHERE coalesce(issn, e_issn) IS NOT NULL)""",
)
def zero_cited(spark, sf):
    responses = issn_omid(spark, sf).select("issn", (F.col("num") % 3).alias("citation_count"))
    return selection.zero_cited_journals(journals(spark, sf), responses)


# ---- joins ------------------------------------------------------------------------------


@register(
    "J6_validated_left_join",
    "SELECT o_orderkey, o_orderpriority, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def validated_join(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_orderkey")).alias("key"), "o_orderkey", "o_orderpriority")
    sizes = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return tables.validated_left_join(orders, sizes, ["key"]).drop("key")


@register(
    "J7_dimension_lookup",
    "SELECT s_suppkey, n_name AS country FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2",
)
def dimension_lookup(spark, sf):
    nation = read_table(spark, sf, "nation").filter("n_regionkey <> 2")
    out = tables.lookup(read_table(spark, sf, "supplier"), "s_nationkey", nation, "n_nationkey", "n_name", "country")
    return out.select("s_suppkey", "country")


@register(
    "J8_lookup_with_fallback",
    f"""WITH {JOURNAL_IDS_SQL}, c AS (SELECT issn, CASE WHEN num % 5 = 0 THEN NULL ELSE num END AS n FROM om WHERE num % 3 <> 0)
    SELECT internal_id, CASE WHEN a.issn IS NOT NULL THEN a.n WHEN b.issn IS NOT NULL THEN b.n ELSE 0 END AS citations
    FROM j LEFT JOIN c a ON a.issn = j.issn LEFT JOIN c b ON b.issn = j.e_issn""",
)
def fallback_lookup(spark, sf):
    table = issn_omid(spark, sf).filter("num % 3 <> 0").select("issn", F.when(F.col("num") % 5 != 0, F.col("num")).alias("n"))
    out = tables.lookup_with_fallback(journals(spark, sf), "issn", "e_issn", table, "issn", "n", "citations", F.lit(0))
    return out.select("internal_id", "citations")


@register(
    "J9_inverted_lookup",
    f"""WITH {JOURNALS_SQL}, {RESPONSES_SQL} SELECT o AS venue_omid, string_agg(issn, ',' ORDER BY issn) AS issns
    FROM (SELECT issn, unnest(omids) AS o FROM om) GROUP BY 1""",
)
def inverted_lookup(spark, sf):
    return counts.issns_of_omids(issn_omid(spark, sf)).select("venue_omid", F.array_join("issns", ",").alias("issns"))


@register(
    "J7_last_wins_titles",
    f"""WITH {JOURNAL_IDS_SQL}, f AS (SELECT internal_id, title, unnest(list_distinct(coalesce(omids_issn, []) || coalesce(omids_eissn, []))) AS o FROM ji)
    SELECT o AS venue_omid, arg_max_null(title, internal_id) AS title FROM f GROUP BY 1""",
)
def last_wins(spark, sf):
    j = journals_with_ids(spark, sf).withColumn("omids", selection.merged_omids("omids_issn", "omids_eissn"))
    return counts.omid_titles(j)


@register(
    "J8_issn_to_journal",
    f"""WITH {JOURNALS_SQL}, e AS (SELECT issn, 0 AS w, internal_id FROM j UNION ALL SELECT e_issn, 1, internal_id FROM j)
    SELECT issn, arg_max(internal_id, (w, internal_id)) AS internal_id FROM e WHERE issn IS NOT NULL GROUP BY 1""",
)
def issn_map(spark, sf):
    return counts.issn_to_internal_id(journals(spark, sf))


@register(
    "J11_mapping_application",
    """SELECT l_orderkey, l_linenumber, min(coalesce(CASE WHEN p_size > 25 THEN p_size::BIGINT END, l_partkey)) AS l_partkey
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def mapping_application(spark, sf):
    mapping = read_table(spark, sf, "part").filter("p_size > 25").select("p_partkey", F.col("p_size").cast("bigint").alias("canonical"))
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = tables.apply_mapping(rows, "l_partkey", mapping, "p_partkey", "canonical")
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


@register(
    "J12_url_to_file",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id || '.pdf' END AS pdf_name FROM pages",
)
def url_to_file(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", F.concat(F.col("url"), F.lit("#"), F.col("page_id")).alias("url"))
    files = pages.filter("page_id % 3 <> 0").select("url", F.concat(F.col("page_id"), F.lit(".pdf")).alias("pdf"))
    return tables.lookup(pages, "url", files, "url", "pdf", "pdf_name").select("page_id", "pdf_name")


# ---- dedup, windows, ordering -----------------------------------------------------------


@register("W1_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def distinct_rows(spark, sf):
    return read_table(spark, sf, "documents").select("text", "lang").distinct()


@register(
    "W2_duplicate_report",
    "SELECT md5(text) AS text, lang FROM documents WHERE (text, lang) IN (SELECT (text, lang) FROM documents GROUP BY text, lang HAVING count(*) > 1)",
)
def duplicate_report(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.md5("text").alias("text"), "lang")
    return tables.duplicate_report(docs)


@register(
    "W3_keep_first_twice",
    """WITH a AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS r FROM lineitem),
    b AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r FROM a WHERE r = 1)
    SELECT l_partkey, l_suppkey FROM b WHERE r = 1""",
)
def keep_first_twice(spark, sf):
    pairs = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return tables.one_to_one(pairs, "l_partkey", "l_suppkey", ["l_partkey", "l_suppkey"])


@register(
    "W5_keep_first_by_id",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1",
)
def keep_first_by_id(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return tables.keep_first(orders, ["o_custkey"], ["o_orderkey"])


@register("W6_distinct_pairs", "SELECT DISTINCT l_partkey AS citing, l_suppkey AS cited FROM lineitem")
def distinct_pairs(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited"))
    return tables.distinct_pairs(rows, "citing", "cited")


@register(
    "W11_union_of_sources",
    """SELECT c_custkey AS key, c_mktsegment AS segment, NULL::VARCHAR AS supplier FROM customer
    UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""",
)
def union_of_sources(spark, sf):
    a = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("supplier"))
    return tables.union_all(a, b)


@register(
    "W12_surrogate_ids",
    "SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS internal_id FROM supplier",
)
def surrogate_ids(spark, sf):
    rows = read_table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return tables.number_rows(rows, ["s_name", "s_suppkey"]).select("s_suppkey", "internal_id")


@register(
    "W14_distinct_issns",
    f"WITH {JOURNALS_SQL} SELECT DISTINCT issn FROM (SELECT issn FROM j UNION ALL SELECT e_issn FROM j) WHERE issn IS NOT NULL",
)
def distinct_issns(spark, sf):
    return tables.distinct_values(journals(spark, sf), ["issn", "e_issn"], "issn")


# ---- census -----------------------------------------------------------------------------


@register(
    "A31_first_non_null",
    f"""WITH {JOURNALS_SQL} SELECT country, arg_min(issn, internal_id) FILTER (WHERE issn IS NOT NULL) AS issn,
    arg_min(discipline, internal_id) FILTER (WHERE discipline IS NOT NULL) AS discipline FROM j GROUP BY 1""",
)
def first_non_null(spark, sf):
    return tables.first_non_null(journals(spark, sf), ["country"], "internal_id", ["issn", "discipline"])


@register(
    "A32_joined_disciplines",
    f"""WITH {JOURNALS_SQL} SELECT title, min(internal_id) AS internal_id,
    arg_min(issn, internal_id) FILTER (WHERE issn IS NOT NULL) AS issn,
    coalesce(string_agg(DISTINCT discipline, '|' ORDER BY discipline), '') AS discipline FROM j GROUP BY 1""",
)
def joined_disciplines(spark, sf):
    out = census.reduce_titles(journals(spark, sf), "internal_id", columns=["title", "discipline", "internal_id", "issn"])
    return out.select("title", "internal_id", "issn", "discipline")


CENSUS_SQL = f"""{DUMP_SQL},
vr AS (SELECT file, trim(string_split(venue, '[')[1]) AS venue_name, trim(substr(venue, strpos(venue, '['))) AS venue_ids, type,
       {extract_sql('venue', 'issn:(.{4}-.{4})')} AS issn FROM dump WHERE venue LIKE '%issn%'),
vv AS (SELECT file, issn, venue_name, venue_ids, type, count(*) AS n_rows FROM vr GROUP BY ALL),
vt AS (SELECT *, sum(n_rows) OVER (PARTITION BY file, issn) AS issn_count FROM vv),
cs AS (SELECT issn, arg_min(venue_name, (file, venue_name, venue_ids, type)) AS venue_name,
       arg_min(venue_ids, (file, venue_name, venue_ids, type)) AS venue_ids, arg_min(type, (file, venue_name, venue_ids, type)) AS type,
       sum(n_rows)::BIGINT AS issn_count, sum(issn_count)::BIGINT AS issn_count_legacy FROM vt GROUP BY 1)"""


@register("A33_issn_census", f"WITH {CENSUS_SQL} SELECT * FROM cs")
def issn_census(spark, sf):
    return census.issn_census(dump_rows(spark, sf))


@register(
    "A34_country_size",
    f"""WITH {CENSUS_SQL}, ic AS (SELECT issn, CASE WHEN substr(issn, 9, 1) = '7' THEN NULL ELSE 'Country ' || substr(issn, 8, 1) END AS country FROM cs),
    sz AS (SELECT country AS c, count(*)::BIGINT AS country_counter FROM ic GROUP BY 1)
    SELECT cs.issn, country, country_counter FROM cs LEFT JOIN ic ON ic.issn = cs.issn LEFT JOIN sz ON c IS NOT DISTINCT FROM country""",
)
def country_size(spark, sf):
    cs = census.issn_census(dump_rows(spark, sf))
    countries = cs.select(
        "issn", F.when(F.substring("issn", 9, 1) != "7", F.concat(F.lit("Country "), F.substring("issn", 8, 1))).alias("country")
    )
    return census.attach_country(cs, countries).select("issn", "country", "country_counter")


@register(
    "A35_value_counts",
    rounded_sql(
        f"WITH {JOURNALS_SQL} SELECT discipline, count(*)::BIGINT AS n, count(*) / (SELECT count(*) FROM j) AS share FROM j GROUP BY 1",
        ["share"],
    ),
)
def value_counts(spark, sf):
    return rounded(tables.value_counts(journals(spark, sf), "discipline"))
