"""The driver's tables read as bibliographic tables, in Spark and in SQL.

orders are articles, the nation of the customer is the venue, line items are citations of
the order by a part. Line items not returned as 'A' are in the first (open) index, those
not returned as 'R' in the second. The order status says which source holds the article,
the order priority how it was matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citestat.operators.selection import status_flags
from citestat.sources import read_table

STATUS = {"F": "both", "O": "open_citations_only", "P": "scopus_only"}
METHOD = {
    "1-URGENT": "doi_exact", "2-HIGH": "title_exact_year", "3-MEDIUM": "doi_exact",
    "4-NOT SPECIFIED": "title_fuzzy_year_auto", "5-LOW": "manual_confirmed",
}


def case(column: str, choices: dict[str, str]) -> Column:
    out = None
    for value, choice in choices.items():
        cond = F.col(column) == value
        out = F.when(cond, choice) if out is None else out.when(cond, choice)
    return out


def case_sql(column: str, choices: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items()) + " END"


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """(citing, cited, in_a, in_b): a part cites an order."""
    return read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("citing"), F.col("l_orderkey").alias("cited"),
        (F.col("l_returnflag") != "A").alias("in_a"), (F.col("l_returnflag") != "R").alias("in_b"),
    )


def venues(spark: SparkSession, sf: str) -> DataFrame:
    """(custkey, venue_internal_id, venue_name): nation 24 has no id, one segment another spelling."""
    nation = read_table(spark, sf, "nation")
    customer = read_table(spark, sf, "customer")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("custkey"),
        F.when(F.col("n_nationkey") != 24, F.col("n_nationkey")).cast("bigint").alias("venue_internal_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lower("n_name")).otherwise(F.col("n_name")).alias("venue_name"),
    )


def citation_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of every cited article in both indexes, one pass; NULL where an index has none."""
    return (
        citations(spark, sf).groupBy("cited")
        .agg(
            F.nullif(F.count_if("in_a"), F.lit(0)).alias("count_a"),
            F.nullif(F.count_if("in_b"), F.lit(0)).alias("count_b"),
        )
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """All articles: article_omid (order key), venue, year, and citation counts of both indexes."""
    orders = read_table(spark, sf, "orders")
    return (
        orders.join(venues(spark, sf), F.col("o_custkey") == F.col("custkey"))
        .join(citation_totals(spark, sf), F.col("o_orderkey") == F.col("cited"), "left")
        .select(
            F.col("o_orderkey").alias("article_omid"), "venue_internal_id", "venue_name",
            F.year("o_orderdate").cast("bigint").alias("year"), "o_orderstatus", "o_orderpriority",
            F.col("count_a").alias("citedby_count"), F.col("count_b").alias("citedby_count_b"),
        )
    )


ARTICLES_SQL = """
tot AS (
  SELECT l_orderkey, nullif(sum(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END), 0)::BIGINT AS count_a,
         nullif(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS count_b
  FROM lineitem GROUP BY l_orderkey
),
art AS (
  SELECT o_orderkey AS article_omid,
         CASE WHEN c_nationkey = 24 THEN NULL ELSE c_nationkey::BIGINT END AS venue_internal_id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN lower(n_name) ELSE n_name END AS venue_name,
         year(o_orderdate)::BIGINT AS year, o_orderstatus, o_orderpriority,
         count_a AS citedby_count, count_b AS citedby_count_b
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN tot ON l_orderkey = o_orderkey
)"""


def master(spark: SparkSession, sf: str) -> DataFrame:
    """Linked article table with status flags, as the comparison operators expect it."""
    a = articles(spark, sf)
    status = case("o_orderstatus", STATUS)
    in_a, in_b = status != "scopus_only", status != "open_citations_only"
    key = F.col("article_omid").cast("string")
    doi = F.when(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM", "5-LOW"), F.concat(F.lit("10.1/"), key))
    rows = a.select(
        F.when(in_a, F.concat(F.lit("br/"), key)).alias("article_id_oc"),
        F.when(in_b, F.concat(F.lit("2-s2.0-"), key)).alias("article_id_scopus"),
        "venue_internal_id",
        F.when(in_a, F.col("venue_name")).alias("venue_name_oc"),
        F.when(in_b, F.col("venue_name")).alias("venue_name_scopus"),
        "venue_name",
        F.concat(F.lit("Article "), key).alias("title_preferred"),
        F.col("year").alias("year_preferred"),
        F.when(in_a, F.col("year")).alias("year_oc"),
        F.when(in_b, F.col("year")).alias("year_sc"),
        doi.alias("doi_norm"),
        status.alias("source_status"),
        F.when(status == "both", case("o_orderpriority", METHOD))
        .when(status == "scopus_only", "scopus_only").otherwise("oc_only").alias("match_method"),
        F.when(in_a, F.coalesce("citedby_count", F.lit(0))).cast("double").alias("citedby_count_oc"),
        F.when(in_b, F.coalesce("citedby_count_b", F.lit(0))).cast("double").alias("citedby_count_scopus"),
    )
    return status_flags(rows)


MASTER_SQL = ARTICLES_SQL + f""",
m0 AS (SELECT *, {case_sql('o_orderstatus', STATUS)} AS source_status FROM art),
m AS (
  SELECT CASE WHEN source_status <> 'scopus_only' THEN 'br/' || article_omid END AS article_id_oc,
         CASE WHEN source_status <> 'open_citations_only' THEN '2-s2.0-' || article_omid END AS article_id_scopus,
         venue_internal_id, venue_name, 'Article ' || article_omid AS title_preferred, year AS year_preferred,
         CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN '10.1/' || article_omid END AS doi_norm,
         source_status,
         CASE WHEN source_status = 'both' THEN {case_sql('o_orderpriority', METHOD)}
              WHEN source_status = 'scopus_only' THEN 'scopus_only' ELSE 'oc_only' END AS match_method,
         CASE WHEN source_status <> 'scopus_only' THEN coalesce(citedby_count, 0) END::DOUBLE AS citedby_count_oc,
         CASE WHEN source_status <> 'open_citations_only' THEN coalesce(citedby_count_b, 0) END::DOUBLE
           AS citedby_count_scopus
  FROM m0
),
b AS (
  SELECT *, citedby_count_oc AS oc, citedby_count_scopus AS sc, citedby_count_scopus - citedby_count_oc AS d
  FROM m WHERE source_status = 'both'
),
nm AS (
  SELECT venue_internal_id AS nid, arg_min(venue_name, (-n, venue_name)) AS pname FROM (
    SELECT venue_internal_id, venue_name, count(*) AS n FROM m WHERE venue_internal_id IS NOT NULL GROUP BY ALL)
  GROUP BY 1
)"""


# ---- documents as two article sources ---------------------------------------------------
#
# The title is the whole text, the year follows from the first word, the DOI is a hash of
# the text that a third of the documents lack, the venue is the language. Which index holds a
# document follows from its source name.


def document_articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    doi = F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("10.5/"), F.md5("text")))
    first_word = F.length(F.split("text", " ")[0])
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"),
        (F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("bigint").alias("venue_internal_id"),
        F.col("lang").alias("venue"), F.col("text").alias("title"), doi.alias("doi"),
        (F.lit(2000) + F.least(first_word, F.lit(99))).cast("string").alias("pub_date"),
        F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 7).cast("string")).alias("citedby_count"),
        (F.col("source") < "src2").alias("in_a"), "n_chars",
    )


def articles_a(spark: SparkSession, sf: str) -> DataFrame:
    """Open-index layout of the documents of one group of sources."""
    return document_articles(spark, sf).filter("in_a").select(
        F.col("key").alias("article_omid"), "venue_internal_id", F.col("venue").alias("venue_name"), "title",
        "pub_date",
        F.concat_ws(" ", F.concat(F.lit("omid:br/"), "key"), F.concat(F.lit("doi:"), "doi")).alias("id"),
        "citedby_count",
    )


def articles_b(spark: SparkSession, sf: str) -> DataFrame:
    """Second-index layout of the documents of the other sources."""
    return document_articles(spark, sf).filter(~F.col("in_a")).select(
        F.col("key").alias("eid"), "venue_internal_id", F.upper("venue").alias("publication_name"), "title",
        F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"),
        F.col("pub_date").alias("cover_date"), "citedby_count",
    )


def linkage_sql(title_norm) -> str:
    """CTEs ``a`` and ``b``: both prepared sources; ``title_norm`` writes the title key."""
    return f"""
docs AS (
  SELECT lpad(doc_id::VARCHAR, 12, '0') AS key, ascii(lang) * 256 + ascii(substr(lang, 2, 1)) AS venue_internal_id,
         lang AS venue, text AS title,
         CASE WHEN n_chars % 3 <> 0 THEN '10.5/' || md5(text) END AS doi,
         2000 + least(length(string_split(text, ' ')[1]), 99) AS year,
         coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END, 0)::DOUBLE AS cites, source < 'src2' AS in_a, n_chars
  FROM documents),
a AS (SELECT key, venue_internal_id::BIGINT AS venue_internal_id, venue, title, {title_norm('title')} AS title_norm, doi,
      year::BIGINT AS year, cites, n_chars FROM docs WHERE in_a),
b AS (SELECT key, venue_internal_id::BIGINT AS venue_internal_id, upper(venue) AS venue, title, {title_norm('title')} AS title_norm, doi,
      year::BIGINT AS year, cites, n_chars FROM docs WHERE NOT in_a)"""
