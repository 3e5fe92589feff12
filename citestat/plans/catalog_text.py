"""Queries of the scalar functions (F1-F28) over whole texts and derived identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from citestat.functions import similarity as S, text as X
from citestat.plans.registry import register, rounded, rounded_sql
from citestat.sources import read_table

# RE2 spelling of the Unicode white space class
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean_sql(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{WS}', ' ', 'g')), '')"


def extract_sql(x: str, pattern: str, flags: str = "") -> str:
    extra = f", '{flags}'" if flags else ""
    return f"nullif(regexp_extract({x}, '{pattern}', 1{extra}), '')"


def year_sql(x: str) -> str:
    return extract_sql(x, r"(1[6-9]\d{2}|20\d{2}|21\d{2})")


def doi_sql(x: str) -> str:
    s = f"regexp_replace(lower({clean_sql(x)}), '^https?://(dx\\.)?doi\\.org/', '')"
    return f"nullif(trim(regexp_replace({s}, '^doi:\\s*', '')), '')"


def title_sql(x: str) -> str:
    s = f"replace(lower(strip_accents(lower({x}))), '&', ' and ')"
    return f"nullif(trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g')), '')"


@register("F1_clean_text", f"SELECT doc_id, md5({clean_sql('text')}) AS cleaned FROM documents")
def clean_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.md5(X.clean_text("text")).alias("cleaned"))


# five spellings of an identifier
DOI_FORMS = """CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.1/' || p_name WHEN 1 THEN 'http://dx.doi.org/10.2/' || p_type
 WHEN 2 THEN 'DOI: 10.3/' || p_brand WHEN 3 THEN '  ' END"""


@register(
    "F2_normalize_doi",
    f"SELECT p_partkey, {doi_sql('raw')} AS doi FROM (SELECT p_partkey, {DOI_FORMS} AS raw FROM part)",
)
def normalize_doi(spark, sf):
    raw = read_table(spark, sf, "part").select("p_partkey", F.expr(DOI_FORMS).alias("raw"))
    return raw.select("p_partkey", X.normalize_doi("raw").alias("doi"))


IDS = """'omid:br/06' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' DOI:10.5/' || p_brand || '/' || p_size END
 || ' openalex:W' || p_partkey || CASE WHEN p_size % 2 = 0 THEN ' omid:br/05' || p_size ELSE '' END"""


def _ids(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", F.expr(IDS).alias("id"))


@register("F3_extract_doi", f"SELECT p_partkey, {extract_sql('id', '(?i)doi:([^ ]+)')} AS doi FROM (SELECT p_partkey, {IDS} AS id FROM part)")
def extract_doi(spark, sf):
    return _ids(spark, sf).select("p_partkey", X.extract_doi("id").alias("doi"))


@register(
    "F4_extract_omid",
    f"""SELECT p_partkey, {extract_sql('id', 'omid:([^ ]+)')} AS omid,
    array_to_string(list_sort(list_transform(list_filter(string_split(id, ' '), lambda t: contains(t, 'omid:')),
      lambda t: replace(t, 'omid:', ''))), ',') AS omids
    FROM (SELECT p_partkey, {IDS} AS id FROM part)""",
)
def extract_omid(spark, sf):
    return _ids(spark, sf).select(
        "p_partkey", X.extract_omid("id").alias("omid"), F.array_join(X.extract_omids("id"), ",").alias("omids")
    )


@register("F5_normalize_title", f"SELECT doc_id, md5({title_sql('text')}) AS title_norm FROM documents")
def normalize_title(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.md5(X.normalize_title("text")).alias("title_norm"))


@register("F6_extract_year", f"SELECT doc_id, {year_sql('text')} AS year FROM documents")
def extract_year(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", X.extract_year("text").alias("year"))


DATE_FORMS = """CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM')
 WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE 'in print' END"""


@register(
    "F7_safe_year",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN year(o_orderdate)::BIGINT END AS year FROM orders",
)
def safe_year(spark, sf):
    dates = read_table(spark, sf, "orders").select("o_orderkey", F.expr(DATE_FORMS).alias("d"))
    return dates.select("o_orderkey", X.safe_year("d").cast("bigint").alias("year"))


@register(
    "F8_pick_date",
    "SELECT o_custkey, min(year(o_orderdate))::BIGINT AS earliest_year FROM orders GROUP BY 1",
)
def pick_date(spark, sf):
    """Mixed date spellings of a customer's orders, collected per customer."""
    spelled = """CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy')
      WHEN 1 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") END"""
    dates = (
        read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.expr(spelled)).alias("dates"))
    )
    return dates.select("o_custkey", X.pick_date("dates").cast("bigint").alias("earliest_year"))


@register(
    "F9_stable_id",
    f"""SELECT p_partkey, coalesce('doi:' || {doi_sql('raw')}, 'temp:' || substr(md5(
      coalesce(nullif(concat_ws(' | ', {clean_sql('p_name')}, {clean_sql('p_brand')}, nullif(trim(CASE WHEN p_size > 25 THEN p_type ELSE ' ' END), '')), ''), 'empty')), 1, 16)) AS id
    FROM (SELECT *, {DOI_FORMS} AS raw FROM part)""",
)
def stable_id(spark, sf):
    part = read_table(spark, sf, "part").withColumn("raw", F.expr(DOI_FORMS))
    maybe = F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ")
    return part.select("p_partkey", X.stable_id("raw", "p_name", "p_brand", maybe).alias("id"))


VENUE = """CASE WHEN s_suppkey % 7 = 0 THEN '[issn:' || lpad(s_suppkey::VARCHAR, 4, '0') || '-123X]'
 ELSE s_name || ' [omid:br/06' || s_suppkey || ' issn:' || lpad(s_suppkey::VARCHAR, 4, '0') || '-' || lpad(s_nationkey::VARCHAR, 4, '0') || ']' END"""


def _venue_text(spark, sf):
    return read_table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", F.expr(VENUE.replace("VARCHAR", "STRING")).alias("venue")
    )


@register(
    "F10_venue_name_and_ids",
    f"""SELECT s_suppkey, trim(string_split(venue, '[')[1]) AS venue_name,
    trim(substr(venue, strpos(venue, '['))) AS venue_ids FROM (SELECT s_suppkey, {VENUE} AS venue FROM supplier)""",
)
def venue_parts(spark, sf):
    return _venue_text(spark, sf).select(
        "s_suppkey", X.venue_name("venue").alias("venue_name"), X.venue_ids("venue").alias("venue_ids")
    )


@register(
    "F11_extract_issn",
    f"SELECT s_suppkey, {extract_sql('venue', 'issn:(.{4}-.{4})')} AS issn FROM (SELECT s_suppkey, {VENUE} AS venue FROM supplier)",
)
def extract_issn(spark, sf):
    return _venue_text(spark, sf).select("s_suppkey", X.extract_issn("venue").alias("issn"))


@register(
    "F12_format_issn",
    """SELECT c_custkey, substr(d, 1, 4) || '-' || substr(d, 5) AS issn
    FROM (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS d FROM customer)""",
)
def format_issn(spark, sf):
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    return read_table(spark, sf, "customer").select("c_custkey", X.format_issn(digits).alias("issn"))


PAGES = {"f": "CASE WHEN l_linenumber > 1 THEN '' || l_linenumber ELSE ' ' END",
         "l": "CASE WHEN l_returnflag = 'N' THEN '' ELSE '' || (l_linenumber + 10) END"}


@register(
    "F13_page_range",
    f"""SELECT f || '|' || l AS given, CASE WHEN trim(f) = '' THEN NULL WHEN l = '' THEN f ELSE f || '-' || l END AS page, count(*)::BIGINT AS n
    FROM (SELECT {PAGES['f']} AS f, {PAGES['l']} AS l FROM lineitem) GROUP BY ALL""",
)
def page_range(spark, sf):
    pages = read_table(spark, sf, "lineitem").select(*[F.expr(e).alias(k) for k, e in PAGES.items()])
    return (
        pages.select(F.concat_ws("|", "f", "l").alias("given"), X.page_range("f", "l").alias("page"))
        .groupBy("given", "page").agg(F.count(F.lit(1)).alias("n"))
    )


AUTHOR_FIELDS = {
    "surname": "c_mktsegment",
    "given_names": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END",
    "full_name": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name || ' ' || c_mktsegment END",
    "orcid": "CASE WHEN c_custkey % 5 = 0 THEN 'https://orcid.org/0000-' || c_custkey || '/' END",
}


def _author_lists(spark, sf):
    """Three authors per customer record, made of the record's own fields."""
    person = F.struct(*[F.expr(e).alias(n) for n, e in AUTHOR_FIELDS.items()])
    second = F.struct(
        F.lit("Second").alias("surname"), F.when(F.col("c_nationkey") > 12, "N").alias("given_names"),
        F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("orcid"),
    )
    return read_table(spark, sf, "customer").select("c_custkey", F.array(person, second, person).alias("authors"))


@register(
    "F14_authors_string",
    f"""WITH p AS (SELECT c_nationkey, c_custkey, {', '.join(f'{e} AS {n}' for n, e in AUTHOR_FIELDS.items())} FROM customer),
    q AS (SELECT *, coalesce(full_name, given_names || ' ' || surname, surname) AS b, CASE WHEN c_nationkey > 12 THEN 'N Second' ELSE 'Second' END AS s2,
          full_name || coalesce(' [orcid:' || rtrim(replace(orcid, 'https://orcid.org/', ''), '/') || ']', '') AS g FROM p)
    SELECT c_custkey, full_name || '; ' || full_name AS plain, b || '; ' || s2 || '; ' || b AS built, g || '; ' || g AS tagged FROM q""",
)
def authors_string(spark, sf):
    return _author_lists(spark, sf).select(
        "c_custkey", X.authors_string("authors").alias("plain"),
        X.authors_string("authors", built_names=True).alias("built"),
        X.authors_string("authors", orcid=True).alias("tagged"),
    )


@register(
    "F15_normalize_orcid",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '0000-' || c_custkey END AS orcid FROM customer""",
)
def normalize_orcid(spark, sf):
    raw = F.expr(AUTHOR_FIELDS["orcid"])
    return read_table(spark, sf, "customer").select("c_custkey", X.normalize_orcid(raw).alias("orcid"))


@register("F16_first_author", "SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_name END AS first_author FROM customer")
def first_author(spark, sf):
    author = F.concat(F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_name")), F.lit(" ; "), F.col("c_mktsegment"))
    return read_table(spark, sf, "customer").select("c_custkey", X.first_author(author).alias("first_author"))


@register(
    "F17_venue_with_issue",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
    ELSE o_orderpriority || ' [issue:' || o_orderstatus || ']' END AS venue FROM orders""",
)
def venue_with_issue(spark, sf):
    issue = F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus"))
    return read_table(spark, sf, "orders").select(
        "o_orderkey", X.venue_with_issue("o_orderpriority", issue).alias("venue")
    )


LINKS_SQL = "list_sort([l_partkey, l_suppkey + 1000000, CASE WHEN l_linenumber > 3 THEN l_linenumber + 2000000 END]) AS l"


@register(
    "F19_language_links",
    f"""SELECT pl, en, count(*)::BIGINT AS n FROM (SELECT list_filter(l, lambda x: x IS NOT NULL)[1] AS pl, list_filter(l, lambda x: x IS NOT NULL)[2] AS en
    FROM (SELECT {LINKS_SQL} FROM lineitem)) GROUP BY 1, 2""",
)
def language_links(spark, sf):
    """View links of a line item, with the number at the end, in no particular order."""
    def url(number, end=""):
        return F.concat(F.lit("https://x.org/view/7/"), number, F.lit(end))

    third = F.when(F.col("l_linenumber") > 3, url(F.col("l_linenumber") + 2000000))
    links = F.array_compact(F.array(third, url(F.col("l_suppkey") + 1000000, "/"), url(F.col("l_partkey"))))
    split = read_table(spark, sf, "lineitem").select(X.split_by_last_number(links).alias("s"))
    return (
        split.select(X.last_number("s.pl").alias("pl"), X.last_number("s.en").alias("en"))
        .groupBy("pl", "en").agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "F20_edition_url",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'https://rcin.org.pl/Content/' || page_id || '/download/' END AS download_url FROM pages""",
)
def edition_url(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "/publication/").otherwise("/edition/")
    url = F.concat(F.col("url"), kind, F.col("page_id"), F.lit("/content"))
    return read_table(spark, sf, "pages").select("page_id", X.edition_url(url).alias("download_url"))


STEMS_SQL = "|".join(X.POETRY_STEMS)


@register(
    "F24_keyword_flag",
    f"""SELECT conv_id, bool_or(regexp_matches(lower(text), '{STEMS_SQL}')) AS poetry FROM conversations GROUP BY 1""",
)
def keyword_flag(spark, sf):
    """Every turn is a record with three text columns, by role; a conversation counts if any turn does."""
    roles = ["user", "assistant", "system"]
    records = read_table(spark, sf, "conversations").select(
        "conv_id", *[F.when(F.col("role") == r, F.array("text")).alias(r) for r in roles]
    )
    flagged = records.select("conv_id", X.mentions_any(roles).alias("hit"))
    return flagged.groupBy("conv_id").agg(F.bool_or("hit").alias("poetry"))


# consecutive turns of a conversation
TURNS_SQL = """t AS (SELECT conv_id, turn, text FROM conversations),
 p AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _turn_pairs(spark, sf):
    t = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return t.withColumnRenamed("text", "a").join(after, ["conv_id", "turn"])


def sim_sql(a: str, b: str) -> str:
    """Similarity by edit distance. SQL measures it in bytes, so the accented letters of the tables,
    lowered, become capital letters there, which a lowered text no longer has."""
    x, y = (f"translate(lower({clean_sql(c)}), 'ßäçèéêíñóöü', 'ABCDEFGHIJK')" for c in (a, b))
    return f"coalesce(1.0::DOUBLE - levenshtein({x}, {y}) / greatest(length({x}), length({y})), 0.0)"


@register(
    "F26_levenshtein_similarity",
    rounded_sql(f"WITH {TURNS_SQL} SELECT conv_id, turn, {sim_sql('a', 'b')} AS similarity FROM p", ["similarity"]),
)
def levenshtein_similarity(spark, sf):
    pairs = _turn_pairs(spark, sf)
    return rounded(pairs.select("conv_id", "turn", S.levenshtein_similarity("a", "b").alias("similarity")))


def common_sql(x: str, y: str) -> str:
    """Length of the longest common subsequence of two lists of characters, diagonal by diagonal.

    Entry i + 1 of ``p`` is the length for the first i characters of ``x`` and k - i of ``y``; ``q`` is the diagonal before.
    """
    zeros = f"list_resize([0], CASE WHEN k = 1 THEN len({x}) + 1 ELSE 0 END, 0)"
    return f"""list_reduce(
      list_transform(range(1, len({x}) + len({y}) + 1), lambda k: {{'k': k, 'p': {zeros}, 'q': {zeros}}}),
      lambda s, e: {{'k': e.k, 'q': s.p, 'p': list_transform(s.p, lambda v, i:
        CASE WHEN i = 1 OR e.k - i + 1 < 1 OR e.k - i + 1 > len({y}) THEN 0
             WHEN {x}[i - 1] = {y}[e.k - i + 1] THEN s.q[i - 1] + 1 ELSE greatest(s.p[i - 1], v) END)}}
    ).p[len({x}) + 1]"""


@register(
    "F27_indel_ratio",
    rounded_sql(
        f"""WITH {TURNS_SQL}, o AS (SELECT conv_id, turn, length(a) + length(b) AS total, length(a) <= length(b) AS shorter, a, b FROM p),
        ch AS (SELECT conv_id, turn, total, string_split(CASE WHEN shorter THEN a ELSE b END, '') AS x,
          string_split(CASE WHEN shorter THEN b ELSE a END, '') AS y FROM o)
        SELECT conv_id, turn, CASE WHEN total = 0 THEN 100.0::DOUBLE
          ELSE (1.0::DOUBLE - (total - 2 * {common_sql('x', 'y')}) / total::DOUBLE) * 100.0 END AS ratio FROM ch""",
        ["ratio"],
    ),
)
def indel_ratio(spark, sf):
    pairs = _turn_pairs(spark, sf)
    return rounded(pairs.select("conv_id", "turn", S.indel_ratio("a", "b").alias("ratio")))


@register(
    "F28_year_and_slot_match",
    """WITH p AS (SELECT a.o_orderkey, year(a.o_orderdate) AS ya, year(b.o_orderdate) AS yb,
      CASE WHEN a.o_orderstatus = 'F' THEN '' ELSE a.o_orderstatus END AS va, CASE WHEN b.o_orderstatus = 'F' THEN '' ELSE b.o_orderstatus END AS vb
      FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)
    SELECT o_orderkey, ya = yb AS year_match, ya = yb AND va = vb AS same_slot FROM p""",
)
def slot_match(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("pub_date"),
        F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderstatus")).alias("volume"),
        F.lit(None).cast("string").alias("issue"), F.lit("").alias("page"),
    )
    a = o.select("o_orderkey", F.struct("pub_date", "volume", "issue", "page").alias("a"))
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.struct("pub_date", "volume", "issue", "page").alias("b"))
    pairs = a.join(b, "o_orderkey")
    return pairs.select(
        "o_orderkey", S.year_match("a.pub_date", "b.pub_date").alias("year_match"),
        S.same_slot(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")).alias("same_slot"),
    )
