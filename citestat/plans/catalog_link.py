"""Queries of record linkage (L1-L9, J1-J5, W4) and reference enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from citestat.operators import dedup, enrich, link
from citestat.operators.compare import stage_counts
from citestat.plans.catalog_text import clean_sql, doi_sql, sim_sql, title_sql, year_sql
from citestat.plans.domain import articles_a, articles_b, document_articles, linkage_sql
from citestat.plans.registry import register, rounded, rounded_sql
from citestat.session import save_and_reload
from citestat.sources import read_table

AB = f"WITH {linkage_sql(title_sql)}"


def sources(spark, sf, digests=False):
    return link.prepare_a(articles_a(spark, sf), digests), link.prepare_b(articles_b(spark, sf), digests)


def saved_sources(spark, sf):
    """Prepared sources written once with digests of the titles, for queries that run several exact stages on them."""
    a, b = sources(spark, sf, digests=True)
    return save_and_reload(a, "source-a"), save_and_reload(b, "source-b")


PREPARED = "key AS id, venue_internal_id, venue, title_norm, doi AS doi_norm, year, cites"


@register(
    "L1_prepared_sources",
    f"{AB} SELECT 'a' AS side, {PREPARED} FROM a UNION ALL SELECT 'b', {PREPARED} FROM b",
)
def prepared(spark, sf):
    a, b = sources(spark, sf)
    common = ["venue_internal_id", "title_norm", "doi_norm"]
    left = a.select(
        F.lit("a").alias("side"), F.col("article_id_oc").alias("id"), F.col("venue_name_oc").alias("venue"), *common,
        F.col("year").cast("bigint").alias("year"), F.col("citedby_count_oc").alias("cites"),
    )
    right = b.select(
        F.lit("b").alias("side"), F.col("article_id_scopus").alias("id"), F.col("venue_name_scopus").alias("venue"), *common,
        F.col("year").cast("bigint").alias("year"), F.col("citedby_count_scopus").alias("cites"),
    )
    return left.unionByName(right)


def one_to_one_sql(pairs: str, out: str, order: str = "ka, kb") -> str:
    return f"""{out}0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ka ORDER BY {order}) AS r FROM {pairs}) WHERE r = 1),
{out} AS (SELECT * EXCLUDE (r, r2) FROM (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY {order}) AS r2 FROM {out}0) WHERE r2 = 1)"""


DOI_STAGE = f"""{AB},
dp AS (SELECT a.key AS ka, b.key AS kb FROM a JOIN b ON a.venue_internal_id = b.venue_internal_id AND a.doi = b.doi),
{one_to_one_sql('dp', 'ds')}"""
TITLE_STAGE = f"""{DOI_STAGE},
a2 AS (SELECT * FROM a WHERE key NOT IN (SELECT ka FROM ds)), b2 AS (SELECT * FROM b WHERE key NOT IN (SELECT kb FROM ds)),
tp AS (SELECT a2.key AS ka, b2.key AS kb FROM a2 JOIN b2 ON a2.venue_internal_id = b2.venue_internal_id
       AND a2.title_norm = b2.title_norm AND a2.year = b2.year),
{one_to_one_sql('tp', 'ts')}"""
# pairs a person looked at: the first article of the other source with the same venue and
# text length; marked when the length is even
REVIEWED = """SELECT a.key AS ka, kb FROM a JOIN (SELECT venue_internal_id AS v, n_chars AS n, min(key) AS kb FROM b GROUP BY 1, 2)
 ON a.venue_internal_id = v AND a.n_chars = n WHERE a.n_chars % 2 = 0"""
# the same with all pairs of equal venue and text length
REVIEWED_PAIRS = "SELECT a.key AS ka, b.key AS kb FROM a JOIN b ON a.venue_internal_id = b.venue_internal_id AND a.n_chars = b.n_chars WHERE a.n_chars % 2 = 0"


def manual_stage_sql(reviewed: str) -> str:
    return f"{TITLE_STAGE}, mp AS ({reviewed}), {one_to_one_sql('mp', 'ms')}"


def merged_sql(reviewed: str) -> str:
    return f"""{manual_stage_sql(reviewed)},
allm AS (SELECT ka, kb, 1 AS pri, 'doi_exact' AS method FROM ds UNION ALL SELECT ka, kb, 2, 'title_exact_year' FROM ts
         UNION ALL SELECT ka, kb, 3, 'manual_confirmed' FROM ms),
{one_to_one_sql('allm', 'mg', 'pri, ka, kb')}"""


MANUAL_STAGE, MERGED = manual_stage_sql(REVIEWED), merged_sql(REVIEWED)


@register("L2_doi_stage", f"{DOI_STAGE} SELECT ka AS article_id_oc, kb AS article_id_scopus, 'doi_exact' AS match_method FROM ds")
def doi_stage(spark, sf):
    return link.match_doi(*sources(spark, sf, digests=True)).select("article_id_oc", "article_id_scopus", "match_method")


@register(
    "J1_two_key_join",
    f"{AB} SELECT a.venue_internal_id, a.doi, count(*)::BIGINT AS n_a, max(nb)::BIGINT AS n_b FROM a JOIN (SELECT venue_internal_id AS v, doi AS d, count(*) AS nb FROM b GROUP BY 1, 2) ON v = a.venue_internal_id AND d = a.doi GROUP BY 1, 2",
)
def two_key_join(spark, sf):
    """Equal keys on both sides, as group sizes: the pairs of a key are never written out."""
    a, b = sources(spark, sf, digests=True)
    keys = ["venue_internal_id", "doi_norm"]
    n_a = a.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    n_b = b.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    return n_a.join(n_b, keys).withColumnRenamed("doi_norm", "doi")


@register(
    "J2_three_key_join",
    f"{AB} SELECT a.key AS article_id_oc, min(b.key) AS first_scopus FROM a JOIN b ON a.venue_internal_id = b.venue_internal_id AND a.title_norm = b.title_norm AND a.year = b.year GROUP BY 1",
)
def three_key_join(spark, sf):
    a, b = sources(spark, sf, digests=True)
    keys = ["venue_internal_id", "title_norm", "year"]
    first = b.dropna(subset=keys).groupBy(*keys).agg(F.min("article_id_scopus").alias("first_scopus"))
    return a.join(first, keys).select("article_id_oc", "first_scopus")


@register("J3_anti_join", f"{DOI_STAGE} SELECT key AS id FROM a WHERE key NOT IN (SELECT ka FROM ds) UNION ALL SELECT key FROM b WHERE key NOT IN (SELECT kb FROM ds)")
def anti_join(spark, sf):
    a, b = saved_sources(spark, sf)
    left_a, left_b = link.without_matched(a, b, link.match_doi(a, b))
    return left_a.select(F.col("article_id_oc").alias("id")).unionByName(left_b.select(F.col("article_id_scopus").alias("id")))


@register("L3_title_year_stage", f"{TITLE_STAGE} SELECT ka AS article_id_oc, kb AS article_id_scopus, 'title_exact_year' AS match_method FROM ts")
def title_stage(spark, sf):
    a, b = saved_sources(spark, sf)
    a2, b2 = link.without_matched(a, b, link.match_doi(a, b))
    return link.match_title_year(a2, b2).select("article_id_oc", "article_id_scopus", "match_method")


@register(
    "L4_stage_bookkeeping",
    f"""{TITLE_STAGE}, k AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM ds) AS d, (SELECT count(*) FROM ts) AS t)
    SELECT 'a' AS side, (na - d)::BIGINT AS after_doi, (na - d - t)::BIGINT AS after_title FROM k
    UNION ALL SELECT 'b', nb - d, nb - d - t FROM k""",
)
def bookkeeping(spark, sf):
    a, b = saved_sources(spark, sf)
    doi = link.match_doi(a, b)
    a2, b2 = link.without_matched(a, b, doi)
    title = link.match_title_year(a2, b2)
    after = dict(zip("ab", link.without_matched(a2, b2, title)))
    count = F.count(F.lit(1))
    rows = []
    for side, first in (("a", a2), ("b", b2)):
        one = first.agg(count.alias("after_doi")).join(F.broadcast(after[side].agg(count.alias("after_title"))))
        rows.append(one.select(F.lit(side).alias("side"), "after_doi", "after_title"))
    return rows[0].unionByName(rows[1])


def reviewed(spark, sf, every=False):
    """Review list: every article with one candidate of equal venue and length; several may name the same one.

    With ``every`` each article has all such candidates.
    """
    d = document_articles(spark, sf)
    a = d.filter("in_a").select("venue_internal_id", "n_chars", F.col("key").alias("article_id_oc"))
    b = d.filter("NOT in_a").select("venue_internal_id", "n_chars", F.col("key").alias("article_id_scopus"))
    if not every:
        b = b.groupBy("venue_internal_id", "n_chars").agg(F.min("article_id_scopus").alias("article_id_scopus"))
    flag = F.when(F.col("n_chars") % 2 == 0, " X").otherwise("no")
    return a.join(b, ["venue_internal_id", "n_chars"]).select("article_id_oc", "article_id_scopus", flag.alias("the same"))


@register("L7_manual_stage", f"{MANUAL_STAGE} SELECT ka AS article_id_oc, kb AS article_id_scopus, 'manual_confirmed' AS match_method FROM ms")
def manual_stage(spark, sf):
    a, b = sources(spark, sf, digests=True)
    return link.match_manual(reviewed(spark, sf), a, b).select("article_id_oc", "article_id_scopus", "match_method")


@register(
    "J5_records_of_manual_pairs",
    f"""{MANUAL_STAGE} SELECT ka AS article_id_oc, kb AS article_id_scopus, a.title_norm AS title_norm_oc, b.title_norm AS title_norm_sc,
    coalesce(a.doi, b.doi) AS doi_norm, a.year AS year_oc, b.year AS year_sc FROM ms JOIN a ON a.key = ka JOIN b ON b.key = kb""",
)
def manual_records(spark, sf):
    a, b = sources(spark, sf)
    return link.match_manual(reviewed(spark, sf), a, b).select(
        "article_id_oc", "article_id_scopus", "title_norm_oc", "title_norm_sc", "doi_norm",
        F.col("year_oc").cast("bigint").alias("year_oc"), F.col("year_sc").cast("bigint").alias("year_sc"),
    )


def exact_matches(spark, sf, every=False):
    a, b = saved_sources(spark, sf)
    doi = link.match_doi(a, b)
    title = link.match_title_year(*link.without_matched(a, b, doi))
    return a, b, link.merge_stages(doi, title, link.match_manual(reviewed(spark, sf, every), a, b))


@register("L8_merged_stages", f"{MERGED} SELECT ka AS article_id_oc, kb AS article_id_scopus, method AS match_method FROM mg")
def merged_stages(spark, sf):
    return exact_matches(spark, sf)[2].select("article_id_oc", "article_id_scopus", "match_method")


@register(
    "W4_priority_one_to_one",
    f"{merged_sql(REVIEWED_PAIRS)} SELECT method AS match_method, count(*)::BIGINT AS n FROM mg GROUP BY 1",
)
def priority_counts(spark, sf):
    return stage_counts(exact_matches(spark, sf, every=True)[2], "match_method")


@register(
    "L9_master_of_exact_stages",
    f"""{MERGED}, mm AS (
      SELECT a.key AS ia, b.key AS ib, method, 'both' AS source_status, coalesce(a.venue, b.venue) AS venue_name,
             coalesce(a.title, b.title) AS title, coalesce(a.year, b.year) AS year, coalesce(a.doi, b.doi) AS doi_norm
      FROM mg JOIN a ON a.key = ka JOIN b ON b.key = kb
      UNION ALL SELECT key, NULL, 'oc_only', 'open_citations_only', venue, title, year, doi FROM a WHERE key NOT IN (SELECT ka FROM mg)
      UNION ALL SELECT NULL, key, 'scopus_only', 'scopus_only', venue, title, year, doi FROM b WHERE key NOT IN (SELECT kb FROM mg))
    SELECT ia AS article_id_oc, ib AS article_id_scopus, method AS match_method, source_status, venue_name,
           md5(title) AS title_preferred, year AS year_preferred, doi_norm FROM mm""",
)
def exact_master(spark, sf):
    a, b, matches = exact_matches(spark, sf)
    return link.master_table(matches, a, b).select(
        "article_id_oc", "article_id_scopus", "match_method", "source_status", "venue_name",
        "title_preferred", F.col("year_preferred").cast("bigint").alias("year_preferred"),
        "doi_norm",
    )


# ---- fuzzy stage (no SQL form: rows only, tested against a sequential model) -------------


def linked(spark, sf, with_manual=False, review=True):
    a, b = sources(spark, sf)
    return link.link_sources(a, b, reviewed(spark, sf) if with_manual else None, review=review)


@register("J4_blocked_fuzzy_join")
def fuzzy_join(spark, sf):
    return rounded(
        linked(spark, sf).candidates.select(
            "article_id_oc", "article_id_scopus", "best_score", "second_score", "score_gap", "accepted"
        )
    )


@register("L5_fuzzy_stage")
def fuzzy_stage(spark, sf):
    # a floor below the automatic threshold changes no match
    return rounded(linked(spark, sf, review=False).fuzzy.select("article_id_oc", "article_id_scopus", "fuzzy_score"))


@register("L6_review_queue")
def review_queue(spark, sf):
    queue = linked(spark, sf).review
    return rounded(queue.orderBy(F.desc("best_score"), F.desc("score_gap"), "article_id_oc"))


@register("L9_master_of_all_stages")
def full_master(spark, sf):
    return linked(spark, sf, with_manual=True, review=False).master


@register("A38_linkage_summary")
def linkage_summary(spark, sf):
    found = link.link_sources(*sources(spark, sf), reviewed(spark, sf), review=False, count_review=True, texts=False)
    return link.linkage_summary(found.a, found.b, found)


# ---- enrichment -------------------------------------------------------------------------
#
# References are the turns of the conversations, their texts the titles. The provider answers a
# query with a near copy of the title and the sentences of the turn from the second on.

REF_FIELDS = {
    "identifier": "'oai:' || conv_id", "reference_index": "turn",
    "title": "text", "author": "'Author ' || md5('' || (conv_id % 50)) || '; Second'",
    "pub_date": "'' || (2000 + conv_id % 20)", "venue": "'Journal of ' || md5('' || (conv_id % 7))",
    "doi": "CASE WHEN turn % 3 = 2 THEN 'https://doi.org/10.9/X' || conv_id || '.' || turn END",
    "volume": "'' || (turn % 2)", "raw_reference": "text",
}
REFS_SQL = "rf AS (SELECT {} FROM conversations)".format(
    ", ".join(f"{e} AS {n}" for n, e in REF_FIELDS.items())
)


def references(spark, sf):
    turns = read_table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    return turns.select(
        *[F.expr(e).alias(n) for n, e in REF_FIELDS.items()],
        none.alias("issue"), none.alias("page"), none.alias("type"), none.alias("publisher"), none.alias("editor"),
    )


def responses(spark, sf):
    """One stored provider answer (JSON items) per distinct query."""
    asked = references(spark, sf).withColumn("query", enrich.query_text()).filter("doi IS NULL")
    sentences = F.split("raw_reference", r"\.")

    def item(doi, title, year, family):
        return F.struct(
            doi.alias("DOI"), F.array(title).alias("title"), F.array(F.col("venue")).alias("container-title"),
            F.array(F.struct(F.lit("Author").alias("given"), family.alias("family"))).alias("author"),
            F.lit("journal-article").alias("type"), F.lit(1.5).alias("score"),
            F.struct(F.array(F.array(year)).alias("date-parts")).alias("issued"),
        )

    digit = F.element_at(F.split(F.split("author", ";")[0], " "), 2)
    own = item(
        F.concat(F.lit("10.8/"), F.col("identifier"), F.lit("."), F.col("reference_index")),
        F.concat(F.col("title"), F.lit(" x")), F.col("pub_date").cast("int"), digit,
    )
    rest = F.transform(
        F.slice(sentences, F.lit(2), F.size(sentences)),
        lambda t, i: item(F.concat(F.lit("10.8/o"), i + 1), t, F.lit(1999), F.lit("Other")),
    )
    answered = asked.withColumn("items_json", F.to_json(F.concat(F.array(own), rest)))
    return answered.groupBy("query").agg(F.min_by("items_json", F.struct("identifier", "reference_index")).alias("items_json"))


QUERY_SQL = f"""coalesce(nullif(concat_ws(' ', {clean_sql('title')}, string_split({clean_sql('author')}, ';')[1],
 {year_sql('pub_date')}, {clean_sql('venue')}), ''), {clean_sql('raw_reference')})"""
# the provider's answer to every query: first the near copy, then the other sentences
CANDS_SQL = f"""{REFS_SQL},
q AS (SELECT *, {QUERY_SQL} AS query, {doi_sql('doi')} AS existing FROM rf),
firstq AS (SELECT query, identifier AS fi, reference_index AS fr, title AS ft, pub_date AS fp, author AS fa, venue AS fv
  FROM q WHERE existing IS NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY identifier, reference_index) = 1),
oth AS (SELECT 'oai:' || conv_id AS oi, turn, unnest(string_split(text, '.')[2:]) AS ot, generate_subscripts(string_split(text, '.')[2:], 1) AS p
  FROM conversations),
cand AS (
  SELECT query, 0 AS pos, lower('10.8/' || fi || '.' || fr) AS cdoi, {clean_sql("ft || ' x'")} AS ctitle, string_split(fa, ';')[1] AS cauthor,
         fp AS cyear, fv AS cvenue FROM firstq
  UNION ALL SELECT query, p, '10.8/o' || p, {clean_sql('ot')}, 'Author Other', '1999', fv
  FROM firstq JOIN oth ON oi = fi AND turn = fr)"""
SCORED_SQL = f"""WITH {CANDS_SQL},
sc0 AS (SELECT q.*, cand.* EXCLUDE (query), {sim_sql('title', 'ctitle')} AS ts, {sim_sql("string_split(author, ';')[1]", 'cauthor')} AS aus,
        {sim_sql('venue', 'cvenue')} AS vs, (pub_date = cyear)::INT AS ym FROM q JOIN cand USING (query) WHERE existing IS NULL),
sc AS (SELECT *, 0.60::DOUBLE * ts + 0.20::DOUBLE * aus + 0.10::DOUBLE * vs + 0.10::DOUBLE * ym AS score FROM sc0),
acc AS (SELECT *, (ts >= 0.85 AND ym = 1) OR (score >= 0.78 AND ts >= 0.80) AS accepted FROM sc)"""


@register("L16_query_text", f"WITH {REFS_SQL} SELECT identifier, reference_index, {QUERY_SQL} AS query FROM rf")
def query_text(spark, sf):
    return references(spark, sf).select("identifier", "reference_index", enrich.query_text().alias("query"))


@register("L16_distinct_queries", f"WITH {REFS_SQL} SELECT DISTINCT {QUERY_SQL} AS query FROM rf WHERE {doi_sql('doi')} IS NULL")
def distinct_queries(spark, sf):
    return enrich.distinct_queries(references(spark, sf))


@register(
    "L15_flattened_candidates",
    f"WITH {CANDS_SQL} SELECT md5(query) AS query_key, pos::BIGINT AS pos, cdoi AS doi, ctitle AS title, cauthor AS author, cyear AS pub_date, cvenue AS venue FROM cand",
)
def flattened(spark, sf):
    c = enrich.candidates_from_responses(responses(spark, sf))
    flat = c.select("query_key", F.posexplode("candidates").alias("pos", "c"))
    return flat.select(
        "query_key", F.col("pos").cast("bigint").alias("pos"), "c.doi", "c.title", "c.author", "c.pub_date", "c.venue"
    )


def scored(spark, sf):
    return enrich.score_candidates(references(spark, sf), enrich.candidates_from_responses(responses(spark, sf)))


@register(
    "L10_scored_candidates",
    rounded_sql(f"{SCORED_SQL} SELECT identifier, reference_index, pos::BIGINT AS candidate_position, score AS crossref_match_score FROM sc",
                ["crossref_match_score"]),
)
def scored_candidates(spark, sf):
    d = enrich.diagnostics(scored(spark, sf), ["identifier", "reference_index"])
    return rounded(d.select("identifier", "reference_index", F.col("candidate_position").cast("bigint").alias("candidate_position"), "crossref_match_score"))


@register(
    "L11_candidate_acceptance",
    f"{SCORED_SQL} SELECT identifier, reference_index, pos::BIGINT AS candidate_position, accepted FROM acc",
)
def acceptance(spark, sf):
    d = enrich.diagnostics(scored(spark, sf), ["identifier", "reference_index"])
    return d.select("identifier", "reference_index", F.col("candidate_position").cast("bigint").alias("candidate_position"), "accepted")


@register(
    "L12_best_candidate",
    f"{SCORED_SQL} SELECT identifier, reference_index, arg_min(cdoi, (-score, pos)) AS best_doi FROM acc GROUP BY 1, 2",
)
def best_candidate(spark, sf):
    s = scored(spark, sf).filter("_existing IS NULL AND size(scored) > 0")
    return s.select("identifier", "reference_index", F.array_max("scored")["candidate"]["doi"].alias("best_doi"))


ENRICHED_SQL = f"""{SCORED_SQL},
best AS (SELECT identifier, reference_index, arg_min(cdoi, (-score, pos)) AS bd, arg_min(score, (-score, pos)) AS bs, arg_min(accepted, (-score, pos)) AS ba
         FROM acc GROUP BY 1, 2),
en AS (SELECT q.*, coalesce(existing, CASE WHEN ba THEN bd END) AS doi_enriched,
       CASE WHEN existing IS NOT NULL THEN 'existing' WHEN ba THEN 'crossref' ELSE 'none' END AS doi_source,
       CASE WHEN existing IS NULL AND ba THEN bs END AS crossref_match_score
       FROM q LEFT JOIN best USING (identifier, reference_index))"""


@register(
    "L13_enriched_references",
    rounded_sql(f"{ENRICHED_SQL} SELECT identifier, reference_index, doi_enriched, doi_source, crossref_match_score FROM en",
                ["crossref_match_score"]),
)
def enriched(spark, sf):
    return rounded(
        enrich.enrich(scored(spark, sf)).select("identifier", "reference_index", "doi_enriched", "doi_source", "crossref_match_score")
    )


@register(
    "L14_candidate_diagnostics",
    rounded_sql(
        f"""{SCORED_SQL} SELECT identifier, reference_index, title AS local_title, query AS crossref_query, cdoi AS crossref_doi,
        ctitle AS crossref_title, ts AS crossref_title_similarity, aus AS crossref_author_similarity,
        vs AS crossref_venue_similarity, ym::BIGINT AS crossref_year_match, accepted FROM acc""",
        ["crossref_title_similarity", "crossref_author_similarity", "crossref_venue_similarity"],
    ),
)
def candidate_diagnostics(spark, sf):
    d = enrich.diagnostics(scored(spark, sf), ["identifier", "reference_index"])
    return rounded(
        d.select(
            "identifier", "reference_index", "local_title", "crossref_query", "crossref_doi", "crossref_title",
            "crossref_title_similarity", "crossref_author_similarity", "crossref_venue_similarity",
            F.col("crossref_year_match").cast("bigint").alias("crossref_year_match"), "accepted",
        )
    )


# ---- deduplication and export -----------------------------------------------------------


@register(
    "L17_matching_score",
    rounded_sql(
        f"""WITH {REFS_SQL}, p AS (SELECT x.identifier, x.reference_index, x.title AS t1, y.title AS t2, x.author AS a1, y.author AS a2,
          x.venue AS v1, y.venue AS v2, {doi_sql('x.doi')} AS d1, {doi_sql('y.doi')} AS d2, x.volume = y.volume AND x.pub_date = y.pub_date AS slot
          FROM rf x JOIN rf y ON x.identifier = y.identifier AND y.reference_index = x.reference_index + 1)
        SELECT identifier, reference_index, 50 * coalesce(d1 = d2, false)::INT + 25 * {sim_sql('t1', 't2')}
          + 10 * {sim_sql("string_split(a1, ';')[1]", "string_split(a2, ';')[1]")} + 10 * {sim_sql('v1', 'v2')} + 5 * slot::INT AS score FROM p""",
        ["score"],
    ),
)
def pair_score(spark, sf):
    """Score of every reference with the next one of its article."""
    r = references(spark, sf).withColumn("doi_enriched", F.lit(None).cast("string"))
    fields = [c for c in r.columns if c not in ("identifier", "reference_index")]
    a = r.select("identifier", "reference_index", F.struct(*fields).alias("a"))
    b = r.select("identifier", (F.col("reference_index") - 1).alias("reference_index"), F.struct(*fields).alias("b"))
    pairs = a.join(b, ["identifier", "reference_index"])
    return rounded(pairs.select("identifier", "reference_index", dedup.matching_score("a", "b").alias("score")))


def _citing_id(identifier: str):
    return F.concat(F.lit("citing:"), F.col(identifier))


def deduplicated(spark, sf):
    r = enrich.enrich(scored(spark, sf)).withColumn(
        "citing_id", _citing_id("identifier")
    )
    return dedup.deduplicate(r, ["identifier", "reference_index"])


def key_sim_sql(c: str) -> str:
    """Similarity of the key ``c`` of the rows x and y, as `sim_sql` has it; accents are replaced in the keys."""
    return f"CASE WHEN x.{c} = '' OR y.{c} = '' THEN 0 ELSE 1.0::DOUBLE - levenshtein(x.{c}, y.{c}) / greatest(length(x.{c}), length(y.{c})) END"


def _key_sql(x: str) -> str:
    return f"translate(lower(coalesce({clean_sql(x)}, '')), 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


# the sequential scan itself: one step per record, carrying the canonical records so far
DEDUP_SQL = f"""WITH RECURSIVE {ENRICHED_SQL.removeprefix('WITH ')},
dr AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY identifier, reference_index) AS pos, coalesce({doi_sql('doi_enriched')}, {doi_sql('doi')}, '') AS dk,
       {_key_sql('title')} AS tk, {_key_sql("string_split(author, ';')[1]")} AS ak, {_key_sql('venue')} AS vk,
       coalesce({year_sql('pub_date')}, '') AS yk, volume AS sk,
       coalesce('doi:' || coalesce({doi_sql('doi_enriched')}, {doi_sql('doi')}), 'temp:' || substr(md5(coalesce(nullif(concat_ws(' | ', {clean_sql('title')},
         {clean_sql('author')}, {clean_sql('pub_date')}, {clean_sql('venue')}, {clean_sql('raw_reference')}), ''), 'empty')), 1, 16)) AS rid FROM en),
-- titles are compared only where their lengths let the score exceed 30
d0 AS MATERIALIZED (SELECT x.pos AS p, y.pos AS q, 50 * (x.dk = y.dk AND x.dk <> '')::INT AS d, x.tk AS xt, y.tk AS yt, {key_sim_sql('ak')} AS a, {key_sim_sql('vk')} AS v,
       5 * (x.yk = y.yk AND x.yk <> '' AND x.sk = y.sk)::INT AS s FROM dr x JOIN dr y ON y.pos < x.pos),
d1 AS MATERIALIZED (SELECT * FROM d0 WHERE d + 25.0::DOUBLE * least(length(xt), length(yt)) / greatest(length(xt), length(yt), 1) + 10 * a + 10 * v + s > 29.999),
dp AS MATERIALIZED (SELECT * FROM (SELECT p, q, d + 25 * CASE WHEN xt = '' OR yt = '' THEN 0 ELSE 1.0::DOUBLE - levenshtein(xt, yt) / greatest(length(xt), length(yt)) END
       + 10 * a + 10 * v + s AS score FROM d1) WHERE score > 30),
dq AS MATERIALIZED (SELECT p, list(q) AS qs FROM dp GROUP BY p),
scan(done, heads) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT done + 1, CASE WHEN list_has_any(heads, coalesce(qs, [])) THEN heads ELSE list_append(heads, done + 1) END
  FROM scan LEFT JOIN dq ON p = done + 1 WHERE done < (SELECT count(*) FROM dr)),
hd AS (SELECT unnest(heads) AS h FROM (SELECT heads FROM scan ORDER BY done DESC LIMIT 1)),
bm AS (SELECT p, arg_max(q, (score, -q)) AS q, max(score) AS score FROM dp JOIN hd ON q = h WHERE p NOT IN (SELECT h FROM hd) GROUP BY p),
dd AS MATERIALIZED (SELECT dr.*, 'citing:' || identifier AS citing, coalesce(bm.q, dr.pos) AS cpos, bm.score AS mscore,
       CASE WHEN bm.q IS NULL THEN 'new_canonical' ELSE 'matched_existing' END AS status FROM dr LEFT JOIN bm ON bm.p = dr.pos),
dm AS MATERIALIZED (SELECT dd.*, c.rid AS cid, c.title AS ctitle2 FROM dd JOIN dr c ON c.pos = dd.cpos)"""


@register(
    "L18_leader_deduplication",
    rounded_sql(f"""{DEDUP_SQL} SELECT identifier, reference_index, cpos AS canonical_position, mscore AS matching_score, status AS dedup_status FROM dd""",
                ["matching_score"]),
)
def leader_dedup(spark, sf):
    return rounded(
        deduplicated(spark, sf).select("identifier", "reference_index", "canonical_position", "matching_score", "dedup_status")
    )


@register(
    "L19_mapping_table",
    rounded_sql(f"""{DEDUP_SQL} SELECT rid AS original_temp_id, cid AS canonical_id, mscore AS matching_score, status AS dedup_status,
      title, ctitle2 AS canonical_title FROM dm""", ["matching_score"]),
)
def mapping(spark, sf):
    return rounded(dedup.mapping_table(deduplicated(spark, sf)))


def citing_of_references(spark, sf):
    jobs = references(spark, sf).select("identifier").distinct()
    none = F.lit(None).cast("string")
    return jobs.select(
        "identifier", _citing_id("identifier").alias("id"), F.concat(F.lit("Article "), "identifier").alias("title"),
        *[none.alias(c) for c in ("author", "pub_date", "venue", "volume", "issue", "page", "type", "publisher", "editor")],
    )


@register(
    "L20_export_metadata",
    f"""{DEDUP_SQL},
    xm AS (SELECT 'citing:' || identifier AS id, 'Article ' || identifier AS title, NULL::VARCHAR AS author, NULL::VARCHAR AS pub_date, NULL::VARCHAR AS venue, NULL::VARCHAR AS volume,
             NULL::VARCHAR AS type, 0 AS part, 0 AS ord FROM (SELECT DISTINCT identifier FROM rf)
           UNION ALL SELECT cid, {clean_sql('title')}, {clean_sql('author')}, {clean_sql('pub_date')}, {clean_sql('venue')}, {clean_sql('volume')},
             'journal article', 1, -pos FROM dm WHERE status = 'new_canonical')
    SELECT id, title, author, pub_date, venue, volume, NULL AS issue, NULL AS page, type, NULL AS publisher, NULL AS editor
    FROM xm QUALIFY row_number() OVER (PARTITION BY id ORDER BY part, ord) = 1""",
)
def export_metadata(spark, sf):
    return dedup.export_metadata(citing_of_references(spark, sf), deduplicated(spark, sf), ["identifier"])


@register(
    "L20_export_citations",
    f"""{DEDUP_SQL}, lastm AS (SELECT rid, arg_max(cid, pos) AS cid FROM dm GROUP BY rid)
    SELECT DISTINCT dm.citing AS citing_id, lastm.cid AS cited_id FROM dm JOIN lastm ON lastm.rid = dm.rid""",
)
def export_citations(spark, sf):
    return dedup.citation_pairs(deduplicated(spark, sf))
