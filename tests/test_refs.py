import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citestat.functions import similarity as S
from citestat.functions import xml
from citestat.functions.xml import texts
from citestat.operators import enrich, refs

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>The <hi>big</hi> title</title>
<author><persName><forename>Jan</forename><surname>Nowak</surname></persName></author><author> Team  X </author></titleStmt>
<publicationStmt><date>May 2001</date></publicationStmt>
<sourceDesc><biblStruct><idno type="ISSN">1</idno><idno type="DOI">10.1/ABC</idno></biblStruct></sourceDesc></fileDesc></teiHeader>
<text><back><listBibl>
<biblStruct><analytic><title>Art</title><author><persName><surname>S</surname><forename>F</forename></persName></author></analytic>
<monogr><title level="j">Jour</title><imprint><biblScope unit="volume">3</biblScope><biblScope unit="page" from="1" to="9"/><date when="1999-01"/></imprint></monogr>
<idno type="doi">10.5/Q</idno></biblStruct>
<biblStruct><monogr><title>Book</title><author>Only Text</author><editor><persName><surname>E</surname></persName></editor>
<imprint><publisher>Pub</publisher><biblScope unit="page" from="5"/></imprint></monogr><note type="raw_reference">Text of 1987 &amp; more</note></biblStruct>
<biblStruct><note type="raw_reference"> </note></biblStruct>
</listBibl></back></text></TEI>"""

JATS = """<article xml:lang="pl" xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-id pub-id-type="doi"> </article-id>
<article-id pub-id-type="doi">10.1/x</article-id><article-id pub-id-type="publisher-id">77</article-id>
<article-title>A <i>b</i>  c</article-title><contrib-group content-type="author"><contrib><name><surname>S</surname><given-names>G</given-names></name></contrib>
<contrib><name><surname>T</surname></name><contrib-id contrib-id-type="orcid">0000</contrib-id></contrib></contrib-group>
<contrib-group content-type="editor"><contrib><name><surname>E</surname></name></contrib></contrib-group>
<pub-date><month>1</month></pub-date><pub-date><year>2005</year></pub-date>
<self-uri content-type="application/pdf" xlink:href="u1"/><self-uri xlink:href="u2"/><kwd>k1</kwd><kwd/><kwd> </kwd><kwd>k2</kwd></front>
<back><ref id="R1"><mixed-citation>One <i>two</i></mixed-citation></ref><ref id="R2"><mixed-citation> </mixed-citation></ref><ref><mixed-citation>Three</mixed-citation></ref></back></article>"""


def test_tei(spark):
    df = spark.createDataFrame([("d", TEI)], "identifier string, xml string")
    h = refs.tei_header(df).first()
    assert (h.tei_title, h.tei_doi, h.tei_author, h.tei_pub_date) == ("The big title", "10.1/abc", "Nowak, Jan; Team X", "May 2001")
    one, two, three = refs.tei_references(df).orderBy("tei_ref_position").collect()
    assert (one.id, one.title, one.author, one.venue, one.volume, one.page, one.pub_date, one.type) == (
        "doi:10.5/q", "Art", "S, F", "Jour", "3", "1-9", "1999-01", "journal article"
    )
    assert (two.title, two.author, two.page, two.pub_date, two.publisher, two.editor, two.type) == (
        "Book", "Only Text", "5", "1987", "Pub", "E", "book"
    )
    assert two.id.startswith("temp:") and three.type == "other" and three.title is None
    assert [r.raw_reference for r in refs.raw_references(df).collect()] == ["Text of 1987 & more"]
    bare = spark.createDataFrame([("d", TEI.replace('type="raw_reference"', ""))], "identifier string, xml string")
    assert len(refs.raw_references(bare).collect()) == 2


def test_jats(spark):
    df = spark.createDataFrame([("d", JATS), ("bad", "<article><x>"), ("none", None)], "identifier string, xml string")
    good, bad = refs.split_malformed(df)
    assert sorted((r.identifier, r.error) for r in bad.collect()) == [
        ("bad", "document is not well-formed XML"), ("none", "no document")
    ]
    r = refs.parse_jats(good).first()
    assert (r.doi, r.publisher_id, r.article_title, r.year, r.keywords) == ("10.1/x", "77", "A b c", "2005", ["k1", "k2"])
    assert [tuple(a) for a in r.authors] == [("S", "G", "G S", None), ("T", None, "T", "0000")]
    assert [tuple(x) for x in r.references] == [("R1", "One two"), (None, "Three")]
    assert (r.pdf_urls, r.article_urls) == (["u1"], ["u2"])
    assert good.select(refs.document_language()).first()[0] == ["pl"]


def test_gold_references(spark):
    kind = "array<struct<ref_id:string,citation:string>>"
    df = spark.createDataFrame([("d", [("r1", "a"), ("r2", " "), (None, "c")]), ("n", None)], f"identifier string, references_gold {kind}")
    got = [tuple(r) for r in refs.gold_references(df, keep=["identifier"]).collect()]
    assert got == [("d", 1, "a", "r1"), ("d", 3, "c", None)]
    plain = spark.createDataFrame([("d", ["a", "", "c"])], "identifier string, references_gold array<string>")
    assert [tuple(r) for r in refs.gold_references(plain).collect()] == [(1, "a", None), (3, "c", None)]
    counts = refs.extracted_vs_gold(df.selectExpr("identifier", "references_gold AS g", "references_gold AS e"), "e", "g", ["identifier"])
    assert {r.identifier: (r.pdf_reference_count, r.pdf_gold_ratio) for r in counts.collect()} == {"d": (3, 1.0), "n": (0, None)}


def test_parsed_json(spark):
    data = [
        (1, '{"title":["T  one","x"],"author":[{"family":"F","given":"G"},{"family":"H"},"Plain name"],"date":["1999"],"container-title":"V","pages":[],"type":"book"}'),
        (2, '{"title":"plain"}'), (3, "{oops"), (4, None),
    ]
    df = spark.createDataFrame(data, "i int, parsed_json string")
    good, bad = refs.split_unparsed(df)
    assert sorted((r.i, r.error) for r in bad.collect()) == [(3, "parser output is not JSON"), (4, "no parser output")]
    got = {r.i: r for r in refs.completeness(refs.parsed_fields(good)).collect()}
    assert (got[1].title, got[1].author, got[1].pub_date, got[1].venue, got[1].page, got[1].type) == (
        "T one", "F, G; H; Plain name", "1999", "V", None, "book"
    )
    assert got[2].title == "plain" and got[2].author is None and (got[2].has_title, got[2].has_author) == (1, 0)


def test_jobs_need_path_and_ok(spark):
    cols = [f"{l}_{f}" for l in ("pl", "en") for f in ("view_url", "direct_pdf_url", "status", "filename", "path")]
    row = ("v", "d", "OK", "f", " p ") + ("v", "d", "http_404", "f", "q")
    df = spark.createDataFrame([("a", *row), ("b", *([None] * 10))], "identifier string, " + ", ".join(f"{c} string" for c in cols))
    assert [(r.identifier, r.lang, r.pdf_rel_path) for r in refs.jobs(df).collect()] == [("a", "pl", "p")]
    assert len(refs.jobs(df, only_ok=False).collect()) == 2
    assert refs.jobs(df, languages=["en"]).count() == 0


def test_completeness_rates_default_to_zero(spark):
    parsed = spark.createDataFrame([("a", 1, '{"title":"t"}'), ("a", 2, "{")], "identifier string, reference_index int, parsed_json string")
    articles = spark.createDataFrame([("a",), ("b",)], "identifier string")
    got = {r.identifier: r for r in refs.completeness_rates(refs.compare_sources({"g": parsed}), articles, {"gold": "g", "grobid": "h"}).collect()}
    assert (got["a"].gold_reference_count, got["a"].gold_has_title_rate, got["a"].grobid_has_title_rate) == (2, 0.5, 0.0)
    assert (got["b"].gold_reference_count, got["b"].gold_has_title_rate) == (0, 0.0)


REF = "i int, doi string, title string, author string, pub_date string, venue string, raw_reference string, type string"
CAND = f"query_key string, candidates array<{enrich.CANDIDATE}>, error string"


def test_enrichment(spark):
    base = ("A title of some length", "Nowak; X", "2001", "Venue", "raw", "book")
    data = [(1, "DOI:10.1/OWN", *base), (2, None, *base), (3, None, "Another", *base[1:]), (4, " ", None, None, None, None, "raw text", None),
            (5, None, "Tied title here", *base[1:])]
    df = spark.createDataFrame(data, REF)
    queries = {r.i: r.q for r in df.select("i", enrich.query_text().alias("q")).collect()}
    assert queries[2] == "A title of some length Nowak 2001 Venue" and queries[4] == "raw text"
    assert len(enrich.distinct_queries(df).collect()) == 4
    import hashlib

    key = lambda i: hashlib.md5(queries[i].encode()).hexdigest()
    good = ("10.2/good", "A title of some length", "Nowak", "2001", "Venue", "monograph", 1.0)
    near = ("10.2/near", "A title of some lengths", "Nowak", "2001", "Venue", "t", 1.0)
    no_doi = (None, "Another", "Nowak", "2001", "Venue", "t", 1.0)
    second = ("10.2/second", "Another", "Nowak", "1999", "Venue", "t", 1.0)
    tie = lambda d: (d, "Tied title here", "Nowak", "2001", "Venue", "t", 1.0)
    cands = spark.createDataFrame(
        [(key(2), [near, good], None), (key(3), [second, no_doi], None), (key(4), [], None), (key(5), [tie("10.2/t1"), tie("10.2/t2")], None)], CAND
    )
    scored = enrich.score_candidates(df, cands)
    got = {r.i: (r.doi_enriched, r.doi_source) for r in enrich.enrich(scored).collect()}
    assert got == {
        1: ("10.1/own", "existing"), 2: ("10.2/good", "crossref"),
        3: (None, "none"),  # the best candidate has no DOI; the acceptable second one does not count
        4: (None, "none"), 5: ("10.2/t1", "crossref"),
    }
    typed = {r.i: r.type for r in enrich.enrich(scored, prefer_provider_type=True).collect()}
    assert typed[2] == "monograph" and typed[1] == "book"
    diag = enrich.diagnostics(scored, ["i"]).collect()
    assert len(diag) == 6
    best = next(r for r in diag if r.crossref_doi == "10.2/good")
    assert best.crossref_match_score == pytest.approx(1.0) and best.accepted


def test_stored_responses(spark):
    page = '{"search-results":{"opensearch:totalResults":"3","entry":[{"eid":"e1","dc:title":"t","citedby-count":"4"},{"dc:title":"no id"}]}}'
    df = spark.createDataFrame([("q1", page), ("q1", page), ("q2", '{"search-results":{"opensearch:totalResults":"0"}}')], "issn_query string, page_json string")
    assert [(r.eid, r.title, r.citedby_count) for r in refs.search_rows(df).collect()] == [("e1", "t", 4.0)]
    assert {r.issn_query: r.total for r in refs.search_totals(df).collect()} == {"q1": 3, "q2": 0}
    ids = spark.createDataFrame([("i1", ["omid:br/2 doi:x", "omid:br/1"]), ("i2", ["doi:x"]), ("i3", None)], "issn string, ids array<string>")
    assert {r.issn: r.omids for r in refs.omids_of_responses(ids).collect()} == {"i1": ["br/1", "br/2"], "i2": None, "i3": None}
    assert {r.issn: r.omid for r in refs.omids_of_responses(ids, single=True).collect()}["i1"] == "br/2"


def test_comments_hold_no_elements(spark):
    xml = "<r><!-- <ref>no</ref> --><ref>a<!-- <ref> --></ref><![CDATA[<!--]]><ref>b</ref><!-- x\n--><ref>c</ref></r>"
    df = spark.createDataFrame([(xml,), (None,), ("",)], "xml string")
    assert [r.t for r in df.select(texts("xml", "ref").alias("t")).collect()] == [["a", "b", "c"], None, []]


HARD_TEI = """<t:TEI xmlns:t="http://www.tei-c.org/ns/1.0"><t:text><t:listBibl>
<t:biblStruct><t:analytic><t:title note="a > b"><![CDATA[<title>Tags & </biblStruct> in</title>]]> text</t:title></t:analytic>
<t:monogr><t:title level='j'>J</t:title><t:imprint><t:date when="2001"/></t:imprint></t:monogr>
<t:relatedItem><t:biblStruct><t:monogr><t:title>Inner</t:title></t:monogr></t:biblStruct></t:relatedItem>
<!-- <t:biblStruct><t:monogr/></t:biblStruct> --></t:biblStruct>
<t:biblStruct/></t:listBibl></t:text></t:TEI>"""
HARD_JATS = """<j:article xmlns:j="http://jats"><j:article-title>1 &lt; 2 <j:i>and</j:i> <![CDATA[<ref>]]></j:article-title>
<j:ref id="a > b"><j:mixed-citation>Outer <j:ref id="n"><j:mixed-citation>inner</j:mixed-citation></j:ref></j:mixed-citation></j:ref>
<j:ref id=""><j:mixed-citation><![CDATA[<b>x</b>]]></j:mixed-citation></j:ref></j:article>"""


def test_xml_as_a_parser_reads_it(spark):
    """CDATA that holds tags, ``>`` in attributes, nested elements of one name, prefixes, comments."""
    df = spark.createDataFrame([("d", HARD_TEI)], "identifier string, xml string")
    one, two = refs.tei_references(df).orderBy("tei_ref_position").collect()
    assert (one.title, one.venue, one.pub_date, one.type) == ("<title>Tags & </biblStruct> in</title> text", "J", "2001", "journal article")
    assert (two.title, two.type, two.raw_reference) == (None, "other", None)
    raw = refs.raw_references(df).collect()
    assert [r.raw_reference for r in raw] == ["<title>Tags & </biblStruct> in</title> text J Inner"]
    r = refs.parse_jats(spark.createDataFrame([("d", HARD_JATS)], "identifier string, xml string")).first()
    assert r.article_title == "1 < 2 and <ref>"
    assert [(x.ref_id, x.citation) for x in r.references] == [("a > b", "Outer inner"), (None, "<b>x</b>")]


def test_xml_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "<x>")], "identifier string, xml string")
    assert refs.tei_references(df).count() == refs.raw_references(df).count() == 0
    assert [r.tei_title for r in refs.tei_header(df).collect()] == [None] * 3
    assert [r.article_title for r in refs.parse_jats(df).collect()] == [None] * 3


def test_similarities_of_many_candidates(spark, capsys):
    texts = ["Zażółć  gęślą jaźń", "abc", "ABC x", "xabcy", "", None, "a" * 200 + "b" + "c" * 70, "a" * 190 + "d" + "c" * 70, "👍 abc"]
    df = spark.createDataFrame([(t, texts) for t in texts], "t string, ts array<string>").unionByName(
        spark.createDataFrame([("abc", None), ("abc", [])], "t string, ts array<string>")
    )
    both = df.select(
        "t", "ts", S.levenshtein_similarities("t", F.col("ts")).alias("got"),
        F.transform("ts", lambda o: S.levenshtein_similarity(F.col("t"), o)).alias("want"),
    )
    rows = both.collect()
    assert len(rows) == len(texts) + 2 and all(r.got == r.want for r in rows)
    # a plan works out the distances of a reference once, whatever is taken from them
    refs_df = spark.createDataFrame([(1, "T", "A", "2000", "V", None, "raw")], "i int, title string, author string, pub_date string, venue string, doi string, raw_reference string")
    cands = spark.createDataFrame([], CAND)
    enrich.diagnostics(enrich.score_candidates(refs_df, cands), ["i"]).filter("accepted").explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython [") == 1 and "levenshtein(" not in plan


def test_xml_is_read_some_documents_at_a_time(monkeypatch):
    made = []
    monkeypatch.setattr(xml.F, "arrow_udf", lambda f, kind: made.append(f) or (lambda c: c))
    monkeypatch.setattr(xml.F, "col", lambda c: c)
    monkeypatch.setattr(xml, "SLICE_BYTES", 100)
    xml.parsed("xml", lambda root: root.text, "string", broken="bad")
    documents = [f"<a>{'x' * 60}{i}</a>" for i in range(10)] + [None, "<a>", "<a>" + "y" * 500 + "</a>"]
    parts = list(made[0](iter([pa.array(documents), pa.array([], pa.string()), pa.array(["<a/>"])])))
    assert max(map(len, parts)) == 1
    assert [x for p in parts for x in p.to_pylist()] == [f"{'x' * 60}{i}" for i in range(10)] + [None, "bad", "y" * 500, None]
