import pytest
from pyspark.sql import functions as F

from citestat import sources
from citestat.operators import census, counts, selection, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_first_orders_nulls_last(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 2, "y"), ("a", 1, "z"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    got = tables.keep_first(df, ["k"], ["o"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, "z"), (None, 4, "m")], key=str)


def test_one_to_one(spark):
    df = spark.createDataFrame([("a1", "b1"), ("a1", "b2"), ("a2", "b1"), ("a3", "b3")], "a string, b string")
    assert rows(tables.one_to_one(df, "a", "b", ["a", "b"])) == [("a1", "b1"), ("a3", "b3")]


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_duplicate_report(spark, chunk):
    df = spark.createDataFrame([(1, None)] * 5 + [(2, "x")] * 2 + [(3, "y")], "a int, b string")
    got = sorted(map(tuple, tables.duplicate_report(df, chunk).collect()))
    assert got == [(1, None)] * 5 + [(2, "x")] * 2


def test_validated_join_refuses_repeats(spark):
    left = spark.createDataFrame([(" k", 1)], "key string, a int")
    right = spark.createDataFrame([("k", 2)], "key string, b int")
    assert rows(tables.validated_left_join(left, right, ["key"])) == [("k", 1, 2)]
    with pytest.raises(ValueError):
        tables.validated_left_join(left, right.union(right), ["key"])


def test_lookups(spark):
    table = spark.createDataFrame([("i1", 7), ("i2", None)], "issn string, n int")
    df = spark.createDataFrame([(1, "i1", "i2"), (2, "i2", "i1"), (3, "x", "i1"), (4, None, None)], "id int, issn string, e string")
    got = tables.lookup_with_fallback(df, "issn", "e", table, "issn", "n", "c", F.lit(0))
    # a known key with a missing value does not fall back
    assert {r.id: r.c for r in got.collect()} == {1: 7, 2: None, 3: 7, 4: 0}
    last = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), (None, "z", 3)], "k string, v string, p int")
    assert rows(tables.last_value_map(last, "k", "v", "p")) == [("k", "new")]


def test_numbering_any_partitioning(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("x")).repartition(13)
    got = {r.x: r.internal_id for r in tables.number_rows(df, ["x"]).collect()}
    assert got == {i: i + 1 for i in range(500)}


def test_first_non_null(spark):
    df = spark.createDataFrame([("g", 2, "b", None), ("g", 1, None, None), ("h", 1, None, "q")], "k string, p int, v string, w string")
    got = {r.k: (r.v, r.w) for r in tables.first_non_null(df, ["k"], "p", ["v", "w"]).collect()}
    assert got == {"g": ("b", None), "h": (None, "q")}


def test_top_n_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 5.0), (4, 1.0)], "id int, v double")
    assert [r.id for r in tables.top_n(df, "v", 3, ["id"]).collect()] == [2, 3, 4]
    assert [r.id for r in tables.top_n(df, "v", 4, ["id"], ascending=True).collect()] == [4, 2, 3, 1]


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert sources.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        sources.require_columns(df, ["c", "a", "b"])


def test_result_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["x", "y"], 'q "z"'), (2, "b", None, "")], "i int, s string, l array<string>, t string")
    path = str(tmp_path / "out")
    sources.write_result(df, path, ["s", "i", "l", "t"])
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == ["s", "i", "l", "t"]
    got = {r.i: tuple(x or "" for x in r) for r in back.collect()}
    assert got == {"1": ("", "1", '["x","y"]', 'q "z"'), "2": ("b", "2", "", "")}


def test_xml_and_documents(spark, tmp_path):
    (tmp_path / "a.tei.xml").write_text("<r><x>1</x></r>", encoding="utf-8")
    (tmp_path / "b.xml").write_text("<r><x>2</x></r>", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    assert rows(sources.read_xml_documents(spark, str(tmp_path))) == [("a", "<r><x>1</x></r>"), ("b", "<r><x>2</x></r>")]


def test_selection(spark):
    cur = spark.createDataFrame([(" J ", "P ", 3, None), ("K", "P", 1, "wrong")], "journal string, publisher string, count long, false_info string")
    art = spark.createDataFrame([(1, "J", "P"), (2, "K", "P"), (3, "J", None)], "id int, venue_name string, publisher_name string")
    assert [r.id for r in selection.allowed_pairs(art, cur).collect()] == [1]
    dump = spark.createDataFrame([("N [omid:br/1]",), ("N [omid:br/12]",), (None,)], "venue string")
    ids = spark.createDataFrame([("br/1",), ("br/1",)], "venue_omid string")
    assert [r.venue for r in selection.rows_of_venues(dump, ids).collect()] == ["N [omid:br/1]"]
    j = spark.createDataFrame([("Poland", "quality"), ("Poland", "Lit"), (None, "lit"), ("Poland", None)], "c string, k string")
    assert rows(selection.country_and_keyword(j, "c", "Poland", "k", "lit")) == [("Poland", "quality")]
    marked = spark.createDataFrame([(1, " X "), (2, "no"), (3, None)], "id int, `the same` string")
    assert [r.id for r in selection.manually_accepted(marked).collect()] == [1]
    cites = spark.createDataFrame([("a", "b"), ("c", "c")], "citing string, cited string")
    kept, own = selection.split_self_citations(cites)
    assert rows(kept) == [("a", "b")] and rows(own) == [("c", "c")]


def test_journal_flags(spark):
    df = spark.createDataFrame([(True, 0), (True, 3), (False, 5)], "i boolean, c int")
    got = [r[0] for r in df.select(selection.journal_category("i", "c")).collect()]
    assert got == ["in OpenCitations but 0 citations", "cited in OpenCitations", "no data in OpenCitations"]
    df = spark.createDataFrame([(1, None), (None, 0), (None, None), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(selection.more_in_first("a", "b")).collect()] == [True, False, False, False]


def test_venue_totals(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", None), (2, "c", None), (None, "d", 9)], "venue_internal_id long, article_omid string, citedby_count long")
    assert rows(counts.venue_totals(df)) == [(1, 2, 2, 1.0), (2, 1, 0, 0.0)]


def test_census_counts_rows_once(spark):
    dump = spark.createDataFrame(
        [("f1", "A [issn:1111-2222]", "x"), ("f1", "A [issn:1111-2222]", "x"), ("f1", "B [issn:1111-2222]", "x"),
         ("f2", "A [issn:1111-2222]", None), ("f2", "none", "x"), ("f2", None, "x")],
        "file string, venue string, type string",
    )
    got = census.issn_census(dump).collect()
    assert [(r.issn, r.venue_name, r.type, r.issn_count, r.issn_count_legacy) for r in got] == [("1111-2222", "A", "x", 4, 7)]


def test_reduce_titles(spark):
    df = spark.createDataFrame(
        [(1, "T", None, "b"), (2, "T", "i2", "a"), (3, "T", "i3", "b"), (4, None, "i4", None)],
        "pos int, title string, issn string, discipline string",
    )
    got = {r.title: (r.issn, r.discipline) for r in census.reduce_titles(df, "pos").collect()}
    assert got == {"T": ("i2", "a|b"), None: ("i4", "")}
