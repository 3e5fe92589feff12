import random

import pytest
from pyspark.sql import functions as F

import models
from citestat.functions import similarity as S
from citestat.functions import text as X


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make("v").alias("o")).collect()]


def test_clean_text(spark):
    given = ["  a   b\t\nc ", " ", "", None, "x\x1cy"]
    assert column(spark, given, X.clean_text) == ["a b c", None, None, None, "x y"]


def test_normalize_doi(spark):
    given = ["https://doi.org/X", "http://dx.doi.org/X", "DOI: X", " ", None, "doi:10.1/A b"]
    assert column(spark, given, X.normalize_doi) == ["x", "x", "x", None, None, "10.1/a b"]


def test_normalize_title(spark):
    given = ["Été à l’école", "łódź", "A & B", "“x” – y — z‐w", "!!!", None, "ﬁne ½ x²", "ét", "＆", "Straße"]
    want = ["ete a l ecole", "odz", "a and b", "x y z w", None, None, "fine 1 2 x2", "et", "and", "stra e"]
    assert column(spark, given, X.normalize_title) == want


def test_safe_year(spark):
    given = ["2019", "2019-05", "2019-05-31", "soon", "2019-13", None, "  1999 "]
    assert column(spark, given, X.safe_year) == [2019, 2019, 2019, None, None, None, 1999]
    assert column(spark, [2019, 1500], X.safe_year, "int") == [2019, 1500]


def test_extract_year(spark):
    given = ["in 1599 or 1987", "2199", "2200", "year 20190", None]
    assert column(spark, given, X.extract_year) == ["1987", "2199", None, "2019", None]


def test_pick_date(spark):
    given = [["2013-07-29T11:07:01Z", "1995"], ["12.05.2001"], ["x 1999 y"], [], None, ["2001", "1990-01-01"]]
    assert column(spark, given, X.pick_date, "array<string>") == [1995, 2001, 1999, None, None, 1990]


def test_ids(spark):
    ids = ["doi:10.1/a omid:br/2 omid:br/1", "openalex:W1", None, "omid:br/9"]
    assert column(spark, ids, X.extract_doi) == ["10.1/a", None, None, None]
    assert column(spark, ids, X.extract_omid) == ["br/2", None, None, "br/9"]
    assert column(spark, ids, X.extract_omids) == [["br/1", "br/2"], None, None, ["br/9"]]
    venue = ["Name [omid:br/07 issn:1234-567X]", "[issn:1-2]", "Plain", None]
    assert column(spark, venue, X.venue_name) == ["Name", "", "Plain", None]
    assert column(spark, venue, X.venue_ids) == ["[omid:br/07 issn:1234-567X]", "[issn:1-2]", "", None]
    assert column(spark, venue, X.extract_issn) == ["1234-567X", None, None, None]
    assert column(spark, ["1234567X", None], X.format_issn) == ["1234-567X", None]


def test_stable_id(spark):
    import hashlib

    df = spark.createDataFrame([("DOI:A", "x", None), (None, " x ", "y"), (" ", None, "")], "d string, a string, b string")
    got = [r[0] for r in df.select(X.stable_id("d", "a", "b")).collect()]
    md5 = lambda s: "temp:" + hashlib.md5(s.encode()).hexdigest()[:16]
    assert got == ["doi:a", md5("x | y"), md5("empty")]


def test_page_and_authors(spark):
    df = spark.createDataFrame([("1", "9"), ("1", " "), (None, "9")], "f string, l string")
    assert [r[0] for r in df.select(X.page_range("f", "l")).collect()] == ["1-9", "1", None]
    people = [[("S", "G", "G S", "https://orcid.org/0000-1/"), ("T", "H", None, None), ("U", None, " ", None)], [], None]
    kind = "array<struct<surname:string,given_names:string,full_name:string,orcid:string>>"
    assert column(spark, people, X.authors_string, kind) == ["G S", None, None]
    assert column(spark, people, lambda c: X.authors_string(c, orcid=True), kind) == ["G S [orcid:0000-1]", None, None]
    assert column(spark, people, lambda c: X.authors_string(c, built_names=True), kind) == ["G S; H T; U", None, None]
    assert column(spark, ["A B; C", None, ";"], X.first_author) == ["A B", None, None]


def test_language_split(spark):
    urls = [["https://x/view/1/30", "https://x/view/1/7/"], ["https://x/1/5"], [], None]
    got = column(spark, urls, X.split_by_last_number, "array<string>")
    assert [(r.pl, r.en) for r in got] == [
        ("https://x/view/1/7/", "https://x/view/1/30"), ("https://x/1/5", None), (None, None), (None, None)
    ]


def test_keywords_and_edition(spark):
    df = spark.createDataFrame([(["o Poezji"], None), (["xyz"], ["SONETY"]), (["abc"], []), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.mentions_any(["a", "b"])).collect()] == [True, True, False, False]
    urls = ["https://rcin.org.pl/dlibra/publication/1/edition/22/content", "https://x"]
    assert column(spark, urls, X.edition_url) == ["https://rcin.org.pl/Content/22/download/", None]


@pytest.mark.parametrize("seed", range(3))
def test_similarities(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdł ") for _ in range(rng.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(60)] + [("", ""), ("a", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.orderBy("i").select(
        S.indel_ratio("a", "b"), S.indel_ratio_native("a", "b"), S.levenshtein_similarity("a", "b")
    ).collect()
    for (a, b), (arrow, native, lev) in zip(pairs, got):
        assert arrow == pytest.approx(models.ratio(a, b))
        assert native == pytest.approx(models.ratio(a, b))
        clean = [" ".join(t.split()) for t in (a, b)]
        assert lev == pytest.approx(models.similarity(*clean))


def test_slot(spark):
    row = lambda y, v: (y, v, None, "")
    kind = "struct<pub_date:string,volume:string,issue:string,page:string>"
    df = spark.createDataFrame(
        [(0, row("2001", "1"), row("x 2001", "1")), (1, row("2001", None), row("2001", " ")), (2, row(None, "1"), row(None, "1"))],
        f"i int, a {kind}, b {kind}",
    )
    got = [r[0] for r in df.orderBy("i").select(S.same_slot(lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}"))).collect()]
    assert got == [True, True, False]


@pytest.mark.parametrize("alphabet", ["ab", "abcde é漢😀", "abcdefghijklmnopqrstuvwxyz "])
@pytest.mark.parametrize("cells,small", [(4_000_000, 200), (9_000, 1), (4_000_000, 10**9)])
def test_common_subsequences_of_many_pairs(monkeypatch, alphabet, cells, small):
    monkeypatch.setattr(S, "BATCH_CELLS", cells)
    monkeypatch.setattr(S, "SMALL_BATCH", small)
    rng = random.Random(3)
    a, b = (
        ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 62, 63, 64, 126, 127, 150]))) for _ in range(60)]
        for _ in range(2)
    )
    assert S.common_subsequences(a, b).tolist() == [models.lcs(x, y) for x, y in zip(a, b)]
    assert S.common_subsequences([], []).tolist() == []


@pytest.mark.parametrize("alphabet", ["ab", "abcde é漢😀\0"])
def test_common_subsequences_of_packed_texts(alphabet):
    rng = random.Random(4)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7, 62, 63, 64, 150]))) for _ in range(40)]
    packed = S.PackedTexts(texts)
    for x in [*texts[:15], "unknown z"]:
        assert packed.common(x).tolist() == [models.lcs(x, y) for y in texts]
    assert S.PackedTexts(["", ""]).common("ab").tolist() == [0, 0]
