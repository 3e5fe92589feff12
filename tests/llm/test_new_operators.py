"""Merkle manifest, HTML extraction and tokenizer alignment against plain versions."""

import collections
import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citestat.llm import alignment, htmltext, merkle, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, digest string, kids string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def rows_of(spark, n, hot=20):
    """Repeated, tied, null and empty values; one source with most rows; clashing columns."""
    rows = [(i, f"text {i}\nline", "en", "hot" if i % hot else f"s{i}", i, 1, "d", "k", "p") for i in range(n)]
    rows += [(3, "text 3\nline", "en", "hot", 3, 1, "d", "k", "p")] * 2 + [(4, "other", None, "hot", None, 1, "d", "k", "p")]
    rows += [(None, None, None, None, None, 1, "d", "k", "p"), (7, "", "", "", 0, 1, "d", "k", "p"), (8, "x" * 200_000, "é", "é", 5, 1, "d", "k", "p")]
    return spark.createDataFrame(rows, DOCS)


def plain_manifest(rows, fan):
    def leaf(r):
        return sha(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.LEAF_COLUMNS])

    def climb(nodes):
        paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            joined, below = [], []
            for a in range(0, len(nodes), fan):
                run = nodes[a : a + fan]
                for j in range(len(run)):
                    for i in under[a + j]:
                        paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                joined.append(sha(*run))
                below.append(sum(under[a : a + fan], []))
            nodes, under = joined, below
        return nodes[0], paths

    by_source = collections.defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    trees = {s: climb([x[2] for x in sorted(found)]) for s, found in by_source.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, over = climb([trees[s][0] for s in names])
    return [
        (x[3], s, x[2], trees[s][0], root, tuple(path + over[k]))
        for k, s in enumerate(names) for x, path in zip(sorted(by_source[s]), trees[s][1], strict=True)
    ]


@pytest.mark.parametrize(("n", "fan", "depth"), [(120, 3, 6), (120, 3, 2), (40, 2, 1), (0, 4, 3)])
def test_manifest(spark, n, fan, depth):
    docs = rows_of(spark, n).repartition(3)
    found = merkle.manifest(docs, fan=fan, depth=depth).collect()
    got = [
        (r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"])) for r in found
    ]
    key = lambda r: (r[2], str(r[5]))
    assert sorted(got, key=key) == sorted(plain_manifest([r.asDict() for r in docs.collect()], fan), key=key)


def test_manifest_shows_changes(spark):
    docs = rows_of(spark, 50)
    found = merkle.manifest(docs.withColumn("other", merkle.leaf_digest(replaced={"lang": F.lit("xx")})), keep=("other",))
    marks = found.select(merkle.verified(found, F.col("leaf")).alias("same"), merkle.verified(found, F.col("other")).alias("changed")).collect()
    assert len(marks) == docs.count() and all(r["same"] and not r["changed"] for r in marks)


def test_manifest_of_little(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.manifest(rows_of(spark, 50).filter("doc_id = 40")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["path"] == []


STORY = "".join(f"<p>A paragraph {i} of the story, with words enough to count as the text of a page, and &amp;amp; more.</p>" for i in range(4))
STORY_TEXT = "\n".join(f"A paragraph {i} of the story, with words enough to count as the text of a page, and &amp; more." for i in range(4))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<!-- <p>never closed", ""), ("<script>if (a < b) '<p>x</p>'", ""),
        (f"<title>t</title><nav><a>x</a></nav><article><h1>Head</h1>{STORY}<p>To.</p></article><footer>y</footer>", f"Head\n{STORY_TEXT}\nTo."),
        ("<article><h1>T</h1><p>To.</p></article>", "T\nTo."),
        (f"<div class='nav-menu'><a>One</a><a>Two</a></div><div id=content><h1>Head</h1>{STORY}<p>To.</p></div>"
         f"<div id='comments'><h3>Comments</h3>{STORY}</div><div class='sideBar'>{STORY}</div>", f"Head\n{STORY_TEXT}\nTo."),
        (f"<body><div><a href=1>Home</a> | <a href=2>News</a></div><div><h1>Head</h1>{STORY}<p>Short.</p></div><div>Copyright</div>",
         f"Head\n{STORY_TEXT}\nShort."),
        (f"<main><header><h1>Title</h1><p>by X</p></header>{STORY}<aside>also</aside><blockquote>Said</blockquote><form><input>Mail</form>"
         f"<section><article class=comment>{STORY}</article></section></main>", f"Title\n{STORY_TEXT}\nSaid"),
        ("<article><p><b>One<br>two &lt;3&nbsp;&#x41;\n x<p>three<ul><li>a<li>b</ul><div class=ad>Buy</div><p>end", "One two <3 A x\nthree\na\nb\nend"),
        ("<article><p title='a > b'>One</p><!-- <p>no</p> --><style>p{}</style><p hidden>no</p><p>Two</p></div></article>", "One\nTwo"),
        ("<article><p>a &copy; 2 < 3</p></article>", "a © 2 < 3"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_extract(spark):
    pages = spark.createDataFrame(
        [(1, f"<article>{STORY}</article>", "u", "x")] * 2 + [(None, None, None, None), (2, "<article><p>é" + "word " * 300_000, "u", "x")],
        "page_id bigint, html string, url string, text string",
    )
    found = htmltext.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0), r["n_chars"], r["text"][:20]) for r in found.collect())
    assert got == [(0, 0, ""), (1, len(STORY_TEXT), STORY_TEXT[:20]), (1, len(STORY_TEXT), STORY_TEXT[:20]), (2, 1_500_000, "éword word word word")]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    """Every page's article, found by a plain cut of the known template."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.QUERIES["op12_html_extraction"](spark, DATA).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def plain_alignment(texts):
    folder = alignment.TOKENIZERS
    tokenizer = Tokenizer.from_file(f"{folder}/{alignment.BYTE_FILE}")
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{alignment.PIECE_FILE}")
    known_a = alignment.ByteVocabulary(f"{folder}/{alignment.BYTE_FILE}").bytes
    known_b = alignment.PieceVocabulary(f"{folder}/{alignment.PIECE_FILE}").bytes
    rows, counts, all_links = [], collections.Counter(), []
    for text in texts:
        a = b = []
        if text:
            a, b, whole = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text), (" " + text).encode()
            if b"".join(known_a[i] for i in a) != whole or b"".join(known_b[i] for i in b) != whole:
                a = b = []
        spans = []
        for ids, known in ((a, known_a), (b, known_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at + len(known[i]), i))
                at += len(known[i])
            spans.append(found)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links, before = [], [], 0
        for cut in cuts:
            x, y = [[s for s in side if before <= s[0] and s[1] <= cut] for side in spans]
            groups.append("|".join(",".join(str(s[2]) for s in side) for side in (x, y)))
            links += [(s[2], t[2]) for s in x for t in y if max(s[0], t[0]) < min(s[1], t[1])]
            before = cut
        counts.update(set(links))
        all_links.append(links)
        rows.append((len(a), len(b), len(groups), len(links), ";".join(groups)))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (*r[:4], sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), r[4], sha(r[4]) if r[4] else "")
        for r, links in zip(rows, all_links, strict=True)
    ]


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 300])
def test_alignment(spark, block_bytes):
    texts = [
        None, "", " ", "  a  b ", "x▁ y", "\n\n  z\t\tq<|endoftext|> <s> </s><0x0A>", "日本語 テキスト 😀😀 é", " x 　 y", "a" * 3000,
        "\x00 b", " 's don't  I'LL", "1 234  5,6", "one two three", "one two three", "one two four", "w " * 2000,
    ]
    schema = "doc_id bigint, text string, block int, pairs string, a int"
    docs = spark.createDataFrame([(None if i == 12 else i, t, 1, "x", 2) for i, t in enumerate(texts)], schema)
    found = alignment.alignment(docs.coalesce(2), keep_groups=True, block_bytes=block_bytes).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    got = {12 if r["doc_id"] is None else r["doc_id"]: tuple(r[n] for n in names) for r in found}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_alignment_of_little(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    one = alignment.alignment(spark.createDataFrame([("x", None)], "doc_id string, text string")).collect()
    assert [tuple(r) for r in one] == [("x", 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], plain_alignment([r["text"] for r in docs]), strict=True))
    for r in queries.QUERIES["op13_tokenizer_alignment"](spark, DATA).collect():
        w = want[r["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (*w[:6], w[7])
