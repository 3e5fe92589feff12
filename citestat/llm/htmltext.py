"""Main text of web pages by the distribution of text over blocks of lines.

A page's markup is stripped into lines, one per block element, in page order; what is not shown or is
marked as something beside the article (scripts, menus, forms, adverts, comments, ...) leaves an empty line.
A line's length is its text outside links. The lengths are summed over sliding windows of lines: where the
sum surges above a threshold the main text begins, where it dives to nothing it ends, and what lies between
is kept, however short the single lines are. Lines of an ``article`` or ``main`` element count as long as
the threshold, so a page that marks its article keeps all of it and nothing else.

Broken markup is read as browsers do as far as the lines need it: unclosed elements end with the one
around them, a new block ends an open paragraph, an end tag without a start is ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citestat.llm.common import col

#: Lines that a window sums up.
WINDOW = 3
#: Characters of a window from which on it is main text.
SURGE = 80
#: Share of a line's characters in links from which on the line is a menu.
LINKED = 0.5

# fixed values: elements of HTML by what they do to the lines
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot "
    "thead tr ul".split()
)
CELLS = frozenset(["td", "th", "br"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that hold no part of an article.
OUTSIDE = frozenset(
    "applet aside audio button canvas datalist dialog footer form head iframe input math menu nav noembed noframes noscript "
    "object option script search select style svg template textarea title video".split()
)
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class and id names of what is no part of an article.
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial adbox adslot banner breadcrumb breadcrumbs byline comment "
    "comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer footnav gdpr header hidden login masthead "
    "menu menus modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination paywall popup privacy "
    "promo promoted promotion recommendations recommended related replies reply respond responses search share sharing sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending widget widgets".split()
)
#: Reader comments are no article even where they are marked up as one.
COMMENT_NAMES = frozenset("comment comments commentlist disqus discussion replies reply respond responses".split())
#: An open element of the first kind ends where one of the second kind begins, up to one of the third.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPES = frozenset(["article", "main", "section", "div", "body", "html", "table", "td", "th", "blockquote", "li", "header", "footer", "aside", "nav", "form"])

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<tag>/?[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<loose>/?[A-Za-z][^\s/>]*)(?P<tail>[^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line(NamedTuple):
    text: str
    linked: int
    heading: bool
    marked: bool
    parent: int


def _attributes(rest: str) -> dict[str, str]:
    if "=" not in rest and "hidden" not in rest:
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(rest)))}


def _outside(tag: str, rest: str) -> bool:
    """Whether the element is no part of an article by its name, role, class, id or style."""
    if tag in OUTSIDE:
        return True
    if tag in ("html", "body"):
        return False
    found = _attributes(rest)
    if "hidden" in found or found.get("aria-hidden") == "true" or _UNSHOWN.search(found.get("style", "")):
        return True
    given = f"{found.get('class', '')} {found.get('id', '')}"
    names = {w.lower() for w in [*_NAME_PARTS.findall(given), *re.findall("[A-Za-z]+", given)]}
    if tag in ("article", "main") or names & {"content", "article", "story", "post"} and not names & {"ad", "ads", "sidebar", "advert"}:
        return bool(names & COMMENT_NAMES)
    return found.get("role", "").lower() in OUTSIDE_ROLES or bool(names & OUTSIDE_NAMES)


def lines(page: str) -> list[Line]:
    """The lines of a page; an empty one stands where something beside the article was."""
    out: list[Line] = []
    open_tags: list[str] = ["html"]
    blocks: list[int] = [0]  # per open element the number of the block it is in
    texts: list[str] = []
    state = {"linked": 0, "outside": 0, "marked": 0, "count": 0, "a": 0}
    heads = 0  # where a header inside an article began; only its headings are kept

    def end_line() -> None:
        # white space inside a block is one space
        text = " ".join("".join(texts).split())
        texts.clear()
        if text:
            heading = any(t in HEADINGS for t in open_tags[-3:])
            if not (heads and not heading):
                out.append(Line(text, state["linked"], heading, bool(state["marked"]), blocks[-1]))
        state["linked"] = 0

    def gap() -> None:
        if out and out[-1].text:
            out.append(Line("", 0, False, False, -1))

    def close_to(depth: int) -> None:
        nonlocal heads
        while len(open_tags) > depth:
            tag = open_tags[-1]
            if tag in BLOCKS and not state["outside"]:
                end_line()
            open_tags.pop()
            blocks.pop()
            if tag == "a":
                state["a"] -= 1
            if state["outside"] > len(open_tags):
                state["outside"] = 0
            if heads > len(open_tags):
                heads = 0
            if state["marked"] > len(open_tags):
                state["marked"] = 0

    def take(text: str) -> None:
        if text and not state["outside"]:
            text = html.unescape(text)
            texts.append(text)
            if state["a"]:
                state["linked"] += len("".join(text.split()))

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        take(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = m["tag"] or m["loose"]
        if not name:
            continue
        tag, rest = name.lower(), m["rest"] if m["tag"] else m["tail"]
        if tag[0] == "/":
            tag = tag[1:]
            if tag in open_tags[1:]:
                close_to(len(open_tags) - 1 - open_tags[::-1].index(tag))
            elif tag == "p" and not state["outside"]:
                end_line()
            continue
        if tag in CELLS:
            texts.append(" ")
        if tag in VOID:
            if tag == "hr" and not state["outside"]:
                end_line()
            continue
        if tag in RAW:
            # what a browser doesn't read as markup, up to the end tag or the end of the page
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in ENDED_BY:
            ended, up_to = ENDED_BY[tag]
            k = len(open_tags) - 1
            while k > 0 and open_tags[k] not in up_to and open_tags[k] not in ended:
                k -= 1
            if k > 0 and open_tags[k] in ended:
                close_to(k)
        if tag in BLOCKS:
            k = len(open_tags) - 1
            while k > 0 and open_tags[k] != "p" and open_tags[k] not in SCOPES:
                k -= 1
            if k > 0 and open_tags[k] == "p":
                close_to(k)
            if not state["outside"]:
                end_line()
        open_tags.append(tag)
        state["count"] += tag in BLOCKS
        # a paragraph belongs to the block around it
        blocks.append(state["count"] if tag in SCOPES else blocks[-1])
        if tag == "a":
            state["a"] += 1
        if state["outside"] or heads:
            continue
        if tag == "header" and state["marked"]:
            heads = len(open_tags)
        elif tag == "header" or _outside(tag, rest or ""):
            if tag in BLOCKS:
                gap()
            state["outside"] = len(open_tags)
        elif tag in ("article", "main") and not state["marked"]:
            state["marked"] = len(open_tags)
    close_to(0 if state["outside"] else 1)
    if not state["outside"]:
        end_line()
    return out


def main_lines(found: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[int]:
    """Places of the lines that are main text."""
    marked = [i for i, x in enumerate(found) if x.text and x.marked]
    lengths = []
    for x in found:
        n = len("".join(x.text.split()))
        own = 0 if n and x.linked > LINKED * n and not x.marked else n - x.linked
        lengths.append(max(own, surge) if x.marked and x.text else 0 if marked else own)
    # sums over sliding windows, a gap ending what comes before it
    kept: list[int] = []
    i, n = 0, len(found)
    while i < n:
        if sum(_reach(lengths, found, i, window)) < surge or not lengths[i]:
            i += 1
            continue
        # surge: from here on, up to where nothing follows
        end = i
        while end < n and found[end].text and (lengths[end] or sum(_reach(lengths, found, end, window)) >= surge):
            end += 1
        start = i
        while start > 0 and found[start - 1].text and found[start - 1].heading and not marked:
            start -= 1
        kept += _trimmed(found, lengths, start, end, surge)
        i = max(end, i + 1)
    return [i for i in kept if not (marked and not found[i].marked)]


def _reach(lengths: list[int], found: list[Line], i: int, window: int) -> Iterator[int]:
    for k in range(i, min(i + window, len(found))):
        if not found[k].text:
            return
        yield lengths[k]


def _trimmed(found: list[Line], lengths: list[int], start: int, end: int, surge: int) -> list[int]:
    """Without short lines at either end that are in another element than the longest lines."""
    at = range(start, end)
    long = min(surge, max(lengths[i] for i in at) / 2)
    homes = {found[i].parent for i in at if lengths[i] >= long}
    stay = lambda i: lengths[i] >= long or found[i].marked or found[i].heading or found[i].parent in homes
    while start < end and not stay(start):
        start += 1
    while start < end and (not stay(end - 1) or found[end - 1].heading and not found[end - 1].marked):
        end -= 1
    return list(range(start, end))


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of a page, one block a line; '' for null and for pages without any."""
    found = lines(page or "")
    return "\n".join(found[i].text for i in main_lines(found, window, surge))


def extract(pages: DataFrame, html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """All columns of ``pages`` but the html, with text and n_chars (its code points).

    A page without main text, a null or empty one, has the empty text and 0. Repeated rows stay. Columns of
    the input that are named text or n_chars are replaced. An empty table gives none.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), window, surge) for page in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*[f"c{i}" for i in range(len(kept))], "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([*[f"c{i} {kinds[c]}" for i, c in enumerate(kept)], "text string", "n_chars bigint"])
    found = pages.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kept)], col(html_col)).mapInArrow(run, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")
