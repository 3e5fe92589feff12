"""String, identifier, date and array functions as Spark expressions.

Every normaliser returns NULL for an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# White space as Unicode defines it plus the four ASCII separators; Java's plain \s is ASCII only.
WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

YEAR_PATTERN = r"(1[6-9]\d{2}|20\d{2}|21\d{2})"

# Word stems that mark a text as being about poetry.
POETRY_STEMS = [
    "poezj", "poet", "wiersz", "liry", "poemat", "sonet", "elegi", "hymn", "tren", "epigram",
    "frasz", "pieśn", "ballad", "satyr", "epos", "rapsod", "epitalam", "sielank", "limeryk",
    "dystych", "oktostych", "tercyn", "strof", "wers", "rym", "rytm", "metafor", "trop",
]

# Language codes accepted from the two kinds of repositories.
POLISH_CODES_JOURNALS = ["pol", "pl_PL", "Polski", "pl", "polski", "Pl", "PL"]
POLISH_CODES_LIBRARY = ["pol", "pl", "Pl", "Pol"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or NULL (Spark's own function gives '')."""
    return _null_if_empty(F.regexp_extract(c, pattern, group))


def clean_text(c: Column | str) -> Column:
    """Collapse white space, trim, NULL when nothing is left."""
    return _null_if_empty(F.trim(F.regexp_replace(_col(c).cast("string"), WHITESPACE, " ")))


def normalize_doi(c: Column | str) -> Column:
    """Lower case, without a leading resolver address or ``doi:`` label."""
    s = F.lower(clean_text(c))
    s = F.regexp_replace(s, r"^https?://(dx\.)?doi\.org/", "")
    s = F.regexp_replace(s, r"^doi:\s*", "")
    return _null_if_empty(F.trim(s))


def extract_doi(ids: Column | str) -> Column:
    """First ``doi:`` token of a space separated id list."""
    return _extract(_col(ids), r"(?i)doi:(\S+)")


def extract_omid(ids: Column | str) -> Column:
    """First ``omid:`` token of a space separated id list, without the prefix."""
    return _extract(_col(ids), r"(?:^| )omid:([^ ]+)")


def extract_omids(ids: Column | str) -> Column:
    """All ``omid:`` tokens, prefix removed, sorted; NULL if there is none."""
    tokens = F.filter(F.split(_col(ids), " "), lambda t: t.contains("omid:"))
    found = F.array_sort(F.transform(tokens, lambda t: F.replace(t, F.lit("omid:"), F.lit(""))))
    return F.when(F.size(found) > 0, found)


def extract_venue_omid(venue: Column | str) -> Column:
    """Venue identifier ``br/<digits>`` inside a venue text."""
    return _extract(_col(venue), r"omid:(br/\d+)")


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, dict[str, str]]:
    """Character folding generated from the Unicode data.

    Returns (from, to, expansions): ``translate`` arguments for the characters that fold to
    one kept character or (past the end of ``to``) to nothing, and the few that fold to
    several characters, such as ligatures and fractions.
    """
    keep = set("abcdefghijklmnopqrstuvwxyz0123456789&")
    single: dict[str, str] = {}
    dropped: list[str] = []
    expansions: dict[str, str] = {}
    for code in range(0x80, 0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        folded = "".join(
            x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)
        )
        folded = "".join(x if x in keep else " " for x in folded)
        if folded == "":
            dropped.append(ch)
        elif not folded.strip():
            continue
        elif len(folded) == 1:
            single[ch] = folded
        else:
            expansions[ch] = folded
    return "".join(single) + "".join(dropped), "".join(single.values()), expansions


def _cover(characters: list[str], gap: int = 40) -> str:
    """Character class of a few ranges around the characters (a quick test, not exact)."""
    codes = sorted(map(ord, characters))
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= gap:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def normalize_title(c: Column | str) -> Column:
    """Conservative title key: lower case, accents folded, ``&`` spelled out, only a-z and 0-9.

    Characters without a decomposition (such as the Polish l-stroke) become a space.
    """
    source, target, expansions = _folding_tables()
    s = F.lower(_col(c).cast("string"))
    expand_class = _cover(list(expansions))
    # one foldable expression instead of hundreds of literals
    entries = F.lit("|".join(f"{ch}={text}" for ch, text in expansions.items()))
    lookup = F.str_to_map(entries, F.lit("[|]"), F.lit("="))
    expanded = F.array_join(
        F.transform(F.split(s, ""), lambda ch: F.coalesce(F.try_element_at(lookup, ch), ch)), ""
    )
    s = F.when(s.rlike(expand_class), expanded).otherwise(s)
    s = F.when(s.rlike(r"[^\x00-\x7f]"), F.translate(s, source, target)).otherwise(s)
    s = F.replace(s, F.lit("&"), F.lit(" and "))
    return _null_if_empty(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def extract_year(c: Column | str) -> Column:
    """First plausible year (1600-2199) in a text, as text."""
    return _extract(_col(c).cast("string"), YEAR_PATTERN)


def safe_year(c: Column | str) -> Column:
    """Year of a date given as ``yyyy``, ``yyyy-MM``, ``yyyy-MM-dd`` or an integer year."""
    s = F.trim(_col(c).cast("string"))
    day = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy")])
    in_range = s.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")
    return F.when(in_range, F.year(day)).otherwise(
        F.year(F.try_to_timestamp(s))
    ).cast("int")


def pick_date(dates: Column | str) -> Column:
    """Earliest year in an array of date texts (``YYYY``, dotted, ISO, anything with four digits)."""
    def longest_part(d: Column) -> Column:
        # first of the longest dot-separated parts
        parts = F.transform(
            F.split(d, r"\."), lambda p, i: F.struct((-F.length(p)).alias("l"), i.alias("i"), p.alias("p"))
        )
        return F.array_min(parts)["p"]

    def year_of(d: Column) -> Column:
        text = (
            F.when(F.length(d) == 4, d)
            .when(d.contains("."), longest_part(d))
            .when(d.contains("-"), F.substring(d, 1, 4))
            .otherwise(F.regexp_extract(d, r"\d{4}", 0))
        )
        return text.try_cast("int")

    return F.array_min(F.transform(_col(dates), year_of))


def stable_id(doi: Column | str | None, *parts: Column | str, prefix: str = "temp") -> Column:
    """``doi:<doi>``, else ``temp:`` and 16 hex digits of the md5 of the non-empty parts."""
    key = F.concat_ws(" | ", *[clean_text(p) for p in parts])
    temp = F.concat(
        F.lit(f"{prefix}:"),
        F.substring(F.md5(F.coalesce(_null_if_empty(key), F.lit("empty"))), 1, 16),
    )
    if doi is None:
        return temp
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), temp)


def query_key(query: Column | str) -> Column:
    """Full md5 of the cleaned query text, the key of the candidates table."""
    return F.md5(F.coalesce(clean_text(query), F.lit("")))


def venue_name(venue: Column | str) -> Column:
    """Text before the bracketed ids of a venue or publisher."""
    return F.trim(F.split(_col(venue), r"\[")[0])


def venue_ids(venue: Column | str) -> Column:
    """What is left of a venue once its name is removed."""
    name = venue_name(venue)
    # replace() with an empty search text leaves the text alone
    return F.trim(F.replace(_col(venue), name, F.lit("")))


def extract_issn(ids: Column | str) -> Column:
    return _extract(_col(ids), r"issn:(.{4}-.{4})")


def format_issn(c: Column | str) -> Column:
    """Eight characters to ``dddd-dddd``."""
    s = _col(c)
    return F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, F.length(s)))


def page_range(first: Column | str, last: Column | str) -> Column:
    """``f-l``, or ``f`` alone, or NULL when there is no first page."""
    f, last_page = clean_text(first), clean_text(last)
    return F.coalesce(F.concat(f, F.lit("-"), last_page), f)


def normalize_orcid(c: Column | str) -> Column:
    s = F.regexp_replace(clean_text(c), r"https?://orcid\.org/", "")
    return _null_if_empty(F.regexp_replace(s, r"^/+|/+$", ""))


def authors_string(authors: Column | str, orcid: bool = False, built_names: bool = False) -> Column:
    """Author names joined by ``; ``.

    ``orcid`` adds ``[orcid:..]``; ``built_names`` makes a missing full name from given
    name and surname, or the surname alone.
    """
    def one(a: Column) -> Column:
        full = clean_text(a["full_name"])
        if built_names:
            surname = clean_text(a["surname"])
            given = clean_text(a["given_names"])
            full = F.coalesce(full, F.concat(given, F.lit(" "), surname), surname)
        if orcid:
            tag = F.concat(F.lit(" [orcid:"), normalize_orcid(a["orcid"]), F.lit("]"))
            full = F.concat(full, F.coalesce(tag, F.lit("")))
        return full

    names = F.filter(F.transform(_col(authors), one), lambda n: n.isNotNull())
    return _null_if_empty(F.array_join(names, "; "))


def first_author(authors: Column | str) -> Column:
    """Text before the first ``;``."""
    return clean_text(F.split(clean_text(authors), ";")[0])


def venue_with_issue(venue: Column | str, issue: Column | str) -> Column:
    v, i = clean_text(venue), clean_text(issue)
    return F.coalesce(F.concat(v, F.lit(" [issue:"), i, F.lit("]")), v)


def last_number(url: Column | str) -> Column:
    """Number that ends a URL, with or without a closing slash."""
    return _extract(_col(url), r"/(\d+)/?$").cast("bigint")


def split_by_last_number(urls: Column | str) -> Column:
    """(pl, en) links: smallest trailing number is Polish, the next one English."""
    keyed = F.array_sort(
        F.transform(
            _col(urls),
            lambda u, i: F.struct(last_number(u).alias("n"), i.alias("i"), u.alias("u")),
        )
    )
    return F.struct(
        F.try_element_at(keyed, F.lit(1))["u"].alias("pl"),
        F.try_element_at(keyed, F.lit(2))["u"].alias("en"),
    )


def edition_id(url: Column | str) -> Column:
    return _extract(_col(url), r"/edition/(\d+)/content")


def edition_url(url: Column | str) -> Column:
    """Download address of a digital-library edition."""
    return F.concat(
        F.lit("https://rcin.org.pl/Content/"), edition_id(url), F.lit("/download/")
    )


def mentions_any(columns: list[Column | str], stems: list[str] | None = None) -> Column:
    """True if any element of any of the array columns contains one of the stems."""
    pattern = "|".join(POETRY_STEMS if stems is None else stems)
    empty = F.array().cast("array<string>")
    texts = F.concat(*[F.coalesce(_col(c), empty) for c in columns])
    return F.exists(texts, lambda x: F.coalesce(F.lower(x).rlike(pattern), F.lit(False)))


def country_label(graph: Column | str) -> Column:
    """Label of the first node whose id lies in the country vocabulary."""
    nodes = F.filter(_col(graph), lambda n: n["id"].contains("id.loc.gov/vocabulary/countries"))
    return F.try_element_at(nodes, F.lit(1))["label"]


def number_or_zero(c: Column | str) -> Column:
    """Numeric coercion; what cannot be read counts as 0."""
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def first_containing(values: Column | str, needle: str) -> Column:
    return F.try_element_at(F.filter(_col(values), lambda v: v.contains(needle)), F.lit(1))


def any_contains(values: Column | str, needle: str) -> Column:
    return F.coalesce(F.exists(_col(values), lambda v: v.contains(needle)), F.lit(False))
