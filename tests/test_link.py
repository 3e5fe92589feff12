import hashlib
import random

import numpy as np
import pandas as pd
import pytest

import models
from citestat.functions import similarity as S
from citestat.operators import link

A = "article_omid string, venue_internal_id long, venue_name string, title string, pub_date string, id string, citedby_count string"
B = "eid string, venue_internal_id long, publication_name string, title string, doi string, cover_date string, citedby_count string"


def sources(spark, left, right):
    """left: (id, venue, title, year, doi), right the same."""
    a = spark.createDataFrame([(i, v, "J", t, y, f"omid:{i}" + (f" doi:{d}" if d else ""), "1") for i, v, t, y, d in left], A)
    b = spark.createDataFrame([(i, v, "J", t, d, y, "2") for i, v, t, y, d in right], B)
    return link.prepare_a(a).repartition(3), link.prepare_b(b).repartition(3)


def pairs(df):
    return sorted((r.article_id_oc, r.article_id_scopus) for r in df.collect())


def test_missing_keys_never_match(spark):
    a, b = sources(spark, [("a1", 1, "x", "2000", None)], [("b1", 1, "y", "2000", None)])
    assert pairs(link.match_doi(a, b)) == []
    assert pairs(link.match_doi(a, b, legacy_null_match=True)) == [("a1", "b1")]


def test_doi_stage_is_one_to_one(spark):
    left = [("a1", 1, "x", "2000", "D"), ("a2", 1, "x", "2000", "d"), ("a3", 2, "x", "2000", "D"), ("a4", 1, "q", "2000", "E")]
    right = [("b1", 1, "y", "2001", "https://doi.org/D"), ("b2", 1, "y", "2001", "d"), ("b3", 1, "z", "1999", "e")]
    assert pairs(link.match_doi(*sources(spark, left, right))) == [("a1", "b1"), ("a4", "b3")]


def brute_stage(left, right, key):
    """Merge on a key in row order, then first per left id, then first per right id."""
    found = [(x[0], y[0]) for x in sorted(left) for y in sorted(right) if key(x) is not None and key(x) == key(y)]
    first = dict(reversed(found))
    used, out = set(), []
    for x, y in sorted(first.items()):
        if y not in used:
            used.add(y)
            out.append((x, y))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_exact_stage_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def side(tag):
        return [
            (f"{tag}{i:02d}", rng.choice([1, 2, None]), rng.choice(["t", "u", "v"]), rng.choice(["2000", "2001"]), rng.choice(["d", "e", None, None]))
            for i in range(25)
        ]

    left, right = side("a"), side("b")
    a, b = sources(spark, left, right)
    doi = lambda r: (r[1], r[4]) if None not in (r[1], r[4]) else None
    title = lambda r: r[1:4] if None not in r[1:4] else None
    assert pairs(link.match_doi(a, b)) == brute_stage(left, right, doi)
    assert pairs(link.match_title_year(a, b)) == brute_stage(left, right, title)


@pytest.mark.parametrize("seed,tile", [(0, 4000), (1, 3), (2, 1), (3, 7), (4, 2)])
def test_fuzzy_stage_against_greedy_loop(spark, seed, tile):
    rng = random.Random(seed)
    stems = ["the history of modern polish poetry and its many readers number", "a short note", "on wonders of reading"]

    def title():
        t = rng.choice(stems)
        if rng.random() < 0.7:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("abc ") + t[i + rng.choice([0, 1]):]
        return " ".join(t.split())

    left = [(f"a{i:02d}", rng.choice([1, 2]), title(), rng.choice(["2000", "2001"]), None) for i in range(30)]
    right = [(f"b{i:02d}", rng.choice([1, 2]), title(), rng.choice(["2000", "2001"]), None) for i in range(20)]
    a, b = sources(spark, left, right)
    resolved = link.resolve_fuzzy(link.fuzzy_candidates(a, b, tile))
    want, review = models.greedy_fuzzy(
        [(i, v, y, t) for i, v, t, y, _ in left], [(i, v, y, t) for i, v, t, y, _ in right]
    )
    got = sorted((r.article_id_oc, r.article_id_scopus, r.fuzzy_score) for r in link.fuzzy_matches(resolved, b).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    quick = link.resolve_fuzzy(link.fuzzy_candidates(a, b, tile, floor=93.0))
    assert pairs(link.fuzzy_matches(quick, b)) == [w[:2] for w in want]
    queue = sorted((r.article_id_oc, r.article_id_scopus, r.best_score, r.second_score) for r in link.review_queue(resolved, b).collect())
    assert [q[:2] for q in queue] == [w[:2] for w in review]
    assert [q[2:] for q in queue] == [pytest.approx(w[2:]) for w in review]


def test_fuzzy_titles_of_unlike_lengths_and_empty_sides(spark):
    # the only candidates are far in length, so only the second round finds them
    left = [("a1", 1, "x" * 300, "2000", None), ("a2", 1, "y", "2000", None)]
    right = [("b1", 1, "x" * 20, "2000", None), ("b2", 1, "xy" * 30, "2000", None)]
    a, b = sources(spark, left, right)
    got = {r.article_id_oc: (r.article_id_scopus, r.best_score, r.second_score) for r in link.fuzzy_candidates(a, b).collect()}
    want = {i: sorted((-models.ratio(t, u), j) for j, _, u, _, _ in right) for i, _, t, _, _ in left}
    assert got == {i: (w[0][1], pytest.approx(-w[0][0]), pytest.approx(-w[1][0])) for i, w in want.items()}
    assert link.fuzzy_candidates(a, b.limit(0)).count() == link.fuzzy_candidates(a.limit(0), b).count() == 0


def test_floor_finds_the_candidates_above_it_by_beginnings(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    right = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 60, 400]))) for _ in range(24)]
    near = [list(t) for t in right[:8]]
    for t in near:
        for _ in range(len(t) // 25):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "ab"])
    left = ["".join(t) for t in near] + [t[40:] + t[:15] for t in right[8:16]] + ["abc"]
    rest = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)]
    b = pd.DataFrame({"title_norm": right, "first_id": [f"b{i:02d}" for i in range(len(right))], "copies": 1})
    for floor in (93.0, 60.0):
        got = link._tile_scorer(floor)(pd.DataFrame({"title_id": left, "title_norm": left, "known": floor}), b)
        for t in left:
            total = np.array([len(t) + len(u) for u in right])
            ratios = S.ratios_from_common(S.common_subsequences([t] * len(right), right), total)
            scored = sorted(zip(-ratios, b["first_id"]))
            want = [(i, pytest.approx(-s)) for s, i in scored[:2] if -s >= floor]
            assert [(r.first_id, r.score) for r in got[got.title_id == t].itertuples()] == want
    # unlike titles of the same words are ruled out without scoring a pair
    monkeypatch.setattr(link, "common_subsequences", lambda x, y: pytest.fail("scored") if x else np.zeros(0))
    a = pd.DataFrame({"title_id": rest, "title_norm": rest, "known": 93.0})
    assert link._tile_scorer(93.0)(a, b[b["title_norm"].str.len() > 1000]).empty


def test_review_queue_is_counted_without_its_candidates(spark):
    # b2 names two records in a block, so its review rows come twice; a5 has no year, a6 no partner
    left = [
        ("a1", 1, "one title of some length that is matched", "2000", None), ("a2", 1, "unlike anything", "2000", None),
        ("a3", 2, "second block", "2000", None), ("a4", 2, "third of them", "2000", None), ("a5", 1, "no year", None, None),
        ("a6", 3, "alone", "2000", None),
    ]
    right = [
        ("b1", 1, "one title of some length that is matchet", "2000", None), ("b2", 2, "third of these", "2000", None),
        ("b2", 2, "a record of the same id", "2000", None), ("b3", 1, "zzz", "2000", None),
    ]
    a, b = sources(spark, left, right)
    whole, counted = link.link_sources(a, b), link.link_sources(a, b, review=False, count_review=True)
    want = {r.stage: r.n for r in link.linkage_summary(a, b, whole).collect()}
    assert {r.stage: r.n for r in link.linkage_summary(a, b, counted).collect()} == want
    assert want["review candidates"] == whole.review.count() > counted.review.count() > 0
    assert pairs(counted.matches) == pairs(whole.matches) == [("a1", "b1")]


def test_review_round_trip_and_master(spark):
    long = "a quite long title about the reception of translated novels"
    left = [
        ("a1", 1, "same doi", "2000", "d"), ("a2", 1, "Same Title!", "2001", None), ("a3", 1, long + "s", "2002", None),
        ("a4", 1, "only partly alike one", "2003", None), ("a5", 9, "alone", "2004", None),
    ]
    right = [
        ("b1", 1, "other", "1990", "D"), ("b2", 1, "same title", "2001", None), ("b3", 1, long, "2002", None),
        ("b4", 1, "only partly alike two", "2003", None), ("b5", 8, "alone", "2004", None),
    ]
    a, b = sources(spark, left, right)
    first = link.link_sources(a, b)
    assert pairs(first.matches) == [("a1", "b1"), ("a2", "b2"), ("a3", "b3")]
    assert [(r.article_id_oc, r.article_id_scopus, r.second_score) for r in first.review.collect()] == [("a4", "b4", -999.0)]
    reviewed = spark.createDataFrame([("a4", "b4", " x"), ("a5", "b5", "no"), ("a1", "b4", "x")], "article_id_oc string, article_id_scopus string, `the same` string")
    second = link.link_sources(a, b, reviewed)
    # a1 is taken by its DOI already, so the stage order keeps a4 with b4 out only if a1 claims b4 first
    methods = {(r.article_id_oc, r.article_id_scopus): r.match_method for r in second.matches.collect()}
    assert methods[("a1", "b1")] == "doi_exact" and methods[("a2", "b2")] == "title_exact_year"
    assert methods[("a3", "b3")] == "title_fuzzy_year_auto"
    master = second.master.collect()
    n = lambda s: sum(r.source_status == s for r in master)
    assert n("both") + n("open_citations_only") == len(left) and n("both") + n("scopus_only") == len(right)
    summary = {r.stage: r.n for r in link.linkage_summary(a, b, second).collect()}
    assert summary["total matched pairs"] == n("both")


def test_merge_by_priority(spark):
    schema = ", ".join(f"{c} {'double' if c == 'fuzzy_score' else 'string'}" for c in link.MATCH_COLUMNS)

    def stage(method, *found):
        return spark.createDataFrame([(x, y) + (None,) * 16 + (method, None) for x, y in found], schema)

    merged = link.merge_stages(
        stage("title_fuzzy_year_auto", ("a1", "b9"), ("a5", "b5")), stage("doi_exact", ("a1", "b1")),
        stage("manual_confirmed", ("a2", "b1"), ("a3", "b3")), stage("title_exact_year", ("a4", "b3")),
    )
    assert pairs(merged) == [("a1", "b1"), ("a4", "b3"), ("a5", "b5")]


def test_titles_as_digests(spark):
    one = ("br/1", 1, "V", "A  Title & more", "2001", "doi:10.1/x", "2")
    a = spark.createDataFrame([one, one, (*one[:3], None, *one[4:])], A)
    plain = {(r.title_oc, r.title_norm) for r in link.prepare_a(a).collect()}
    short = link.prepare_a(a, digests=True)
    md5 = lambda t: t and hashlib.md5(t.encode()).hexdigest()
    sha = lambda t: t and hashlib.sha256(t.encode()).hexdigest()
    assert short.count() == 2 and {(r.title_oc, r.title_norm) for r in short.collect()} == {(md5(t), sha(n)) for t, n in plain}


def long_sources(spark, n=60, chars=6000):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstuwz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(chars // 5))[:chars].strip()
    left = [(f"a{i:02d}", 1, text(), "2000", None) for i in range(n)]
    right = [(f"b{i:02d}", 1, t[:50] + "q" + t[50:] if i % 3 else t, "2000", None) for i, (_, _, t, _, _) in enumerate(left)]
    return sources(spark, left, right)


def test_exact_stages_run_on_digests_and_results_hold_texts(spark, monkeypatch):
    a, b = long_sources(spark, n=12, chars=400)
    saved, plain = {}, link.save_and_reload
    monkeypatch.setattr(link, "save_and_reload", lambda df, name="stage": saved.setdefault(name, plain(df, name)))
    found = link.link_sources(a, b, review=False)
    assert {len(r.title_norm_oc) for r in saved["title"].collect()} == {64}
    texts = {r.article_id_oc: (r.title_oc, r.title_norm) for r in a.collect()} | {r.article_id_scopus: (r.title_scopus, r.title_norm) for r in b.collect()}
    methods = set()
    for r in found.master.collect():
        methods.add(r.match_method)
        assert (r.title_oc, r.title_norm_oc) == texts[r.article_id_oc] and (r.title_scopus, r.title_norm_sc) == texts[r.article_id_scopus]
    assert methods == {"title_exact_year", "title_fuzzy_year_auto"} and found.master.count() == 12


def test_titles_travel_to_few_tiles_where_there_is_a_floor(spark, monkeypatch):
    a, b = long_sources(spark)
    sent, plain = [], link.spread
    monkeypatch.setattr(link, "spread", lambda df, *keys: sent.append(df.count()) or plain(df, *keys))
    quick = link.resolve_fuzzy(link.fuzzy_candidates(a, b, floor=93.0))
    # 60 titles of 6,000 characters on each side, which lie in two classes at most
    assert sum(sent) <= 2 * (a.count() + b.count())
    monkeypatch.undo()
    whole = link.resolve_fuzzy(link.fuzzy_candidates(a, b))
    rows = lambda df: sorted((r.article_id_oc, r.article_id_scopus, r.best_score) for r in df.filter("accepted").collect())
    assert rows(quick) == rows(whole) and len(rows(quick)) == 60
