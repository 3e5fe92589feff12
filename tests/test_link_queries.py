"""The fuzzy linkage queries, which have no SQL form, against the sequential model on small tables."""

import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import models
from citestat.plans import catalog_link as C

LANGS, SOURCES = ["de", "en"], ["src0", "src1", "src2", "src3"]
STEMS = [
    "Readers of poems. They write about the novels of their time.\nA second line.",
    "Notes on translation, with a list of words & names.\nNothing more follows. " * 3,
    "Short one.",
]


def texts(rng, n):
    """Texts that differ after the first sentence, copies, near copies, empty and missing ones."""
    made = [None, "", "...", "Alone"]
    while len(made) < n:
        t = rng.choice(STEMS)
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            i = rng.randrange(12, len(t)) if len(t) > 14 else rng.randrange(len(t))
            t = t[:i] + rng.choice("abcdé .") + t[i + rng.choice([0, 1]):]
        made.append(rng.choice(made[4:]) if len(made) > 8 and rng.random() < 0.15 else t)
    return made


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng, folder = random.Random(5), tmp_path_factory.mktemp("link")
    docs = pd.DataFrame({"doc_id": range(70), "text": texts(rng, 70)})
    docs["lang"] = [rng.choice(LANGS) for _ in docs.index]
    docs["source"] = [rng.choice(SOURCES) for _ in docs.index]
    # pairs alike that resemble nothing else
    words = ["".join(rng.choice("abcdefghijklmnoprstuwz") for _ in range(6)) for _ in range(200)]
    for i in range(10, 26, 2):
        title = " ".join(rng.sample(words, 12)) + "."
        docs.loc[i, ["text", "lang", "source"]] = [title, "de", "src0"]
        docs.loc[i + 1, ["text", "lang", "source"]] = [title[:-3] + "x.\n", "de", "src3"]
    docs["n_chars"] = [len(t or "") for t in docs.text]
    docs.to_parquet(folder / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    left, right = (
        con.execute(
            f"{C.TITLE_STAGE} SELECT key, venue_internal_id, year, title_norm FROM {s}2 "
            f"WHERE key NOT IN (SELECT k{s} FROM ts) AND venue_internal_id IS NOT NULL AND year IS NOT NULL AND title_norm IS NOT NULL"
        ).fetchall()
        for s in "ab"
    )
    accepted, review = models.greedy_fuzzy(left, right)
    assert accepted and review
    con.execute("CREATE TABLE fz (ka VARCHAR, kb VARCHAR)")
    con.executemany("INSERT INTO fz VALUES (?, ?)", [x[:2] for x in accepted])
    merged = C.MERGED.replace(
        "SELECT ka, kb, 3, 'manual_confirmed' FROM ms", "SELECT ka, kb, 3, 'manual_confirmed' FROM ms UNION ALL SELECT ka, kb, 4, 'title_fuzzy_year_auto' FROM fz"
    )
    return spark, str(folder), con, accepted, review, merged


def run(case, name):
    return entry.queries()[name](case[0], case[1]).collect()


def test_candidates_matches_and_queue(case):
    accepted, review = case[3:5]
    got = {r.article_id_oc: r for r in run(case, "J4_blocked_fuzzy_join")}
    assert set(got) == {x[0] for x in accepted} | {x[0] for x in review}
    assert sorted(i for i, r in got.items() if r.accepted) == sorted(x[0] for x in accepted)
    for a, b, best, second in review:
        assert got[a].article_id_scopus == b and (got[a].best_score, got[a].second_score) == pytest.approx((best, second))
    matches = sorted((r.article_id_oc, r.article_id_scopus, r.fuzzy_score) for r in run(case, "L5_fuzzy_stage"))
    assert [m[:2] for m in matches] == [x[:2] for x in sorted(accepted)]
    assert [m[2] for m in matches] == pytest.approx([x[2] for x in sorted(accepted)])
    queue = run(case, "L6_review_queue")
    assert sorted((r.article_id_oc, r.article_id_scopus) for r in queue) == sorted(x[:2] for x in review)
    assert [r.best_score for r in queue] == sorted((r.best_score for r in queue), reverse=True)


def test_master_and_summary(case):
    con, accepted, review, merged = case[2:]
    pairs = con.execute(f"{merged} SELECT ka, kb, method FROM mg").fetchall()
    n_a, n_b, n_doi, n_title, n_manual = con.execute(
        f"{merged} SELECT (SELECT count(*) FROM a), (SELECT count(*) FROM b), (SELECT count(*) FROM ds), (SELECT count(*) FROM ts), (SELECT count(*) FROM ms)"
    ).fetchone()
    master = run(case, "L9_master_of_all_stages")
    both = sorted((r.article_id_oc, r.article_id_scopus, r.match_method) for r in master if r.source_status == "both")
    assert both == sorted(pairs)
    assert len(master) == n_a + n_b - len(pairs)
    assert {r.stage: r.n for r in run(case, "A38_linkage_summary")} == {
        "open index records": n_a, "second index records": n_b, "DOI matches": n_doi, "exact title and year matches": n_title,
        "automatic fuzzy matches": len(accepted), "review candidates": len(review), "manually confirmed matches": n_manual,
        "total matched pairs": len(pairs), "open index only": n_a - len(pairs), "second index only": n_b - len(pairs),
    }


def test_priority_counts_resolve_every_reviewed_pair(case, monkeypatch):
    con, lists, plain = case[2], [], C.link.match_manual
    monkeypatch.setattr(C.link, "match_manual", lambda reviewed, a, b: lists.append(reviewed.count()) or plain(reviewed, a, b))
    rows = run(case, "W4_priority_one_to_one")
    pairs, articles = con.execute(
        "SELECT count(*), count(DISTINCT x.doc_id) FROM documents x JOIN documents y ON x.lang = y.lang AND x.n_chars = y.n_chars "
        "AND x.source < 'src2' AND y.source >= 'src2'"
    ).fetchone()
    assert lists == [pairs] and pairs > articles
    assert sorted(map(tuple, rows)) == sorted(con.execute(entry.oracle_sql()["W4_priority_one_to_one"]).fetchall())
