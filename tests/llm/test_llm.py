"""Operators of citestat.llm on small hand-made tables and against plain versions."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from citestat.llm import (
    chat, classifier, decontamination, linededup, mixing, neardup, packing, quality_rules, queries, sharding, toxicity,
)
from citestat.llm.common import bits_for

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, hits int, h1 int, row string"


def docs_of(spark, texts):
    return spark.createDataFrame(
        [(i, t, "en", "a" if i and i % 2 else None, len(t or ""), "x", 1, 2, "y") for i, t in texts], DOCS
    )


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tied, repeated and very long texts; clashing columns; a null id."""
    base = " ".join(f"word{i}" for i in range(80))
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, base), (5, base), (5, base), (6, base.upper()), (7, base + " tail"),
        (8, "word " * 30_000), (9, "short one"), (None, base), (None, "alone"), (10, "a\nb\nc\nd\na\nb\nc\na\nb\nc"),
        (11, "x\na\nb\nc\n\ny"), (12, "éàü ÉÀÜ    end"), (13, "it's 's don't  two  spaces\n\n new\r\nline "),
    ]
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_quality_rules(odd, none):
    got = quality_rules.quality_report(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[3]["n_words"] == 0
    assert by_id[8]["n_repeat_words"] == 30_000 and by_id[8]["base_failed"]
    assert by_id[4]["kept"] and not by_id[9]["kept"] and by_id[10]["n_dup_lines"] == 6
    assert quality_rules.quality_report(none).count() == 0
    assert {r["doc_id"] for r in quality_rules.filter_by_rules(odd).collect()} == {4, 5, 7, None}  # 6 is all capitals
    assert quality_rules.filter_by_rules(odd).columns == odd.columns


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame(
        [(7, " ".join(f"WORD{i}" for i in range(5, 17))), (8, "short ONE"), (9, None), (9, "")], "item_id bigint, text string"
    )
    got = {r["doc_id"]: r for r in decontamination.leak_report(odd.filter("doc_id IS NOT NULL"), bench).collect()}
    assert (got[4]["n_hit"], got[4]["items"]) == (12, ["7"]) and (got[9]["n_hit"], got[9]["items"]) == (2, ["8"])
    assert got[1]["n_words"] == got[2]["n_words"] == got[8]["n_hit"] == 0
    kept = decontamination.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9
    joined = decontamination.scan(odd, bench, words="w_", hits="h_", max_windows=0)[0]
    assert joined.filter("size(h_) = 0").count() == 9
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(odd, bench, mode="spans").collect()}
    kept_words = cut[4].split()
    assert "word5" not in kept_words and "word16" not in kept_words and "word17" in kept_words and cut[9] == "" and cut[8] == "word " * 30_000
    assert decontamination.leak_report(none, bench).count() == 0
    assert decontamination.leak_report(odd, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_large_benchmark_gives_the_same_rows(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    sets = []
    for most in (decontamination.MAX_WINDOWS, 0):
        found = decontamination.scan(docs, bench, words="w_", hits="h_", max_windows=most)[0]
        sets.append({(r["doc_id"], r["n"], tuple(sorted(h["gram"] for h in r["h_"])), tuple(sorted(h["start"] for h in r["h_"])))
                     for r in found.selectExpr("doc_id", "size(w_) AS n", "h_").collect()})
    assert sets[0] == sets[1] and any(x[2] for x in sets[0])
    assert [bits_for(n) for n in (0, 65_536, 200_000, 10**9)] == [1 << 20, 1 << 21, 1 << 22, 1 << 27]


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def test_near_duplicates(spark, odd, none):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    texts = [(i, " ".join(w if rng.random() > 0.02 * (i % 9) / 3 else f"z{rng.randrange(99)}" for w in base)) for i in range(120)]
    texts += [(500 + i, f"tiny {i % 3}") for i in range(6)] + [(900, None), (901, "")]
    got = {r["node"]: r for r in neardup.near_duplicate_components(docs_of(spark, texts), k=3, percent=85).collect()}
    sets = {i: sets_of(t, 3) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {i: (got[i]["n_shingles"], got[i]["component"]) for i in sets} == {i: (len(sets[i]), find(i)) for i in sets}
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 13]
    assert neardup.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("percent", [85, 80, 70, 50, 10])
def test_bands_follow_the_similarity(percent):
    bands, rows = neardup.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_low_similarity_pairs_are_found(spark):
    """150 pairs that share 42 of 78 words."""
    texts = [(2 * i + j, " ".join(f"w{i}x{w}" for w in range(18 * j, 18 * j + 60))) for i in range(150) for j in range(2)]
    got = {r["node"]: r["component"] for r in neardup.near_duplicate_components(docs_of(spark, texts), k=1, percent=50).collect()}
    assert got == {i: i - i % 2 for i, _ in texts}


def test_tiles_are_searched(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(w if rng.random() > 0.035 else f"z{rng.randrange(99)}" for w in base)) for i in range(60)]
    got = {r["node"]: r["component"] for r in neardup.near_duplicate_components(docs_of(spark, texts), k=1, percent=90).collect()}
    sets = {i: sets_of(t, 1) for i, t in texts}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            assert got[a] == got[b]


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, 60, dtype=np.uint64)])) for _ in range(2))
    s = neardup._signatures([a, b], neardup._multipliers())
    p, f = s["parity"].view(np.uint64), s["filled"].view(np.uint64)
    assert abs(neardup.similarity_estimate(p[0], p[1], f[0], f[1]) - 900 / 1020) < 0.04


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    words = [f"plain{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choices(words, k=40) + (["idiot", "scum"] if i % 8 == 0 else []))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(100)] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    docs = docs_of(spark, texts + [(900, None), (901, "")])
    index = toxicity.fit(docs, labels)
    got = {r["id"]: r for r in toxicity.scored(docs, index).collect()}
    assert all((got[i]["score"] >= 0.3) == (i % 8 == 0) for i in range(200)) and got[0]["evidence"]
    assert got[900]["score"] == got[901]["score"] < 0.3
    assert toxicity.scored(odd, index).count() == odd.count() and toxicity.scored(none, index).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, empty).collect()} == {0.5}


def test_toxicity_knows_rare_and_common_words(spark):
    """540 words in 4 of 2,000 examples each, and one in more than a fifth of them."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(100)]
    rare = lambda g: [f"{chr(97 + g % 26)}{g // 26}{chr(97 + j)}" for j in range(12)]
    toxic = lambda i: i % 2200 < 180
    texts = [(i, " ".join(rng.choices(words, k=8) + (rare(i % 45) + ["hate"] if toxic(i) else ["hate"] * (i % 5 == 0)))) for i in range(2400)]
    labels = spark.createDataFrame([(i, int(toxic(i))) for i in range(2000)], "doc_id bigint, toxic int")
    index = toxicity.fit(docs_of(spark, texts), labels)
    assert len(index.idf) > 540
    scores = {r["id"]: r["score"] for r in toxicity.scored(docs_of(spark, texts[2000:]), index).collect()}
    assert all((s >= 0.3) == toxic(i) for i, s in scores.items()) and sum(map(toxic, scores)) == 180


def test_evidence_gives_the_score(spark):
    texts = [(i, " ".join(["idiot", "scum"] if i % 8 == 0 else [f"plain{i % 9}", f"p{i % 40}"])) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    index = toxicity.fit(docs_of(spark, texts), labels)
    most = 0
    for r in toxicity.scored(docs_of(spark, texts), index, prior=0.5).collect():
        seen = [(e["cosine"], e["label"]) for e in r["evidence"]]
        most = max(most, len(seen))
        if seen:
            want = (sum(c * t for c, t in seen) + 0.5 * index.prior) / (sum(c for c, _ in seen) + 0.5)
            assert r["score"] == pytest.approx(want)
    assert most == toxicity.NEIGHBOURS


def test_neighbours_are_exact(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(words[:40] if i % 2 else words[20:], k=5))) for i in range(800)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(700)], "doc_id bigint, toxic int")
    index = toxicity.fit(docs_of(spark, texts), labels)
    n, terms = len(index.ids), len(index.idf)
    assert terms > 5
    dense = np.zeros((n, terms))
    for t in range(terms):
        part = slice(index.pointers[t, 0], index.pointers[t, -1])
        dense[index.postings[part], t] = index.weights[part]
    for q in range(0, n, 7):
        used = np.flatnonzero(dense[q])
        best, cosine = index.nearest(used, dense[q, used], dense[q, used] @ index.block_max[used], 10)
        assert np.allclose(cosine, np.sort(dense @ dense[q])[::-1][: len(cosine)])


def test_classifier(spark, odd, none):
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(500)}" + ("###" if i % 3 == 0 else "") for _ in range(60))) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(100)], "doc_id bigint, quality int")
    docs = docs_of(spark, texts)
    model = classifier.fit(docs, labels)
    assert model.rules and {r["doc_id"] for r in classifier.keep_good(docs, model).collect()} == {i for i in range(150) if i % 3}
    got = classifier.scored(odd, model)
    assert got.columns == [*odd.columns, "score"] and got.filter("score >= 0 AND score <= 1").count() == odd.count()
    assert classifier.scored(none, model).count() == 0 and not classifier.fit(docs, labels.limit(0)).rules


def test_line_dedup(odd, none):
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in linededup.dedup_lines(odd, report=True).collect()}
    assert got[10, "a\nb\nc\nd"] == 6 and got[11, "x\n\ny"] == 3 and got[1, None] == 0 and got[2, ""] == 0
    assert linededup.dedup_lines(odd).columns == odd.columns and linededup.dedup_lines(none).count() == 0


def test_packing_round_trip(odd, none):
    from citestat.session import save_and_reload

    rows = save_and_reload(packing.packed(odd, length=256))
    back = sorted((r["doc_id"] or 0, r["text"]) for r in packing.unpacked(rows).collect())
    assert back == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    encoding = packing.load_encoding(packing.TOKENIZERS, packing.RANKS)
    parts: dict = {}
    for r in rows.collect():
        ids, places, cuts = np.frombuffer(r["ids"], np.uint16), np.frombuffer(r["positions"], np.uint16), r["cu_seqlens"]
        assert len(ids) == len(places) == 256 and cuts[0] == 0
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            assert (places[a:b] == np.arange(b - a)).all()
            parts.setdefault(r["rows"][k], []).append((r["starts"][k], ids[a:b].tolist()))
    whole = sorted([t for _, part in sorted(p) for t in part] for p in parts.values())
    assert whole == sorted(encoding.encode_ordinary(r["text"] or "") + [packing.END] for r in odd.collect())
    assert packing.packed(none).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 500)
    rows = packing.best_fit_decreasing(sizes, 100)
    room: dict = {}
    for i in np.argsort(-sizes, kind="stable"):
        fits = [r for r in room if room[r] >= sizes[i]]
        if fits:
            assert room[rows[i]] == min(room[r] for r in fits)
        room[rows[i]] = room.get(rows[i], 100) - sizes[i]
    assert min(room.values()) >= 0


def cheapest(roles):
    """Least repair cost by trying every role, merge and insertion."""
    best = {0: 0.0}
    for role in roles:
        after: dict = {}
        for q, cost in best.items():
            for x in (1, 2, 3):
                named = 0 if x == role else chat.RELABEL
                ways = [named] if (q, x) in chat.LEGAL else []
                ways += [named + chat.INSERT for y in (1, 2, 3) if (q, y) in chat.LEGAL and (y, x) in chat.LEGAL]
                ways += [named + chat.MERGE] if q == x else []
                if ways:
                    after[x] = min(after.get(x, 1e9), cost + min(ways))
        best = after
    return min(c + {0: 0, 1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[q] for q, c in best.items())


def test_chat_repair(spark):
    rng = random.Random(8)
    names = ["user", "assistant", "system", "tool", None]
    rows, roles = [], {}
    for conv in range(40):
        # one conversation goes over many chunks and blocks of chunks
        roles[conv] = [rng.randrange(5) for _ in range(70 if conv == 20 else rng.randrange(1, 9))]
        rows += [(conv, t, names[r], f"t{t}" if t else None) for t, r in enumerate(roles[conv])]
    rows += [(None, None, "user", "x"), (99, 0, "user", "a"), (99, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    number = {0: 2, 1: 3, 2: 1, 3: 0, 4: 0}
    for chunk, fan in ((4096, 4096), (3, 4096), (4, 3)):
        got = chat.repaired_turns(turns, chunk=chunk, fan=fan).collect()
        assert len(got) == len(rows)
        cost = {c: sum(r["cost"] for r in got if r["conv_id"] == c) for c in roles}
        assert cost == {c: cheapest([number[r] for r in rs]) for c, rs in roles.items()}
    for r in chat.rendered(turns, chunk=3).collect():
        spoken = re.findall(r"<\|im_start\|>(\w+)\n", r["chat"])
        states = [0, *[chat.ROLES.index(s) + 1 for s in spoken]]
        assert all(p in chat.LEGAL for p in itertools.pairwise(states)) and states[-1] == 3
    assert chat.repaired_turns(turns.limit(0)).count() == 0


def test_mixing(spark, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = mixing.mix_plan(docs, keep=("source",)).toPandas()
    total = plan.groupby("source").agg(size=("size", "sum"), target=("target", "first"))
    weights = dict(zip(sorted(total.index), itertools.cycle(mixing.WEIGHTS)))
    want, open_ = {}, set(total.index)
    while True:
        rest = total["size"].sum() - sum(want.values())
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total["size"][s]}
        if not full:
            break
        want |= {s: 3.0 * total["size"][s] for s in full}
        open_ -= full
    assert {s: pytest.approx(t) for s, t in (want | share).items()} == total["target"].to_dict()
    assert plan["copies"].between(0, 3).all()
    assert docs.count() == len(plan) and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == plan["copies"].sum() and mixing.mix(none).count() == 0
    again = mixing.mix_plan(docs.repartition(5), keep=("source",)).toPandas()
    assert plan.set_index("doc_id")["copies"].sort_index().equals(again.set_index("doc_id")["copies"].sort_index())


def test_budget_is_met():
    lengths, counts = np.array([3, 50, 7, 1200, 11]), np.array([40, 9, 100, 30, 2])
    for budget in (1, 6, 100, 5000, 20_001, 36_000):
        taken = mixing.fit_budget(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and budget - 2 <= lengths @ taken <= budget


def test_sharding(spark, odd, none):
    got = sharding.shard(odd, shards=3, keep=("lang",)).toPandas()
    assert len(got) == odd.count() and got["size"].sum() == 30_000 * 5 + got[got["size"] < 9999]["size"].sum() + 16
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    loads = sharding.shard(copies, shards=4).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(loads) == 4 and loads.max() < 1.2 * loads.min()
    assert sharding.shard(none).count() == 0
    sample = sharding.shard(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert (sample["text_crc32"] == sample["doc_id"].map(lambda i: zlib.crc32(text[i].encode()))).all()


def test_pack_fixed():
    rng = random.Random(9)
    sizes = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    bins = sharding.pack_fixed(sizes, 100)
    loads = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(max(bins) + 1)]
    assert max(loads) <= 100 and len(loads) <= 1.05 * -(-sum(sizes) // 100) + 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(docs.columns) <= set(out.columns) and len(out)
    assert sum(labels.get(i, 1) for i in out["doc_id"]) >= 0.97 * len(out)
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    words = {i: sets_of(t, 5) for i, t in zip(out["doc_id"], out["text"])}
    for a, b in itertools.combinations(words, 2):
        assert 10 * len(words[a] & words[b]) < 8 * len(words[a] | words[b])
