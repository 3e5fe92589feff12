import random
import time
from contextlib import redirect_stdout
from io import StringIO
from pathlib import Path
from threading import Barrier
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import models
from citestat import session
from citestat.operators import graph


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "citing string, cited string").repartition(3)


def random_edges(seed, n=25, m=50):
    rng = random.Random(seed)
    out = {(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)}
    return sorted((a, b) for a, b in out if a != b) + [("x1", "x2")]


def test_edge_table_and_roles(spark):
    raw = edge_frame(spark, [("a", "b"), ("a", "b"), ("b", "b"), (None, "c"), ("b", "c"), ("c", None)])
    e = graph.edge_table(raw)
    assert sorted(map(tuple, e.collect())) == [("a", "b"), ("b", "c")]
    assert {r.node: r.node_type for r in graph.node_roles(e).collect()} == {"a": "citing_only", "b": "both", "c": "cited_only"}
    assert tuple(graph.graph_summary(e).first()) == (2, 2, 2, 3)


@pytest.mark.parametrize("seed", range(2))
def test_pagerank(spark, seed):
    edges = random_edges(seed)
    got = {r.node: r.pagerank for r in graph.pagerank(edge_frame(spark, edges)).collect()}
    want = models.pagerank(edges)
    assert sum(got.values()) == pytest.approx(1)
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_hits(spark):
    edges = random_edges(7)
    got = {r.node: r for r in graph.hits(edge_frame(spark, edges)).collect()}
    hub, authority = models.hits(edges)
    for n in hub:
        assert got[n].hub == pytest.approx(hub[n], abs=1e-5) and got[n].authority == pytest.approx(authority[n], abs=1e-5)


def test_rounds_of_hits_pass_packed_tiles(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 30, raising=False)
    rows, plain = [], graph.save_and_reload
    monkeypatch.setattr(graph, "save_and_reload", lambda df, name="stage": (rows.append(df.count()) if name == "hits" else None) or plain(df, name))
    # one node is cited by all others
    edges = sorted(set(random_edges(5, n=40, m=120)) | {(f"n{i:02d}", "hub") for i in range(40)})
    got = {r.node: r for r in graph.hits(edge_frame(spark, edges)).collect()}
    hub, authority = models.hits(edges)
    assert set(got) == set(hub)
    for n in hub:
        assert got[n].hub == pytest.approx(hub[n], abs=1e-9) and got[n].authority == pytest.approx(authority[n], abs=1e-9)
    # a block of nodes is one row
    assert len(rows) > 1 and max(rows) <= len(edges) // 30 + 1


def test_hits_of_repeated_and_loose_edges(spark):
    e = edge_frame(spark, [("a", "b"), (None, "c"), ("a", "c"), ("a", "c"), ("d", None), ("a", "a")])
    got = {r.node: (r.hub, r.authority) for r in graph.hits(e).collect()}
    assert got == {"a": (1, 0.25), "b": (0, 0.25), "c": (0, 0.5), "d": (0, 0), None: (0, 0)}
    assert graph.hits(e.limit(0)).collect() == []
    assert {r.hub + r.authority for r in graph.hits(e, max_rounds=0).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cores(spark, seed):
    edges = random_edges(seed, n=40, m=35)
    e = edge_frame(spark, edges)
    assert {r.node: r.component for r in graph.weak_components(e).collect()} == models.components(edges)
    dense = random_edges(seed, n=15, m=70)
    assert {r.node: r.core for r in graph.core_numbers(edge_frame(spark, dense)).collect()} == models.core_numbers(dense)


def test_long_path_is_one_component(spark):
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    assert {r.component for r in graph.weak_components(edge_frame(spark, edges)).collect()} == {"p000"}


def test_communities_of_two_cliques(spark):
    clique = lambda t: [(f"{t}{i}", f"{t}{j}") for i in range(5) for j in range(i)]
    edges = clique("a") + clique("b") + [("a4", "b4")]
    got = {r.node: r.community for r in graph.communities(edge_frame(spark, edges)).collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1
    assert got["a0"] != got["b0"]


def settled(edges, label):
    """Whether every node has the most frequent label near it, the smallest on a tie."""
    near = {n: [label[n]] for n in label}
    for a, b in {tuple(sorted(e)) for e in edges}:
        near[a].append(label[b])
        near[b].append(label[a])
    return all(label[n] == min(set(x), key=lambda c: (-x.count(c), c)) for n, x in near.items())


def test_communities_of_a_path_settle_or_raise(spark):
    edges = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(5)]
    e = edge_frame(spark, edges)
    got = {r.node: r.community for r in graph.communities(e).collect()}
    assert settled(edges, got) and set(got.values()) == {"p00"}
    with pytest.raises(graph.NotConverged):
        graph.communities(e, max_rounds=3)


def test_communities_settle_where_all_at_once_swings(spark):
    small = [("n0", "n2"), ("n2", "n3"), ("n3", "n4"), ("n3", "n6"), ("n4", "n5"), ("n5", "n6")]
    edges = [(f"{c}{a}", f"{c}{b}") for c in "abc" for a, b in small]
    got = {r.node: r.community for r in graph.communities(edge_frame(spark, edges)).collect()}
    assert len(got) == 18 and settled(edges, got)


def test_node_metrics_and_subgraph(spark):
    edges = random_edges(1, n=8, m=20)
    e = edge_frame(spark, edges)
    table = graph.node_metrics(e).collect()
    assert len(table) == len({n for x in edges for n in x})
    ranks = graph.pagerank(e)
    best = {r.node for r in graph.top_n(ranks, "pagerank", 3, ["node"]).collect()}
    want = sorted((a, b) for a, b in edges if a in best and b in best)
    assert sorted(map(tuple, graph.induced_by_top(e, ranks, 3).collect())) == want


def test_metrics_without_settled_hits_are_no_result(spark, monkeypatch):
    monkeypatch.setattr(graph, "HITS_ROUNDS", 5, raising=False)
    e = edge_frame(spark, random_edges(3))
    with pytest.raises(graph.NotConverged):
        graph.node_metrics(e)
    with pytest.raises(graph.NotConverged):
        graph.hits(e)


def test_rounds_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(session, "SWEEP_SHARE", float("inf"), raising=False)
    folders = [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f.name.split("_")[1] for d in folders for f in Path(d).rglob("shuffle_*.data")}

    before, calls, plain = shuffles(), [], session.sweep
    monkeypatch.setattr(graph, "sweep", lambda spark: calls.append(1) or plain(spark))
    graph.communities(spark.createDataFrame([(i, i + 1) for i in range(14)], "citing long, cited long"))
    assert len(calls) > 10
    until = time.monotonic() + 20
    while len(shuffles() - before) > 8 and time.monotonic() < until:
        time.sleep(0.2)
    # a round has two or more
    assert len(shuffles() - before) <= 8


def test_node_metrics_save_edges_and_neighbours_once(spark, monkeypatch):
    made, plain = [], session.save_and_reload
    for module in (session, graph):
        monkeypatch.setattr(module, "save_and_reload", lambda df, name="stage": made.append((name, df.count())) or plain(df, name))
    edges = random_edges(2, n=9, m=15)
    graph.node_metrics(edge_frame(spark, edges))
    both = len({x for a, b in edges for x in ((a, b), (b, a))})
    assert [n for _, n in made if n == both] == [both]
    assert [name for name, n in made if n == len(edges) and name != "rank-edges"] == ["graph"]


def test_loops_of_node_metrics_run_side_by_side(spark, monkeypatch):
    together = Barrier(4, timeout=60)

    def loop(*columns):
        def run(edges):
            together.wait()
            return graph.degrees(edges).select("node", *[F.lit(i).alias(c) for i, c in enumerate(columns)])

        return run

    for name, columns in {"pagerank": ["pagerank"], "hits": ["hub", "authority"], "core_numbers": ["core"], "communities": ["community"]}.items():
        monkeypatch.setattr(graph, name, loop(*columns))
    got = graph.node_metrics(edge_frame(spark, [("a", "b"), ("b", "c")])).select("node", "degree", "authority").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 1), ("b", 2, 1), ("c", 1, 1)]


def test_hubs_of_components(spark, monkeypatch):
    # stars of several sizes in a chain, joined by nodes of more edges than a task may join
    monkeypatch.setattr(graph, "HUB", 2)
    pairs = [(c, c * 10 + i) for c in range(1, 9) for i in range(1, 8)] + [(c * 10 + 1, (c + 1) * 10 + 2) for c in range(1, 4)] + [(500, 501)]
    edges = spark.createDataFrame(pairs, "citing long, cited long")
    parent = {n: n for p in pairs for n in p}
    for _ in pairs:
        for u, v in pairs:
            parent[u] = parent[v] = min(parent[u], parent[v])
    assert {r.node: r.component for r in graph.weak_components(edges).collect()} == parent


def test_rounds_of_components_are_small_plans(spark, monkeypatch):
    reads, plain = [], graph.save_and_reload

    def counted(df, name="stage"):
        shown = StringIO()
        with redirect_stdout(shown):
            df.explain()
        reads.append(shown.getvalue().count("FileScan"))
        return plain(df, name)

    monkeypatch.setattr(graph, "save_and_reload", counted)
    pairs = [(i, i // 2) for i in range(1, 60)]
    got = graph.weak_components(spark.createDataFrame(pairs, "citing long, cited long")).collect()
    assert {r.component for r in got} == {0} and len(got) == 60
    assert reads[0] == 0 and max(reads) <= 3


def test_components_without_edges(spark):
    none = spark.createDataFrame([(1, 1)], "citing long, cited long")
    assert [tuple(r) for r in graph.weak_components(none).collect()] == [(1, 1)]
    assert graph.weak_components(none.limit(0)).count() == 0


def test_rank_rounds_leave_out_nodes_that_cite_nothing(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 1), (1, 5), (4, 6)], "citing long, cited long")
    kept, plain = [], graph.kept_by
    monkeypatch.setattr(graph, "kept_by", lambda df, *keys: kept.append(df.count()) or plain(df, *keys))
    got = {r.node: r.pagerank for r in graph.pagerank(edges, tolerance=1e-13).collect()}
    assert kept == [2, 2]
    rank, out = dict.fromkeys(range(1, 7), 1 / 6), {1: [2, 5], 2: [1, 3], 4: [1, 6]}
    for _ in range(200):
        lost = sum(rank[n] for n in (3, 5, 6))
        rank = {n: 0.15 / 6 + 0.85 * (lost / 6 + sum(rank[c] / 2 for c, to in out.items() if n in to)) for n in rank}
    assert all(abs(got[n] - rank[n]) < 1e-12 for n in rank)


def test_only_one_process_limits_the_partitions():
    def width(master):
        return session.shuffle_width(SimpleNamespace(
            conf=SimpleNamespace(get=lambda _: "600"), sparkContext=SimpleNamespace(master=master, defaultParallelism=12)))

    assert width("local-cluster[3,4,10240]") == width("spark://host:7077") == 600
    assert width("local[12]") == width("local[*]") == 24
