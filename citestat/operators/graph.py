"""Citation graph: edges, degrees, PageRank, HITS, components, cores, communities.

Edges are (citing, cited). Loops join the edge table with one value per node and reduce
with map-side aggregation; every round ends in a saved table, so the plan stays short and
a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import count
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from citestat.operators.tables import top_n
from citestat.session import as_saved, discard, kept_by, save_and_reload, spread, sweep

# edges of one node that are joined in one task; nodes with more are few and travel with the plan
HUB = 100_000
# edges of a block of nodes in HITS, which one task holds as packed numbers
BLOCK = 300_000
# rounds in which HITS must settle where the caller sets no limit
HITS_ROUNDS = 1000


class NotConverged(RuntimeError):
    """A loop reached its limit of rounds before its values settled."""


def edge_table(citations: DataFrame) -> DataFrame:
    """Distinct edges without missing ends and self-loops."""
    return (
        citations.select("citing", "cited").dropna().filter(F.col("citing") != F.col("cited")).distinct()
    )


def _ends(edges: DataFrame) -> DataFrame:
    """One row per edge end: node, is_citing, is_cited."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("citing").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inn")),
                F.struct(F.col("cited").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("inn")),
            )
        )
    )


def degrees(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("node").agg(
        F.sum("inn").alias("in_degree"), F.sum("out").alias("out_degree"),
        F.count(F.lit(1)).alias("degree"),
    )


def _role() -> Column:
    return (
        F.when((F.col("in_degree") > 0) & (F.col("out_degree") > 0), "both")
        .when(F.col("in_degree") > 0, "cited_only")
        .otherwise("citing_only")
    )


def node_roles(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("node", _role().alias("node_type"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Edges, distinct citing, distinct cited, nodes."""
    return degrees(edges).agg(
        F.sum("out_degree").alias("n_edges"),
        F.count_if(F.col("out_degree") > 0).alias("n_citing"),
        F.count_if(F.col("in_degree") > 0).alias("n_cited"),
        F.count(F.lit(1)).alias("n_nodes"),
    )


def node_label(node: str = "node") -> Column:
    return F.replace(F.col(node).cast("string"), F.lit("omid:"), F.lit(""))


def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-10,
             max_rounds: int = 200, rounds_per_check: int = 5) -> DataFrame:
    """PageRank with the mass of dangling nodes spread evenly; the ranks sum to 1.

    With uniform restart and uniform spreading of dangling mass, the rank is proportional
    to the solution of ``y = 1 + alpha * sum over citing nodes of y / out_degree``, so no
    round needs a global sum. Only edges whose citing node is itself cited can change
    between rounds; the others contribute a constant that is added up once. A node that cites
    nothing changes no other, so its value is found once, after the last round.
    """
    deg = degrees(edges)
    share = deg.filter("out_degree > 0").select(
        F.col("node").alias("citing"), F.try_divide(F.lit(alpha), F.col("out_degree")).alias("w"),
        (F.col("in_degree") > 0).alias("live"),
    )
    ends = deg.filter("in_degree > 0").select(F.col("node").alias("cited"), (F.col("out_degree") > 0).alias("onward"))
    weighted = edges.join(share, "citing")
    constant = (
        weighted.groupBy("cited")
        .agg(F.sum(F.when(~F.col("live"), F.col("w")).otherwise(0.0)).alias("base"))
        .join(ends, "cited").select(F.col("cited").alias("node"), (F.col("base") + 1).alias("base"), "onward")
    )
    base = save_and_reload(constant, "rank-base")
    live = save_and_reload(
        weighted.filter("live").join(ends, "cited").select("citing", "cited", "w", "onward"), "rank-edges"
    )
    inner_base = kept_by(base.filter("onward").select("node", "base"), "node")
    inner_edges = kept_by(live.filter("onward").select("citing", "cited", "w"), "citing")

    def step(y: DataFrame, edges: DataFrame = inner_edges, constant: DataFrame = inner_base) -> DataFrame:
        flow = (
            edges.join(y, edges["citing"] == y["node"])
            .groupBy("cited").agg(F.sum(F.col("w") * F.col("y")).alias("flow"))
        )
        return constant.join(flow, constant["node"] == flow["cited"], "left").select(
            constant["node"], (F.col("base") + F.coalesce("flow", F.lit(0.0))).alias("y")
        )

    current = base.filter("onward").select("node", F.col("base").alias("y"))
    saved = None
    for _ in range(0, max_rounds, rounds_per_check):
        start = current
        for _ in range(rounds_per_check):
            current = step(current)
        both = current.join(start.withColumnRenamed("y", "y0"), "node")
        kept = save_and_reload(both, "rank")
        change = kept.agg(
            F.try_divide(F.sum(F.abs(F.col("y") - F.col("y0"))), F.sum("y"))
        ).first()[0]
        current = kept.select("node", "y")
        if saved is not None:
            discard(saved)
        saved = kept
        sweep(edges.sparkSession)
        if change is None or change < tolerance:
            break
    else:
        raise NotConverged(f"PageRank changes by {change} after {max_rounds} rounds")
    inner_base.unpersist()
    inner_edges.unpersist()
    current = step(current, live, base)
    ranked = deg.select("node").join(current, "node", "left").select(
        "node", F.coalesce("y", F.lit(1.0)).alias("y")
    )
    total = ranked.agg(F.sum("y").alias("_total"))
    # the total is one row
    return ranked.join(F.broadcast(total)).select("node", (F.col("y") / F.col("_total")).alias("pagerank"))


def hits(edges: DataFrame, tolerance: float = 1e-9, max_rounds: int | None = None,
         rounds_per_check: int = 5) -> DataFrame:
    """Hub and authority scores, each summing to 1.

    Scores that still change after `HITS_ROUNDS` rounds raise `NotConverged`. With ``max_rounds`` given they are zeros
    beyond it, for a caller that reads zeros as no result.

    Citing and cited nodes lie in blocks. The edges between two blocks are a tile: positions of the nodes in
    their blocks, as packed numbers. In a round the citing block sends one number for each cited node of a tile and gets
    one back, so edges are rows only once, before the first round.

    Scores stay unscaled within a block of rounds and are scaled by their maximum when the
    block is saved.
    """
    edges = as_saved(edges, "hits-edges")
    citing, cited = _tiles(edges)
    by_citing = kept_by(citing.select("block", "other", "pos", "slot"), "block")
    by_cited = kept_by(cited.select("block", "other", "pos"), "block")
    hub = citing.filter("own IS NOT NULL").select("block", F.transform("own", lambda _: F.lit(1.0)).alias("x"))
    saved = None
    for _ in range(0, HITS_ROUNDS if max_rounds is None else max_rounds, rounds_per_check):
        start = hub
        mail = _meet(by_citing, hub, _first_mail, MAIL)
        for _ in range(rounds_per_check - 1):
            mail = _meet(by_citing, _meet(by_cited, mail, _passed_on, MAIL), _passed_on, MAIL)
        hub = _meet(by_citing, _meet(by_cited, mail, _passed_on, MAIL), _received, SCORES)
        both = hub.join(start.withColumnRenamed("x", "x0"), "block")
        kept = save_and_reload(both, "hits")
        top, s1, s0 = kept.agg(F.max(F.array_max("x")), F.sum(_total("x")), F.sum(_total("x0"))).first()
        if top is None:
            break
        moved = F.zip_with("x", "x0", lambda x, x0: F.abs(x / s1 - x0 / s0))
        change = kept.agg(F.sum(_total(moved))).first()[0]
        hub = kept.select("block", F.transform("x", lambda x: x / top).alias("x"))
        if saved is not None:
            discard(saved)
        saved = kept
        sweep(edges.sparkSession)
        if change < tolerance:
            break
    else:
        if max_rounds is None:
            raise NotConverged(f"HITS: scores still change after {HITS_ROUNDS} rounds")
        # without convergence there are no scores
        hub = hub.select("block", F.transform("x", lambda _: F.lit(0.0)).alias("x"))
    authority = save_and_reload(_meet(by_cited, _meet(by_citing, hub, _first_mail, MAIL), _received, SCORES), "hits")
    by_citing.unpersist()
    by_cited.unpersist()
    # an edge without one end counts for no score, but its nodes are listed
    loose = _ends(edges.filter("citing IS NULL OR cited IS NULL")).select("node", F.lit(None).cast("double").alias("x"), F.lit(2).alias("kind"))
    ends = _by_node(citing, hub, 0).unionByName(_by_node(cited, authority, 1)).unionByName(loose)
    score = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("x")))
    totals = hub.agg(F.sum(_total("x")).alias("_h")).join(F.broadcast(authority.agg(F.sum(_total("x")).alias("_a"))))
    return (
        ends.groupBy("node").agg(score(0).alias("h"), score(1).alias("a")).join(F.broadcast(totals))
        .select(
            "node",
            F.coalesce(F.try_divide("h", "_h"), F.lit(0.0)).alias("hub"),
            F.coalesce(F.try_divide("a", "_a"), F.lit(0.0)).alias("authority"),
        )
    )


def _tiles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the tiles: (block, other, pos, own), one row per tile, the citing side with ``slot`` and ``node``.

    ``pos`` are places in ``own``, the nodes of a block, which its first tile holds. The citing side has an entry
    per edge; ``slot`` is the cited node's place in ``node``, the cited nodes of the tile. The cited side has an
    entry per cited node of the tile, in the same order.
    """
    n_blocks = edges.count() // BLOCK + 1
    block = lambda node: F.pmod(F.xxhash64(node), F.lit(n_blocks)).cast("int")
    citing_type, cited_type = (edges.schema[c].dataType.simpleString() for c in ("citing", "cited"))
    placed = edges.select("citing", "cited", block("citing").alias("block"), block("cited").alias("other")).dropna()
    citing = save_and_reload(
        spread(placed, "block").groupBy("block").applyInArrow(
            _citing_tiles, f"block int, other int, pos array<int>, own array<{citing_type}>, slot array<int>, node array<{cited_type}>"
        ), "hits-citing",
    )
    turned = citing.select(F.col("other").alias("block"), F.col("block").alias("other"), "node")
    cited = save_and_reload(
        spread(turned, "block").groupBy("block").applyInArrow(
            _cited_tiles, f"block int, other int, pos array<int>, own array<{cited_type}>"
        ), "hits-cited",
    )
    return citing, cited


def _by_node(tiles: DataFrame, scores: DataFrame, kind: int) -> DataFrame:
    """(node, x, kind) of the scores of blocks."""
    own = tiles.filter("own IS NOT NULL").select("block", F.col("own").alias("node"))
    return own.join(scores, "block").select(F.inline(F.arrays_zip("node", "x")), F.lit(kind).alias("kind"))


def _total(values: str | Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


SCORES = "block int, x array<double>"
MAIL = "block int, other int, x array<double>"


def _meet(tiles: DataFrame, values: DataFrame, turn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``turn`` of each block's tiles and of what has come for the block."""
    return tiles.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(turn, schema)


def _lists(starts: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _flat(lists: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in lists.chunks])


def _first_only(nodes: pa.Array, n: int) -> pa.Array:
    """The list ``nodes`` and nulls after it, ``n`` rows."""
    return pa.concat_arrays([_lists(np.array([0, len(nodes)]), nodes), pa.nulls(n - 1, pa.list_(nodes.type))])


def _coded(nodes: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of ``nodes`` among the distinct ones, and these."""
    codes = nodes.dictionary_encode()
    return codes.indices.to_numpy(), codes.dictionary


def _citing_tiles(edges: pa.Table) -> pa.Table:
    edges = edges.sort_by([("other", "ascending"), ("cited", "ascending")]).combine_chunks()
    other, (pos, own) = edges["other"].to_numpy(), _coded(edges["citing"].chunk(0))
    cited, _ = _coded(edges["cited"].chunk(0))
    n = len(other)
    tile_begins = np.concatenate([[True], other[1:] != other[:-1]])
    slot_begins = tile_begins | np.concatenate([[True], cited[1:] != cited[:-1]])
    starts, slot = np.flatnonzero(tile_begins), np.cumsum(slot_begins) - 1
    sizes = np.diff(starts, append=n)
    first_slots = slot[starts]
    return pa.table({
        "block": edges["block"].take(starts), "other": other[starts], "pos": _lists(np.append(starts, n), pos),
        "own": _first_only(own, len(starts)),
        "slot": _lists(np.append(starts, n), (slot - np.repeat(first_slots, sizes)).astype(np.int32)),
        "node": _lists(np.append(first_slots, slot[-1] + 1), edges["cited"].chunk(0).take(pa.array(np.flatnonzero(slot_begins)))),
    })


def _cited_tiles(tiles: pa.Table) -> pa.Table:
    pos, own = _coded(_flat(tiles["node"]))
    return pa.table({
        "block": tiles["block"], "other": tiles["other"], "pos": _lists(_starts(tiles["node"]), pos),
        "own": _first_only(own, tiles.num_rows),
    })


def _starts(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])


def _layout(tiles: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, slots counted over all tiles, and where the slots of each tile begin."""
    pos, begins = _flat(tiles["pos"]).to_numpy(), _starts(tiles["pos"])
    if "slot" not in tiles.column_names:
        return pos, np.arange(len(pos)), begins
    slot = _flat(tiles["slot"]).to_numpy()
    starts = np.concatenate([[0], np.cumsum(np.maximum.reduceat(slot, begins[:-1]) + 1)])
    return pos, slot + np.repeat(starts[:-1], np.diff(begins)), starts


def _sent(tiles: pa.Table, x: np.ndarray, pos: np.ndarray, slot: np.ndarray, starts: np.ndarray) -> pa.Table:
    sums = np.bincount(slot, x[pos], starts[-1])
    return pa.table({"block": tiles["other"], "other": tiles["block"], "x": _lists(starts, sums)})


def _first_mail(tiles: pa.Table, scores: pa.Table) -> pa.Table:
    tiles = tiles.sort_by("other")
    return _sent(tiles, _flat(scores["x"]).to_numpy(), *_layout(tiles))


def _passed_on(tiles: pa.Table, mail: pa.Table) -> pa.Table:
    tiles = tiles.sort_by("other")
    pos, slot, starts = _layout(tiles)
    return _sent(tiles, np.bincount(pos, _flat(mail.sort_by("other")["x"]).to_numpy()[slot]), pos, slot, starts)


def _received(tiles: pa.Table, mail: pa.Table) -> pa.Table:
    pos, slot, _ = _layout(tiles.sort_by("other"))
    x = np.bincount(pos, _flat(mail.sort_by("other")["x"]).to_numpy()[slot])
    return pa.table({"block": tiles["block"].slice(0, 1), "x": _lists(np.array([0, len(x)]), x)})


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each: (u, v)."""
    return edges.select(
        F.inline(
            F.array(
                F.struct(F.col("citing").alias("u"), F.col("cited").alias("v")),
                F.struct(F.col("cited").alias("u"), F.col("citing").alias("v")),
            )
        )
    ).distinct()


_kept_pairs: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


@contextmanager
def _neighbours(edges: DataFrame) -> Iterator[DataFrame]:
    """`undirected` edges kept by ``v``; loops inside a block of the same edges share its table."""
    if edges in _kept_pairs:
        yield _kept_pairs[edges]
        return
    table = save_and_reload(undirected(edges), "both-ways")
    pairs = _kept_pairs[edges] = kept_by(table, "v")
    try:
        yield pairs
    finally:
        del _kept_pairs[edges]
        pairs.unpersist()
        discard(table)


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the weakly connected component.

    Large-star / small-star: every round hangs nodes below smaller ones, and the number of
    rounds grows with the logarithm of the graph, not with its diameter.
    """
    def saved(df: DataFrame) -> DataFrame:
        # each star is a small plan of its own: one plan for both reads its table many times over
        return save_and_reload(spread(df, "u").distinct(), "wcc")

    def large_star(df: DataFrame, n_rows: int) -> DataFrame:
        low = df.groupBy("u").agg(F.min("v").alias("m"))
        # every row has v < u, so a node without smaller neighbours has no row as u
        below = low.select(F.col("u").alias("_v"), "m")
        if n_rows <= HUB:
            return df.join(below, F.col("v") == F.col("_v"), "left").select("u", F.coalesce("m", "v").alias("v"))
        hubs = df.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select(F.col("v").alias("hub"))
        known = hubs.join(low, F.col("hub") == F.col("u"), "left").select("hub", F.coalesce("m", "hub").alias("to"))
        # at most one hub per `HUB` rows
        marked = df.join(F.broadcast(known), F.col("v") == F.col("hub"), "left")
        rest = spread(marked.filter("hub IS NULL").select("u", "v"), "v")
        rest = rest.join(below, F.col("v") == F.col("_v"), "left").select("u", F.coalesce("m", "v").alias("v"))
        return rest.unionByName(marked.filter("hub IS NOT NULL").select("u", F.col("to").alias("v")))

    def small_star(df: DataFrame) -> DataFrame:
        low = df.groupBy("u").agg(F.min("v").alias("m"))
        hung = df.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(low.select("u", F.col("m").alias("v")))

    def signature(df: DataFrame) -> tuple:
        # a set of edges is unchanged when its size and hash sum are
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ordered = edges.select(F.greatest("citing", "cited").alias("u"), F.least("citing", "cited").alias("v"))
    current = saved(ordered.filter("u <> v"))
    now = signature(current)
    # stars only ever hang lower, so the loop ends
    while now[0]:
        large = saved(large_star(current, now[0]))
        following = saved(small_star(large))
        discard(large)
        discard(current)
        current, before = following, now
        now = signature(current)
        if now == before:
            break
    nodes = _ends(edges).select("node").distinct()
    parent = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(parent, nodes["node"] == parent["u"], "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def component_sizes(components: DataFrame, n: int | None = 10, column: str = "component") -> DataFrame:
    """Group sizes, largest first."""
    sizes = components.groupBy(column).agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes if n is None else top_n(sizes, "n_nodes", n, [column])


def core_numbers(edges: DataFrame) -> DataFrame:
    """Core number of every node of the undirected graph.

    Starting from the degree, each node takes the largest k such that k neighbours have at
    least k; the fixpoint is the core number. A node's neighbours are counted per value
    first, so a hub costs one row per distinct value.
    """
    with _neighbours(edges) as pairs:
        return _core_numbers(pairs)


def _core_numbers(pairs: DataFrame) -> DataFrame:
    current = save_and_reload(
        pairs.groupBy("u").agg(F.count(F.lit(1)).alias("core")).withColumnRenamed("u", "node"), "core"
    )
    # values only ever fall, so the loop ends
    for _ in count():
        own = current.select(F.col("node").alias("u"), F.col("core").alias("own"))
        neighbour = current.select(F.col("node").alias("v"), F.col("core").alias("value"))
        # as many tasks as the session has partitions: the rows are narrow, merged ones would be large in memory
        seen = (
            spread(pairs.join(neighbour, "v").select("u", "value"), "u").join(own, "u")
            # values above a node's own cannot raise it, so they count as equal
            .groupBy("u", "own", F.least("value", "own").alias("value"))
            .agg(F.count(F.lit(1)).alias("c"))
        )
        down = W.partitionBy("u").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0)
        new = (
            seen.withColumn("h", F.least("value", F.sum("c").over(down)))
            .groupBy("u").agg(F.max("h").alias("core"), F.max("own").alias("own"))
            .withColumnRenamed("u", "node")
        )
        following = save_and_reload(new, "core")
        discard(current)
        current = following
        sweep(pairs.sparkSession)
        if current.filter(F.col("core") < F.col("own")).limit(1).count() == 0:
            break
    return current.select("node", "core")


def communities(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, community) by label propagation, run until no label changes.

    In the result every node has the most frequent label among its neighbours and itself, the
    smallest on a tie. All nodes change at once until nothing changes or the labels swing
    between two states, the only ways in which such rounds can end. From a swing on, a node
    changes only if its place in an order drawn anew each round comes before those of all
    neighbours that want to change. No two neighbours change together then, and as a node's own label
    counts, each change puts more edges inside communities, so this ends too.

    More than ``max_rounds`` rounds, if given, raise `NotConverged`.
    """
    with _neighbours(edges) as pairs:
        return _communities(pairs, max_rounds)


def _communities(pairs: DataFrame, max_rounds: int | None) -> DataFrame:
    start = pairs.select(F.col("u").alias("node")).distinct()
    # ``old`` is the label one round before
    current = save_and_reload(start.select("node", F.col("node").alias("community"), F.col("node").alias("old")), "label")
    swings = settled = False
    for i in count():
        if max_rounds is not None and i == max_rounds:
            break
        heard = pairs.join(current, pairs["v"] == current["node"]).select(F.col("u").alias("node"), "community")
        # one shuffle by node serves both counts and the join below
        votes = (
            spread(heard.unionByName(current.select("node", "community")), "node")
            .groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        )
        chosen = votes.groupBy("node").agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("community").alias("c"))).alias("b")
        ).select("node", F.col("b.c").alias("wanted"))
        before = current.select("node", F.col("community").alias("old"), F.col("old").alias("older"))
        following = chosen.join(before, "node")
        if swings:
            following = _one_of_neighbours(following, pairs, i)
        following = save_and_reload(following.withColumnRenamed("wanted", "community"), "label")
        discard(current)
        current = following
        sweep(pairs.sparkSession)
        changed, back = current.agg(
            F.count_if(F.col("community") != F.col("old")), F.count_if(F.col("community") != F.col("older"))
        ).first()
        if not changed:
            settled = True
            break
        swings = swings or (i > 0 and not back)
    if not settled:
        raise NotConverged(f"communities: labels still change after {max_rounds} rounds")
    return current.select("node", "community")


def _one_of_neighbours(wishes: DataFrame, pairs: DataFrame, turn: int) -> DataFrame:
    """``wishes`` with ``wanted`` granted to no two neighbours, and to one node at least if any wants to change."""
    place = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("n"))
    moving = wishes.filter(F.col("wanted") != F.col("old")).select(F.col("node").alias("mover"), place.alias("place"))
    nearby = (
        pairs.join(moving, pairs["v"] == moving["mover"]).groupBy("u").agg(F.min("place").alias("first_nearby"))
    )
    joined = wishes.join(nearby, wishes["node"] == nearby["u"], "left")
    free = F.col("first_nearby").isNull() | (place < F.col("first_nearby"))
    return joined.select("node", F.when(free, F.col("wanted")).otherwise(F.col("old")).alias("wanted"), "old", "older")


def induced_by_top(edges: DataFrame, ranks: DataFrame, n: int = 100) -> DataFrame:
    """Edges whose two ends are among the ``n`` nodes of highest PageRank."""
    best = top_n(ranks, "pagerank", n, ["node"]).select("node")
    kept = edges.join(best.withColumnRenamed("node", "citing"), "citing", "left_semi")
    return kept.join(best.withColumnRenamed("node", "cited"), "cited", "left_semi").select("citing", "cited")


def node_metrics(edges: DataFrame) -> DataFrame:
    """One row per node with all metrics.

    The four loops run side by side: their jobs are many and short, and one loop's jobs use the
    cores that the last tasks of another's leave idle.
    """
    edges = save_and_reload(edges, "graph")
    loops = (pagerank, hits, core_numbers, communities)
    # cores and communities read one table of neighbours
    with _neighbours(edges), ThreadPoolExecutor(len(loops)) as pool:
        running = [pool.submit(inheritable_thread_target(edges.sparkSession)(loop), edges) for loop in loops]
        ranks, scores, cores, labels = [r.result() for r in running]
    base = degrees(edges).withColumn("node_type", _role()).withColumn("label", node_label())
    out = base.join(ranks, "node").join(scores, "node")
    out = out.join(cores.withColumnRenamed("core", "core_number"), "node")
    out = out.join(labels, "node")
    return out.select(
        "node", "label", "node_type", "in_degree", "out_degree", "degree", "pagerank",
        "authority", "hub", "core_number", "community",
    )
