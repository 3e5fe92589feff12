"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources.

Every row becomes a leaf digest. The leaves of a source, in the order of their ids, are joined
in runs of ``fan`` consecutive nodes until one is left, the subroot; the subroots, in the order of
their sources, are joined the same way into the root. A digest is the lowercase hex SHA-256 of the
concatenated hex digests below it.

The tree is a rollup over the digits of the leaves' ranks. Rows are placed once by
(source, block), a block being ``fan ** depth`` consecutive leaves; then one digit after the other is
grouped away, and every group nests the structs of its children, so the groupings of a block need no
further shuffle and the nested struct of a block has a bounded size. The blocks are the leaves of the
next rollup, until a source is one node. On the way back, each nested struct is transformed from its
top down into its leaves with their proofs, and exploded; a block meets the proof of its own digest
by grouping on the block's key. No proof is found by a join.

Leaves are ordered by id, null first, and rows of one id by their digest; rows that agree in
both are alike, so their order changes no digest. Each repeated row is a leaf of its own. A null
source is a source, the first one. An empty table has an empty manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from citestat.llm.common import col
from citestat.session import save_and_reload, shuffle_width

FAN = 3
#: Levels of the tree in one nested struct: 3 ** 6 = 729 leaves.
DEPTH = 6

#: The columns of a row that its leaf covers, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, numbers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(columns: Sequence[str] = LEAF_COLUMNS, replaced: dict[str, Column] | None = None) -> Column:
    """Leaf of a row; ``replaced`` gives other values for some of the columns."""
    return digest(*[encoded((replaced or {}).get(c, col(c))) for c in columns])


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf leads to: from below, each step hashes left siblings, digest and right siblings."""
    return F.aggregate(path, leaf, lambda held, step: digest(step["left"], held, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: Sequence[str] = LEAF_COLUMNS,
    keep: Sequence[str] = (), fan: int = FAN, depth: int = DEPTH,
) -> DataFrame:
    """Per row: id, source, the columns ``keep``, leaf, subroot, root and path.

    path is an array of (left, right), from the leaf up to the root: the concatenated digests of the
    siblings on either side, both empty where a run has one node.
    """
    leaves = save_and_reload(
        docs.select(
            # null is the first source; the marks make keys comparable without nulls
            F.when(col(source_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col(source_col).cast("string"))).alias("tree"),
            col(id_col).alias("id"), leaf_digest(columns).alias("digest"), F.monotonically_increasing_id().alias("row"),
            F.struct(col(id_col).alias("id"), col(source_col).alias("source"), *[col(c).alias(f"keep{i}") for i, c in enumerate(keep)]).alias("held"),
        ),
        "merkle-leaves",
    )
    ranked = _ranked(leaves, ["tree"], ["id", "digest", "row"], fan)
    rounds = _rounds(ranked.agg(F.max("levels")).first()[0], depth)
    up, tops = _rollup(ranked, ["tree"], rounds, fan, depth)
    sources = _ranked(tops.select("tree", "digest", F.col("tree").alias("held")), [], ["tree"], fan)
    n = _rounds(sources.agg(F.max("levels")).first()[0], depth)
    over, top = _rollup(sources, [], n, fan, depth)
    above = top.select(F.lit(0).cast("bigint").alias("block"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"), _no_path().alias("path"))
    above = _proofs(over, [], above)
    # a source's leaves begin with the path of its subroot
    above = save_and_reload(above.select(F.col("held").alias("tree"), F.lit(0).cast("bigint").alias("block"), "root", F.col("digest").alias("subroot"), "path"), "merkle-sources")
    return _proofs(up, ["tree"], above).select(
        F.col("held.id").alias(id_col), F.col("held.source").alias(source_col), *[F.col(f"held.keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("digest").alias("leaf"), "subroot", "root", "path",
    )


def verified(rows: DataFrame, leaf: Column) -> Column:
    """Whether ``leaf`` leads to the row's root over the row's path."""
    return folded(leaf, F.col("path")) == F.col("root")


def _rounds(levels: int | None, depth: int) -> int:
    return max(1, -(-(levels or 0) // depth))


def _no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def _ranked(nodes: DataFrame, by: list[str], order: list[str], fan: int) -> DataFrame:
    """``nodes`` with rank (from 0, within ``by``) and levels (of the tree over all nodes of ``by``).

    Range partitions are numbered each by itself and the rows before them are added.
    """
    spark = nodes.sparkSession
    parts = shuffle_width(spark)
    placed = nodes.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id())
    placed = save_and_reload(placed, "merkle-placed")
    sizes = placed.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(*by)
    before = every.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("total")
    ).select(*by, "part", "before", _levels("total", fan).alias("levels"))
    inner = F.row_number().over(W.partitionBy(*by, "part").orderBy(*order))
    numbered = placed.withColumn("inner", inner).join(offsets, [*by, "part"])
    return numbered.select(*by, (F.col("before") + F.col("inner") - 1).cast("bigint").alias("rank"), "levels", "digest", "held")


def _levels(n: str, fan: int) -> Column:
    """The least number of levels with fan ** levels >= n."""
    powers = ", ".join(f"{fan**k}L" for k in range(62) if fan**k < 1 << 62)
    return F.expr(f"size(filter(array({powers}), p -> p < {n}))")


def _rollup(nodes: DataFrame, by: list[str], rounds: int, fan: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The nested blocks of each round, and the top node per ``by``.

    ``nodes`` has rank, levels, digest and held. Blocks of later rounds hold the number of the
    block below as held. ``levels`` falls by ``depth`` with each round.
    """
    up = []
    for r in range(rounds):
        blocks = _nested(nodes, by, fan, depth)
        blocks = save_and_reload(blocks, f"merkle-blocks-{r}")
        up.append(blocks)
        nodes = blocks.select(
            *by, F.col("block").alias("rank"), F.greatest(F.col("levels") - depth, F.lit(0)).alias("levels"), "digest",
            F.col("block").alias("held"),
        )
    return up, nodes.select(*by, "digest")


def _nested(nodes: DataFrame, by: list[str], fan: int, depth: int) -> DataFrame:
    """One row per block: levels, digest, and the nested children in the order of their ranks.

    A level above the tree's own (a lone node) keeps the digest as it is.
    """
    parts = shuffle_width(nodes.sparkSession)
    digits = [f"d{k}" for k in range(depth)]
    placed = nodes.selectExpr(
        *by, f"rank div {fan**depth} AS block", *[f"CAST(rank div {fan**k} % {fan} AS INT) AS {digits[k]}" for k in range(depth)],
        "levels", "struct(digest, held) AS node",
    ).repartition(parts, *by, "block")
    for k in range(depth):
        # grouping away the lowest digit left; the rows lie together by (by, block) already
        left = [*by, "block", *digits[k + 1 :]]
        grouped = placed.groupBy(*left).agg(
            F.max("levels").alias("levels"), F.expr(f"transform(array_sort(collect_list(struct({digits[k]}, node))), c -> c.node) AS kids")
        )
        joined = "sha2(CAST(array_join(transform(kids, c -> c.digest), '') AS BINARY), 256)"
        placed = grouped.selectExpr(
            *left, "levels", f"struct(CASE WHEN levels > {k} THEN {joined} ELSE kids[0].digest END AS digest, kids) AS node"
        )
    return placed.selectExpr(*by, "block", "levels", "node.digest", "node.kids")


def _proofs(up: list[DataFrame], by: list[str], above: DataFrame) -> DataFrame:
    """All nodes below, with digest, held, root, subroot and path, from the paths of the top blocks."""
    for blocks in reversed(up):
        above = _emitted(blocks, by, above)
        if blocks is not up[0]:
            above = above.withColumnRenamed("held", "block").drop("digest")
    return above


def _emitted(blocks: DataFrame, by: list[str], above: DataFrame) -> DataFrame:
    """The nodes nested in ``blocks``, each with its path up to the root.

    Blocks and their own paths are brought together by grouping on the block's key.
    """
    key = [*by, "block"]
    kids = dict((f.name, f.dataType) for f in blocks.schema.fields)["kids"]
    depth = 0
    inner = kids.elementType
    while "kids" in inner.names:
        depth, inner = depth + 1, inner["kids"].dataType.elementType
    depth += 1
    path = above.schema["path"].dataType
    low = blocks.select(*key, F.struct("levels", "kids").alias("low"), F.lit(None).cast("struct<root:string,subroot:string>").alias("names"), F.lit(None).cast(path).alias("path"))
    high = above.select(*key, F.lit(None).cast(low.schema["low"].dataType).alias("low"), F.struct("root", "subroot").alias("names"), "path")
    met = low.unionByName(high).groupBy(*key).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("low", "names", "path")]
    )
    rows = met.filter("low IS NOT NULL").select(*by, "names.*", "low.levels", "low.kids", "path")
    # from the block down: the children of every node, each with its path
    for k in reversed(range(depth)):
        rows = rows.select(*by, "root", "subroot", "levels", F.explode(_children(k)).alias("x"))
        rows = rows.select(*by, "root", "subroot", "levels", "x.node.digest", f"x.node.{'kids' if k else 'held'}", "x.path")
    return rows.drop("levels")


def _children(k: int) -> Column:
    """The children of a node at level k + 1, with their paths. Levels above the tree's own join nothing."""
    joined = "array_join(transform({}, x -> x.digest), '')".format
    step = f"struct({joined('slice(kids, 1, i)')} AS `left`, {joined('slice(kids, i + 2, size(kids))')} AS `right`)"
    path = f"CASE WHEN levels > {k} THEN concat(array({step}), path) ELSE path END"
    return F.expr(f"transform(kids, (c, i) -> struct(c AS node, {path} AS path))")
