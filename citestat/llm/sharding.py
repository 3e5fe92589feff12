"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text are one group. Groups sorted by size enter the bin with the least remaining
capacity that still holds them, found in a balanced tree of the bins' remaining capacities.

At scale the groups are dealt out: the few groups that are large against a shard (at most
`LARGE` of them, whatever the table's size) are packed first, in one task; the many small ones are
dealt by hash into cells of about `CELL_GROUPS` groups, and every cell fills the capacity that the
large ones left in proportion to its bytes. So no task sees all groups. A group larger
than a shard cannot be whole: it is cut by a hash of its rows' ids into pieces well below a shard.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from citestat.llm.common import col, number_within, with_row_key
from citestat.session import save_and_reload

SHARDS = 40
#: Bytes a row needs beside its text.
ROW_BYTES = 16
LARGE = 20_000
CELL_GROUPS = 100_000
#: Pieces per shard into which a group above a shard's size is cut.
PIECES = 16


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key: tuple[int, int], rank: float):
        self.key, self.rank, self.left, self.right = key, rank, None, None


class CapacityTree:
    """Treap of (remaining capacity, bin): balanced on average, whatever the order of the keys."""

    def __init__(self, keys: Iterator[tuple[int, int]] = ()):
        self._root: _Node | None = None
        self._random = random.Random(1)
        for key in keys:
            self.add(key)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        self._root = self._merge(self._merge(low, _Node(key, self._random.random())), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Smallest key with a capacity of at least ``size``, removed from the tree."""
        low, rest = self._split(self._root, (size, -1))
        if rest is None:
            self._root = low
            return None
        parent, node = None, rest
        while node.left is not None:
            parent, node = node, node.left
        if parent is None:
            rest = node.right
        else:
            parent.left = node.right
        self._root = self._merge(low, rest)
        return node.key

    def largest(self) -> tuple[int, int]:
        """Largest key, removed from the tree."""
        parent, node = None, self._root
        while node.right is not None:
            parent, node = node, node.right
        if parent is None:
            self._root = node.left
        else:
            parent.right = node.left
        return node.key

    @classmethod
    def _split(cls, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = cls._split(node.right, key)
            return node, high
        low, node.left = cls._split(node.left, key)
        return low, node

    @classmethod
    def _merge(cls, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = cls._merge(a.right, b)
            return a
        b.left = cls._merge(a, b.left)
        return b


def pack(sizes: list[int], capacities: list[int]) -> list[int]:
    """Bin of each item; ``sizes`` descend. An item that fits nowhere enters the emptiest bin."""
    tree = CapacityTree((c, i) for i, c in enumerate(capacities))
    out = []
    for size in sizes:
        left, i = tree.tightest(size) or tree.largest()
        tree.add((left - size, i))
        out.append(i)
    return out


def pack_fixed(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item when bins of ``capacity`` are opened as needed; ``sizes`` descend.

    An item above the capacity has a bin of its own.
    """
    tree, out, n = CapacityTree(), [], 0
    for size in sizes:
        found = tree.tightest(size)
        if found is None:
            found, n = (max(capacity, size), n), n + 1
        tree.add((found[0] - size, found[1]))
        out.append(found[1])
    return out


def _level(total: int, shards: int, largest: list[int]) -> int:
    """Capacity of a shard when items that are larger than it have shards of their own."""
    for i, size in enumerate(largest):
        level = max(1, -(-total // max(1, shards - i)))
        if size <= level:
            return level
        total -= size
    return max(1, total)


def shard(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Per row: id, the columns ``keep``, size, text_crc32, shard and slot; shards have nearly equal bytes.

    Size is the UTF-8 bytes of the text, 0 for null, plus `ROW_BYTES`. Rows of equal text share
    a shard, null texts among themselves too, unless their bytes exceed a whole shard. Slots
    number the rows of a shard from 0 without gaps. Repeated rows each have a slot.
    """
    rows = save_and_reload(
        docs.select(
            col(id_col).alias("id"), (F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            # two hashes and the size name a text
            F.xxhash64(F.lit(1), col(text_col)).alias("h1"), F.xxhash64(F.lit(2), F.isnull(col(text_col)), col(text_col)).alias("h2"),
            *[col(c).alias(f"keep{i}") for i, c in enumerate(keep)],
        ),
        "shard-rows",
    )
    texts = ["h1", "h2", "size"]
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n_rows:
        total = 0
    fair = max(1, -(-int(total) // shards))
    whole = rows.groupBy(*texts).agg(F.sum("size").alias("bytes"))
    cut = save_and_reload(
        whole.filter(F.col("bytes") > fair).select(
            *texts, F.least(F.ceil(F.col("bytes") * PIECES / fair), F.col("bytes")).cast("bigint").alias("pieces")
        ),
        "shard-cut",
    )
    # fewer than ``shards`` texts are above a shard's size
    placed = rows.join(F.broadcast(cut), texts, "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("id", F.lit(3)), "pieces"), F.lit(0)).cast("bigint")
    ).drop("pieces")
    key = [*texts, "piece"]
    groups = save_and_reload(placed.groupBy(*key).agg(F.sum("size").alias("bytes")), "shard-groups")
    fair = _level(int(total), shards, [r["bytes"] for r in groups.orderBy(F.desc("bytes")).limit(shards).collect()])
    # of groups above this size there are at most LARGE
    large = max(1, int(total) // LARGE)

    def pack_large(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", *key], ascending=[False] + [True] * len(key))
        return group.assign(shard=pack(group["bytes"].tolist(), [fair] * shards))[[*key, "shard"]]

    schema = "h1 bigint, h2 bigint, size bigint, piece bigint, shard int"
    big = groups.filter(F.col("bytes") > large)
    # one task over at most LARGE rows
    first = save_and_reload(big.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(pack_large, schema), "shard-large")
    used = {r["shard"]: r["b"] for r in first.join(big, key).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    left = [max(0, fair - used.get(i, 0)) for i in range(shards)]
    small = groups.filter(F.col("bytes") <= large)
    n_small = small.count()
    cells = max(1, -(-n_small // CELL_GROUPS))

    def pack_small(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", *key], ascending=[False] + [True] * len(key))
        part = group["bytes"].sum() / max(1, sum(left))
        room = [int(c * part) + 1 for c in left]
        return group.assign(shard=pack(group["bytes"].tolist(), room))[[*key, "shard"]]

    rest = small.withColumn("cell", F.pmod(F.xxhash64(*key, F.lit(5)), F.lit(cells))).groupBy("cell").applyInPandas(pack_small, schema)
    # the copies of a text can be many rows, so the join may be split
    homes = save_and_reload(first.unionByName(rest), "shard-homes")
    housed = save_and_reload(placed.join(homes, key), "shard-housed")
    numbered = number_within(housed, ["shard"], [F.xxhash64("id", "h1"), F.col("id"), F.col("h1")], "slot", cells=256)
    return numbered.select(
        F.col("id").alias(id_col), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "size", "text_crc32", "shard", "slot"
    )


def sharded(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` with size, text_crc32, shard and slot; columns of these names are replaced.

    Shards are planned on row keys and hashes; the rows are joined once, as they are written.
    """
    added = ["size", "text_crc32", "shard", "slot"]
    keyed, key = with_row_key(docs)
    plan = shard(keyed, text_col, id_col, shards, keep=tuple(key))
    plan = plan.select(*[col(k).alias(f"key{i}") for i, k in enumerate(key)], *added)
    kept = keyed.select(*key, F.struct(*[col(c) for c in docs.columns]).alias("row"))
    rows = kept.join(plan, [F.col(k) == F.col(f"key{i}") for i, k in enumerate(key)])
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added], *added)
