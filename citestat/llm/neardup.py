"""Near-duplicate groups by MinHash bands, odd sketches and exact set comparison.

1. Every text becomes its set of word shingles. MinHash bands of the set give candidates. A
   second MinHash of one permutation, cut into `BINS` bins, keeps one sample per bin; the
   samples are folded into an odd sketch, a bitmap in which each sample flips one bit, so that
   the XOR of two sketches counts the samples that differ.
2. Texts with equal sets are one class with the smallest id as representative; only
   representatives are compared, and copies never meet.
3. In each band bucket every member is held against one leader, the smallest id. Pairs whose
   sketches are too far apart go; the others are compared on their full sets.
4. The links so far give components. A bucket that still holds several components is searched
   in tiles: members of different components are compared by sketch inside the tile, and only
   pairs that pass leave it, for the full comparison. First the most alike pair of each member
   and component, then, with the components that this leaves, every pair. A group of thousands
   of alike texts is mostly one component after step 3, so few pairs of it are looked at.

A pair of the wanted similarity shares no band with probability (1 - s**rows)**bands. Bands and
rows follow from the wanted similarity so that this is at most 1e-6, and the sketch's margin
from it so that it is at least five standard deviations. Links are confirmed on the full sets, so none is wrong.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citestat.llm.common import WORD, col, free_name, likely_in
from citestat.llm.words import mixed, shingle_sets
from citestat.operators.graph import weak_components
from citestat.session import save_and_reload

#: Bands at least and rows at most; for lower similarities the bands grow to `MANY_BANDS`, then rows are given up.
BANDS, ROWS, MANY_BANDS = 24, 5, 128
#: Probability, at most, that a pair at the threshold shares no band.
MISS = 1e-6
BINS, BITS = 1024, 2048
MARGIN = 0.08
TILE = 512

_SIGNATURE = "n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, parity binary, filled binary"


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows) with which a pair of ``percent`` similarity shares no band with probability `MISS` at most."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    if percent == 100:
        return BANDS, ROWS
    for rows in range(ROWS, 0, -1):
        bands = max(BANDS, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))))
        if bands <= MANY_BANDS:
            break
    return bands, rows


def margin(percent: int) -> float:
    """How far below ``percent`` an estimate of a pair at it may lie: five standard deviations at least."""
    s = percent / 100
    share = (1 - math.exp(-4 * (1 - s) * BINS / BITS)) / 2
    sketch = math.sqrt(BITS * share * (1 - share)) / (1 - 2 * share) / 2 / BINS
    return max(MARGIN, 5 * math.hypot(sketch, math.sqrt(s * (1 - s) / BINS)))


def _multipliers(n: int = BANDS * ROWS) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(
    sets: list[np.ndarray], multipliers: np.ndarray, n_bands: int = BANDS, n_rows: int = ROWS
) -> dict[str, np.ndarray]:
    """Per non-empty set: two fingerprints, the band keys, the odd sketch and the filled bins."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = {
        "f1": np.add.reduceat(mixed(every ^ np.uint64(0x243F6A8885A308D3)), starts),
        "f2": np.add.reduceat(mixed(every ^ np.uint64(0x13198A2E03707344)), starts),
    }
    product = np.empty_like(every)
    bands = np.empty((len(sets), n_bands), dtype=np.uint64)
    for band in range(n_bands):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for row in range(n_rows):
            np.multiply(every, multipliers[band * n_rows + row], out=product)
            key = mixed(key ^ np.minimum.reduceat(product, starts))
        bands[:, band] = key
    # sets are sorted, so the first value of each bin is the bin's minimum
    bins = (every >> np.uint64(54)).astype(np.int64)
    place = owner * BINS + bins
    first = np.flatnonzero(np.diff(place, prepend=-1))
    flips = owner[first] * BITS + (mixed(every[first]) & np.uint64(BITS - 1)).astype(np.int64)
    parity = np.bincount(flips, minlength=len(sets) * BITS).astype(np.uint8) & 1
    filled = np.zeros(len(sets) * BINS, dtype=np.uint8)
    filled[place[first]] = 1
    return out | {
        "bands": bands,
        "parity": np.packbits(parity.reshape(len(sets), BITS), axis=1),
        "filled": np.packbits(filled.reshape(len(sets), BINS), axis=1),
    }


def similarity_estimate(parity_a: np.ndarray, parity_b: np.ndarray, filled_a: np.ndarray, filled_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from odd sketches, row by row; arrays of 64-bit words."""
    apart = np.bitwise_count(parity_a ^ parity_b).sum(axis=-1, dtype=np.int64)
    # a bitmap with half its bits different says nothing more about the distance
    share = np.minimum(2 * apart / BITS, 0.98)
    differing = -0.5 * BITS * np.log1p(-share)
    n_a = np.bitwise_count(filled_a).sum(axis=-1, dtype=np.int64)
    n_b = np.bitwise_count(filled_b).sum(axis=-1, dtype=np.int64)
    either = np.bitwise_count(filled_a | filled_b).sum(axis=-1, dtype=np.int64)
    return (n_a + n_b - differing) / 2 / np.maximum(either, 1)


def _words64(column: pd.Series | pa.Array) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, n_shingles, f1, f2, bands, parity, filled) per row; nulls after n_shingles for an empty set."""
    multipliers = _multipliers(bands * rows)
    names = [f.split()[0] for f in _SIGNATURE.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), k):
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                node = batch.column(0).slice(first, len(sets))
                cells: dict[str, list] = {n: [None] * len(sets) for n in names[1:]}
                if len(full):
                    made = _signatures([sets[i] for i in full], multipliers, bands, rows)
                    for name in ("f1", "f2"):
                        for i, v in zip(full, made[name].view(np.int64).tolist(), strict=True):
                            cells[name][i] = v
                    for i, v in zip(full, made["bands"].view(np.int64), strict=True):
                        cells["bands"][i] = v
                    for name in ("parity", "filled"):
                        for i, v in zip(full, made[name], strict=True):
                            cells[name][i] = v.tobytes()
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [node, pa.array(sizes)] + [pa.array(cells[n], t) for n, t in zip(names[1:], kinds, strict=True)],
                    names=["node", *names],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(col(id_col).alias("node"), col(text_col).alias("text")).mapInArrow(
        sign, f"node {kind}, {_SIGNATURE}"
    )


def _pass_sketch(pairs: DataFrame, sketches: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least ``floor``."""
    def side(name: str) -> DataFrame:
        return sketches.select(F.col("rep").alias(name), F.col("parity").alias(f"p_{name}"), F.col("filled").alias(f"f_{name}"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p_a, f_a, p_b, f_b = (_words64(batch.column(c)) for c in ("p_a", "f_a", "p_b", "f_b"))
                near = similarity_estimate(p_a, p_b, f_a, f_b) >= floor
                yield batch.select(["a", "b"]).filter(pa.array(near))

    kind = dict(pairs.dtypes)["a"]
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", "p_a", "f_a", "p_b", "f_b"
    ).mapInArrow(close, f"a {kind}, b {kind}")


def _confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full shingle sets, once each."""
    nodes = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct()
    nodes = save_and_reload(nodes, "near-nodes")
    texts = docs.select(col(id_col).alias("node"), col(text_col).alias("text"))
    texts = save_and_reload(likely_in(texts, F.col("node"), nodes).join(nodes, "node").distinct(), "near-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a share of the rows at a time bounds what the sets of a batch need
            size = max(1, int(batch.num_rows * (1 << 23) / max(batch.nbytes, 1 << 23)))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                both = pa.concat_arrays([part.column("ta"), part.column("tb")])
                sets = [s for _, found in shingle_sets(both, k) for s in found]
                linked = []
                for i in range(part.num_rows):
                    x, y = sets[i], sets[part.num_rows + i]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    )
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def _tile_pairs(members: DataFrame, floor: float, best: bool) -> DataFrame:
    """Pairs of one bucket that lie in different components and pass the sketch; with ``best`` only
    the most alike pair of a member and a component.

    ``members``: key, n, leader, rep, comp, bands, parity, filled. A bucket is cut into tiles of
    about `TILE` members; every pair of tiles is one group, so no task holds a whole bucket.
    A pair is looked at in the first band that its members share.
    """
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    kind = dict(members.dtypes)["rep"]
    dealt = (
        members.withColumn("tiles", tiles)
        .withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile",
            "leader", "rep", "comp", "bands", "parity", "filled",
        )
    )

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = key
        bands = np.stack(group["bands"].to_numpy())
        parity, filled = _words64(group["parity"]), _words64(group["filled"])
        rep, tile = group["rep"].to_numpy(), group["tile"].to_numpy()
        comp = pd.factorize(group["comp"])[0]
        common = np.bincount(comp).argmax()
        mine = int(np.flatnonzero(bands[0] == bucket)[0])
        found: list[tuple] = []
        # all but the largest component against everything
        for x in np.flatnonzero(comp != common):
            other = (comp != comp[x]) & ((comp == common) | (rep > rep[x])) & (rep != group["leader"].iat[0])
            if rep[x] == group["leader"].iat[0]:
                continue
            if i != j:
                other &= tile != tile[x]
            ys = np.flatnonzero(other)
            likeness = similarity_estimate(parity[x], parity[ys], filled[x], filled[ys])
            ys, likeness = ys[likeness >= floor], likeness[likeness >= floor]
            if best:
                ys = ys[np.argsort(-likeness, kind="stable")]
                ys = ys[np.unique(comp[ys], return_index=True)[1]]
            else:
                ys = ys[(bands[ys] == bands[x]).argmax(axis=1) == mine]
            found += [(min(rep[x], rep[y]), max(rep[x], rep[y])) for y in ys]
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInPandas(search, f"a {kind}, b {kind}")


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """(node, n_shingles, f1, f2, component): one row per row of ``docs``.

    ``component`` is the smallest id reachable over links of at least ``percent`` similarity.
    Texts without words, and null texts, are linked with nothing. Rows that share an id are one
    node, linked with whatever any of their texts is like. A row with a null id belongs to its
    exact copies only; alone, its component is null. Ids are integers.
    """
    floor = percent / 100 - margin(percent)
    rows = save_and_reload(signatures(docs, id_col, text_col, k, *banding(percent)), "near-signatures")
    classes = save_and_reload(
        rows.filter("f1 IS NOT NULL").groupBy("f1", "f2").agg(
            F.min("node").alias("rep"), F.first("bands").alias("bands"),
            F.first("parity").alias("parity"), F.first("filled").alias("filled"),
        ),
        "near-classes",
    )
    sketches = classes.filter("rep IS NOT NULL").select("rep", "bands", "parity", "filled")
    cells = sketches.select("rep", F.explode("bands").alias("key"))
    buckets = save_and_reload(
        cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).filter("n > 1"), "near-buckets"
    )
    members = save_and_reload(
        likely_in(cells, F.col("key"), buckets.select("key")).join(buckets, "key"), "near-members"
    )
    stars = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    near = save_and_reload(_pass_sketch(stars, sketches, floor), "near-stars")
    links = save_and_reload(_confirm(near, docs, id_col, text_col, k, percent), "near-links")
    label = save_and_reload(
        weak_components(links.select(F.col("a").alias("citing"), F.col("b").alias("cited"))), "near-components"
    )
    # the most alike pairs first: they join most of what can be joined, and few pairs remain
    for best in (True, False):
        # two members are one pair, and it has been compared
        placed = members.filter("n > 2").join(label, F.col("rep") == F.col("node"), "left").select(
            "key", "n", "leader", "rep", F.coalesce("component", "rep").alias("comp")
        )
        placed = save_and_reload(placed, "near-placed")
        several = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        rest = placed.join(several, "key").join(sketches, "rep")
        more = save_and_reload(_tile_pairs(rest, floor, best).distinct(), "near-more")
        label = _joined(label, save_and_reload(_confirm(more, docs, id_col, text_col, k, percent), "near-links"))
    final = classes.select("f1", "f2", "rep").join(label, F.col("rep") == F.col("node"), "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component")
    )
    return rows.select("node", "n_shingles", "f1", "f2").join(save_and_reload(final, "near-final"), ["f1", "f2"], "left").select(
        "node", "n_shingles", "f1", "f2", F.when(F.col("f1").isNull(), F.col("node")).otherwise(F.col("component")).alias("component")
    )


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b); a node without a row is its own component."""
    ends = (
        links.join(label.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
        .join(label.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
        .select(F.coalesce("ca", "a").alias("citing"), F.coalesce("cb", "b").alias("cited"))
        .filter("citing <> cited").distinct()
    )
    moved = save_and_reload(weak_components(save_and_reload(ends, "near-ends")), "near-moved")
    moved = moved.withColumnsRenamed({"node": "old", "component": "new"})
    before = label.join(moved, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    # what had no link until now
    fresh = moved.join(label, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return save_and_reload(before.unionByName(fresh), "near-components")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the row of the smallest id.

    Of repeated rows of one id the row with the smallest text stays. Rows without words and
    rows with a null id all stay.
    """
    found = save_and_reload(near_duplicate_components(docs, id_col, text_col, k, percent), "near-found")
    node = free_name(docs, "node")
    known = found.filter(F.col("f1").isNotNull() & F.col("node").isNotNull()).groupBy(F.col("node").alias(node)).agg(
        F.min("component").alias("component"), F.count(F.lit(1)).alias("n_rows")
    )
    known = save_and_reload(known, "near-known")
    gone = save_and_reload(known.filter(F.col(node) != F.col("component")).select(node), "near-gone")
    repeated = save_and_reload(known.filter("n_rows > 1").select(node), "near-repeated")

    def without(df: DataFrame, ids: DataFrame) -> DataFrame:
        # rows without words stay, whatever else has their id
        worded = F.coalesce(df[f"`{text_col}`"], F.lit("")).rlike(WORD)
        return df.join(ids, (df[f"`{id_col}`"] == ids[node]) & worded, "left_anti")

    several = docs.join(repeated, docs[f"`{id_col}`"] == repeated[node], "left_semi")
    several = without(several.filter(F.coalesce(col(text_col), F.lit("")).rlike(WORD)), gone)
    whole = F.struct(*[col(c) for c in docs.columns])
    one_each = several.groupBy(col(id_col).alias(node)).agg(F.min_by(whole, col(text_col)).alias("row")).select("row.*")
    return without(without(docs, repeated), gone).unionByName(one_each)
