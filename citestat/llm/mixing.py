"""Mixing sources to target weights by subset-sum budget fitting.

Targets come from the weights by filling up: a source gets its share until it reaches `MAX_COPIES`
times its size, and what is left over goes to the others. A source gives all its texts as often
as they fit whole into its target; the rest of the target is a budget that a subset of its texts
has to meet. Texts of one length are alike to the budget, so the subset is a number of
texts per length: first the same share of every length, then a bounded knapsack by dynamic programming
over what remains, which usually meets the budget to the word. Which texts of a length are taken is
decided by a seeded hash.

Only counts per source and length leave the table; the program runs in one group per source over
its distinct lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from citestat.llm.common import WORD, col, free_name, number_within, with_row_key
from citestat.session import save_and_reload

#: Weights of the sources in the order of their names, repeating; a null source is the last.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Words that the knapsack spans at least; it spans twice the longest text where that is more.
SPAN = 100_000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The targets add up to all sizes. A source reaches its limit, ``most`` times its size, when the
    level per unit of weight reaches limit / weight; sources are passed in that order, and the
    level is found where what is left suffices for the others.
    """
    # one row per source goes through these windows, not the texts
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ring = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("w", F.element_at(ring, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    limit = F.lit(float(most)) * F.col("source_size")
    ordered = W.orderBy(limit / F.col("w"), F.col("source").isNull(), "source")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    passed = named.withColumn("level", level).withColumn("limit", limit)
    full = F.col("limit") <= F.col("level") * F.col("w")
    # the first source that isn't full sets the level of all later ones
    first = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    return passed.withColumn("at", first).select(
        "source", "source_size", F.when(F.col("at").isNull(), F.col("limit")).otherwise(F.col("at") * F.col("w")).alias("target")
    )


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many texts of each length to take, at most ``counts``, so that the lengths add up to ``budget``.

    Where no choice meets the budget, the sum is the nearest one, above or below, that the program at the end
    can reach.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int(lengths @ counts)
    share = min(1.0, budget / total) if total else 0.0
    # leave some of every length to the program below
    taken = np.minimum(np.floor(share * counts).astype(np.int64), counts)
    left = budget - int(lengths @ taken)
    span = max(2 * int(lengths.max(initial=0)), SPAN)
    for i, n in enumerate(lengths):
        if left <= span:
            break
        # one more of each length, longest first, until the rest is short
        more = int(min(counts[i] - taken[i], 1 if share < 1 else 0, (left - span) // n + 1)) if n else 0
        taken[i] += max(more, 0)
        left -= max(more, 0) * int(n)
    if left > 0:
        taken += _knapsack(lengths, counts - taken, left)
    out = np.zeros_like(taken)
    out[order] = taken
    return out


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the sum nearest to ``budget``, the lower one of two, over at most ``free`` of each length."""
    # nothing beyond the budget and one more text can be nearer than what lies below it
    top = budget + int(lengths[free > 0].max(initial=0))
    via = np.full(top + 1, -1, dtype=np.int32)
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        n, c = int(lengths[i]), int(free[i])
        if not n or reached[budget]:
            continue
        c, times = min(c, top // n), 1
        while c > 0 and not reached[budget]:
            # 1, 2, 4, ... copies as one item reach every number of copies
            m = min(times, c)
            c, times, w = c - m, times * 2, n * m
            new = np.flatnonzero(reached[: top + 1 - w] & ~reached[w:]) + w
            via[new] = len(items)
            reached[new] = True
            items.append((i, m))
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    taken = np.zeros(len(lengths), dtype=np.int64)
    while at:
        i, m = items[via[at]]
        taken[i] += m
        at -= m * int(lengths[i])
    return taken


def mix_plan(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = 0, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, the columns ``keep``, size, source_size, target and copies (0 to ``most``).

    Texts without words, null ones included, have size 0 and are never taken. A null source is a
    source, the last one. Repeated rows are texts of their own. Reruns over the same rows
    agree, up to which of several rows with one id and size is meant.
    """
    rows = save_and_reload(
        docs.select(
            col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"),
            *[col(c).alias(f"keep{i}") for i, c in enumerate(keep)],
        ),
        "mix-rows",
    )
    lengths = save_and_reload(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    sources = save_and_reload(
        targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "mix-targets"
    )

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        target, whole = float(group["target"].iat[0]), int(group["source_size"].iat[0])
        rounds = min(most, int(target // whole)) if whole else 0
        budget = int(round(target)) - rounds * whole
        lengths, counts = group["size"].to_numpy(), group["n"].to_numpy()
        extra = np.zeros(len(group), dtype=np.int64)
        if whole and rounds < most and budget > 0:
            extra = fit_budget(lengths, counts, min(budget, whole))
        return group[["source", "size"]].assign(rounds=rounds, extra=extra)

    kind = dict(rows.dtypes)["source"]
    joined = lengths.join(sources, lengths["source"].eqNullSafe(sources["source"])).select(
        lengths["source"], "size", "n", "source_size", "target"
    )
    # a source is one group of its distinct lengths, which are at most the longest text's words
    chosen = joined.groupBy("source").applyInPandas(choose, f"source {kind}, size bigint, rounds bigint, extra bigint")
    chosen = save_and_reload(chosen.select(F.col("source").alias("s"), F.col("size").alias("l"), "rounds", "extra"), "mix-chosen")
    numbered = number_within(rows, ["source", "size"], [F.xxhash64(F.lit(seed), "id"), F.col("id")], "place")
    plan = numbered.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")))
    sources = sources.select(F.col("source").alias("t"), "source_size", "target")
    plan = plan.join(sources, F.col("source").eqNullSafe(F.col("t")))
    copies = F.when(F.col("size") > 0, F.col("rounds") + (F.col("place") < F.col("extra")).cast("bigint")).otherwise(F.lit(0))
    return plan.select(
        F.col("id").alias(id_col), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target",
        copies.cast("int").alias("copies"),
    )


def mix(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = 0,
) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as it is taken; same columns.

    The plan is made on row keys and sizes; texts are joined once, to the rows that are taken.
    """
    keyed, key = with_row_key(docs)
    plan = mix_plan(keyed, text_col, source_col, id_col, weights, most, seed, keep=tuple(key))
    times = free_name(keyed, "times")
    taken = plan.filter("copies > 0").select(*[col(k).alias(f"key{i}") for i, k in enumerate(key)], F.col("copies").alias(times))
    same = [col(k) == F.col(f"key{i}") for i, k in enumerate(key)]
    rows = keyed.join(taken, same).withColumn(times, F.explode(F.sequence(F.lit(1), col(times))))
    return rows.select(*[col(c) for c in docs.columns])
