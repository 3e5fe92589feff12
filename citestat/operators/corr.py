"""Pearson, Spearman and Kendall correlations per group, from contingency cells.

A cell is (group, x, y, c). For citation counts the cells are far fewer than the articles,
and no step pairs cells with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from citestat.session import save_and_reload


def contingency(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Cells of the rows in which both values exist."""
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _with_totals(cells: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every cell with the one row of its group in ``totals``; missing keys meet. No window gathers the cells."""
    if not keys:
        return cells.join(F.broadcast(totals))
    values = [c for c in totals.columns if c not in keys]
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *values)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cells.join(totals, same).drop(*[f"_{k}" for k in keys])


def _weighted_pearson(cells: DataFrame, keys: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """NULL for fewer than two rows or a constant side. Two passes: means, then moments about them."""
    keys, n = list(keys), F.sum("c")
    means = cells.groupBy(*keys).agg(
        (F.sum(F.col("c") * F.col(x)) / n).alias("_mean_x"), (F.sum(F.col("c") * F.col(y)) / n).alias("_mean_y")
    )
    centred = _with_totals(cells, means, keys).select(
        *keys, "c", (F.col(x) - F.col("_mean_x")).alias("dx"), (F.col(y) - F.col("_mean_y")).alias("dy")
    )
    c, dx, dy = F.col("c"), F.col("dx"), F.col("dy")
    r = F.try_divide(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx)) * F.sqrt(F.sum(c * dy * dy)))
    return centred.groupBy(*keys).agg(F.when(F.sum("c") >= 2, r).alias(name))


def _marginal(cells: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Average rank and dense position (from 0) of every value of one side."""
    totals = cells.groupBy(*keys, side).agg(F.sum("c").alias("t"))
    w = W.partitionBy(*keys).orderBy(side)
    below = F.coalesce(F.sum("t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return totals.select(
        *keys, side, "t",
        (below + (F.col("t") + 1) / 2).alias(f"rank_{side}"),
        (F.row_number().over(w) - 1).alias(f"pos_{side}"),
    )


def _ranked(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = cells
    for side in ("x", "y"):
        m = _marginal(cells, keys, side).drop("t")
        m = m.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(side).alias("_v"), f"rank_{side}", f"pos_{side}")
        cond = F.col(side) == F.col("_v")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(m, cond).drop("_v", *[f"_{k}" for k in keys])
    return out


def pearson(cells: DataFrame, keys: Sequence[str], name: str = "pearson_r") -> DataFrame:
    return _weighted_pearson(cells, keys, "x", "y", name)


def spearman(cells: DataFrame, keys: Sequence[str], name: str = "spearman_rho",
             ranked: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of average ranks."""
    ranked = _ranked(cells, keys) if ranked is None else ranked
    return _weighted_pearson(ranked, keys, "rank_x", "rank_y", name)


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def kendall(cells: DataFrame, keys: Sequence[str], name: str = "kendall_tau",
            ranked: DataFrame | None = None) -> DataFrame:
    """Tau-b with tie correction, without pairing cells.

    Two different y positions differ first at exactly one binary digit. For every digit,
    positions with the same higher digits form a bucket, and a running sum over x counts
    how often a 1 stands before a 0: the discordant pairs. A bucket has at most one row
    per distinct x.
    """
    keys = list(keys)
    ranked = _ranked(cells, keys) if ranked is None else ranked
    digits = F.length(F.conv(F.max("pos_y").cast("string"), 10, 2))
    spread = (
        _with_totals(ranked, ranked.groupBy(*keys).agg(digits.alias("_digits")), keys)
        .withColumn("bit", F.explode(F.sequence(F.lit(0), F.col("_digits") - 1)))
        .withColumn("bucket", F.call_function("shiftright", F.col("pos_y"), F.col("bit") + 1))
        .withColumn("is_one", F.call_function("shiftright", F.col("pos_y"), F.col("bit")) % 2 == 1)
        .groupBy(*keys, "bit", "bucket", "x")
        .agg(
            F.sum(F.when(F.col("is_one"), F.col("c")).otherwise(0)).alias("ones"),
            F.sum(F.when(~F.col("is_one"), F.col("c")).otherwise(0)).alias("zeros"),
        )
    )
    before = W.partitionBy(*keys, "bit", "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    discordant = (
        spread.withColumn("_d", F.col("zeros") * F.coalesce(F.sum("ones").over(before), F.lit(0)))
        .groupBy(*keys).agg(F.sum("_d").cast("double").alias("discordant"))
    )

    def ties(by: str) -> DataFrame:
        totals = cells.groupBy(*keys, by).agg(F.sum("c").alias("t"))
        return totals.groupBy(*keys).agg(F.sum(_pairs(F.col("t"))).alias(f"ties_{by}"))

    base = cells.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(_pairs(F.col("c"))).alias("ties_xy")
    )
    out = base
    for part in (ties("x"), ties("y"), discordant):
        new = [c for c in part.columns if c not in keys][0]
        renamed = part.select(*[F.col(k).alias(f"_{k}") for k in keys], new)
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(renamed, cond, "left").drop(*[f"_{k}" for k in keys])
    total = _pairs(F.col("n"))
    concordant = total - F.col("ties_x") - F.col("ties_y") + F.col("ties_xy") - F.col("discordant")
    tau = F.try_divide(
        concordant - F.col("discordant"),
        F.sqrt(total - F.col("ties_x")) * F.sqrt(total - F.col("ties_y")),
    )
    return out.select(*keys, F.when(F.col("n") >= 2, tau).alias(name))


def correlations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """All three coefficients per group (keys may be empty: one row)."""
    if not keys:
        df = df.withColumn("_all", F.lit(1))
    return correlations_of_cells(contingency(df, list(keys) or ["_all"], x, y), keys)


def correlations_of_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from contingency cells (with a column ``_all`` when there are no keys).

    The ranked cells are saved: they are few next to the articles and all three
    coefficients read them several times.
    """
    group = list(keys) or ["_all"]
    ranked = save_and_reload(_ranked(cells, group), "cells")
    cells = ranked.select(*group, "x", "y", "c")
    out = pearson(cells, group)
    others = ((spearman(cells, group, ranked=ranked), "spearman_rho"), (kendall(cells, group, ranked=ranked), "kendall_tau"))
    for part, name in others:
        renamed = part.select(*[F.col(k).alias(f"_{k}") for k in group], name)
        cond = F.lit(True)
        for k in group:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(renamed, cond, "left").drop(*[f"_{k}" for k in group])
    return out.select(*keys, "pearson_r", "spearman_rho", "kendall_tau")


def correlation_matrix(df: DataFrame, variables: Sequence[str], method: str) -> DataFrame:
    """(row_var, col_var, value) for all ordered pairs of variables, pairwise deletion.

    Ranks are taken anew inside every pair, as rows missing one value drop out of that pair.
    """
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("i"), F.lit(b).alias("j"),
                F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"),
            )
            for a, b in pairs
        ]
    )
    long = df.select(F.inline(entries))
    cells = contingency(long, ["i", "j"], "x", "y")
    coefficient = {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method]
    found = coefficient(cells, ["i", "j"], "value")
    frame = df.sparkSession.createDataFrame(pairs, "i string, j string")
    full = frame.join(found, ["i", "j"], "left")
    mirrored = F.when(
        F.col("i") != F.col("j"),
        F.array(F.struct(F.col("i").alias("row_var"), F.col("j").alias("col_var")),
                F.struct(F.col("j").alias("row_var"), F.col("i").alias("col_var"))),
    ).otherwise(F.array(F.struct(F.col("i").alias("row_var"), F.col("j").alias("col_var"))))
    return full.select(F.inline(mirrored), "value")
