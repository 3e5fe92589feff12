"""Generic table operators: keep-first, duplicates, lookups, top-n, numbering.

Broadcasts are left to Spark's own size checks (the static threshold and AQE's measured
sizes); hot keys are reduced by map-side aggregation before anything is shuffled by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from citestat.session import save_and_reload, shuffle_width


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order`` (NULL order values last).

    An aggregation rather than a window, so a key holding a large share of the rows is
    reduced inside every map task. NULL is a key value of its own.
    """
    ranks = []
    for o in order:
        c = F.col(o) if isinstance(o, str) else o
        ranks += [c.isNull(), c]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ranks)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def last_value_map(df: DataFrame, key: str, value: str, position: Column | str) -> DataFrame:
    """Lookup table of a key-value list in which the last entry of a key wins."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(value, position).alias(value))
    )


def one_to_one(df_a: DataFrame, id_a: str, id_b: str, order: Sequence[Column | str]) -> DataFrame:
    """One row per ``id_a``, then one row per ``id_b``, each time the first in ``order``."""
    return keep_first(keep_first(df_a, [id_a], order), [id_b], order).select(df_a.columns)


def duplicate_report(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Every row that occurs more than once, as often as it occurs.

    Copies are counted with map-side aggregation and spread again in chunks, so no task
    writes out one group of copies alone.
    """
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    chunks = counted.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / chunk).cast("long")))
    ).repartition(F.xxhash64(*cols), F.col("_chunk"))
    size = F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_chunk") * chunk)
    return chunks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*cols)


def non_unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def validated_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on trimmed text keys, refused unless the keys are unique on both sides."""
    def prepared(df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) for k in keys})

    left, right = prepared(left), prepared(right)
    for name, side in (("left", left), ("right", right)):
        if non_unique_keys(side, keys).limit(1).count():
            raise ValueError(f"the {name} side has repeated keys {list(keys)}; expected one to one")
    joined = left.join(right, list(keys), "left")
    return joined.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in keys})


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str,
           name: str, default: Column | None = None) -> DataFrame:
    """Attach ``table.value`` for ``df.key``; an absent key gives NULL or ``default``."""
    side = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    out = df.join(side, df[key] == F.col("_k"), "left")
    found = F.col("_v") if default is None else F.when(F.col("_hit"), F.col("_v")).otherwise(default)
    return out.withColumn(name, found).drop("_k", "_v", "_hit")


def lookup_with_fallback(df: DataFrame, first: str, second: str, table: DataFrame, table_key: str,
                         value: str, name: str, default: Column) -> DataFrame:
    """Value of the first key; where that key is absent from the table, of the second; else default."""
    def side(tag: str) -> DataFrame:
        return table.select(
            F.col(table_key).alias(f"_k{tag}"), F.col(value).alias(f"_v{tag}"), F.lit(True).alias(f"_h{tag}")
        )

    out = df.join(side("1"), F.col(first) == F.col("_k1"), "left")
    out = out.join(side("2"), F.col(second) == F.col("_k2"), "left")
    found = F.when(F.col("_h1"), F.col("_v1")).when(F.col("_h2"), F.col("_v2")).otherwise(default)
    return out.withColumn(name, found).drop("_k1", "_v1", "_h1", "_k2", "_v2", "_h2")


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, original: str, canonical: str) -> DataFrame:
    """Replace an id by its canonical id; ids outside the mapping stay."""
    side = mapping.select(F.col(original).alias("_o"), F.col(canonical).alias("_c"))
    return (
        df.join(side, F.col(column) == F.col("_o"), "left")
        .withColumn(column, F.coalesce("_c", column))
        .drop("_o", "_c")
    )


def top_n(df: DataFrame, column: str, n: int, tie_break: Sequence[str], ascending: bool = False) -> DataFrame:
    """First ``n`` rows by a column, NULL last, ties by id."""
    c = F.col(column)
    first = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_last() for t in tie_break]).limit(n)


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(o).asc_nulls_last() for o in order]).limit(n)


def ordered(df: DataFrame, descending: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    return df.orderBy(
        *[F.col(c).desc_nulls_last() for c in descending],
        *[F.col(c).asc_nulls_last() for c in tie_break],
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str = "internal_id") -> DataFrame:
    """Ids 1..n in the given order (which must be unique).

    Rows are range partitioned and saved once, every partition is numbered by itself, and
    the partition offsets (one row per partition) are added; no task sees the whole table.
    """
    parts = shuffle_width(df.sparkSession)
    cols = [F.col(o).asc_nulls_last() for o in order]
    placed = save_and_reload(
        df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()), "numbering"
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*cols))
    return (
        placed.withColumn("_i", within)
        .join(offsets, "_part")
        .withColumn(name, (F.col("_before") + F.col("_i")).cast("bigint"))
        .drop("_part", "_i", "_before")
    )


def distinct_values(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Distinct non-null values of several columns as one column."""
    return (
        df.select(F.explode(F.array(*columns)).alias(name)).filter(F.col(name).isNotNull()).distinct()
    )


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).distinct()


def first_non_null(df: DataFrame, keys: Sequence[str], position: Column | str,
                   columns: Sequence[str]) -> DataFrame:
    """Per group, the first non-null value of every column in the order of ``position``."""
    p = F.col(position) if isinstance(position, str) else position
    # a NULL value must lose to any other row, so its position is taken out of the race
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), p)).alias(c) for c in columns]
    )


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value with NULL as a value, and their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    # the total is one row
    return counts.join(F.broadcast(total)).select(
        column, "n", F.try_divide("n", "_total").alias("share")
    )
