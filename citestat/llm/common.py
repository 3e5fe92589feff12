"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from citestat.session import save_and_reload

#: Every character but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, cells: int = 64) -> DataFrame:
    """Number the rows of each key group from 0 as ``name``, in an order set by ``order``.

    A group is dealt out over ``cells`` cells by a hash of ``order``; each cell is numbered by
    itself and the counts of the cells before it are added, so a group of any size is never in
    one task. Rows that agree in ``order`` lie in one cell and are numbered in any order.
    ``df`` is read twice and should be a saved table. Null keys are a group like any other.
    """
    cell, before = free_name(df, "cell"), free_name(df, "before")
    placed = df.withColumn(cell, F.pmod(F.xxhash64(F.lit(cells), *order), F.lit(cells)).cast("int"))
    sizes = placed.groupBy(*[col(k) for k in keys], cell).agg(F.count(F.lit(1)).alias("n"))
    running = W.partitionBy(*[col(k) for k in keys]).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *[col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(cell).alias("cell0"),
        F.coalesce(F.sum("n").over(running), F.lit(0)).alias(before),
    )
    within = F.row_number().over(W.partitionBy(*[col(k) for k in keys], cell).orderBy(*order))
    numbered = placed.withColumn(name, within)
    condition = F.col(cell) == F.col("cell0")
    for i, k in enumerate(keys):
        condition = condition & col(k).eqNullSafe(F.col(f"key{i}"))
    return (
        numbered.join(offsets, condition)
        .withColumn(name, (F.col(before) + F.col(name) - 1).cast("bigint"))
        .drop(cell, before, "cell0", *[f"key{i}" for i in range(len(keys))])
    )


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` and the names of added columns that name each row, the same every time it is read.

    Rows of Parquet files are named by file and place in the file. Any other table is saved
    once with a number per row.
    """
    file, at = free_name(df, "row_file"), free_name(df, "row_at")
    columns = [col(c) for c in df.columns]
    try:
        return df.select(*columns, F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)), [file, at]
    except AnalysisException:
        return save_and_reload(df.select(*columns, F.monotonically_increasing_id().alias(at)), "row-keys"), [at]


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once per row.

    The optimizer puts the expression of a column in its place wherever a filter above asks for
    it, also inside the lambda of an array function, where it would run once per element. A
    generated column stays as it is.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def bits_for(keys: int) -> int:
    """Size of a bitmap for `likely_in`: 16 to 32 bits a key, a power of two from 2**20 to 2**27.

    The largest is some 2 million rows to broadcast. From some 8 million keys on more rows pass in vain.
    """
    return 1 << min(max((16 * keys).bit_length(), 20), 27)


def likely_in(df: DataFrame, key: Column, keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``keys``, and a few others.

    A bitmap of the keys' hashes is broadcast as at most bits / 64 rows, whatever the number of
    keys, so what is shuffled for the exact join afterwards is little more than what it keeps. With
    far more keys than bits the map fills up and lets everything pass.
    """
    h = lambda c: F.pmod(F.xxhash64(c, F.lit(17)), F.lit(bits))
    words = keys.select(h(col(keys.columns[0])).alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("b")
    )
    spot, w, b = free_name(df, "spot"), free_name(df, "w"), free_name(df, "b")
    words = F.broadcast(words.select(F.col("w").alias(w), F.col("b").alias(b)))
    marked = df.withColumn(spot, h(key)).join(words, F.shiftright(spot, 6) == F.col(w))
    return marked.filter(F.getbit(b, F.pmod(F.col(spot), F.lit(64)).cast("int")) == 1).drop(spot, w, b)
