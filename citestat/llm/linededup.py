"""Removal of repeated passages by overlapping three-line windows.

Lines are trimmed and blank ones skipped; three consecutive lines are a window, named by two
64-bit hashes. Windows that occur more than once are found by one aggregation over all texts;
of each, the first occurrence (by id, then text, then place) stays. Every other occurrence
covers its three lines, and the lines that windows of a text cover together are removed. Where a
window repeats so closely that it overlaps its own first occurrence, the lines of the first
occurrence stay.

Windows leave the scan as hashes and places; texts are shuffled once, to be put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citestat.llm.common import col, free_name, worked_out
from citestat.session import save_and_reload

WINDOW = 3


def _filled(lines: Column) -> Column:
    """array<struct<at, line>> of the lines that are not blank, trimmed."""
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\x0b\x0c\r")).alias("line")))
    return F.filter(placed, lambda v: v["line"] != "")


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, j, h1, h2): one row per window; j is the place of its first line among the filled ones."""
    named = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("text"))
    filled = worked_out(named, "lines", _filled(F.split("text", "\n", -1))).drop("text")
    line = lambda j, k: F.try_element_at("lines", j + (k + 1))["line"]
    starts = F.when(F.size("lines") >= WINDOW, F.sequence(F.lit(0), F.size("lines") - WINDOW)).otherwise(F.array())
    named = filled.select(
        "id", "h",
        F.transform(
            starts.cast("array<int>"),
            lambda j: F.struct(
                j.alias("j"), F.xxhash64(*[line(j, k) for k in range(WINDOW)]).alias("h1"),
                F.xxhash64(F.lit(1), *[line(j, k) for k in range(WINDOW)]).alias("h2"),
            ),
        ).alias("w"),
    )
    return named.select("id", "h", F.inline("w"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, gone): places, among the filled lines, of the lines that go, for texts that lose any."""
    windows = _windows(docs, id_col, text_col)
    repeated = save_and_reload(
        windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "j")).alias("first"))
        .filter("n > 1").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first"),
        "line-windows",
    )
    met = windows.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    later = met.filter(~(own & (F.col("j") == F.col("first.j"))))
    start = F.when(own, F.greatest("j", F.col("first.j") + WINDOW)).otherwise(F.col("j"))
    return (
        later.select("id", "h", F.explode(F.sequence(start, F.col("j") + (WINDOW - 1))).alias("p"))
        .groupBy("id", "h").agg(F.sort_array(F.collect_set("p")).alias("gone"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with repeated passages removed from the text; with ``report`` also n_lines, n_removed.

    Texts of fewer than three filled lines, null and empty ones included, stay as they are. Blank
    lines stay where they are. Rows with the same id and text are one text: they get the same
    result. Ids may be null.
    """
    gone = repeated_lines(docs, id_col, text_col).select(F.col("id").alias("id0"), F.col("h").alias("h0"), "gone")
    names = {n: free_name(docs, n) for n in ("lines", "filled", "places")}
    lines, filled, places = names["lines"], names["filled"], names["places"]
    joined = docs.join(gone, docs[f"`{id_col}`"].eqNullSafe(gone["id0"]) & (F.xxhash64(docs[f"`{text_col}`"]) == gone["h0"]), "left")
    split = worked_out(joined, lines, F.split(col(text_col), "\n", -1))
    split = worked_out(split, filled, _filled(F.col(lines)))
    split = worked_out(split, places, F.transform("gone", lambda p: F.element_at(filled, p + 1)["at"]))
    left = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places)), lambda i: F.element_at(lines, i + 1)
    )
    out = split.withColumn(text_col, F.when(F.col("gone").isNull(), col(text_col)).otherwise(F.array_join(left, "\n")))
    columns = [col(c) for c in docs.columns]
    if report:
        n_lines = F.coalesce(F.size(filled), F.lit(0))
        columns += [
            F.greatest(n_lines, F.lit(0)).cast("bigint").alias("n_lines"),
            F.greatest(F.size(F.coalesce("gone", F.array().cast("array<int>"))), F.lit(0)).cast("bigint").alias("n_removed"),
        ]
    return out.select(*columns)
