"""Benchmark passages in training texts, with DataFrame functions only.

The n-word windows of the benchmark are a hash set that travels with the plan to every
executor, and each text is scanned in its own row: a window start must have a known first
word, then a known word pair, and then be a known window as a whole. The window itself is
compared, not a hash, so every hit is verified. Nothing is shuffled for the scan. Only the
windows found go on, to be joined with the ids of their items.

The set is shipped only while the benchmark has at most `MAX_WINDOWS` distinct windows. A
larger benchmark takes `_scan_joined`: a broadcast bitmap of window hashes, sized from their
number, passes the windows of the texts that may be known, and only these are shuffled, to be
joined with those of the benchmark as words. It gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citestat.llm.common import bits_for, col, free_name, likely_in, worked_out
from citestat.session import save_and_reload

#: Digits, letters and everything outside ASCII; A to Z are lowered afterwards.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_WINDOWS = 50_000


def leak_words(text: Column) -> Column:
    """Words of a text, A to Z lowered; a null text has none."""
    found = F.coalesce(F.regexp_extract_all(text, F.lit(ANY_CASE), F.lit(0)), F.array().cast("array<string>"))
    # translate() is slow, and most words have no capital at all
    return F.transform(found, lambda w: F.when(F.lower(w) == w, w).otherwise(
        F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ))


def _gram(words: Column, start: Column, k: int) -> Column:
    return F.array_join(F.slice(words, start, k), " ")


def _all_grams(words: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: _gram(F.col(words), i, n))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(gram, n, items): distinct windows with their word count and the sorted ids having them.

    An item of fewer than ``k`` words, but not none, is one window. Items with a null id are
    used as well; their id is the string "null".
    """
    words = benchmark.select(F.coalesce(col(id_col).cast("string"), F.lit("null")).alias("item"), leak_words(col(text_col)).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    grams = words.filter(n > 0).select(
        "item", F.least(n, F.lit(k)).alias("n"),
        F.explode(F.array_distinct(F.transform(starts, lambda i: _gram(F.col("w"), i, k)))).alias("gram"),
    )
    return grams.groupBy("gram", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _quoted(values: list[str]) -> str:
    # words hold no ASCII quote or backslash
    return ", ".join(f"'{v}'" for v in values)


def _hits(words: str, windows: list[tuple[str, int]]) -> Column:
    """array<struct<start, n, gram>> of the windows that start in ``words``, as one expression."""
    parts = []
    for n in sorted({n for _, n in windows}):
        grams = sorted(g for g, m in windows if m == n)
        first = sorted({g.split(" ", 1)[0] for g in grams})
        tests = [f"element_at({words}, i) IN ({_quoted(first)})"]
        if n > 2:
            pairs = sorted({" ".join(g.split(" ", 2)[:2]) for g in grams})
            tests.append(f"concat_ws(' ', element_at({words}, i), element_at({words}, i + 1)) IN ({_quoted(pairs)})")
        if n > 1:
            tests.append(f"array_join(slice({words}, i, {n}), ' ') IN ({_quoted(grams)})")
        starts = f"if(size({words}) >= {n}, sequence(1, size({words}) - {n - 1}), array())"
        found = f"filter({starts}, i -> {' AND '.join(tests)})"
        parts.append(f"transform({found}, i -> struct(i AS start, {n} AS n, array_join(slice({words}, i, {n}), ' ') AS gram))")
    kind = "array<struct<start:int,n:int,gram:string>>"
    if not parts:
        return F.expr(f"CAST(array() AS {kind})")
    return F.expr(f"CAST(concat({', '.join(parts)}) AS {kind})")


def _scan_inline(docs: DataFrame, text_col: str, windows: list[tuple[str, int]], words: str, hits: str) -> DataFrame:
    return worked_out(worked_out(docs, words, leak_words(col(text_col))), hits, _hits(f"`{words}`", windows))


def _scan_joined(docs: DataFrame, text_col: str, windows: DataFrame, words: str, hits: str, k: int) -> DataFrame:
    """The same columns by a join on windows, for a benchmark of any size; unlikely windows are not shuffled."""
    row = free_name(docs, "row")
    saved = save_and_reload(
        docs.withColumn(words, leak_words(col(text_col))).withColumn(row, F.monotonically_increasing_id()), "leak-words"
    )
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # 1 to k
    grams = None
    for n in lengths:
        part = saved.filter(F.size(words) >= n).select(
            row, F.lit(n).alias("n"),
            F.posexplode(_all_grams(words, n)).alias("pos", "gram"),
        )
        grams = part if grams is None else grams.unionByName(part)
    empty = F.expr("CAST(array() AS array<struct<start:int,n:int,gram:string>>)")
    if grams is None:
        return saved.withColumn(hits, empty).drop(row)
    likely = likely_in(grams, F.col("gram"), windows.select("gram"), bits_for(windows.count()))
    found = likely.join(windows.select("gram", "n"), ["gram", "n"], "left_semi").groupBy(F.col(row).alias("row0")).agg(
        F.collect_list(F.struct((F.col("pos") + 1).alias("start"), "n", "gram")).alias(hits)
    )
    return saved.join(found, F.col(row) == F.col("row0"), "left").withColumn(hits, F.coalesce(hits, empty)).drop(row, "row0")


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = 10, words: str = "words", hits: str = "hits", max_windows: int = MAX_WINDOWS,
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with its words and hits, and the saved windows of the benchmark."""
    windows = save_and_reload(item_windows(benchmark, item_id, item_text, k), "leak-windows")
    if windows.limit(max_windows + 1).count() <= max_windows:
        known = [(r["gram"], r["n"]) for r in windows.select("gram", "n").collect()]
        return _scan_inline(docs, text_col, known, words, hits), windows
    return _scan_joined(docs, text_col, windows, words, hits, k), windows


def covered_spans(hits: str) -> str:
    """SQL for the disjoint word spans (start, stop) that hits cover, sorted; stop is exclusive."""
    spans = f"array_sort(array_distinct(transform({hits}, h -> struct(h.start AS start, h.start + h.n AS stop))))"
    kind = "array<struct<start:int,stop:int>>"
    return (
        f"aggregate({spans}, CAST(array() AS {kind}), (acc, s) -> "
        f"if(size(acc) > 0 AND element_at(acc, -1).stop >= s.start, "
        f"concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).start AS start, "
        f"greatest(element_at(acc, -1).stop, s.stop) AS stop))), concat(acc, array(s))))"
    )


def leak_report(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, n_words, n_hit, items (sorted ids as strings).

    A word inside any occurrence of a benchmark window is hit. Null and empty texts have no
    words; repeated rows are reported one by one; an empty benchmark hits nothing.
    """
    from_docs = docs.select(*[col(c).alias(f"keep{i}") for i, c in enumerate(keep)], col(text_col).alias("text"))
    found, windows = scan(from_docs, benchmark, "text", item_id, item_text, k)
    kept = [f"keep{i}" for i in range(len(keep))]
    counted = found.select(
        *kept, F.size("words").cast("bigint").alias("n_words"), "hits"
    ).select(
        *kept, "n_words",
        F.expr(f"CAST(aggregate({covered_spans('hits')}, 0, (n, s) -> n + s.stop - s.start) AS bigint)").alias("n_hit"),
        F.expr("array_distinct(transform(hits, h -> h.gram))").alias("grams"),
        F.monotonically_increasing_id().alias("row"),
    )
    named = counted.select("row", *kept, "n_words", "n_hit", F.explode_outer("grams").alias("gram")).join(
        windows.select("gram", "items"), "gram", "left"
    )
    # one row per text and item set; the items of a text are few whatever the table's size
    return named.groupBy("row").agg(
        *[F.first(c).alias(c) for c in (*kept, "n_words", "n_hit")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = 10, mode: str = "documents",
) -> DataFrame:
    """``docs`` without benchmark passages; same columns.

    ``mode="documents"`` removes rows with a hit, ``mode="spans"`` cuts the hit words, from the
    first letter of a span to the last, and keeps the rest of the text as it is.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    words, hits = free_name(docs, "words"), free_name(docs, "hits")
    found, _ = scan(docs, benchmark, text_col, item_id, item_text, k, words, hits)
    if mode == "documents":
        return found.filter(F.size(hits) == 0).drop(words, hits)
    # words and the gaps around them alternate: gap 0, word 1, gap 1, word 2, ...
    spans, gaps = free_name(found, "spans"), free_name(found, "gaps")
    raw = F.regexp_extract_all(col(text_col), F.lit(ANY_CASE), F.lit(0))
    cut = found.withColumn(spans, F.expr(covered_spans(f"`{hits}`"))).withColumn(
        gaps, F.when(F.size(hits) > 0, F.struct(F.split(col(text_col), ANY_CASE, -1).alias("gap"), raw.alias("word")))
    )
    kept = F.expr(
        f"concat(element_at(`{gaps}`.gap, 1), array_join(transform(sequence(1, size(`{gaps}`.word)), i -> "
        f"concat(if(exists(`{spans}`, s -> s.start <= i AND i < s.stop), '', element_at(`{gaps}`.word, i)), "
        f"if(exists(`{spans}`, s -> s.start <= i AND i + 1 < s.stop), '', element_at(`{gaps}`.gap, i + 1)))), ''))"
    )
    return cut.withColumn(text_col, F.when(F.size(hits) > 0, kept).otherwise(col(text_col))).drop(words, hits, spans, gaps)
