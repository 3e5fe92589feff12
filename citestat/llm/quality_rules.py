"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a condition under which a text goes. Rules are measured on a bounded sample:
their cost (time over the sample) and how many texts they reject. They are then tried in the
order of rejections per cost inside one CASE expression, so a text that a cheap rule rejects
is never looked at by the dear ones. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from citestat.llm.common import SPACE, col, worked_out
from citestat.session import save_and_reload

#: Rows of the sample on which rules are measured.
SAMPLE_ROWS = 1000


class Rule(NamedTuple):
    """``rejects`` is SQL over the text column and the statistics columns in ``uses``."""

    name: str
    rejects: str
    uses: tuple[str, ...] = ()


#: Statistic -> SQL over ``text`` and earlier statistics.
STATISTICS = {
    "pieces": f"split(text, '{SPACE.replace(chr(92), chr(92) * 2)}', -1)",
    "words": "array_remove(pieces, '')",
    "lines": r"filter(split(text, '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')",
    "n_words": "CAST(size(words) AS BIGINT)",
    "word_chars": "CAST(char_length(text) - size(pieces) + 1 AS BIGINT)",
    "n_symbols": "CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT)",
    "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT)",
    "n_lines": "CAST(size(lines) AS BIGINT)",
    "n_repeat_words": None,  # several steps: see _with_repeats
    "n_upper": "CAST(regexp_count(text, '[A-Z]') AS BIGINT)",
    "n_marks": "CAST(regexp_count(text, '[!?]') AS BIGINT)",
}
_NEEDS = {
    "words": ("pieces",), "n_words": ("words",), "word_chars": ("pieces",), "n_dup_lines": ("lines",),
    "n_lines": ("lines",), "n_repeat_words": ("words",),
}

BASE_RULES = (
    Rule("few_words", "n_words < 50", ("n_words",)),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("n_repeat_words", "n_words")),
)
RULES = (
    Rule("symbols", "10 * n_symbols > n_words", ("n_symbols", "n_words")),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines", ("n_dup_lines", "n_lines")),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", ("word_chars", "n_words")),
    Rule("capitals", "100 * n_upper > 30 * word_chars", ("n_upper", "word_chars")),
    Rule("exclamations", "10 * n_marks > n_words", ("n_marks", "n_words")),
)


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside a three-word window that the text has twice or more.

    Windows are sorted as one long each, the high bits of a hash above the window's place, so a
    repeat is a neighbour. Neighbours are compared as words; where two different windows share
    the high bits, the windows themselves are sorted instead, so the count is exact.
    """
    starts = (
        df.withColumn("n_windows", F.expr("greatest(size(words) - 2, 0)"))
        .withColumn("bits", F.expr("CAST(ceil(log2(n_windows + 2)) AS INT)"))
        .withColumn("hashed", F.expr("transform(words, w -> xxhash64(w))"))
        .withColumn(
            "sorted_windows",
            F.expr(
                "if(n_windows < 1, CAST(array() AS array<bigint>), sort_array(transform(sequence(1, n_windows), i -> "
                "shiftleft(xxhash64(hashed[i - 1], hashed[i], hashed[i + 1]), bits) + i)))"
            ),
        )
        .withColumn("mask", F.expr("shiftleft(1L, bits) - 1"))
    )
    same = (
        "words[i0 - 1] = words[i1 - 1] AND words[i0] = words[i1] AND words[i0 + 1] = words[i1 + 1]"
    )
    # neighbours with equal high bits: the places of both, and whether the words agree
    place = "CAST(sorted_windows[{0}] & mask AS INT)"
    pairs = starts.withColumn(
        "met",
        F.expr(
            "if(n_windows < 2, array(), filter(sequence(1, n_windows - 1), j -> "
            "shiftright(sorted_windows[j - 1], bits) = shiftright(sorted_windows[j], bits)))"
        ),
    ).withColumn(
        "met", F.expr(f"transform(met, j -> struct({place.format('j - 1')} AS i0, {place.format('j')} AS i1))")
    )
    agree = same.replace("i0", "p.i0").replace("i1", "p.i1")
    exact = (
        "array_sort(transform(sequence(1, n_windows), i -> struct(words[i - 1] AS a, words[i] AS b, words[i + 1] AS c, i AS i)))"
    )
    repeated = pairs.withColumn("clash", F.expr(f"exists(met, p -> NOT ({agree}))")).withColumn(
        "exact", F.expr(f"if(clash, {exact}, NULL)")
    ).withColumn(
        "places",
        F.expr(
            "if(clash, flatten(transform(filter(sequence(1, n_windows - 1), j -> exact[j - 1].a = exact[j].a AND "
            "exact[j - 1].b = exact[j].b AND exact[j - 1].c = exact[j].c), j -> array(exact[j - 1].i, exact[j].i))), "
            "flatten(transform(met, p -> array(p.i0, p.i1))))"
        ),
    ).withColumn("places", F.expr("sort_array(array_distinct(places))"))
    # a window covers three words, or as many as lie before the next window
    return repeated.withColumn(
        "n_repeat_words",
        F.expr(
            "CAST(if(size(places) = 0, 0, 3 + aggregate(sequence(1, size(places)), 0, (n, j) -> "
            "n + if(j < size(places), least(3, places[j] - places[j - 1]), 0))) AS BIGINT)"
        ),
    ).drop("n_windows", "bits", "hashed", "sorted_windows", "mask", "met", "clash", "exact", "places")


def with_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` (column ``text``, not null) with the statistics ``names`` and what they need."""
    def add(df: DataFrame, name: str) -> DataFrame:
        if name in df.columns:
            return df
        for need in _NEEDS.get(name, ()):
            df = add(df, need)
        return _with_repeats(df) if name == "n_repeat_words" else df.withColumn(name, F.expr(STATISTICS[name]))

    for name in names:
        df = add(df, name)
    return df


def order_rules(texts: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second over a sample of about ``sample_rows`` texts.

    ``texts`` has the column ``text``. A rule that rejects nothing comes after all that do, the
    cheapest first; names decide between equals. An empty table keeps the given order.
    """
    n = texts.count()
    if not n:
        return list(rules)
    sample = save_and_reload(texts.sample(min(1.0, sample_rows / n), seed=7).coalesce(4), "rule-sample")
    measured = []
    for rule in rules:
        rejected = with_statistics(sample, rule.uses).agg(F.sum(F.expr(rule.rejects).cast("int")))
        began = time.perf_counter()
        hits = rejected.first()[0] or 0
        cost = time.perf_counter() - began
        measured.append((-hits / cost, cost, rule.name, rule))
    return [m[-1] for m in sorted(measured, key=lambda m: m[:3])]


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, tried in the given order; null for a text that passes."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(first)
    return first


def quality_report(
    docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES,
    sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Per row: the columns ``keep``, the base statistics, base_failed, rejected_by and kept.

    ``kept`` is false where a base rule fails, else where a rule rejects; ``rejected_by`` names
    the first that did, and its choice among several may vary with the measured order. Null
    texts count as empty: no words, so the base fails. Repeated rows are judged one by one.
    """
    from_docs = docs.select(
        *[col(c).alias(f"keep{i}") for i, c in enumerate(keep)], F.coalesce(col(text_col), F.lit("")).alias("text")
    )
    ordered = order_rules(from_docs.select("text"), rules, sample_rows)
    uses = list(dict.fromkeys(
        ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words"] + [u for r in base for u in r.uses]
    ))
    counted = with_statistics(from_docs, uses)
    lazy = {u: STATISTICS[u] for r in rules for u in r.uses if u not in counted.columns}
    # what only the rules use stays inside the CASE, and is worked out when it is reached
    inside = [Rule(r.name, _inlined(r, lazy), r.uses) for r in ordered]
    failed = F.expr(" OR ".join(f"({r.rejects})" for r in base))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(inside)))
        .select(
            *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "n_repeat_words", "base_failed", "rejected_by", F.col("rejected_by").isNull().alias("kept"),
        )
    )


def _inlined(rule: Rule, lazy: dict[str, str]) -> str:
    sql = rule.rejects
    for name, statistic in lazy.items():
        if name in rule.uses:
            sql = sql.replace(name, f"({statistic})")
    return sql


def filter_by_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = (*BASE_RULES, *RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that any rule rejects; base rules are part of the cascade here."""
    row = F.struct(*[col(c) for c in docs.columns])
    texts = docs.select(row.alias("row"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    ordered = order_rules(texts.select("text"), rules, sample_rows)
    kept = texts
    for rule in ordered:
        # a generated column keeps the filter from pulling the statistics apart
        kept = worked_out(with_statistics(kept, rule.uses), rule.name, F.expr(rule.rejects)).filter(~F.col(rule.name))
    return kept.select("row.*")
