"""Quality classifier: rules read off trees, weighted by a lasso, scored as column expressions.

Each text is described by statistics, all of them column expressions. On a bounded sample of
labelled texts a random forest of shallow trees is grown; every path from a root to a node is
a conjunctive rule over the statistics. A logistic regression with an L1 penalty keeps few
rules and weighs them. The fitted model is a list of (conditions, weight), and scoring is one
column expression over the statistics: nothing is shuffled and no Python runs for it.
"""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from citestat.llm.common import SPACE, WORD, col, free_name, worked_out
from citestat.session import save_and_reload

#: Labelled texts on which a model is fitted, at most.
FIT_ROWS = 4000
TREES, DEPTH = 20, 3
PENALTY = 0.002


class Condition(NamedTuple):
    statistic: str
    above: bool
    threshold: float


class RuleModel(NamedTuple):
    """score = logistic(intercept + the weights of the rules that hold)."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, prefix: str = "") -> Column:
        """Score as a column over the statistics columns."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(_holds(conditions, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps(self)


def _holds(conditions: tuple[Condition, ...], prefix: str = "") -> Column:
    held = F.lit(True)
    for c in conditions:
        value = F.col(f"{prefix}{c.statistic}")
        held = held & ((value > c.threshold) if c.above else (value <= c.threshold))
    return held


#: What a rule may ask for. Shares of nothing are 0.
STATISTICS = (
    "n_words", "word_length", "distinct_words", "symbols", "capitals", "marks", "digits", "stops",
    "n_lines", "duplicate_lines", "words_per_line",
)


def with_statistics(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """``df`` with the statistics of ``text``; a null text counts as empty."""
    p = prefix
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    count = lambda pattern: F.regexp_count(F.col(f"{p}text"), F.lit(pattern)).cast("double")
    df = df.withColumn(f"{p}text", F.coalesce(text, F.lit("")))
    df = df.withColumn(f"{p}pieces", F.split(f"{p}text", SPACE, -1)).withColumn(f"{p}words", F.array_remove(f"{p}pieces", ""))
    df = df.withColumn(f"{p}lines", F.filter(F.split(f"{p}text", "\n", -1), lambda x: x.rlike(WORD)))
    df = df.withColumns({
        f"{p}n_words": F.size(f"{p}words").cast("double"),
        f"{p}n_distinct": F.size(F.array_distinct(f"{p}words")).cast("double"),
        f"{p}n_chars": (F.char_length(f"{p}text") - F.size(f"{p}pieces") + 1).cast("double"),
        f"{p}n_lines": F.size(f"{p}lines").cast("double"),
        f"{p}n_lines_distinct": F.size(F.array_distinct(f"{p}lines")).cast("double"),
        f"{p}n_symbols": count(r"[#*$%&|<>]"), f"{p}n_capitals": count(r"[A-Z]"), f"{p}n_marks": count(r"[!?]"),
        f"{p}n_digits": count(r"[0-9]"), f"{p}n_stops": count(r"[.,;:]"),
    })
    words, chars, lines = F.col(f"{p}n_words"), F.col(f"{p}n_chars"), F.col(f"{p}n_lines")
    return df.withColumns({
        f"{p}word_length": share(chars, words), f"{p}distinct_words": share(F.col(f"{p}n_distinct"), words),
        f"{p}symbols": share(F.col(f"{p}n_symbols"), words), f"{p}capitals": share(F.col(f"{p}n_capitals"), chars),
        f"{p}marks": share(F.col(f"{p}n_marks"), words), f"{p}digits": share(F.col(f"{p}n_digits"), chars),
        f"{p}stops": share(F.col(f"{p}n_stops"), words),
        f"{p}duplicate_lines": share(lines - F.col(f"{p}n_lines_distinct"), lines), f"{p}words_per_line": share(words, lines),
    })


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int
) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled texts, chosen by a hash of their id.

    Labels that are null or contradict each other are not used; of texts that share an id, the
    smallest is.
    """
    chosen = (
        labels.select(col(id_col).alias("id"), col(label_col).cast("double").alias("label")).dropna()
        .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
        .select("id", "label").orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    chosen = save_and_reload(chosen, "labels-chosen")
    # at most ``rows`` rows of two numbers
    return (
        docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id")
        .groupBy("id", "label").agg(F.min("text").alias("text"))
    )


def _paths(debug: str) -> list[tuple[Condition, ...]]:
    """Conjunctions of all nodes below the roots of a forest, read from its description."""
    found: list[tuple[Condition, ...]] = []
    stack: list[tuple[int, Condition]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.E+]+)\)", line)
        if m:
            depth = len(m[1])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            stack.append((depth, Condition(STATISTICS[int(m[2])], m[3] == ">", float(m[4]))))
            found.append(tuple(c for _, c in stack))
        elif line.lstrip().startswith("Tree"):
            stack = []
    return found


def _shortest(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The same rule with one bound per statistic and side, sorted."""
    bounds: dict[tuple[str, bool], float] = {}
    for c in path:
        old = bounds.get((c.statistic, c.above))
        bounds[c.statistic, c.above] = c.threshold if old is None else (max if c.above else min)(old, c.threshold)
    return tuple(Condition(s, a, t) for (s, a), t in sorted(bounds.items()))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
) -> RuleModel:
    """Fit on at most ``rows`` labelled texts (a documented bound; scoring covers every text).

    With no labelled text, or one label only, the model has no rule and its score is the share
    of label 1 (one half without labels).
    """
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows)
    described = with_statistics(sample, F.col("text")).select("id", "label", *STATISTICS)
    # the trees draw their samples by row order, so the order is fixed
    table = save_and_reload(described.orderBy("id").coalesce(1), "classifier-sample")
    n, positive = table.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or positive in (0.0, float(n)):
        share = (float(positive or 0) + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)), ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(table)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=max(2, n // 200), seed=11,
    ).fit(vectors)
    rules = list(dict.fromkeys(_shortest(p) for p in _paths(forest.toDebugString)))
    if not rules:
        share = positive / n
        return RuleModel(math.log(share / (1 - share)), ())
    held = table.select("label", *[_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = save_and_reload(held, "classifier-rules")
    lasso = LogisticRegression(
        featuresCol="x", labelCol="label", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=100,
    ).fit(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held))
    weights = [float(w) for w in lasso.coefficients]
    return RuleModel(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def scored(docs: DataFrame, model: RuleModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each text in [0, 1]; null and empty texts have one too."""
    prefix = free_name(docs, "_s_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    described = with_statistics(docs, col(text_col), prefix)
    return worked_out(described, name, model.score(prefix)).select(*[col(c) for c in docs.columns], name)


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``; same columns."""
    name = free_name(docs, "score")
    return scored(docs, model, text_col, name).filter(F.col(name) >= least).drop(name)
