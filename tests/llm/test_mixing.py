"""Budget fitting against all choices, and mixing of odd tables."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from citestat.llm import mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 3)), max_size=5, unique_by=lambda x: x[0]), st.integers(0, 300))
def test_nearest_sum(kinds, budget):
    lengths = np.array([n for n, _ in kinds], dtype=np.int64)
    counts = np.array([c for _, c in kinds], dtype=np.int64)
    taken = mixing._knapsack(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    sums = {int(lengths @ np.array(c, dtype=np.int64)) for c in itertools.product(*[range(c + 1) for c in counts])}
    assert abs(int(lengths @ taken) - budget) == min(abs(s - budget) for s in sums)


def test_a_long_text_is_nearer():
    assert mixing.fit_budget(np.array([3, 300_000]), np.array([1, 1]), 299_995).tolist() == [0, 1]
    assert mixing.fit_budget(np.array([3, 300_000]), np.array([1, 1]), 100_000).tolist() == [1, 0]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "word " * (i % 5), f"s{i % 2}", 1, "x", 2.0) for i in range(40)] + [(3, "a b c", "s0", 1, "x", 2.0)] * 3
    rows += [(None, "a b", None, 1, "x", 2.0), (50, None, "s1", 1, "x", 2.0), (51, "", "empty", 1, "x", 2.0), (52, "w " * 40_000, "s1", 1, "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, copies string, target double")


def test_odd_rows(odd):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    plan = mixing.mix_plan(odd).toPandas()
    assert len(plan) == odd.count() and plan["copies"].between(0, 3).all()
    assert (plan[plan["size"] == 0]["copies"] == 0).all() and plan["source_size"].notna().all()
    words = odd.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert plan.groupby("source_size")["target"].first().sum() <= words + 1e-6
    again = mixing.mix_plan(odd.repartition(7)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert plan[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_no_rows(odd):
    assert mixing.mix_plan(odd.limit(0)).count() == 0
