"""A training corpus from ``documents``: quality, near duplicates, benchmark passages, mix, shards.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads
it again as the next one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from citestat.llm import classifier, decontamination, mixing, neardup, sharding
from citestat.llm.common import table
from citestat.session import delete_tables, discard, result_only, saved_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the last stage has saved on its way, by application.
_left: dict[str, list[str]] = {}


def stage(work: Stage) -> Stage:
    """Deletes what the stage before has saved on its way, unless ``docs`` still reads it: its result is written by now."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = _left.pop(app, [])
        files = docs.inputFiles() if left else []
        read = [t for t in left if any(t.split("://")[-1].lstrip("/") in f for f in files)]
        if not read:
            delete_tables(spark, left)
        with saved_tables() as made:
            out = work(spark, docs, sf_dir)
        _left[app] = made + (left if read else [])
        return out

    return run_stage



@stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality classifier doesn't reject. Labels teach it; a label is no input of a score."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


@stage
def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


@stage
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a ten-word passage of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a text that is taken twice is two rows."""
    return mixing.mix(docs)


@stage
def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", keep_one_of_alike),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing_sources", mix_sources),
    ("sharding", into_shards),
]

#: Trained models, seeded choices and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done: DataFrame | None = None
    for name, work in STAGES:
        docs = result_only(spark, lambda docs=docs, work=work: work(spark, docs, sf_dir), f"pipeline-{name}")
        # what this stage has read is needed no more
        if done is not None:
            discard(done)
        done = docs
    return docs
