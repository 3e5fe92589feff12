"""The stages of corpus_pipeline.py on odd tables, and what a run leaves behind."""

import subprocess

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citestat import session
from citestat.llm import common, mixing, sharding

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, size int, shard string, copies int, row_at int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null source and id, repeated rows, a long text, clashing columns, no lang."""
    rows = [(i, f"some words of text number {i} " * (1 + i % 7), f"s{i % 3}", 9, 1, "x", 2, 3) for i in range(60)]
    rows += [(3, "some words", "s0", 9, 1, "x", 2, 3)] * 3 + [(None, "no id here", None, 1, 1, "x", 2, 3), (70, None, "s1", 0, 1, "x", 2, 3)]
    rows += [(71, "", "s1", 0, 1, "x", 2, 3), (72, "long " * 50_000, "s2", 0, 1, "x", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def saved(df, tmp_path):
    df.write.parquet(str(tmp_path / "docs"))
    return df.sparkSession.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("from_file", [True, False])
def test_mix_keeps_rows(odd, tmp_path, from_file):
    docs = saved(odd.repartition(3), tmp_path) if from_file else odd
    plan = mixing.mix_plan(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()
    want = {(r["doc_id"], r["size"]): r["n"] for r in plan if r["n"]}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.withColumn("words", mixing.word_count(F.col("text"))).groupBy("doc_id", "words").count().collect()
    assert {(r["doc_id"], r["words"]): r["count"] for r in got} == want
    assert mixed.subtract(docs).count() == 0


@pytest.mark.parametrize("from_file", [True, False])
def test_sharded_keeps_rows(odd, tmp_path, from_file):
    docs = saved(odd.repartition(3), tmp_path) if from_file else odd
    found = sharding.sharded(docs, shards=4)
    assert found.columns == ["doc_id", "text", "source", "n_chars", "copies", "row_at", "size", "text_crc32", "shard", "slot"]
    kept = ["doc_id", "text", "source", "n_chars", "copies", "row_at"]
    assert found.select(kept).exceptAll(docs.select(kept)).count() == docs.select(kept).exceptAll(found.select(kept)).count() == 0
    slots = found.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(list(r["s"]) == list(range(len(r["s"]))) for r in slots)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == sharding.sharded(none).count() == 0


def test_row_keys_name_rows(odd, tmp_path):
    for docs in (odd, saved(odd.repartition(4), tmp_path).filter("doc_id > 5")):
        keyed, key = common.with_row_key(docs)
        assert not set(key) & set(docs.columns)
        assert keyed.select(key).distinct().count() == docs.count()


def folders(spark):
    found = subprocess.run(["ls", f"{session.shared_folder(spark).removeprefix('file:')}/citestat"], capture_output=True, text=True)
    return set(found.stdout.split())


def test_run_leaves_its_result_only(spark):
    before = folders(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(out.columns)
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["pipeline-sharding"]


def test_stages_delete_when_written(spark, tmp_path):
    """Stages called one by one, each result written: the tables of a stage go when the next one begins."""
    before = folders(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, docs, "/root/testdata/sf0.001")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert all(f.startswith("shard-") for f in folders(spark) - before)


def test_stages_without_writing(spark):
    """Stages put together without writing still read their tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chained = docs
    for _, work in corpus_pipeline.STAGES[:3]:
        chained = work(spark, chained, "/root/testdata/sf0.001")
    assert chained.count() > 50


def test_failed_job_leaves_nothing(spark):
    before = folders(spark)

    def job():
        session.save_and_reload(spark.range(5), "half")
        raise ValueError("stopped")

    with pytest.raises(ValueError, match="stopped"):
        session.result_only(spark, job)
    assert folders(spark) == before
