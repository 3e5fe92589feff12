"""Readers with explicit schemas, and result writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from citestat import schemas


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """The frame itself, or an error that lists the missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns in {what}: {missing}")
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_journals(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schemas.JOURNALS)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_metadata_dump(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """All CSV files below ``path`` whose name starts with ``prefix``; ``file`` names the source."""
    return (
        spark.read.schema(schemas.META_DUMP)
        .option("header", True).option("escape", '"').option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", f"{prefix}*.csv")
        .csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )


def read_citation_index(spark: SparkSession, path: str) -> DataFrame:
    """Recursive CSV tree of (id, citing, cited)."""
    return (
        spark.read.schema(schemas.CITATION_INDEX)
        .option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .csv(path)
    )


def read_harvested(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.HARVESTED).format(fmt).load(path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Harvest manifest; the header is checked before the schema is applied."""
    df = spark.read.format(fmt).option("header", True).load(path)
    return require_columns(df, schemas.MANIFEST_REQUIRED, "manifest")


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of large XML files, split by the row tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_xml_documents(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """One row per document file: (identifier, xml)."""
    return (
        spark.read.option("wholetext", True).option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.tei)?\.xml$", 1).alias("identifier"),
            F.col("value").alias("xml"),
        )
    )


def write_result(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "csv",
                 mode: str = "errorifexists") -> None:
    """Write with a fixed column order; other columns dropped, missing values as ''.

    Arrays are written as JSON text to CSV. Parquet and JSON keep types and NULLs.
    """
    out = df.select(*columns) if columns else df
    if fmt != "csv":
        out.write.mode(mode).format(fmt).save(path)
        return
    texts = [
        F.coalesce(
            (F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c)).cast("string"), F.lit("")
        ).alias(c)
        for c, t in out.dtypes
    ]
    (
        out.select(*texts).write.mode(mode)
        .option("header", True).option("escape", '"').option("emptyValue", "")
        .csv(path)
    )
