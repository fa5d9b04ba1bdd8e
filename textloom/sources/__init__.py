"""Readers and writers: the corpus formats that analyses start from and end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted texts over several lines; the schema is given, not inferred."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value as text")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.options(header=True, escape='"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
