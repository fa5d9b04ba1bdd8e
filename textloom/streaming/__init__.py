"""Stateless text expressions over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx


def clean_stream(spark: SparkSession, path: str, schema: str, text_col: str = "text", **options) -> DataFrame:
    """The files that arrive in ``path``, with a ``clean`` column; the same expression as in batch."""
    return spark.readStream.schema(schema).parquet(path).withColumn("clean", tx.clean(F.col(text_col), **options))
