"""Extremes of a column from the footers of Parquet files, without reading a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _from_footers(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    # Aggregates are pushed into the scan only for the second kind of file source, which a session of its own turns on.
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path).agg(*(f(c).alias(f"{name}_{c}") for c in columns for name, f in (("least", F.min), ("highest", F.max))))


def extremes(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """One row ``least_<column>, highest_<column>, ...`` for numbers, dates and truth values; nulls where there are no rows.

    Each file's footer has the extremes of its row groups, so the work grows with the files.  Where a footer lacks them Spark fails or
    reads the rows, but never answers from part of them.
    """
    found = _from_footers(spark, path, *columns)
    return spark.createDataFrame(found.collect(), found.schema)
