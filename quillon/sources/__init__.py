"""Reading tables and writing results. The engine takes any DataFrame; these are conveniences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    df.write.format(fmt).mode(mode).save(path)


def to_dicts(df: DataFrame) -> list[dict]:
    """A small result as plain dicts, for reports."""
    return [r.asDict(recursive=True) for r in df.collect()]
