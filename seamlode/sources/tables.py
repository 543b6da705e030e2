"""Table sources: the Parquet layout ``<dir>/<table>.parquet``, SQL, and the first value of a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Spark resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Name tables as views for ``query``."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, params: dict | list | None = None) -> DataFrame:
    """Rows of a statement with named or positional parameters, as a plan that has not run."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def scalar(spark: SparkSession, sql: str, params: dict | list | None = None):
    """First column of the first row, or None."""
    row = query(spark, sql, params).first()
    return None if row is None else row[0]
