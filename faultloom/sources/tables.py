"""Reading, writing and settling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A parquet path or a catalog table."""
    return spark.read.parquet(name_or_path) if "/" in name_or_path else spark.table(name_or_path)


def write_append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows to a parquet table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def settle(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """Run df now, write it under the shared folder and read it back.

    The result has a measured size, so Spark decides from facts whether to broadcast it, and a
    short lineage that survives lost executors. Tables that are read many times are settled once
    and kept; the others go with the scope they were made in (session.steps).
    """
    path = work_dir(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
