"""Plumbing shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settle

ROWS_PER_BATCH = 256


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound what a Python worker holds at once; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, as _id and _text: other columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_id(docs: DataFrame, rows: DataFrame, id_col: str, kind: str) -> DataFrame:
    """docs joined with rows by their _id, null meeting null; _id gets a name that docs has not."""
    name = fresh(docs, "_id")
    rows = rows.withColumnRenamed("_id", name)
    return docs.join(rows, F.col(id_col).cast("long").eqNullSafe(F.col(name)), kind)


__all__ = ["by_id", "fresh", "keyed", "settle", "small_batches"]
