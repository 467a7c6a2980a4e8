"""Data-quality jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

REQUIRED_FAULT_COLUMNS = (
    "fault_id", "fault_code", "fault_category", "network_type", "equipment_type", "location",
    "customers_affected", "priority_score",
)
REQUIRED_DOCUMENT_COLUMNS = ("document_id", "title", "category", "content")


def missing_columns(df: DataFrame, required=REQUIRED_FAULT_COLUMNS) -> list[str]:
    """Required columns the schema lacks. Reads no data."""
    return [c for c in required if c not in df.columns]


def null_counts(df: DataFrame, columns=REQUIRED_FAULT_COLUMNS) -> DataFrame:
    """NULLs per column in one pass, as (column_name, null_count)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_count")


def record_counts(summary: DataFrame, expected: dict[str, int]) -> DataFrame:
    """A load summary next to the expected counts."""
    want = reduce(
        lambda acc, item: acc.when(F.col("table_name") == item[0], item[1]),
        list(expected.items())[1:],
        F.when(F.col("table_name") == list(expected)[0], list(expected.values())[0]),
    )
    return summary.withColumn("expected_count", want.cast("long")).withColumn(
        "matches", F.col("record_count").eqNullSafe(F.col("expected_count"))
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    keyed = child.filter(F.col(key).isNotNull())
    return keyed.join(parent.select(key).distinct(), key, "left_anti")


def _violations(name: str, table: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check_name"), F.lit(table).alias("table_name"), "violations"
    )


def _twice(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def dq_report(faults: DataFrame, metadata: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Key uniqueness, orphans and chunk length as (check_name, table_name, violations)."""
    checks = [
        _violations(f"unique {key}", table, _twice(df, key))
        for table, key, df in (
            ("network_faults", "fault_id", faults), ("sop_metadata", "document_id", metadata),
            ("sop_files", "file_path", files), ("sop_chunks", "chunk_id", chunks),
        )
    ]
    checks += [
        _violations("metadata without file", "sop_metadata", orphans(metadata, files, "file_path")),
        _violations("chunk without metadata", "sop_chunks", orphans(chunks, metadata, "document_id")),
        _violations("chunk without file", "sop_chunks", orphans(chunks, files, "file_path")),
        _violations(
            f"chunk longer than {fixed.CHUNK_SIZE}", "sop_chunks",
            chunks.filter(F.length("chunk_text") > fixed.CHUNK_SIZE),
        ),
    ]
    return reduce(DataFrame.unionByName, checks)
