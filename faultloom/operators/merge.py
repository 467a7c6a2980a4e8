"""Upserts and inserts against tables without row-level updates.

upsert and insert_missing return the new state of the target as a DataFrame; write it to a new path and
switch readers to it. Tables laid out by write_buckets are merged in place: the buckets that hold a key of
the source are read, written aside and put in their place; all other files stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settle


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill absent columns, and NULLs of present ones, with defaults."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({
        name: F.coalesce(F.col(name), wrap(v)) if name in df.columns else wrap(v)
        for name, v in defaults.items()
    })


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update_cols: list[str],
    on_update: dict[str, Column] | None = None,
    on_insert: dict[str, Column] | None = None,
) -> DataFrame:
    """Update matched rows, insert the rest; columns and order of the target.

    A matched row takes update_cols from the source, NULLs included, and on_update values. An
    inserted row takes what the source has, then on_insert values, then NULL. A source that holds
    a key twice fails the job: which row should win is undefined.
    """
    on_update, on_insert = on_update or {}, on_insert or {}
    taken = [c for c in source.columns if c not in keys]
    checked = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(f"_src_{c}") for c in taken]
    )
    guard = F.when(
        F.col("_n") > 1,
        F.raise_error(F.concat(F.lit("duplicate source key "), F.to_json(F.struct(*keys)))),
    ).otherwise(F.lit(True))
    checked = checked.withColumn("_in_source", guard).drop("_n")
    joined = target.withColumn("_in_target", F.lit(True)).join(checked, keys, "full")
    updated = F.col("_in_source").isNotNull() & F.col("_in_target").isNotNull()
    inserted = F.col("_in_target").isNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        src = F.col(f"_src_{c}") if c in taken else F.lit(None)
        new = F.coalesce(src, on_insert[c]) if c in on_insert else src
        upd = src if c in update_cols else on_update.get(c, F.col(c))
        return F.when(inserted, new).when(updated, upd).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the source rows whose key it lacks; absent source columns become NULL."""
    fresh = source.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True).select(*target.columns)


# --- tables in buckets ---------------------------------------------------------------

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A new table laid out by key, one folder per bucket."""
    df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _touched(spark: SparkSession, path: str, keys: list[str], buckets: int, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The source as a written table, and the rows of the buckets that its keys are in; other folders are not read."""
    changes = settle(source.withColumn(BUCKET, bucket_of(keys, buckets)), "changes")
    found = [r[0] for r in changes.select(BUCKET).distinct().collect()]  # at most as many as buckets
    table = spark.read.parquet(path)
    return changes.drop(BUCKET), table.filter(F.col(BUCKET).isin(found) if found else F.lit(False)).drop(BUCKET)


def _replace(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Put rows in place of the buckets they are in. They are written aside first, so a job that is lost
    meanwhile is run again from there."""
    kept = settle(rows.withColumn(BUCKET, bucket_of(keys, buckets)), "merged")
    kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert_buckets(
    spark: SparkSession, path: str, source: DataFrame, keys: list[str], buckets: int, update_cols: list[str], **options
) -> None:
    """upsert into a table of write_buckets, in place: only buckets with a key of the source are read and rewritten."""
    changes, target = _touched(spark, path, keys, buckets, source)
    _replace(upsert(target, changes, keys, update_cols, **options), path, keys, buckets)


def insert_buckets(spark: SparkSession, path: str, source: DataFrame, keys: list[str], buckets: int) -> None:
    """insert_missing into a table of write_buckets, in place."""
    changes, target = _touched(spark, path, keys, buckets, source)
    _replace(insert_missing(target, changes, keys), path, keys, buckets)


def changed_rows(spark: SparkSession, path: str, source: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, DataFrame]:
    """(rows that a source replaces, rows that come in their place) before the source is merged."""
    changes, target = _touched(spark, path, keys, buckets, source)
    return target.join(changes.select(*keys), keys, "left_semi"), changes
