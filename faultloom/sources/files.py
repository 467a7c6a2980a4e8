"""CSV, JSON and file-listing sources, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import upsert, with_defaults
from ..schemas import EMPTY_DASHBOARD, FAULTS, SOP_DOCUMENTS

# fixed values: texts that mean NULL in a CSV field
NULL_TOKENS = ("NULL", "null", "")
CORRUPT = "_corrupt_record"
CSV_OPTIONS = {
    "header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
}


def csv_text_schema() -> T.StructType:
    """Every fault column as text, plus the raw line of malformed rows."""
    names = [*FAULTS.fieldNames(), CORRUPT]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def _typed(field: T.StructField) -> Column:
    raw = F.when(~F.col(field.name).isin(*NULL_TOKENS), F.col(field.name))
    return raw.try_cast(field.dataType) if not isinstance(field.dataType, T.StringType) else raw


def split_faults(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) from rows of csv_text_schema.

    A row is bad if it has too few or too many fields, or a field that does not parse. Bad rows
    keep what was read and say why, so that nothing is lost.
    """
    typed = {f.name: _typed(f) for f in FAULTS.fields}
    unparsed = [
        F.when(~F.col(f.name).isin(*NULL_TOKENS) & typed[f.name].isNull(), F.lit(f.name))
        for f in FAULTS.fields
        if not isinstance(f.dataType, T.StringType)
    ]
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed row")).otherwise(
        F.nullif(F.concat_ws(",", *unparsed), F.lit(""))
    )
    checked = raw.withColumn("_reason", reason)
    good = checked.filter(F.col("_reason").isNull()).select(
        *[typed[n].alias(n) for n in FAULTS.fieldNames()]
    )
    bad = checked.filter(F.col("_reason").isNotNull()).select(
        "_reason", F.coalesce(CORRUPT, F.to_json(F.struct(*FAULTS.fieldNames()))).alias("raw")
    )
    return good, bad


def read_faults_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Fault CSV files as (good, bad): header skipped, quotes and blanks trimmed, null tokens."""
    return split_faults(spark.read.schema(csv_text_schema()).options(**CSV_OPTIONS).csv(path))


def read_sop_json(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Procedure documents: one object per file, or one per line."""
    reader = spark.read.schema(SOP_DOCUMENTS).option("multiLine", str(one_per_file).lower())
    return reader.json(path)


def list_sop_files(
    spark: SparkSession, path: str, glob: str = "*.pdf", checksum: bool = False
) -> DataFrame:
    """Files below a folder: path relative to it, url, size, time, and checksum on request.

    Without checksum the contents are not read. Spark's file sources skip empty files.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(path)
    )
    root = path.rstrip("/") + "/"
    md5 = F.md5("content") if checksum else F.lit(None).cast("string")
    return files.select(
        F.substring_index(F.col("path"), root, -1).alias("file_path"),
        F.col("path").alias("file_url"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"),
        md5.alias("etag"),
        md5.alias("md5"),
    )


def refresh_files(
    spark: SparkSession, path: str, target: DataFrame, as_of, checksum: bool = False
) -> DataFrame:
    """The file catalog brought up to date with a folder: known files updated, new ones added.

    Files that are gone keep their row.
    """
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    listing = list_sop_files(spark, path, checksum=checksum)
    return upsert(
        target, listing, ["file_path"],
        ["file_url", "file_size", "last_modified", "etag", "md5"],
        on_update={"updated_timestamp": now},
        on_insert={
            "file_status": F.lit("ACTIVE"), "created_timestamp": now, "updated_timestamp": now,
        },
    )


def fault_defaults(faults: DataFrame, as_of) -> DataFrame:
    """Fill the audit columns of a fault table at ingest."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    return with_defaults(faults, {"created_timestamp": now, "updated_timestamp": now})


def metadata_defaults(metadata: DataFrame, as_of, author: str = "Engineering") -> DataFrame:
    """Fill version, author, dates and the active flag of metadata rows at ingest."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    today = now.cast("date")
    return with_defaults(metadata, {
        "document_version": "1.0", "author": author, "creation_date": today,
        "last_reviewed": today, "is_active": True,
        "created_timestamp": now, "updated_timestamp": now,
    })


def empty_faults(spark: SparkSession) -> DataFrame:
    """The dashboard frame without rows, for callers whose source is missing."""
    return spark.createDataFrame([], EMPTY_DASHBOARD)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)
