"""Paths into raw JSON objects, by VARIANT columns.

A text is parsed once; paths are then read from the parsed value. `shred` makes typed columns of the paths
that are read often, so that later queries need neither the text nor the parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import col


def parsed(json: Column | str) -> Column:
    """The value of a JSON text; null for a null or malformed one."""
    return F.try_parse_json(col(json))


def path(value: Column | str, at: str, kind: str = "string") -> Column:
    """What stands at a path such as 'a.b[0]', cast; null where it is absent, null or of another type."""
    return F.try_variant_get(col(value), f"$.{at}", kind)


def shred(df: DataFrame, json_col: str, paths: dict[str, tuple[str, str]], keep: str | None = None) -> DataFrame:
    """df with a typed column per path (name -> (path, type)); keep names a column for the parsed value.

    The parsed value stays in the row between the parser and the paths, so each text is parsed once.
    """
    name = keep or "_value"
    rows = df.withColumn(name, parsed(json_col)).withColumns({c: path(name, *p) for c, p in paths.items()})
    return rows if keep else rows.drop(name)


def object_schema(df: DataFrame, json_col: str) -> DataFrame:
    """One row: the schema that all JSON objects of a column fit, and how many are not JSON."""
    value = parsed(json_col)
    return df.agg(
        F.schema_of_variant_agg(value).alias("schema"),
        F.count_if(col(json_col).isNotNull() & value.isNull()).alias("malformed"),
    )
