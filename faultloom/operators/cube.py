"""A dashboard cube: sums by day, location, category and risk, added up over days and over 'All'.

A slice (date range, and a value or All for each of the three) is one row of the cube and two lookups in
its running sums, whatever the range. The fault table is read once, when the cube is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .deltas import SUMS, kpi_view

KEYS = ("location", "fault_category", "risk_level")


def build_cube(frame: DataFrame) -> DataFrame:
    """A row per combination of keys and All: grouping (bits of the keys that are All), keys, days (ascending)
    and running, the sums up to each day.

    Rows are reduced to (keys, day) first; only that small table is cubed.
    """
    sums = [F.sum(F.expr(e).cast("long")).alias(name) for name, e in SUMS.items()]
    finest = frame.groupBy(*KEYS, F.to_date("fault_timestamp").alias("day")).agg(*sums)
    rolled = (
        finest.withColumn("_day", F.col("day")).cube(*KEYS, "_day")
        .agg(F.grouping_id().alias("_id"), *[F.sum(c).alias(c) for c in SUMS])
        .filter(F.col("_id") % 2 == 0).withColumn("grouping", F.shiftright("_id", 1).cast("int"))
    )
    upto = Window.partitionBy("grouping", *KEYS).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    running = rolled.select("grouping", *KEYS, "_day", *[F.sum(c).over(upto).alias(c) for c in SUMS])
    cells = running.groupBy("grouping", *KEYS).agg(F.array_sort(F.collect_list(F.struct("_day", *SUMS))).alias("running"))
    return cells.select("grouping", *KEYS, F.col("running._day").alias("days"), "running")


def slice_kpis(cube: DataFrame, slices: DataFrame) -> DataFrame:
    """The KPI row of every slice: slice_id, first_day, last_day (closed; null: open) and the keys ('All' or
    null leaves a key out). A slice without faults has the KPIs of an empty table."""
    c = F.col
    left_out = lambda k: c(k).isNull() | (c(k) == "All")
    grouping = sum((F.when(left_out(k), 1 << (len(KEYS) - 1 - i)).otherwise(0) for i, k in enumerate(KEYS)), F.lit(0))
    asked = slices.select("slice_id", "first_day", "last_day", grouping.cast("int").alias("grouping"),
                          *[F.when(~left_out(k), c(k)).alias(f"_{k}") for k in KEYS])
    # a NULL key of the table is no All: cells keep apart by grouping
    marked = lambda k, name: F.coalesce(c(name), F.lit("")).alias(k)
    cells = cube.select("grouping", "days", "running", *[marked(f"_k{i}", k) for i, k in enumerate(KEYS)],
                                             *[c(k).isNull().alias(f"_n{i}") for i, k in enumerate(KEYS)])
    known = F.lit(True)
    for i, k in enumerate(KEYS):
        known = known & (~c(f"_n{i}") | (F.shiftright("grouping", len(KEYS) - 1 - i).bitwiseAND(F.lit(1)) == 1))
    cells = cells.filter(known)
    asked = asked.select("slice_id", "first_day", "last_day", "grouping", *[marked(f"_k{i}", f"_{k}") for i, k in enumerate(KEYS)])
    met = asked.join(cells, ["grouping", *[f"_k{i}" for i in range(len(KEYS))]], "left")
    upto = F.size(F.filter("days", lambda d: F.col("last_day").isNull() | (d <= F.col("last_day"))))
    before = F.size(F.filter("days", lambda d: F.col("first_day").isNotNull() & (d < F.col("first_day"))))
    at = met.withColumns({"_upto": F.get("running", upto - 1), "_before": F.get("running", before - 1)})
    part = lambda name: (F.coalesce(c(f"_upto.{name}"), F.lit(0)) - F.coalesce(c(f"_before.{name}"), F.lit(0)))
    # a range that ends before it starts is empty
    backwards = F.coalesce(c("last_day") < c("first_day"), F.lit(False))
    state = at.select("slice_id", *[F.when(backwards, 0).otherwise(part(name)).cast("long").alias(name) for name in SUMS])
    return kpi_view(state, "slice_id")
