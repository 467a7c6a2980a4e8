"""Aggregations. Every groupBy combines map-side, so a hot key costs one row per task.

Where a report groups the same rows in several ways, the rows are reduced once to the finest
grouping and the other levels are built from that small result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..functions.rules import first_match
from .faults import active, resolved

count = lambda: F.count(F.lit(1))
ratio_of = lambda flag: F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))


def technician_metrics(enhanced: DataFrame, as_of) -> DataFrame:
    """Jobs, first-time fixes and hours of resolved faults per technician, location, category.

    A NULL in any key makes metric_id NULL.
    """
    month = F.date_format(rules.moment(as_of), "yyyyMM")
    fields = ["technician_type_required", "location", "fault_category"]
    key = reduce(lambda a, b: F.concat(a, F.lit("_"), b), [F.col(c) for c in fields] + [month])
    edge = lambda agg: F.date_trunc("month", agg("fault_timestamp")).cast("timestamp_ntz")
    return (
        resolved(enhanced).groupBy(*fields)
        .agg(
            count().alias("total_jobs"),
            F.count_if("first_time_fix").alias("first_time_fix_count"),
            ratio_of("first_time_fix").alias("first_time_fix_rate"),
            F.avg("resolution_time_hours").alias("avg_resolution_time_hours"),
            edge(F.min).alias("period_start"),
            edge(F.max).alias("period_end"),
        )
        .select(
            key.alias("metric_id"), F.col(fields[0]).alias("technician_type"), *fields[1:],
            "total_jobs", "first_time_fix_count", "first_time_fix_rate",
            "avg_resolution_time_hours", "period_start", "period_end",
        )
    )


def equipment_reliability(enhanced: DataFrame, as_of, seed: int = 0) -> DataFrame:
    """Fault counts, risk and maintenance priority per equipment, location and network.

    The id ranks the networks of one equipment and location by fault count (ties by name). The
    drawn columns (dates, risk) are repeatable per key and seed.
    """
    today = F.to_date(rules.moment(as_of))
    key = ["equipment_type", "location", "network_type"]
    since = lambda days: F.count_if(
        F.col("fault_timestamp") >= F.date_sub(today, days).cast("timestamp_ntz")
    )
    rank = Window.partitionBy(*key[:2]).orderBy(F.desc("n"), "network_type")
    more = lambda bound: F.col("n") > bound
    draw = rules.uniform(seed + 2, *key)
    risk = first_match(
        [(more(b), draw * (hi - lo) + lo) for b, _, (lo, hi) in fixed.RELIABILITY_BANDS],
        draw * fixed.RELIABILITY_DEFAULT[1][1],
    )
    ago = lambda salt, days: F.date_sub(today, rules.uniform_int(seed + salt, *days, *key))
    grouped = enhanced.groupBy(*key).agg(
        count().alias("n"),
        since(30).alias("fault_count_30_days"),
        since(90).alias("fault_count_90_days"),
    )
    number = F.row_number().over(rank).cast("string")
    return grouped.select(
        F.concat("equipment_type", F.lit("_"), "location", F.lit("_"), number).alias("equipment_id"),
        *key,
        ago(0, fixed.INSTALL_DAYS).alias("installation_date"),
        ago(1, fixed.MAINTENANCE_DAYS).alias("last_maintenance_date"),
        "fault_count_30_days", "fault_count_90_days",
        risk.alias("predicted_failure_risk"),
        first_match(
            [(more(b), name) for b, name, _ in fixed.RELIABILITY_BANDS],
            fixed.RELIABILITY_DEFAULT[0],
        ).alias("maintenance_priority"),
    )


def fault_quality_summary(enhanced: DataFrame) -> DataFrame:
    return enhanced.groupBy("fault_category").agg(
        count().alias("fault_count"),
        F.avg(F.col("first_time_fix").cast("int")).alias("avg_ftf_rate"),
        F.avg("resolution_time_hours").alias("avg_resolution_time"),
        F.avg("customers_affected").alias("avg_customers_affected"),
    ).orderBy(F.desc("fault_count"), "fault_category")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    size = F.length("chunk_text")
    return chunks.groupBy("chunk_type").agg(
        count().alias("chunk_count"),
        F.avg(size).alias("avg_chunk_length"),
        F.min(size).alias("min_chunk_length"),
        F.max(size).alias("max_chunk_length"),
    ).orderBy(F.desc("chunk_count"), "chunk_type")


def searchable_summary(searchable: DataFrame) -> DataFrame:
    """Chunks and documents per category. Counts per document first, so the distinct count is a
    plain count over already reduced rows and a hot category stays spread over its documents."""
    return (
        searchable.groupBy("category", "document_id").agg(count().alias("n"))
        .groupBy("category")
        .agg(F.sum("n").alias("chunk_count"), count().alias("document_count"))
        .orderBy(F.desc("chunk_count"), "category")
    )


def chunk_inventory(chunks: DataFrame) -> DataFrame:
    """Totals of meaningful chunks. Reduced to (document, type) before the two distinct counts."""
    return (
        chunks.filter("is_meaningful").groupBy("document_id", "chunk_type").agg(count().alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
            F.count_distinct("document_id").alias("total_documents"),
            F.count_distinct("chunk_type").alias("chunk_types"),
        )
    )


def _share(value: Column | str) -> Column:
    """Share of the grand total. Only for aggregated rows: the window is a single partition."""
    value = rules.col(value)
    return F.try_divide(value, F.sum(value).over(Window.partitionBy()))


def model_confusion(analysis: DataFrame) -> DataFrame:
    """Counts per (actual, predicted) and their share; at most categories x 3 rows."""
    return (
        analysis.filter(F.col("actual_category").isNotNull())
        .groupBy("actual_category", "predicted_category")
        .agg(count().alias("prediction_count"))
        .withColumn("percentage", _share("prediction_count"))
        .orderBy("actual_category", "predicted_category")
    )


def model_accuracy(analysis: DataFrame) -> DataFrame:
    """A NULL prediction counts as wrong."""
    hit = F.count_if(F.col("actual_category") == F.col("predicted_category"))
    return analysis.filter(F.col("actual_category").isNotNull()).agg(
        F.lit("Model Performance Summary").alias("metric_type"),
        count().alias("total_predictions"),
        hit.alias("correct_predictions"),
        F.try_divide(hit, count()).alias("accuracy"),
    )


def kpis(df: DataFrame) -> DataFrame:
    """The KPI row in one pass. `last_24h` and `sla_risk` count resolved faults too."""
    live = ~F.col("is_resolved")
    total = lambda c: F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0))
    return df.agg(
        F.count_if(live).alias("active_faults"),
        F.count_if(F.col("hours_since_fault") < 24).alias("last_24h"),
        F.count_if(live & (F.col("risk_level") == "CRITICAL")).alias("critical_faults"),
        F.count_if("sla_breach_risk").alias("sla_risk"),
        (F.avg(F.when(~live, F.col("first_time_fix").cast("int"))) * 100).alias("first_time_fix_pct"),
        total("customers_affected").alias("customers_affected"),
        total("estimated_revenue_impact").alias("revenue_at_risk"),
    )


def category_impact(df: DataFrame) -> DataFrame:
    """Customers and incidents of open faults per category, with their shares."""
    return (
        active(df).filter(F.col("fault_category").isNotNull()).groupBy("fault_category")
        .agg(
            F.coalesce(F.sum("customers_affected"), F.lit(0)).alias("customers_affected"),
            count().alias("fault_count"),
        )
        .withColumns({
            "customer_share": _share("customers_affected"),
            "incident_share": _share("fault_count"),
        })
    )


def location_impact(df: DataFrame) -> DataFrame:
    """Open faults per location and category: count, customers, mean score. NULL keys drop out."""
    keyed = active(df).filter(F.col("location").isNotNull() & F.col("fault_category").isNotNull())
    return keyed.groupBy("location", "fault_category").agg(
        F.count("fault_id").alias("fault_count"),
        F.coalesce(F.sum("customers_affected"), F.lit(0)).alias("customers_affected"),
        F.avg("calculated_priority_score").alias("calculated_priority_score"),
    )


def location_rollup(impact: DataFrame) -> DataFrame:
    """location_impact with location and grand totals; scores weighted by customers.

    level is 0 for a leaf, 1 for a location, 3 for the total.
    """
    customers, score = F.col("customers_affected"), F.col("calculated_priority_score")
    return impact.rollup("location", "fault_category").agg(
        F.grouping_id().alias("level"),
        F.sum("fault_count").alias("fault_count"),
        F.sum(customers).alias("customers_affected"),
        F.try_divide(F.sum(score * customers), F.sum(F.when(score.isNotNull(), customers)))
        .alias("weighted_priority_score"),
    )


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [
        df.agg(count().alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def fault_profile(faults: DataFrame) -> DataFrame:
    """Counts per category and per network type, and the overall means.

    One pass over the faults; the three reports come from the reduced rows.
    """
    small = faults.groupBy("fault_category", "network_type").agg(
        count().alias("n"),
        F.sum(F.col("first_time_fix").cast("int")).alias("fixed"),
        F.count("first_time_fix").alias("fix_known"),
        F.sum("resolution_time_hours").alias("hours"),
        F.count("resolution_time_hours").alias("hours_known"),
    )
    views = F.array(
        F.struct(F.lit("fault_category").alias("dimension"), F.col("fault_category").alias("value")),
        F.struct(F.lit("network_type").alias("dimension"), F.col("network_type").alias("value")),
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")),
    )
    return (
        small.select(F.inline(views), "n", "fixed", "fix_known", "hours", "hours_known")
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(
            F.sum("n").alias("record_count"),
            F.try_divide(F.sum("fixed"), F.sum("fix_known")).alias("first_time_fix_rate"),
            F.try_divide(F.sum("hours"), F.sum("hours_known")).alias("avg_resolution_time"),
        )
    )


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a selector, NULL left out."""
    values = df.select(F.col(column).alias("value"))
    return values.filter(F.col("value").isNotNull()).distinct().orderBy("value")
