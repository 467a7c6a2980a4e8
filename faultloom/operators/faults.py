"""Fault projections, filters, triage and top-k reports.

Projections are map-only: no operator here shuffles unless it sorts or limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..functions.rules import first_match
from ..schemas import FAULT_COLUMNS

AUDIT_COLUMNS = ("created_timestamp", "updated_timestamp")


# --- projections ------------------------------------------------------------

def enhance(faults: DataFrame, as_of) -> DataFrame:
    """Base columns plus the seven derived ones (and the audit columns where present).

    Hours run to the resolution, or to `as_of` while the fault is open.
    """
    now = rules.moment(as_of)
    hours = rules.hours_since("fault_timestamp", F.coalesce("resolution_timestamp", now))
    return faults.select(
        *FAULT_COLUMNS,
        rules.is_resolved().alias("is_resolved"),
        rules.business_hours("fault_timestamp").alias("business_hours_fault"),
        hours.alias("hours_since_fault"),
        F.to_date("fault_timestamp").alias("fault_date"),
        F.to_date("resolution_timestamp").alias("resolution_date"),
        rules.risk_level("priority_score").alias("risk_level"),
        rules.sla_breach("fault_category", hours).alias("sla_breach_risk"),
        *[c for c in AUDIT_COLUMNS if c in faults.columns],
    )


def normalize_schema(df: DataFrame) -> DataFrame:
    """Lower-case names, canonical timestamp columns and defaults for required ones.

    A missing fault_id becomes monotonically_increasing_id() as text: unique, but not the
    consecutive row number a single-process frame would give. Raises when no timestamp column exists.
    """
    df = df.toDF(*[c.lower() for c in df.columns])
    pick = lambda names: next((c for c in df.columns if c in names), None)
    started, ended = pick(fixed.TIMESTAMP_NAMES), pick(fixed.RESOLUTION_NAMES)
    if started is None:
        raise ValueError(f"no timestamp column among {df.columns}")
    as_ntz = lambda c: F.col(c).cast("timestamp_ntz")
    out = df.withColumn("fault_timestamp", as_ntz(started)).withColumn(
        "resolution_timestamp", as_ntz(ended) if ended else F.lit(None).cast("timestamp_ntz")
    )
    defaults = {
        "fault_id": F.monotonically_increasing_id().cast("string"),
        "fault_category": F.lit("Unknown"),
        "priority_score": F.lit(0.5),
    }
    return out.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def _feature_columns(ts: str = "fault_timestamp") -> dict[str, Column]:
    return {"hour_of_day": F.hour(ts), "day_of_week": rules.day_of_week(ts)}


def fault_features(enhanced: DataFrame) -> DataFrame:
    """Labelled faults as flat feature columns plus a `features` struct."""
    keys = ["fault_code", "network_type", "equipment_type", "location", "customers_affected"]
    flat = enhanced.filter(F.col("fault_category").isNotNull()).select(
        "fault_id", *keys, "service_calls_generated",
        *[v.alias(k) for k, v in _feature_columns().items()],
        "business_hours_fault", F.col("fault_category").alias("actual_category"),
    )
    features = F.struct(
        *keys,
        F.col("service_calls_generated").alias("service_calls"),
        "hour_of_day",
        "day_of_week",
        F.col("business_hours_fault").alias("business_hours"),
    )
    return flat.withColumn("features", features)


def training_features(faults: DataFrame) -> DataFrame:
    """(fault_id, features, label) with the training preset: Tuesday to Saturday."""
    features = F.struct(
        "network_type", "equipment_type", "location", "fault_code", "customers_affected",
        "service_calls_generated",
        *[v.alias(k) for k, v in _feature_columns().items()],
        rules.business_hours("fault_timestamp", 2, 6, keep_null=True).alias("business_hours"),
    )
    return faults.filter(F.col("fault_category").isNotNull()).select(
        "fault_id", features.alias("features"), F.col("fault_category").alias("label")
    )


def split_train_test(df: DataFrame, key: str = "fault_id") -> tuple[DataFrame, DataFrame]:
    """Disjoint 80/20 split by a stable hash of the key."""
    bucket = rules.hash_bucket(key)
    return df.filter(bucket < 8), df.filter(bucket >= 8)


def fault_analysis(enhanced: DataFrame, as_of) -> DataFrame:
    """Prediction, score and recommendation next to the original values.

    The recommendation follows the actual category and the original score.
    """
    score = rules.priority_score(
        "fault_category", "customers_affected", "service_calls_generated",
        "business_hours_fault", "equipment_type",
    )
    return enhanced.select(
        "fault_id", "fault_timestamp", "fault_code", "fault_description",
        F.col("fault_category").alias("actual_category"),
        rules.classify_fault("fault_code", "customers_affected", "service_calls_generated")
        .alias("predicted_category"),
        score.alias("calculated_priority_score"),
        rules.recommend_technician("fault_category", "priority_score")
        .alias("technician_recommendation"),
        "network_type", "equipment_type", "location", "severity", "customers_affected",
        "service_calls_generated", F.col("priority_score").alias("original_priority_score"),
        "technician_type_required", "estimated_revenue_impact", "is_resolved", "first_time_fix",
        "resolution_time_hours",
        rules.hours_since("fault_timestamp", rules.moment(as_of)).alias("hours_since_fault"),
        "business_hours_fault",
    )


def fault_triage(analysis: DataFrame) -> DataFrame:
    """Open faults with risk and SLA by predicted category. Unordered; see triage_order."""
    return active(analysis).select(
        "fault_id", "fault_timestamp", "fault_code", "fault_description", "predicted_category",
        "calculated_priority_score",
        F.col("technician_recommendation.technician_type").alias("recommended_technician_type"),
        F.col("technician_recommendation.estimated_duration_hours").alias("estimated_duration"),
        "network_type", "equipment_type", "location", "customers_affected",
        "estimated_revenue_impact", "hours_since_fault",
        rules.risk_level("calculated_priority_score").alias("risk_level"),
        rules.sla_breach("predicted_category", "hours_since_fault").alias("sla_breach_risk"),
    )


def triage_order() -> list[Column]:
    """Sort keys of the triage queue: a NULL score comes first."""
    return [F.desc_nulls_first("calculated_priority_score"), F.desc("hours_since_fault")]


# --- dashboard frame --------------------------------------------------------

def _dashboard(enhanced: DataFrame, predicted: Column, scored: Column, as_of, sla: str) -> DataFrame:
    hours = rules.hours_since("fault_timestamp", rules.moment(as_of), "fraction")
    late = {
        "category": lambda: rules.sla_breach("fault_category", "hours_since_fault"),
        "score": lambda: rules.sla_breach_by_score("calculated_priority_score", "hours_since_fault"),
    }[sla]
    return (
        enhanced.withColumns({
            "predicted_category": F.coalesce(predicted, "fault_category"),
            "calculated_priority_score": F.coalesce(scored, "priority_score"),
            "hours_since_fault": hours,
            "created_date": F.to_date("fault_timestamp"),
        })
        .withColumns({
            "risk_level": rules.risk_level("calculated_priority_score"),
            "sla_breach_risk": late(),
        })
    )


def with_predictions(enhanced: DataFrame, as_of, sla: str = "category") -> DataFrame:
    """The frame behind both apps: predictions for open faults, original values otherwise.

    Prediction is a projection of the same row, so no join is planned; `join_predictions` is the
    joining form for a triage table that was stored elsewhere. sla: category or score preset.
    """
    open_only = lambda c: F.when(~F.col("is_resolved"), c)
    score = rules.priority_score(
        "fault_category", "customers_affected", "service_calls_generated",
        "business_hours_fault", "equipment_type",
    )
    kind = rules.classify_fault("fault_code", "customers_affected", "service_calls_generated")
    return _dashboard(enhanced, open_only(kind), open_only(score), as_of, sla)


def join_predictions(enhanced: DataFrame, triage: DataFrame, as_of, sla: str = "category") -> DataFrame:
    """Left join of a stored triage table on fault_id, then the fallbacks."""
    hits = triage.select(
        "fault_id",
        F.col("predicted_category").alias("_predicted"),
        F.col("calculated_priority_score").alias("_scored"),
    )
    joined = enhanced.join(hits, "fault_id", "left")
    return _dashboard(joined, F.col("_predicted"), F.col("_scored"), as_of, sla).drop(
        "_predicted", "_scored"
    )


# --- filters ----------------------------------------------------------------

def active(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_resolved"))


def resolved(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_resolved"))


def dashboard_slice(
    df: DataFrame, start=None, end=None, location="All", category="All", risk="All"
) -> DataFrame:
    """Closed date range plus equality filters; 'All' (or None) leaves a filter out.

    Dates become bounds on fault_timestamp itself, so they reach the parquet scan.
    """
    ts = F.col("fault_timestamp")
    if start is not None:
        df = df.filter(ts >= F.lit(str(start)).cast("date").cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(ts < F.date_add(F.lit(str(end)).cast("date"), 1).cast("timestamp_ntz"))
    for column, value in (("location", location), ("fault_category", category), ("risk_level", risk)):
        if value not in (None, "All"):
            df = df.filter(F.col(column) == value)
    return df


# --- top-k and display ------------------------------------------------------

def critical_alerts(df: DataFrame, n: int = 5) -> DataFrame:
    """The n open faults that are CRITICAL or at SLA risk, by score."""
    critical = F.col("risk_level") == "CRITICAL"
    return (
        active(df).filter(critical | F.col("sla_breach_risk"))
        .orderBy(F.desc("calculated_priority_score"), "fault_id").limit(n)
        .select(
            "fault_id", "fault_description", "location", "equipment_type",
            "calculated_priority_score", "customers_affected", "estimated_revenue_impact",
            "technician_type_required",
            F.when(critical, "critical-alert").otherwise("high-priority").alias("alert_type"),
        )
    )


def priority_timeline(df: DataFrame, n: int = 20) -> DataFrame:
    """The n open faults with the highest score, as plot points."""
    return (
        active(df).orderBy(F.desc("calculated_priority_score"), "fault_id").limit(n)
        .select(
            "fault_id", "hours_since_fault", "calculated_priority_score", "risk_level",
            (F.col("customers_affected") / 50).alias("marker_size"),
            F.concat("fault_id", F.lit("<br>"), "fault_description").alias("label"),
        )
    )


def assigned_faults(df: DataFrame, n: int = 10) -> DataFrame:
    """The n oldest open faults, with an urgency flag."""
    return (
        active(df).orderBy("fault_timestamp", "fault_id").limit(n)
        .select(
            "fault_id", "fault_description", "fault_code", "equipment_type", "location",
            "calculated_priority_score", "customers_affected",
            F.coalesce(F.col("fault_category") == "Cable Fault", F.lit(False)).alias("is_urgent"),
        )
    )


def triage_display(df: DataFrame) -> DataFrame:
    """The 12 columns of the triage table, formatted. Unordered: order by score at the sink."""
    return active(df).select(
        "fault_id",
        F.date_format("fault_timestamp", "yyyy-MM-dd HH:mm").alias("fault_timestamp"),
        "fault_code", "fault_description", "predicted_category", "location", "equipment_type",
        "customers_affected",
        F.bround("calculated_priority_score", 3).alias("calculated_priority_score"),
        "risk_level", "technician_type_required",
        F.bround("hours_since_fault", 1).alias("hours_since_fault"),
    )


def triage_highlight(risk: Column | str) -> Column:
    """Row class of the triage table."""
    risk = rules.col(risk)
    return first_match([(risk == "CRITICAL", "critical"), (risk == "HIGH", "high")], "")
