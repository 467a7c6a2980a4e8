"""KPIs kept by signed deltas: a corrected fault counts as minus its old row and plus its new one.

The state is one row of sums that add up, so a batch of changes needs the rows it replaces and nothing else
of the fault table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LIVE = "not is_resolved"
#: name -> what one dashboard row adds to it
SUMS: dict[str, str] = {
    "active_faults": f"if({_LIVE}, 1, 0)",
    "last_24h": "if(hours_since_fault < 24, 1, 0)",
    "critical_faults": f"if({_LIVE} and risk_level = 'CRITICAL', 1, 0)",
    "sla_risk": "if(sla_breach_risk, 1, 0)",
    "judged": "if(is_resolved and first_time_fix is not null, 1, 0)",
    "first_time_fixes": "if(is_resolved and first_time_fix, 1, 0)",
    "customers_affected": f"if({_LIVE}, coalesce(customers_affected, 0), 0)",
    # whole cents: sums of doubles depend on their order and would not cancel out
    "revenue_cents": f"if({_LIVE}, cast(round(coalesce(estimated_revenue_impact, 0) * 100) as bigint), 0)",
}


def kpi_sums(df: DataFrame, sign: int = 1) -> DataFrame:
    """One row: the sums of dashboard rows (hours, risk and SLA columns present), times sign."""
    total = lambda e: F.coalesce(F.sum(F.expr(e).cast("long")), F.lit(0)) * sign
    return df.agg(*[total(e).alias(name) for name, e in SUMS.items()])


def apply_changes(state: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The state after rows `old` were replaced by rows `new`."""
    moved = state.unionByName(kpi_sums(old, -1)).unionByName(kpi_sums(new))
    return moved.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS])


def kpi_view(state: DataFrame, *keys: str) -> DataFrame:
    """The columns of metrics.kpis from states, with the keys they are told apart by."""
    return state.select(
        *keys, "active_faults", "last_24h", "critical_faults", "sla_risk",
        (F.try_divide("first_time_fixes", "judged") * 100).alias("first_time_fix_pct"),
        "customers_affected", (F.col("revenue_cents") / 100).cast("double").alias("revenue_at_risk"),
    )
