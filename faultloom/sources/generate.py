"""Synthetic faults and the literal seed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..schemas import FAULT_COLUMNS, FAULTS, SOP_METADATA

SPAN_DAYS = 90


def generate_faults(ids: DataFrame, seed: int, end_ts: str) -> DataFrame:
    """One synthetic fault per row of `ids` (column id), over the 90 days before end_ts.

    Every value is a hash of seed, column and id: any number of executors gives the same rows.
    Pass spark.range(n) or the keys of a table. A fault that would be resolved after end_ts is open.
    """
    draw = lambda salt: rules.uniform(seed * 100 + salt, "id")
    share = F.col("_share")
    bounds, total = [], 0
    for name, spec in fixed.CATEGORIES.items():
        total += spec["share"]
        bounds.append((share < total / 100, name))
    category = rules.first_match(bounds[:-1], bounds[-1][1])
    is_ = lambda name: F.col("fault_category") == name
    per = lambda pick: rules.first_match(
        [(is_(n), pick(s)) for n, s in list(fixed.CATEGORIES.items())[:-1]],
        pick(list(fixed.CATEGORIES.values())[-1]),
    )
    choose = lambda values, salt: F.get(rules.strings(values), F.floor(draw(salt) * len(values)).cast("int"))
    between = lambda key, salt: per(lambda s: draw(salt) * (s[key][1] - s[key][0]) + s[key][0])
    whole = lambda key, salt: per(
        lambda s: (F.floor(draw(salt) * (s[key][1] - s[key][0] + 1)) + s[key][0]).cast("int")
    )
    end = rules.moment(end_ts)
    later = lambda start, seconds: F.timestamp_add("SECOND", seconds, start).cast("timestamp_ntz")
    span = SPAN_DAYS * 86400
    lucky = (draw(7) < per(lambda s: F.lit(s["fix_chance"] / 100))) & (draw(8) < 0.5)
    return (
        ids.select(F.col("id").cast("long").alias("id"))
        .withColumn("_share", draw(0))
        .withColumn("fault_category", category)
        .withColumn("network_type", F.when(draw(1) < 0.5, "COAX").otherwise("FIBER"))
        .withColumns({
            "fault_id": F.format_string("F%06d", F.col("id") + 1),
            "fault_timestamp": later(end, (F.floor(draw(2) * span) - span).cast("int")),
            "_hours": between("hours", 3),
            "fault_code": per(lambda s: choose(s["codes"], 4)),
            "fault_description": per(lambda s: choose(s["descriptions"], 5)),
            "equipment_type": F.when(
                F.col("network_type") == "COAX", choose(fixed.EQUIPMENT["COAX"], 6)
            ).otherwise(choose(fixed.EQUIPMENT["FIBER"], 6)),
            "location": choose(fixed.LOCATIONS, 9),
            "severity": per(lambda s: F.lit(s["severity"])),
            "customer_impact": per(lambda s: F.lit(s["customer_impact"])),
            "customers_affected": whole("customers", 10),
            "service_calls_generated": whole("calls", 11),
            "first_time_fix": lucky,
            "technician_type_required": F.when(is_("Cable Fault"), "Specialist").otherwise("General"),
            "priority_score": between("priority", 12),
        })
        .withColumn("_done", later(F.col("fault_timestamp"), F.floor(F.col("_hours") * 3600).cast("int")))
        .withColumns({
            "resolution_timestamp": F.when(F.col("_done") <= end, F.col("_done")),
            "resolution_time_hours": F.round("_hours", 2),
            "estimated_revenue_impact": F.col("customers_affected") * (draw(13) * 90 + 10),
        })
        .select(*FAULT_COLUMNS)
    )


# fixed values: the five sample faults
_SEED_FAULTS = (
    ("F001", "2024-01-15 08:30:00", "812.3", "Cable signal degradation in residential area", "Cable Fault", "HFC", "Cisco cBR-8", "Copenhagen North", "High", "Service Degradation", 150, 12, "2024-01-15 12:45:00", 4.25, True, "Senior Technician", 25000.0, 0.85),
    ("F002", "2024-01-15 14:20:00", "813.1", "Amplifier failure causing signal loss", "Major", "HFC", "Arris E6000", "Aarhus Central", "Critical", "Service Outage", 300, 45, None, None, False, "Expert Technician", 75000.0, 0.95),
    ("F003", "2024-01-15 16:45:00", "814.2", "Minor interference on upstream channel", "Minor", "DOCSIS", "Casa C100G", "Odense West", "Low", "Performance Issue", 25, 3, "2024-01-15 17:30:00", 0.75, True, "Junior Technician", 2500.0, 0.35),
    ("F004", "2024-01-16 09:15:00", "815.5", "Fiber cut affecting business district", "Cable Fault", "Fiber", "Nokia 7750", "Copenhagen Business", "Critical", "Service Outage", 500, 85, None, None, False, "Expert Technician", 150000.0, 0.98),
    ("F005", "2024-01-16 11:30:00", "816.1", "CMTS overload during peak hours", "Major", "DOCSIS", "Cisco cBR-8", "Aalborg North", "High", "Service Degradation", 200, 25, "2024-01-16 15:20:00", 3.83, False, "Senior Technician", 40000.0, 0.78),
)


def seed_faults(spark: SparkSession) -> DataFrame:
    """The five sample faults; two are open."""
    times = {"fault_timestamp", "resolution_timestamp"}
    raw = spark.createDataFrame(
        list(_SEED_FAULTS),
        ", ".join(
            f"{f.name} {'string' if f.name in times else f.dataType.simpleString()}" for f in FAULTS.fields
        ),
    )
    return raw.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def sop_catalog(spark: SparkSession) -> DataFrame:
    """Metadata of the five procedure documents."""
    rows = []
    for i, title in enumerate(fixed.SOP_TITLES):
        number = f"SOP-{i + 1:03d}"
        rows.append((
            number, f"{number}_{title.replace(' ', '_')}.pdf", title, fixed.SOP_CATEGORIES[i],
            list(fixed.SOP_EQUIPMENT[i]), list(fixed.SOP_CODES[i]), fixed.SOP_PAGES[i], fixed.SOP_WORDS[i],
        ))
    names = ("document_id", "file_path", "title", "category", "equipment_types", "fault_codes",
             "page_count", "word_count")
    schema = ", ".join(f"{n} {SOP_METADATA[n].dataType.simpleString()}" for n in names)
    return spark.createDataFrame(rows, schema)
