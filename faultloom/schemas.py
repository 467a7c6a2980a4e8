"""Table schemas."""

from pyspark.sql import types as T

_ntz = T.TimestampNTZType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_str, _int, _long, _dbl, _bool = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)
_strs = T.ArrayType(T.StringType())

FAULTS = _schema(
    fault_id=_str, fault_timestamp=_ntz, fault_code=_str, fault_description=_str,
    fault_category=_str, network_type=_str, equipment_type=_str, location=_str, severity=_str,
    customer_impact=_str, customers_affected=_int, service_calls_generated=_int,
    resolution_timestamp=_ntz, resolution_time_hours=_dbl, first_time_fix=_bool,
    technician_type_required=_str, estimated_revenue_impact=_dbl, priority_score=_dbl,
)
FAULT_COLUMNS = FAULTS.fieldNames()

SOP_FILES = _schema(
    file_path=_str, file_url=_str, file_size=_long, last_modified=_ntz, etag=_str, md5=_str,
    file_status=_str, created_timestamp=_ntz, updated_timestamp=_ntz,
)

SOP_METADATA = _schema(
    document_id=_str, file_path=_str, title=_str, category=_str, equipment_types=_strs,
    fault_codes=_strs, document_version=_str, author=_str, creation_date=T.DateType(),
    last_reviewed=T.DateType(), page_count=_int, word_count=_int, is_active=_bool,
    created_timestamp=_ntz, updated_timestamp=_ntz,
)

SOP_CHUNKS = _schema(
    chunk_id=_str, document_id=_str, file_path=_str, chunk_sequence=_int, chunk_text=_str,
    chunk_type=_str, section_name=_str, page_number=_int, char_start_position=_int,
    char_end_position=_int, is_meaningful=_bool, created_timestamp=_ntz,
)

SOP_DOCUMENTS = _schema(
    document_id=_str, title=_str, category=_str, equipment_types=_strs, fault_codes=_strs,
    content=_str,
)

DASHBOARD_COLUMNS = [
    "fault_id", "fault_timestamp", "fault_category", "fault_code", "equipment_type", "location",
    "customers_affected", "service_calls", "technician_type_required", "resolution_timestamp",
    "priority_score", "is_resolved", "hours_since_fault", "created_date", "resolution_date",
    "business_hours_fault", "predicted_category", "calculated_priority_score", "risk_level",
    "sla_breach_risk",
]
EMPTY_DASHBOARD = _schema(**{
    "fault_id": _str, "fault_timestamp": _ntz, "fault_category": _str, "fault_code": _str,
    "equipment_type": _str, "location": _str, "customers_affected": _int, "service_calls": _int,
    "technician_type_required": _str, "resolution_timestamp": _ntz, "priority_score": _dbl,
    "is_resolved": _bool, "hours_since_fault": _dbl, "created_date": T.DateType(),
    "resolution_date": T.DateType(), "business_hours_fault": _bool, "predicted_category": _str,
    "calculated_priority_score": _dbl, "risk_level": _str, "sla_breach_risk": _bool,
})
