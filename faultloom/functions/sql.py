"""SQL surface: scalar and table functions and views for users who write SQL.

Function bodies are SQL expressions, which Spark inlines into the calling plan; none is a Python
UDF. Rule values come from `fixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixed

FAULTS, FILES = "network_faults", "sop_pdf_files"
METADATA, CHUNKS = "sop_document_metadata", "sop_document_chunks"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _texts(values) -> str:
    return "array(" + ", ".join(_text(v) for v in values) + ")"


def _case(branches, default: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {default} end"


def _classifier() -> str:
    branches = []
    for name, prefixes, customers, calls in fixed.CLASSIFIER:
        tests = [f"startswith(fault_code, '{p}')" for p in prefixes]
        tests += [f"customers_affected > {customers}", f"service_calls > {calls}"]
        branches.append((" or ".join(tests), _text(name)))
    return _case(branches, _text(fixed.CLASSIFIER_DEFAULT))


def _score() -> str:
    part = lambda c, weight, top: (
        f"if({c} is null, null, least(cast({c} as decimal(18, 6)) * {weight}, {top}))"
    )
    base = _case(
        [(f"fault_category = {_text(n)}", v) for n, v in fixed.BASE_SCORE.items()],
        fixed.BASE_SCORE_DEFAULT,
    )
    vendor = _case([(f"contains(equipment_type, '{n}')", v) for n, v in fixed.VENDOR_BOOST], "0.00")
    parts = [
        base,
        part("customers_affected", fixed.CUSTOMER_WEIGHT, fixed.CUSTOMER_LIMIT),
        part("service_calls", fixed.CALL_WEIGHT, fixed.CALL_LIMIT),
        f"if(business_hours, {fixed.BUSINESS_BOOST}, 0.0)",
        vendor,
    ]
    return "cast(" + " + ".join(f"({p})" for p in parts) + " as double)"


def _dispatch(pick) -> str:
    return _case(
        [(f"fault_category = {_text(n)}", pick(s)) for n, s in fixed.DISPATCH.items()],
        pick(fixed.DISPATCH_DEFAULT),
    )


def _technician() -> str:
    kind = _case(
        [
            ("fault_category = 'Cable Fault'", _text(fixed.TECHNICIAN_SPECIALIST)),
            (f"priority_score > {fixed.SENIOR_SCORE}", _text(fixed.TECHNICIAN_SENIOR)),
        ],
        _text(fixed.TECHNICIAN_GENERAL),
    )
    return (
        f"named_struct('technician_type', {kind},"
        f" 'skill_requirements', {_dispatch(lambda s: _texts(s['skills']))},"
        f" 'estimated_duration_hours', {_dispatch(lambda s: f'{s['hours']}D')},"
        f" 'tools_required', {_dispatch(lambda s: _texts(s['tools']))})"
    )


def _template(template: str, **values: str) -> str:
    out = _text(template)
    for name, expr in values.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return out


def _keyword(rules, default: str) -> str:
    return _case([(f"contains(upper(piece), '{w}')", _text(n)) for w, n in rules], _text(default))


def _hit(column: str, query: str) -> str:
    return f"upper({column}) like '%' || replace(upper({query}), '\\\\', '\\\\\\\\') || '%'"


def _relevance(query: str) -> str:
    return "cast(" + _case(
        [
            (_hit("c.chunk_text", query), fixed.SCORE_TEXT),
            (_hit("c.chunk_text", f"split_part({query}, ' ', 1)"), fixed.SCORE_FIRST_WORD),
            (_hit("c.section_name", query), fixed.SCORE_SECTION),
            (_hit("m.title", query), fixed.SCORE_TITLE),
        ],
        "null",
    ) + " as double)"


def scalar_functions() -> dict[str, str]:
    """Name -> everything after CREATE OR REPLACE TEMPORARY FUNCTION name."""
    return {
        "classify_fault": (
            "(fault_code string, network_type string, equipment_type string, location string,"
            " customers_affected int, service_calls int, hour_of_day int, day_of_week int,"
            f" business_hours boolean) returns string return {_classifier()}"
        ),
        "calculate_priority_score": (
            "(fault_category string, customers_affected int, service_calls int,"
            f" business_hours boolean, equipment_type string) returns double return {_score()}"
        ),
        "recommend_technician": (
            "(fault_category string, equipment_type string, location string, priority_score double)"
            " returns struct<technician_type: string, skill_requirements: array<string>,"
            " estimated_duration_hours: double, tools_required: array<string>>"
            f" return {_technician()}"
        ),
        "generate_repair_procedure": (
            "(fault_description string, equipment_type string, fault_code string default null)"
            " returns struct<procedure_generated: boolean, procedure_text: string, search_query: string>"
            " return named_struct('procedure_generated', true, 'procedure_text', "
            + _template(fixed.REPAIR_TEMPLATE, code="coalesce(fault_code, 'N/A')",
                        equipment="equipment_type", fault="fault_description")
            + ", 'search_query', fault_description || ' ' || equipment_type"
            " || coalesce(' ' || fault_code, ''))"
        ),
        "ask_technical_question": (
            "(question string, equipment_type string default null, fault_code string default null,"
            " max_chunks int default 5) returns struct<answer_found: boolean, query: string,"
            " chunks_used: int, equipment_type: string, fault_code: string>"
            " return named_struct('answer_found', true, 'query', question || ' '"
            " || coalesce(equipment_type, '') || ' ' || coalesce(fault_code, ''),"
            " 'chunks_used', max_chunks, 'equipment_type', equipment_type, 'fault_code', fault_code)"
        ),
    }


def table_functions() -> dict[str, str]:
    """Table functions; all but the chunker read the chunk and metadata tables by name."""
    joined = f"from {CHUNKS} c join {METADATA} m on c.document_id = m.document_id"
    kept = "m.is_active and c.is_meaningful"
    return {
        "create_meaningful_chunks": (
            "(full_text string, document_id string, file_path string) returns table"
            " (chunk_sequence int, chunk_text string, chunk_type string, section_name string,"
            " char_start int, char_end int) return select pos + 1, piece,"
            f" {_keyword(fixed.CHUNK_TYPES, fixed.CHUNK_TYPE_DEFAULT)},"
            f" {_keyword(fixed.SECTION_NAMES, fixed.SECTION_DEFAULT)},"
            f" pos * {fixed.CHUNK_SIZE} + 1, pos * {fixed.CHUNK_SIZE} + length(piece)"
            # no WHERE: a body that only projects and unfolds is inlined into the calling plan; with a filter
            # Spark joins the pieces back to their texts by the texts themselves
            " from inline(filter(transform(regexp_extract_all(full_text,"
            f" '(?s).{{1,{fixed.CHUNK_SIZE}}}', 0), (x, i) -> named_struct('pos', i, 'piece', x)),"
            f" x -> length(trim(x.piece)) > {fixed.CHUNK_MIN_LENGTH})) as p(pos, piece)"
        ),
        "get_contextual_chunks": (
            "(target_chunk_id string, context_window int default 2) returns table (chunk_id string,"
            " document_id string, chunk_sequence int, chunk_text string, chunk_type string,"
            " is_target_chunk boolean, distance_from_target int) return"
            " select c.chunk_id, c.document_id, c.chunk_sequence, c.chunk_text, c.chunk_type,"
            " c.chunk_id = t.chunk_id, abs(c.chunk_sequence - t.chunk_sequence)"
            f" from {CHUNKS} c join (select chunk_id, document_id, chunk_sequence from {CHUNKS}"
            " where chunk_id = get_contextual_chunks.target_chunk_id) t"
            " on c.document_id = t.document_id and c.chunk_sequence between"
            " t.chunk_sequence - get_contextual_chunks.context_window and"
            " t.chunk_sequence + get_contextual_chunks.context_window"
        ),
        "search_sop_chunks": (
            "(query_text string, only_type string default null, only_category string default null,"
            " only_equipment string default null, result_limit int default 10) returns table"
            " (chunk_id string, document_id string, document_title string, category string,"
            " chunk_text string, chunk_type string, section_name string, page_number int,"
            " chunk_sequence int, relevance_score double, equipment_match boolean) return"
            " select chunk_id, document_id, title, category, chunk_text, chunk_type, section_name,"
            " page_number, chunk_sequence, relevance_score, true from (select *, row_number() over"
            " (order by relevance_score desc, document_id, chunk_sequence) as place from"
            " (select c.*, m.title, m.category,"
            f" {_relevance('query_text')} as relevance_score {joined} where {kept}"
            f" and length(trim(c.chunk_text)) > {fixed.SEARCH_MIN_LENGTH}"
            " and (only_type is null or c.chunk_type = only_type)"
            " and (only_category is null or m.category = only_category)"
            " and (only_equipment is null or coalesce(array_contains(m.equipment_types,"
            " only_equipment), false))) where relevance_score is not null) where place <= result_limit"
        ),
        "find_similar_faults": (
            "(description string, similarity_threshold double default 0.3, result_limit int default 5)"
            " returns table (document_id string, document_title string, category string,"
            " similar_chunk_text string, chunk_type string, relevance_score double,"
            " equipment_types array<string>, fault_codes array<string>) return"
            " select document_id, title, category, chunk_text, chunk_type, relevance_score,"
            " equipment_types, fault_codes from (select *, row_number() over"
            " (order by relevance_score desc, document_id, chunk_text) as place from"
            " (select distinct c.document_id, m.title, m.category, c.chunk_text, c.chunk_type,"
            f" {_relevance('description')} as relevance_score, m.equipment_types, m.fault_codes"
            f" {joined} where {kept}) where relevance_score >= similarity_threshold)"
            " where place <= result_limit"
        ),
    }


def register_functions(spark: SparkSession, tables: bool = True) -> None:
    """Create the temporary SQL functions. With tables=True, the chunk and metadata tables (or
    temporary views) must exist under their names."""
    for name, body in scalar_functions().items():
        spark.sql(f"create or replace temporary function {name}{body}")
    if tables:
        for name, body in table_functions().items():
            spark.sql(f"create or replace temporary function {name}{body}")


def create_views(
    spark: SparkSession,
    as_of,
    faults: DataFrame | None = None,
    chunks: DataFrame | None = None,
    metadata: DataFrame | None = None,
    files: DataFrame | None = None,
) -> None:
    """Temporary views over the given tables, and the derived views stacked on them."""
    from ..operators import chunks as ch
    from ..operators import faults as fl
    from ..operators import metrics

    views: dict[str, DataFrame] = {}
    if faults is not None:
        enhanced = fl.enhance(faults, as_of)
        analysis = fl.fault_analysis(enhanced, as_of)
        features = fl.fault_features(enhanced)
        train, test = fl.split_train_test(features)
        views |= {
            FAULTS: faults, "vw_network_faults_enhanced": enhanced, "vw_fault_features": features,
            "vw_training_data": train, "vw_test_data": test, "vw_fault_analysis": analysis,
            "vw_fault_triage": fl.fault_triage(analysis),
            "vw_model_accuracy": metrics.model_confusion(analysis),
        }
    named = {CHUNKS: chunks, METADATA: metadata, FILES: files}
    views |= {name: df for name, df in named.items() if df is not None}
    if all(df is not None for df in named.values()):
        views["vw_searchable_chunks"] = ch.searchable_chunks(chunks, metadata, files)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
