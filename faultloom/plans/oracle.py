"""DuckDB SQL for each registered query, used only to check results.

Written apart from the operators: plain joins, nested loops and windows over whole tables. Lists
and thresholds come from the fixed values; the logic does not.
"""

from __future__ import annotations

from ..functions import fixed

NOW = "timestamp '2024-01-31 00:00:00'"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(listed(v) if isinstance(v, tuple) else quoted(v) for v in values) + "]"


def blank_chars() -> str:
    return "||".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)


def text_template(template: str, **values: str) -> str:
    out = quoted(template).replace("\n", "'||chr(10)||'")
    for name, sql in values.items():
        out = out.replace("{" + name + "}", f"'||{sql}||'")
    return out


C = fixed.CATEGORIES
_codes = [listed(C[n]["codes"]) for n in C]
_desc = [listed(C[n]["descriptions"]) for n in C]
_all_codes = listed(tuple(c for n in C for c in C[n]["codes"]))


def tier(a: str, b: str, c: str) -> str:
    return f"(case when b < 6 then {a} when b < 9 then {b} else {c} end)"


def risk(score: str) -> str:
    bands = " ".join(f"when {score} > {low} then '{name}'" for low, name in fixed.RISK_BANDS)
    return f"case {bands} else '{fixed.RISK_DEFAULT}' end"


def breach(category: str, hours: str) -> str:
    tests = " or ".join(f"({category} = '{n}' and {hours} > {h})" for n, h in fixed.SLA_HOURS.items())
    return f"coalesce({tests}, false)"


def breach_by_score(score: str, hours: str) -> str:
    return f"coalesce({score} > {fixed.SLA_SCORE} and {hours} > {fixed.SLA_SCORE_HOURS}, false)"


def predicted(p: str = "") -> str:
    branches = []
    for name, prefixes, customers, calls in fixed.CLASSIFIER:
        tests = [f"starts_with({p}fault_code, '{x}')" for x in prefixes]
        tests += [f"{p}customers_affected > {customers}", f"{p}service_calls_generated > {calls}"]
        branches.append(f"when {' or '.join(tests)} then '{name}'")
    return f"case {' '.join(branches)} else '{fixed.CLASSIFIER_DEFAULT}' end"


def score() -> str:
    base = " ".join(f"when '{n}' then {v}" for n, v in fixed.BASE_SCORE.items())
    part = lambda c, w, top: (
        f"case when {c} is not null then least(cast({c} as decimal(18,6)) * {w}, {top}) end"
    )
    vendor = " ".join(f"when contains(equipment_type, '{n}') then {v}" for n, v in fixed.VENDOR_BOOST)
    return (
        f"cast((case fault_category {base} else {fixed.BASE_SCORE_DEFAULT} end)"
        f" + ({part('customers_affected', fixed.CUSTOMER_WEIGHT, fixed.CUSTOMER_LIMIT)})"
        f" + ({part('service_calls_generated', fixed.CALL_WEIGHT, fixed.CALL_LIMIT)})"
        f" + (case when business_hours_fault then {fixed.BUSINESS_BOOST} else 0.0 end)"
        f" + (case {vendor} else 0.00 end) as double)"
    )


def dispatch(pick) -> str:
    branches = " ".join(f"when '{n}' then {pick(s)}" for n, s in fixed.DISPATCH.items())
    return f"case fault_category {branches} else {pick(fixed.DISPATCH_DEFAULT)} end"


def keyword(expr: str, rules, default: str) -> str:
    tests = " ".join(f"when contains(upper({expr}), '{w}') then '{n}'" for w, n in rules)
    return f"case {tests} else '{default}' end"


def business(ts: str, lo: int, hi: int) -> str:
    return f"(hour({ts}) between 8 and 17 and dayofweek({ts}) between {lo} and {hi})"


def round_all(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


FAULT_COLUMNS = """fault_id, fault_timestamp, fault_code, fault_description, fault_category,
 network_type, equipment_type, location, severity, customer_impact, customers_affected,
 service_calls_generated, resolution_timestamp, resolution_time_hours, first_time_fix,
 technician_type_required, estimated_revenue_impact, priority_score"""

CTE: dict[str, tuple[tuple[str, ...], str]] = {}

CTE["numbered"] = ((), """
 select *, event_id as e, event_id % 10 as b,
  case when event_id % 10 < 6 then 1800 + (event_id * 15485863) % 12601
       when event_id % 10 < 9 then 7200 + (event_id * 15485863) % 36001
       else 28800 + (event_id * 15485863) % 144001 end as seconds,
  case when event_id % 97 <> 0 then case
       when event_id % 10 < 6 then 1 + event_id * 7919 % 50
       when event_id % 10 < 9 then 50 + event_id * 7919 % 451
       else 500 + event_id * 7919 % 4501 end end as customers
 from events""")

CTE["faults"] = (("numbered",), f"""
 select 'F' || lpad(cast(e as varchar), 9, '0') as fault_id, ts as fault_timestamp,
  {tier(*[f"({c})[cast((e // 10) % 5 as int) + 1]" for c in _codes])} as fault_code,
  {tier(*[f"({d})[cast((e // 50) % 5 as int) + 1]" for d in _desc])} as fault_description,
  case when e % 101 <> 0 then {tier(*[quoted(n) for n in C])} end as fault_category,
  case when user_id % 2 = 0 then 'COAX' else 'FIBER' end as network_type,
  case when user_id % 2 = 0 then ({listed(fixed.EQUIPMENT["COAX"])})[cast((user_id // 2) % 4 as int) + 1]
       else ({listed(fixed.EQUIPMENT["FIBER"])})[cast((user_id // 2) % 4 as int) + 1] end as equipment_type,
  ({listed(fixed.LOCATIONS)})[cast((user_id // 8) % 10 as int) + 1] as location,
  {tier(*[quoted(C[n]["severity"]) for n in C])} as severity,
  {tier(*[quoted(C[n]["customer_impact"]) for n in C])} as customer_impact,
  cast(customers as int) as customers_affected,
  cast({tier("e * 104729 % 6", "5 + e * 104729 % 46", "50 + e * 104729 % 451")} as int)
   as service_calls_generated,
  case when event_type = 'error' or ts + to_seconds(seconds) > {NOW} then null
       else ts + to_seconds(seconds) end as resolution_timestamp,
  cast(seconds as double) / 3600 as resolution_time_hours,
  (e * 32452843 % 100) < {tier("42", "35", "20")} as first_time_fix,
  case when b < 9 then 'General' else 'Specialist' end as technician_type_required,
  cast(customers as double) * (10 + e % 91) as estimated_revenue_impact,
  cast({tier("10 + e * 49979687 % 91", "40 + e * 49979687 % 41", "70 + e * 49979687 % 31")} as double)
   / 100 as priority_score
 from numbered""")

CTE["enhanced"] = (("faults",), f"""
 select *, {risk("priority_score")} as risk_level, {breach("fault_category", "hours_since_fault")}
  as sla_breach_risk
 from (
  select {FAULT_COLUMNS}, resolution_timestamp is not null as is_resolved,
   coalesce({business("fault_timestamp", 1, 5)}, false) as business_hours_fault,
   cast(date_diff('hour', fault_timestamp, coalesce(resolution_timestamp, {NOW})) as int)
    as hours_since_fault,
   cast(fault_timestamp as date) as fault_date, cast(resolution_timestamp as date) as resolution_date
  from faults)""")

CTE["analysis"] = (("enhanced",), f"""
 select *, {predicted()} as predicted_category, {score()} as calculated_priority_score,
  cast(date_diff('hour', fault_timestamp, {NOW}) as int) as hours_to_now,
  date_diff('microsecond', fault_timestamp, {NOW}) / 3.6e9 as hours_exact,
  case when fault_category = 'Cable Fault' then 'Specialist'
       when priority_score > {fixed.SENIOR_SCORE} then 'Senior' else 'General' end as technician_type,
  {dispatch(lambda s: quoted("|".join(s["skills"])))} as skill_requirements,
  {dispatch(lambda s: f"cast({s['hours']} as double)")} as estimated_duration_hours,
  {dispatch(lambda s: quoted("|".join(s["tools"])))} as tools_required
 from enhanced""")

CTE["triage"] = (("analysis",), f"""
 select fault_id, fault_timestamp, fault_code, fault_description, predicted_category,
  calculated_priority_score, technician_type as recommended_technician_type,
  estimated_duration_hours as estimated_duration, network_type, equipment_type, location,
  customers_affected, estimated_revenue_impact, hours_to_now as hours_since_fault,
  {risk("calculated_priority_score")} as risk_level,
  {breach("predicted_category", "hours_to_now")} as sla_breach_risk
 from analysis where not is_resolved""")

CTE["merged"] = (("enhanced", "triage"), f"""
 select e.* exclude (hours_since_fault, risk_level, sla_breach_risk),
  coalesce(t.predicted_category, e.fault_category) as predicted_category,
  coalesce(t.calculated_priority_score, e.priority_score) as calculated_priority_score,
  date_diff('microsecond', e.fault_timestamp, {NOW}) / 3.6e9 as hours_since_fault
 from enhanced e left join triage t using (fault_id)""")

CTE["dash"] = (("merged",), f"""
 select *, {risk("calculated_priority_score")} as risk_level,
  {breach("fault_category", "hours_since_fault")} as sla_breach_risk
 from merged""")

CTE["live"] = (("dash",), "select * from dash where not is_resolved")


def _kind(values) -> str:
    return f"({listed(values)})[cast(doc_id % 5 as int) + 1]"


_headings = (
    "SAFETY REQUIREMENTS:", "DIAGNOSTIC STEPS:", "REPAIR PROCEDURE:", "VERIFICATION:",
    "EQUIPMENT REPAIR NOTES:",
)
CTE["sops"] = ((), f"""
 select doc_id, 'SOP-' || lpad(cast(doc_id as varchar), 6, '0') as document_id,
  'SOP-' || lpad(cast(doc_id as varchar), 6, '0') || '.pdf' as file_path,
  {_kind(fixed.SOP_TITLES)} as title, {_kind(fixed.SOP_CATEGORIES)} as category,
  {_kind(fixed.SOP_EQUIPMENT)} as equipment_types, {_kind(fixed.SOP_CODES)} as fault_codes,
  doc_id % 17 <> 0 as is_active,
  case when doc_id % 19 = 0 then 'DELETED' else 'ACTIVE' end as file_status,
  {_kind(_headings)} || chr(10) || text as content, text
 from documents""")

_marks = listed(("1. ", "2. ", "3. ", "4. ", "5. ", "6. ", "- ", ""))
_openers = listed((
    "SAFETY REQUIREMENTS:", "DIAGNOSTIC STEPS:", "REPAIR PROCEDURES:", "VERIFICATION:",
    "Notes on tools:",
))
CTE["procs"] = (("sops",), f"""
 select s.* exclude (content, text), p.content
 from sops s join (
  select doc_id, string_agg(case when i % 9 = 0
     then (case when i > 0 then chr(10) else '' end) || ({_openers})[(i // 9 + doc_id) % 5 + 1]
          || chr(10) || '  ' || line
     else ({_marks})[i % 9]
          || (case when i % 9 = 7 then 'Check code ' || ({_all_codes})[(doc_id + i) % 15 + 1] || ' '
              else '' end) || line end, chr(10) order by i) as content
  from (select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from sops) group by doc_id
 ) p using (doc_id)""")

CTE["pieces"] = (("sops",), """
 select document_id, file_path, n, substr(content, (n - 1) * 200 + 1, 200) as piece,
  length(content) as total
 from (select *, unnest(range(1, (length(content) + 199) // 200 + 1)) as n from sops)""")

CTE["chunks"] = (("pieces",), f"""
 select document_id || '-C' || case when n < 1000 then lpad(cast(n as varchar), 3, '0')
   else cast(n as varchar) end as chunk_id,
  document_id, file_path, cast(n as int) as chunk_sequence, piece as chunk_text,
  {keyword("piece", fixed.CHUNK_TYPES, fixed.CHUNK_TYPE_DEFAULT)} as chunk_type,
  {keyword("piece", fixed.SECTION_NAMES, fixed.SECTION_DEFAULT)} as section_name,
  cast((n - 1) * 200 + 1 as int) as char_start_position,
  cast(least(n * 200, total) as int) as char_end_position
 from pieces where length(trim(piece)) > 10""")

CTE["idx_all"] = (("chunks", "sops"), """
 select c.*, s.title as document_title, s.category, s.equipment_types, s.fault_codes
 from chunks c join sops s using (document_id) where s.is_active""")
CTE["idx"] = (("idx_all",), "select * from idx_all where length(trim(chunk_text)) > 20")

CTE["asks"] = ((), r"""
 select distinct trim(unnest(string_split(text, '.')), ' ' || chr(10)) as query_text from benchmark""")
CTE["questions"] = (("faults",), """
 select distinct fault_description as question, equipment_type, fault_code from faults""")


def relevance(query: str, text: str, section: str, title: str) -> str:
    """Score of the best hit, NULL where there is none."""
    hit = lambda c, q: f"upper({c}) like '%' || upper({q}) || '%'"
    return (
        f"case when {hit(text, query)} then 0.9"
        f" when {hit(text, f'split_part({query}, chr(32), 1)')} then 0.7"
        f" when {hit(section, query)} then 0.6 when {hit(title, query)} then 0.5 end::double"
    )


HITS = "chunk_id, document_id, document_title, category, chunk_text, chunk_type, section_name, chunk_sequence"


def ranked(queries: str, k: int) -> str:
    """The k best index rows per query_text of `queries`, by nested loop."""
    return f"""select *, cast(row_number() over (partition by query_text
   order by relevance_score desc, document_id, chunk_sequence) as int) as "rank"
  from (select q.query_text, i.*, {relevance("q.query_text", "i.chunk_text", "i.section_name",
        "i.document_title")} as relevance_score
        from (select distinct query_text from {queries} where query_text <> '') q, idx i)
  where relevance_score is not null
  qualify "rank" <= {k}"""


def excerpt(content: str, query: str) -> str:
    pos = f"instr(lower({content}), lower({query}))"
    start, end = f"greatest(0, {pos} - 101)", f"least(length({content}), {pos} + 399)"
    return f"""case when {pos} > 0 then
   (case when {start} > 0 then '...' else '' end)
   || substr({content}, {start} + 1, {end} - {start})
   || (case when {end} < length({content}) then '...' else '' end)
  else substr({content}, 1, 500) || (case when length({content}) > 500 then '...' else '' end) end"""


_SPACE = blank_chars()
CTE["lines"] = (("procs",), f"""
 select document_id, unnest(string_split(content, chr(10))) as raw,
  generate_subscripts(string_split(content, chr(10)), 1) - 1 as position
 from procs""")
_opens = " ".join(
    "when " + " or ".join(f"contains(upper(line), '{w}')" for w in words) + f" then '{name}'"
    for name, words in fixed.STEP_SECTIONS
)
_is_step = " or ".join(f"starts_with(line, '{m}')" for m in fixed.STEP_MARKS)
CTE["steps"] = (("lines",), f"""
 select document_id, section, cast(position as int) as position, line as step
 from (
  select *, last_value(opener ignore nulls) over (partition by document_id order by position) as section
  from (select *, case {_opens} end as opener from
         (select document_id, position, trim(raw, {_SPACE}) as line from lines)))
 where opener is null and section is not null and ({_is_step})""")

CTE["best"] = (("faults", "procs"), f"""
 select fault_code, equipment_type, document_id, confidence from (
  select p.fault_code, p.equipment_type, d.document_id,
   ((case when list_contains(d.fault_codes, p.fault_code) then 8 else 0 end)
    + (case when len(list_filter(d.equipment_types,
          lambda x: contains(lower(x), lower(p.equipment_type)))) > 0 then 6 else 0 end)
    + (case when contains(d.content, p.fault_code) then 4 else 0 end)) / 10 as confidence
  from (select distinct fault_code, equipment_type from faults) p, procs d)
 where confidence > 0
 qualify row_number() over (partition by fault_code, equipment_type
  order by confidence desc, document_id) = 1""")


def with_(names, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names.split():
        visit(n)
    return "with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in order) + "\n" + body


SQL: dict[str, str] = {}

SQL["faults_enhanced"] = with_("enhanced", f"""
select * replace ({round_all("resolution_time_hours", "estimated_revenue_impact", "priority_score")})
from enhanced""")

SQL["hours_since_modes"] = with_("faults", f"""
select fault_id,
 cast(date_diff('hour', fault_timestamp, coalesce(resolution_timestamp, {NOW})) as int) as to_resolution_or_now,
 cast(date_diff('hour', fault_timestamp, {NOW}) as int) as to_now,
 round(date_diff('microsecond', fault_timestamp, {NOW}) / 3.6e9, 6) as to_now_exact
from faults""")

SQL["business_hours_presets"] = with_("faults", f"""
select fault_id, {business("fault_timestamp", 1, 5)} as weekdays,
 {business("fault_timestamp", 2, 6)} as training from faults""")

SQL["risk_levels"] = with_("analysis", f"""
select fault_id, {risk("priority_score")} as original_risk,
 {risk("calculated_priority_score")} as calculated_risk from analysis""")

SQL["sla_breach_variants"] = with_("analysis", f"""
select fault_id, {breach("fault_category", "hours_since_fault")} as by_category,
 {breach("predicted_category", "hours_to_now")} as by_prediction,
 {breach_by_score("priority_score", "hours_exact")} as by_score from analysis""")

SQL["classify_faults"] = with_("faults", f"""
select fault_id, fault_code, fault_category, {predicted()} as predicted_category from faults""")

SQL["priority_scores"] = with_("analysis", "select fault_id, calculated_priority_score from analysis")

SQL["technician_recommendation"] = with_("analysis", """
select fault_id, technician_type, skill_requirements, estimated_duration_hours, tools_required
from analysis""")


def json_object(*pairs: tuple[str, str, str]) -> str:
    """JSON text in the given order without NULL members; kind s is a string, n anything bare."""
    members = [
        f"""'"{name}":' || """ + (f"""'"' || {expr} || '"'""" if kind == "s" else f"cast({expr} as varchar)")
        for name, expr, kind in pairs
    ]
    return "'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"


_keys = [("fault_code", "s"), ("network_type", "s"), ("equipment_type", "s"), ("location", "s")]
_features = json_object(
    *[(k, k, t) for k, t in _keys],
    ("customers_affected", "customers_affected", "n"),
    ("service_calls", "service_calls_generated", "n"),
    ("hour_of_day", "hour(fault_timestamp)", "n"),
    ("day_of_week", "dayofweek(fault_timestamp)", "n"),
    ("business_hours", "business_hours_fault", "n"),
)
_feature_rows = """fault_id, fault_code, network_type, equipment_type, location, customers_affected,
 service_calls_generated, cast(hour(fault_timestamp) as int) as hour_of_day,
 cast(dayofweek(fault_timestamp) as int) as day_of_week, business_hours_fault,
 fault_category as actual_category"""
SQL["fault_features"] = with_("enhanced", f"""
select {_feature_rows}, {_features} as features from enhanced where fault_category is not null""")

_training = json_object(
    ("network_type", "network_type", "s"), ("equipment_type", "equipment_type", "s"),
    ("location", "location", "s"), ("fault_code", "fault_code", "s"),
    ("customers_affected", "customers_affected", "n"),
    ("service_calls_generated", "service_calls_generated", "n"),
    ("hour_of_day", "hour(fault_timestamp)", "n"),
    ("day_of_week", "dayofweek(fault_timestamp)", "n"),
    ("business_hours", business("fault_timestamp", 2, 6), "n"),
)
SQL["training_features"] = with_("faults", f"""
select fault_id, {_training} as features, fault_category as label
from faults where fault_category is not null""")

_bucket = "cast('0x' || substr(md5(fault_id), 1, 8) as bigint) % 10"
for _name, _test in (("train_split", "< 8"), ("test_split", ">= 8")):
    SQL[_name] = with_("enhanced", f"""
select {_feature_rows} from enhanced where fault_category is not null and {_bucket} {_test}""")

SQL["fault_analysis"] = with_("analysis", f"""
select fault_id, fault_timestamp, fault_code, fault_description, fault_category as actual_category,
 predicted_category, network_type, equipment_type, location, severity, customers_affected,
 service_calls_generated, technician_type_required, is_resolved, first_time_fix,
 hours_to_now as hours_since_fault, business_hours_fault, technician_type, skill_requirements,
 estimated_duration_hours, tools_required, round(priority_score, 6) as original_priority_score,
 {round_all("calculated_priority_score", "estimated_revenue_impact", "resolution_time_hours")}
from analysis""")

SQL["fault_triage"] = with_("triage", f"""
select * replace ({round_all("calculated_priority_score", "estimated_revenue_impact")}) from triage""")

SQL["faults_with_predictions"] = with_("dash", f"""
select fault_id, predicted_category, {round_all("calculated_priority_score", "hours_since_fault")},
 risk_level, sla_breach_risk, cast(fault_timestamp as date) as created_date, resolution_date,
 business_hours_fault, is_resolved from dash""")

SQL["joined_predictions"] = with_("merged", f"""
select fault_id, predicted_category, {round_all("calculated_priority_score", "hours_since_fault")},
 {risk("calculated_priority_score")} as risk_level,
 {breach_by_score("calculated_priority_score", "hours_since_fault")} as sla_breach_risk from merged""")

SQL["dashboard_slice"] = with_("dash", f"""
select fault_id, fault_timestamp, location, fault_category, risk_level,
 {round_all("calculated_priority_score")} from dash
where cast(fault_timestamp as date) between date '2024-01-05' and date '2024-01-25'
 and location = 'Aarhus North' and risk_level = 'HIGH'""")

SQL["triage_display"] = with_("live", """
select fault_id, strftime(fault_timestamp, '%Y-%m-%d %H:%M') as fault_timestamp, fault_code,
 fault_description, predicted_category, location, equipment_type, customers_affected,
 round_even(calculated_priority_score, 3) as calculated_priority_score, risk_level,
 technician_type_required, round_even(hours_since_fault, 1) as hours_since_fault,
 case risk_level when 'CRITICAL' then 'critical' when 'HIGH' then 'high' else '' end as highlight
from live""")

SQL["critical_alerts"] = with_("live", f"""
select fault_id, fault_description, location, equipment_type, customers_affected,
 technician_type_required, {round_all("calculated_priority_score", "estimated_revenue_impact")},
 case when risk_level = 'CRITICAL' then 'critical-alert' else 'high-priority' end as alert_type
from live where risk_level = 'CRITICAL' or sla_breach_risk
order by live.calculated_priority_score desc nulls last, fault_id limit 5""")

SQL["priority_timeline"] = with_("live", f"""
select fault_id, {round_all("hours_since_fault", "calculated_priority_score")}, risk_level,
 round(customers_affected / 50, 6) as marker_size, fault_id || '<br>' || fault_description as label
from live order by live.calculated_priority_score desc nulls last, fault_id limit 20""")

SQL["assigned_faults"] = with_("live", f"""
select fault_id, fault_description, fault_code, equipment_type, location,
 {round_all("calculated_priority_score")}, customers_affected,
 coalesce(fault_category = 'Cable Fault', false) as is_urgent
from live order by fault_timestamp, fault_id limit 10""")

SQL["repair_template"] = with_("faults", f"""
select fault_id, {text_template(fixed.REPAIR_TEMPLATE, code="coalesce(fault_code, 'N/A')",
 equipment="equipment_type", fault="fault_description")} as procedure_text,
 fault_description || ' ' || equipment_type || ' ' || fault_code as search_query,
 fault_description || ' ' || fault_code || ' ' || equipment_type as enhanced_query from faults""")

SQL["technician_metrics"] = with_("enhanced", """
select technician_type_required || '_' || location || '_' || fault_category || '_202401' as metric_id,
 technician_type_required as technician_type, location, fault_category, count(*) as total_jobs,
 count(*) filter (where first_time_fix) as first_time_fix_count,
 round(avg(case when first_time_fix then 1.0 else 0.0 end), 6) as first_time_fix_rate,
 round(avg(resolution_time_hours), 6) as avg_resolution_time_hours,
 cast(date_trunc('month', min(fault_timestamp)) as timestamp) as period_start,
 cast(date_trunc('month', max(fault_timestamp)) as timestamp) as period_end
from enhanced where is_resolved group by technician_type_required, location, fault_category""")

def _draw(seed: int) -> str:
    key = "concat_ws('|', '%d', equipment_type, location, network_type)" % seed
    return f"(cast('0x' || substr(md5({key}), 1, 10) as bigint) / {float(1 << 40)}::double)"


def _drawn_day(seed: int, days: tuple[int, int]) -> str:
    lo, hi = days
    return f"cast({NOW} as date) - cast(floor({_draw(seed)} * {hi - lo + 1}) + {lo} as int)"


SQL["equipment_reliability"] = with_("enhanced", f"""
select equipment_type || '_' || location || '_' || cast(row_number() over
  (partition by equipment_type, location order by n desc, network_type) as varchar) as equipment_id,
 equipment_type, location, network_type, fault_count_30_days, fault_count_90_days,
 {_drawn_day(0, fixed.INSTALL_DAYS)} as installation_date,
 {_drawn_day(1, fixed.MAINTENANCE_DAYS)} as last_maintenance_date,
 round(case {" ".join(f"when n > {b} then {_draw(2)} * ({hi} - {lo}) + {lo}" for b, _, (lo, hi) in fixed.RELIABILITY_BANDS)}
  else {_draw(2)} * {fixed.RELIABILITY_DEFAULT[1][1]} end, 6) as predicted_failure_risk,
 case when n > 10 then 'High' when n > 5 then 'Medium' else 'Low' end as maintenance_priority
from (select equipment_type, location, network_type, count(*) as n,
  count(*) filter (where fault_timestamp >= {NOW} - interval 30 day) as fault_count_30_days,
  count(*) filter (where fault_timestamp >= {NOW} - interval 90 day) as fault_count_90_days
 from enhanced group by all)""")

SQL["fault_quality_summary"] = with_("enhanced", """
select fault_category, count(*) as fault_count, round(avg(cast(first_time_fix as int)), 6) as avg_ftf_rate,
 round(avg(resolution_time_hours), 6) as avg_resolution_time,
 round(avg(customers_affected), 6) as avg_customers_affected
from enhanced group by fault_category""")

SQL["model_confusion"] = with_("analysis", """
select fault_category as actual_category, predicted_category, count(*) as prediction_count,
 round(count(*) / (select count(*) from analysis where fault_category is not null), 6) as percentage
from analysis where fault_category is not null group by all""")

SQL["model_accuracy"] = with_("analysis", """
select 'Model Performance Summary' as metric_type, count(*) as total_predictions,
 count(*) filter (where fault_category = predicted_category) as correct_predictions,
 round(count(*) filter (where fault_category = predicted_category) / count(*), 6) as accuracy
from analysis where fault_category is not null""")

SQL["kpi_row"] = with_("dash", """
select count(*) filter (where not is_resolved) as active_faults,
 count(*) filter (where hours_since_fault < 24) as last_24h,
 count(*) filter (where not is_resolved and risk_level = 'CRITICAL') as critical_faults,
 count(*) filter (where sla_breach_risk) as sla_risk,
 round(avg(cast(first_time_fix as int)) filter (where is_resolved) * 100, 6) as first_time_fix_pct,
 cast(coalesce(sum(customers_affected) filter (where not is_resolved), 0) as bigint) as customers_affected,
 round(coalesce(sum(estimated_revenue_impact) filter (where not is_resolved), 0), 6) as revenue_at_risk
from dash""")

SQL["category_impact"] = with_("live", """
select fault_category, customers_affected, fault_count,
 round(customers_affected / sum(customers_affected) over (), 6) as customer_share,
 round(fault_count / sum(fault_count) over (), 6) as incident_share
from (select fault_category, cast(coalesce(sum(customers_affected), 0) as bigint) as customers_affected,
  count(*) as fault_count from live where fault_category is not null group by fault_category)""")

CTE["impact"] = (("live",), """
 select location, fault_category, count(fault_id) as fault_count,
  cast(coalesce(sum(customers_affected), 0) as bigint) as customers_affected,
  avg(calculated_priority_score) as calculated_priority_score
 from live where location is not null and fault_category is not null group by location, fault_category""")
SQL["location_impact"] = with_("impact", f"""
select location, fault_category, fault_count, customers_affected,
 {round_all("calculated_priority_score")} from impact""")
SQL["location_rollup"] = with_("impact", """
select location, fault_category, cast(grouping(location, fault_category) as bigint) as level,
 cast(sum(fault_count) as bigint) as fault_count,
 cast(sum(customers_affected) as bigint) as customers_affected,
 round(sum(calculated_priority_score * customers_affected) / sum(customers_affected), 6)
  as weighted_priority_score
from impact group by rollup (location, fault_category)""")

SQL["fault_profile"] = with_("faults", """
select dimension, value, count(*) as record_count,
 round(avg(cast(first_time_fix as int)), 6) as first_time_fix_rate,
 round(avg(resolution_time_hours), 6) as avg_resolution_time
from (select 'fault_category' as dimension, fault_category as value, * from faults
 union all select 'network_type', network_type, * from faults
 union all select 'all', 'all', * from faults)
where value is not null group by dimension, value""")

SQL["facet_values"] = with_("faults", "select distinct location as value from faults order by 1")

SQL["load_summary"] = with_("enhanced chunks", """
select 'Network Faults' as table_name, count(*) as record_count from faults
union all select 'Training Data', count(*) from faults where fault_category is not null
union all select 'Technician Metrics', count(*) from (
 select distinct technician_type_required, location, fault_category from enhanced where is_resolved)
union all select 'Equipment Reliability', count(*) from (
 select distinct equipment_type, location, network_type from enhanced)
union all select 'PDF Files', count(*) from documents
union all select 'Document Metadata', count(*) from documents
union all select 'Document Chunks', count(*) from chunks""")

SQL["chunk_documents"] = with_("chunks", "select * exclude (chunk_id) from chunks")

SQL["searchable_chunks"] = with_("idx_all", f"""
select chunk_id, c.document_id, document_title, c.category,
 array_to_string(c.equipment_types, '|') as equipment_types,
 array_to_string(c.fault_codes, '|') as fault_codes, chunk_sequence, chunk_text, chunk_type,
 section_name, cast(null as int) as page_number, char_start_position, char_end_position,
 '1.0' as document_version, cast({NOW} as date) as last_reviewed,
 'stage/' || c.file_path as file_url, {NOW} as file_last_modified
from idx_all c join sops f on c.file_path = f.file_path where f.file_status = 'ACTIVE'""")

SQL["chunk_stats"] = with_("chunks", """
select chunk_type, count(*) as chunk_count, round(avg(length(chunk_text)), 6) as avg_chunk_length,
 cast(min(length(chunk_text)) as int) as min_chunk_length,
 cast(max(length(chunk_text)) as int) as max_chunk_length from chunks group by chunk_type""")

SQL["searchable_summary"] = with_("idx_all", """
select c.category, count(*) as chunk_count, count(distinct c.document_id) as document_count
from idx_all c join sops f on c.file_path = f.file_path where f.file_status = 'ACTIVE' group by c.category""")

SQL["chunk_inventory"] = with_("chunks", """
select count(*) as total_chunks, count(distinct document_id) as total_documents,
 count(distinct chunk_type) as chunk_types from chunks""")

SQL["chunk_preview"] = with_("chunks", """
select chunk_id, document_id, chunk_type, cast(length(chunk_text) as int) as chunk_length,
 substr(chunk_text, 1, 50) || '...' as chunk_preview
from chunks order by document_id, chunk_sequence limit 10""")

_words = lambda c: (
    f"cast(case when length(trim({c}, {_SPACE})) > 0"
    f" then len(regexp_split_to_array(trim({c}, {_SPACE}), '[ \\t\\n\\x0B\\f\\r]+')) else 0 end as int)"
)
SQL["chunk_metrics"] = with_("chunks", f"""
select chunk_id, document_id, cast(length(chunk_text) as int) as char_count,
 {_words("chunk_text")} as word_count from chunks""")

SQL["document_list"] = with_("sops", """
select document_id, title, category, array_to_string(equipment_types, ', ') as equipment_types,
 array_to_string(fault_codes, ', ') as fault_codes from sops""")

SQL["document_stats"] = with_("sops", f"""
select document_id, cast(length(content) as int) as char_count, {_words("content")} as word_count,
 cast(ceil(length(content) / 2000) as int) as page_count from sops""")

_numbered = " or ".join(f"starts_with(line, '{m}')" for m in fixed.NUMBER_MARKS)
SQL["document_lines"] = with_("procs", f"""
, sections as (
 select document_id, unnest(string_split(trim(content, {_SPACE}), chr(10) || chr(10))) as section,
  generate_subscripts(string_split(trim(content, {_SPACE}), chr(10) || chr(10)), 1) - 1 as section_no
 from procs),
titled as (
 select *, (upper(title) = title and lower(title) <> title and length(title) < {fixed.HEADER_MAX})
   or ends_with(title, ':') as has_header
 from (select *, trim(split_part(section, chr(10), 1), {_SPACE}) as title from sections
       where length(trim(section, {_SPACE})) > 0)),
unfolded as (
 select document_id, section_no, has_header, trim(unnest(string_split(section, chr(10))), {_SPACE}) as line,
  generate_subscripts(string_split(section, chr(10)), 1) - 1 as line_no from titled where has_header
 union all select document_id, section_no, has_header, section, 0 from titled where not has_header)
select document_id, cast(section_no as int) as section_no, cast(line_no as int) as line_no, line,
 case when not has_header then 'paragraph' when line_no = 0 then 'header' when {_numbered} then 'numbered'
  when starts_with(line, '-') then 'bullet' else 'plain' end as kind
from unfolded where not has_header or line_no = 0 or length(line) > 0""")

SQL["reassembled_texts"] = with_("sops", """
select document_id, cast((length(content) + 199) // 200 as bigint) as chunk_count,
 cast(length(content) as int) as char_count, md5(content) as content_md5 from sops""")

SQL["context_chunks"] = with_("chunks", """
select t.chunk_id as target_chunk_id, c.chunk_id, c.document_id, c.chunk_sequence, c.chunk_text,
 c.chunk_type, c.chunk_id = t.chunk_id as is_target_chunk,
 abs(c.chunk_sequence - t.chunk_sequence) as distance_from_target
from chunks t join chunks c on c.document_id = t.document_id
 and c.chunk_sequence between t.chunk_sequence - 2 and t.chunk_sequence + 2
where t.chunk_type <> 'CONTENT'""")

SQL["context_window"] = with_("chunks", """
select a.chunk_id, a.document_id, a.chunk_sequence,
 string_agg(b.chunk_id, '|' order by b.chunk_id) as neighbour_ids
from chunks a join chunks b on a.document_id = b.document_id
 and abs(a.chunk_sequence - b.chunk_sequence) <= 2 group by all""")

SQL["conversation_tail"] = """
select conv_id, turn, role, text from conversations
qualify row_number() over (partition by conv_id order by turn desc) <= 3"""


def one_search(query: str, where: str, k: int) -> str:
    q = quoted(query)
    return f"""
select {HITS}, cast(null as int) as page_number, relevance_score, true as equipment_match
from (select *, {relevance(q, "chunk_text", "section_name", "document_title")} as relevance_score
      from idx where {where}) where relevance_score is not null
order by relevance_score desc, document_id, chunk_sequence limit {k}"""


SQL["search_chunks"] = with_("idx", one_search("safety requirements", "true", 10))
SQL["search_chunks_filtered"] = with_("idx", one_search(
    "the", "category = 'Major' and list_contains(equipment_types, 'Nokia 7750')", 25
))
SQL["search_chunks_wildcard"] = with_(
    "idx", one_search("d_agnostic%steps", "chunk_type = 'DIAGNOSTIC'", 10)
)
SQL["search_many"] = with_("idx asks", f"""
select query_text, "rank", {HITS}, cast(null as int) as page_number, relevance_score
from ({ranked("asks", 10)})""")

SQL["find_similar"] = with_("idx_all", f"""
select document_id, document_title, category, chunk_text as similar_chunk_text, chunk_type,
 relevance_score, array_to_string(equipment_types, '|') as equipment_types,
 array_to_string(fault_codes, '|') as fault_codes
from (select distinct document_id, document_title, category, chunk_text, chunk_type, equipment_types,
  fault_codes, {relevance("'cable fault'", "chunk_text", "section_name", "document_title")}
  as relevance_score from idx_all)
where relevance_score >= 0.3 order by relevance_score desc, document_id, chunk_text limit 20""")

SQL["search_documents"] = with_("procs", f"""
select document_id, title as document_title, category, relevance_score,
 {excerpt("content", "'check code 812'")} as content_excerpt
from (select *, {relevance("'check code 812'", "content", "cast(null as varchar)", "title")}
  as relevance_score from procs where is_active)
where relevance_score is not null order by relevance_score desc, document_id limit 20""")

SQL["excerpts"] = with_("procs", f"""
select document_id, {excerpt("content", "'check code'")} as excerpt from procs""")

_place = " ".join(f"when '{t}' then {i}" for i, t in enumerate(fixed.CONTEXT_TYPE_ORDER, 1))
SQL["fault_context"] = with_("idx faults", f"""
, ranked as (
 select code, chunk_id, document_id, chunk_type, row_number() over (partition by code
   order by case chunk_type {_place} else 5 end, document_id, chunk_sequence) as place
 from (select *, unnest(fault_codes) as code from idx) qualify place <= 5),
lists as (select code, cast(count(*) as int) as n, string_agg(concat_ws('/', cast(place as varchar), chunk_id, document_id, chunk_type), '|' order by place) as ids
 from ranked group by code)
select fault_id, fault_code, coalesce(n, 0) as context_size, ids as context
from faults left join lists on code = fault_code""")

SQL["ask_questions"] = with_("idx questions", f"""
, composed as (select *, question || ' ' || equipment_type || ' ' || fault_code as query_text
 from questions),
hits as ({ranked("composed", 5)}),
lists as (select query_text, cast(count(*) as int) as n,
 string_agg(concat_ws('/', cast("rank" as varchar), chunk_id, document_id, printf('%.2f', relevance_score)), '|' order by "rank") as ids
 from hits group by query_text)
select question, equipment_type, fault_code, query_text, coalesce(n, 0) > 0 as answer_found,
 'Sources found for: ' || question as answer_text, coalesce(n, 0) as chunks_used, ids as source_chunks
from composed left join lists using (query_text)""")

SQL["chat_answers"] = with_("idx asks", f"""
, hits as ({ranked("asks", 1)}),
shown as (select query_text, document_id, document_title, category, relevance_score,
 {excerpt("chunk_text", "query_text")} as found from hits)
select query_text, coalesce({text_template(fixed.ANSWER_TEMPLATE, title="document_title",
 document="document_id", confidence="printf('%.1f%%', relevance_score * 100)", category="category",
 excerpt="found")}, {quoted(fixed.ANSWER_NONE)}) as answer
from (select distinct query_text from asks where query_text <> '') left join shown using (query_text)""")

SQL["vector_topk"] = """
with v as (select vec_id, cast(embedding as double[]) as x from embeddings)
select query_id, vec_id, round(similarity, 6) as similarity, cast(place as int) as "rank" from (
 select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.x, b.x), 9) as similarity,
  row_number() over (partition by a.vec_id
   order by round(list_cosine_similarity(a.x, b.x), 9) desc, b.vec_id) as place
 from v a, v b where a.vec_id <> b.vec_id) where place <= 5"""

SQL["best_sop"] = with_("best", """
select fault_code, equipment_type, document_id, round(confidence, 6) as confidence from best""")

SQL["repair_steps"] = with_("steps", "select * from steps")


def _steps(name: str) -> str:
    generic = quoted("|".join(fixed.GENERIC[name]))
    return f"case when d.document_id is null then {generic} else coalesce({name}, '') end as {name}_steps"


def _plan(i: int, join: bool) -> str:
    shown = lambda v: quoted("|".join(v) if join else v)
    branches = " ".join(
        f"when d.category = '{n}' then {shown(v[i])}" for n, v in fixed.REPAIR_TIME.items()
    )
    generic = fixed.GENERIC["tools" if join else "time"]
    return (
        f"case when d.document_id is null then {shown(generic)} {branches}"
        f" else {shown(fixed.REPAIR_TIME_DEFAULT[i])} end"
    )


SQL["repair_procedures"] = with_("best steps", f"""
, lists as (select document_id, {", ".join(
    f"string_agg(step, '|' order by position) filter (where section = '{n}') as {n}"
    for n, _ in fixed.STEP_SECTIONS)} from steps group by document_id)
select f.fault_id, coalesce(d.document_id, 'GENERIC') as document_id,
 coalesce(d.title, {quoted(fixed.GENERIC["title"])}) as document_title, d.category,
 round(b.confidence, 6) as confidence, {", ".join(_steps(n) for n, _ in fixed.STEP_SECTIONS)},
 {_plan(0, False)} as estimated_time, {_plan(1, True)} as required_tools,
 md5(coalesce(d.content, {quoted(fixed.GENERIC["content"])} || f.fault_description)) as full_content
from faults f
 left join best b on f.fault_code = b.fault_code and f.equipment_type = b.equipment_type
 left join procs d on d.document_id = b.document_id
 left join lists l on l.document_id = d.document_id""")

CTE["labelled"] = ((), """
 select 'SOP-' || lpad(cast(doc_id as varchar), 6, '0') as document_id,
  'Reviewed, quality ' || cast(quality as varchar) as title, 'Reviewed' as category, toxic = 0 as is_active
 from labels""")

SQL["upsert_files"] = with_("sops", f"""
, listing as (select 'SOP-' || lpad(cast(page_id * 7 as varchar), 6, '0') || '.pdf' as file_path,
  url as file_url, cast(length(html) as bigint) as file_size, md5(html) as md5 from pages)
select l.file_path, l.file_url, {NOW} as last_modified, coalesce(s.file_status, 'ACTIVE') as file_status,
 l.file_size, l.md5, {NOW} as updated_timestamp
from listing l join sops s on s.file_path = l.file_path
union all
select l.file_path, l.file_url, null, 'ACTIVE', l.file_size, l.md5, {NOW}
from listing l where l.file_path not in (select file_path from sops)
union all
select s.file_path, 'stage/' || s.file_path, {NOW}, s.file_status, 0, 'old', timestamp '2024-01-01 00:00:00'
from sops s where s.file_path not in (select file_path from listing)""")

SQL["insert_missing_metadata"] = with_("labelled sops", """
select document_id, title, category, is_active from labelled
union all select document_id, title, category, is_active from sops
where document_id not in (select document_id from labelled)""")

SQL["chunk_orphans"] = with_("chunks labelled", """
select chunk_id, document_id from chunks where document_id not in (select document_id from labelled)""")

SQL["null_counts"] = with_("faults", "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count from faults"
    for c in ("fault_id", "fault_code", "fault_category", "network_type", "equipment_type",
              "location", "customers_affected", "priority_score")
))

_twice = lambda t, k: (
    f"select 'unique {k}' as check_name, '{{}}' as table_name,"
    f" count(*) as violations from (select {k} from {t} group by {k} having count(*) > 1)"
)
SQL["dq_report"] = with_("faults sops chunks labelled", "\nunion all\n".join([
    _twice("faults", "fault_id").format("network_faults"),
    _twice("labelled", "document_id").format("sop_metadata"),
    _twice("sops", "file_path").format("sop_files"),
    _twice("chunks", "chunk_id").format("sop_chunks"),
    """select 'metadata without file', 'sop_metadata', count(*) from labelled
       where document_id || '.pdf' not in (select file_path from sops)""",
    """select 'chunk without metadata', 'sop_chunks', count(*) from chunks
       where document_id not in (select document_id from labelled)""",
    """select 'chunk without file', 'sop_chunks', count(*) from chunks
       where file_path not in (select file_path from sops)""",
    "select 'chunk longer than 200', 'sop_chunks', count(*) from chunks where length(chunk_text) > 200",
]))

# fault rows after a trip through CSV or a stream
for _name in ("csv_load", "streamed_faults"):
    SQL[_name] = with_("faults", f"""
select {FAULT_COLUMNS.replace("resolution_time_hours", "round(resolution_time_hours, 6) as resolution_time_hours")
 .replace("estimated_revenue_impact", "round(estimated_revenue_impact, 6) as estimated_revenue_impact")
 .replace("priority_score", "round(priority_score, 6) as priority_score")} from faults""")

SQL["batch_load"] = with_("enhanced", """
select 'Network Faults' as table_name, count(*) as record_count from faults
union all select 'Training Data', count(*) from faults where fault_category is not null
union all select 'Technician Metrics', count(*) from (
 select distinct technician_type_required, location, fault_category from enhanced where is_resolved)
union all select 'Equipment Reliability', count(*) from (
 select distinct equipment_type, location, network_type from enhanced)""")

SQL["corpus_build"] = with_("idx", """
select 'PDF Files' as table_name, count(*) as record_count from documents
union all select 'Document Metadata', count(*) from documents
union all select 'Document Chunks (200 chars)', count(*) from chunks
union all select 'Chunks ' || chunk_type, count(*) from chunks group by chunk_type
union all select 'Index', count(*) from idx""")

SQL["streamed_chunks"] = with_("chunks", "select * from chunks")

# --- the SQL surface and operators that other queries do not show -----------------

SQL["sql_classify"] = SQL["classify_faults"]
SQL["sql_scores"] = with_("analysis", "select fault_id, round(calculated_priority_score, 6) as calculated_priority_score from analysis")
SQL["sql_technician"] = SQL["technician_recommendation"]
SQL["sql_chunks"] = with_("chunks", """
select document_id, chunk_sequence, chunk_text, chunk_type, section_name, char_start_position, char_end_position from chunks""")
SQL["sql_context"] = with_("chunks", """
select c.chunk_id, c.document_id, c.chunk_sequence, c.chunk_text, c.chunk_type, c.chunk_id = t.chunk_id as is_target_chunk,
 abs(c.chunk_sequence - t.chunk_sequence) as distance_from_target
from chunks t join chunks c on c.document_id = t.document_id
 and c.chunk_sequence between t.chunk_sequence - 2 and t.chunk_sequence + 2 where t.chunk_id = 'SOP-000001-C002'""")
SQL["sql_search"] = SQL["search_chunks"]
SQL["sql_similar"] = SQL["find_similar"]

SQL["search_in_document"] = with_("idx", one_search("the", "document_id = 'SOP-000001'", 10))

_ASKED = ("diagnostic steps", "safety requirements", "repair procedure", "verification", "cable fault",
          "signal level", "equipment repair notes", "service degradation", "network security")
SQL["hybrid_search"] = with_("sops", f"""
, v as (select vec_id, cast(embedding as double[]) as x from embeddings),
q as (select vec_id as query_id, x, [{", ".join(f"'{t}'" for t in _ASKED)}][1 + (vec_id // 20) % {len(_ASKED)}] as query_text
      from v where vec_id % 20 = 0),
near as (select query_id, 'SOP-' || lpad(cast(v.vec_id as varchar), 6, '0') as document_id,
                round(list_cosine_similarity(q.x, v.x), 9) as similarity from q, v),
told as (select query_text, document_id, {relevance("query_text", "content", "cast(null as varchar)", "title")} as relevance_score
         from (select distinct query_text from q) t, sops where is_active),
said as (select query_id, document_id, relevance_score from q join told using (query_text) where relevance_score is not null),
both_ as (select *, round(coalesce(similarity, 0) * 0.5 + coalesce(relevance_score, 0) * 0.5, 9) as score
          from near full join said using (query_id, document_id))
select query_id, cast(row_number() over (partition by query_id order by score desc, document_id) as int) as "rank", document_id,
 round(similarity, 6) as similarity, round(relevance_score, 6) as relevance_score, round(score, 6) as hybrid_score
from both_ qualify "rank" <= 50""")

SQL["indexed_similar"] = SQL["find_similar"]
SQL["indexed_questions"] = SQL["ask_questions"]

SQL["schema_report"] = """
select 'network_faults' as table_name, 'location' as missing, count(*) as record_count from events
union all select 'sop_documents', 'title,content', count(*) from documents"""
SQL["count_report"] = """
select table_name, record_count, cast(1000 as bigint) as expected_count, record_count = 1000 as matches from (
 select 'Network Faults' as table_name, count(*) as record_count from events
 union all select 'PDF Files', count(*) from documents)"""
SQL["normalized_faults"] = with_("faults", """
select fault_id, fault_timestamp, cast(null as timestamp) as resolution_timestamp, fault_code, location,
 'Unknown' as fault_category, cast(0.5 as double) as priority_score from faults""")
SQL["appended_training"] = SQL["training_features"]
SQL["filled_defaults"] = with_("sops", f"""
select document_id, '1.0' as document_version, 'Engineering' as author, cast({NOW} as date) as creation_date,
 cast({NOW} as date) as last_reviewed, true as is_active, {NOW} as created_timestamp, {NOW} as updated_timestamp from sops""")
SQL["json_documents"] = with_("sops", """
select document_id, title, category, array_to_string(equipment_types, '|') as equipment_types,
 array_to_string(fault_codes, '|') as fault_codes, md5(content) as content from sops""")
SQL["rejected_rows"] = with_("faults", """
select fault_id, 'customers_affected' as reason from faults where cast(substr(fault_id, 2) as bigint) % 13 = 0""")

SQL["streamed_index"] = with_("sops", """
, u as (select document_id, string_split(replace(replace(upper(content), 'ß', 'SS'), 'ẞ', 'SS'), ' ') as w from sops),
t as (select document_id, unnest(w) as token, unnest(range(0, len(w))) as place from u)
select document_id, count(distinct token) as tokens, count(*) as places, cast(sum(place) as bigint) as place_sum from t group by 1""")
SQL["streamed_faults_dedup"] = with_("faults", """
select fault_id, fault_timestamp, case when cast(substr(fault_id, 2) as bigint) % 101 = 0 and day(fault_timestamp) < 8
 then 'late' else 'accepted' end as state from faults""")
SQL["object_paths"] = """
select event_id, case when ok then event_type end as technician_type, case when ok then round(user_id / 4, 6) end as duration,
 case when ok then cast(event_id % 5 as int) end as second_skill, case when ok then cast(json_extract(props, '$.k') as int) end as k,
 case when ok and event_id % 2 = 0 then 'yes' end as flag, cast(null as varchar) as absent, cast(null as int) as not_a_number
from (select *, event_id % 50 <> 49 and event_id % 51 <> 50 as ok from events)"""
SQL["upsert_in_buckets"] = SQL["upsert_files"]
SQL["kpi_row_incremental"] = SQL["kpi_row"]
SQL["dashboard_cube"] = with_("dash", """
, v as (select unnest(['All'] || list(distinct location)) as location from dash),
c as (select unnest(['All'] || list(distinct fault_category) filter (where fault_category is not null)) as fault_category from dash),
r as (select unnest(['All'] || list(distinct risk_level)) as risk_level from dash),
d as (select * from (values ('all', null, null), ('week 2', date '2024-01-08', date '2024-01-14'),
 ('from 20', date '2024-01-20', null), ('to 3', null, date '2024-01-03')) t(range, a, b)),
s as (select *, concat_ws('|', range, location, fault_category, risk_level) as slice_id from v, c, r, d)
select slice_id, count(*) filter (where not is_resolved) as active_faults,
 count(*) filter (where hours_since_fault < 24) as last_24h,
 count(*) filter (where not is_resolved and dash.risk_level = 'CRITICAL') as critical_faults,
 count(*) filter (where sla_breach_risk) as sla_risk,
 round(avg(cast(first_time_fix as int)) filter (where is_resolved) * 100, 6) as first_time_fix_pct,
 cast(coalesce(sum(customers_affected) filter (where not is_resolved), 0) as bigint) as customers_affected,
 round(coalesce(sum(estimated_revenue_impact) filter (where not is_resolved), 0), 6) as revenue_at_risk
from s left join dash on s.location in ('All', dash.location) and s.fault_category in ('All', dash.fault_category)
 and s.risk_level in ('All', dash.risk_level) and coalesce(cast(fault_timestamp as date) >= a, true)
 and coalesce(cast(fault_timestamp as date) <= b, true)
group by 1""")
