"""Every branch and boundary of the fault and chunk rules."""

import pytest
from pyspark.sql import functions as F

from faultloom.functions import rules, text
from faultloom.operators import faults as fl

NTZ = "timestamp_ntz"


def evaluate(spark, schema, rows, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def one(spark, **columns):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def ts(value):
    return F.lit(value).cast(NTZ)


@pytest.mark.parametrize(
    "code, customers, calls, expected",
    [
        ("812.3", 1000, 50, "Cable Fault"), ("81", 0, 0, "Cable Fault"), ("8", 0, 0, "Major"),
        ("820.1", 0, 0, "Major"), ("600.1", 0, 0, "Major"), ("700", 0, 0, "Major"),
        ("900.1", 0, 0, "Major"), ("150.4", 60, 5, "Minor"), ("150.4", 100, 10, "Minor"),
        ("150.4", 101, 0, "Major"), ("150.4", 0, 11, "Major"), ("100.1", 1000, 0, "Major"),
        ("100.1", 1001, 0, "Cable Fault"), ("100.1", 0, 100, "Major"),
        ("100.1", 0, 101, "Cable Fault"), (None, 0, 0, "Minor"), (None, None, None, "Minor"),
        (None, None, 101, "Cable Fault"),
    ],
)
def test_classifier(spark, code, customers, calls, expected):
    got = one(spark, c=rules.classify_fault(
        F.lit(code).cast("string"), F.lit(customers).cast("int"), F.lit(calls).cast("int")
    ))
    assert got == (expected,)


@pytest.mark.parametrize(
    "args, expected",
    [
        (("Cable Fault", 1000, 50, True, "Cisco cBR-8"), 1.25),
        (("Major", 50, 5, False, "Arris E6000"), 0.6),
        (("Minor", 0, 0, False, "Nokia 7750"), 0.25),
        (("Other", 0, 0, None, None), 0.1),
        ((None, 200, 10, False, "x"), 0.4),
        (("Minor", None, 0, True, "x"), None),
        (("Minor", 0, None, True, "x"), None),
    ],
)
def test_priority_score(spark, args, expected):
    kinds = ("string", "int", "int", "boolean", "string")
    got = one(spark, s=rules.priority_score(*[F.lit(a).cast(k) for a, k in zip(args, kinds)]))
    assert got == (expected,)


def test_exact_decimals_keep_a_score_of_six_tenths_medium(spark):
    score = rules.priority_score(
        F.lit("Major"), F.lit(50), F.lit(0), F.lit(False), F.lit("Cisco")
    )
    assert 0.5 + 0.05 + 0.05 > 0.6
    assert one(spark, s=score, r=rules.risk_level(score)) == (0.6, "MEDIUM")


@pytest.mark.parametrize(
    "score, level",
    [(0.81, "CRITICAL"), (0.8, "HIGH"), (0.61, "HIGH"), (0.6, "MEDIUM"), (0.41, "MEDIUM"),
     (0.4, "LOW"), (None, "LOW"), (1.25, "CRITICAL")],
)
def test_risk_level(spark, score, level):
    assert one(spark, r=rules.risk_level(F.lit(score).cast("double"))) == (level,)


@pytest.mark.parametrize(
    "category, hours, late",
    [("Cable Fault", 4, False), ("Cable Fault", 5, True), ("Major", 2, False), ("Major", 3, True),
     ("Minor", 1, False), ("Minor", 2, True), (None, 99, False), ("Other", 99, False),
     ("Minor", None, False)],
)
def test_sla_by_category(spark, category, hours, late):
    got = one(spark, s=rules.sla_breach(F.lit(category).cast("string"), F.lit(hours).cast("int")))
    assert got == (late,)


@pytest.mark.parametrize(
    "score, hours, late",
    [(0.71, 4.1, True), (0.7, 9.0, False), (0.9, 4.0, False), (None, 9.0, False)],
)
def test_sla_by_score(spark, score, hours, late):
    got = one(spark, s=rules.sla_breach_by_score(F.lit(score).cast("double"), F.lit(hours)))
    assert got == (late,)


@pytest.mark.parametrize(
    "when, dow, weekdays, training",
    [
        ("2024-01-07 10:00:00", 0, False, False),  # Sunday
        ("2024-01-08 08:00:00", 1, True, False),   # Monday
        ("2024-01-08 07:59:59", 1, False, False),
        ("2024-01-12 17:59:00", 5, True, True),    # Friday
        ("2024-01-12 18:00:00", 5, False, False),
        ("2024-01-13 12:00:00", 6, False, True),   # Saturday
    ],
)
def test_business_hours(spark, when, dow, weekdays, training):
    got = one(
        spark, d=rules.day_of_week(ts(when)), w=rules.business_hours(ts(when)),
        t=rules.business_hours(ts(when), 2, 6),
    )
    assert got == (dow, weekdays, training)


def test_business_hours_of_no_time(spark):
    none = F.lit(None).cast(NTZ)
    got = one(spark, v=rules.business_hours(none), t=rules.business_hours(none, 2, 6, keep_null=True))
    assert got == (False, None)


def test_hours_count_boundaries_or_elapsed_time(spark):
    a, b = ts("2024-01-01 08:59:00"), ts("2024-01-01 09:01:30.5")
    got = one(spark, n=rules.hours_since(a, b), x=rules.hours_since(a, b, "fraction"))
    assert got[0] == 1 and got[1] == pytest.approx(150.5 / 3600, abs=1e-12)
    assert one(spark, n=rules.hours_since(b, a)) == (-1,)
    with pytest.raises(ValueError):
        rules.hours_since(a, b, "other")


@pytest.mark.parametrize(
    "category, score, kind, hours, tools",
    [("Cable Fault", 0.1, "Specialist", 6.0, 4), ("Major", 0.71, "Senior", 3.0, 3),
     ("Major", 0.7, "General", 3.0, 3), ("Minor", None, "General", 1.5, 2), (None, 0.9, "Senior", 1.5, 2)],
)
def test_technician(spark, category, score, kind, hours, tools):
    rec = rules.recommend_technician(F.lit(category).cast("string"), F.lit(score).cast("double"))
    got = one(spark, r=rec)[0]
    assert (got["technician_type"], got["estimated_duration_hours"]) == (kind, hours)
    assert len(got["tools_required"]) == tools


@pytest.mark.parametrize(
    "body, kind, section",
    [("x safety diagnostic", "SAFETY", "Safety Requirements"),
     ("Diagnostic procedure", "DIAGNOSTIC", "Diagnostic Steps"),
     ("a procedure, verification", "PROCEDURE", "Repair Procedure"),
     ("verification of repair", "VERIFICATION", "Verification Steps"),
     ("repair it", "PROCEDURE", "General Content"), ("words", "CONTENT", "General Content")],
)
def test_chunk_rules(spark, body, kind, section):
    got = one(spark, t=rules.chunk_type(F.lit(body)), s=rules.section_name(F.lit(body)))
    assert got == (kind, section)


def test_meaningful_trims_blanks_only(spark):
    got = one(
        spark, a=rules.is_meaningful(F.lit("  1234567890 "), 10),
        b=rules.is_meaningful(F.lit("\t1234567890"), 10),
    )
    assert got == (False, True)


def test_time_and_tools(spark):
    got = one(spark, a=rules.time_and_tools(F.lit("Major")), b=rules.time_and_tools(F.lit("Security")))
    assert got[0]["estimated_time"] == "2-4 hours"
    assert got[1]["required_tools"] == ["Signal Level Meter", "Laptop"]


def test_seeded_draws_repeat_and_stay_in_range(spark):
    df = spark.range(1000).select(
        rules.uniform(7, "id").alias("u"), rules.uniform_int(7, 30, 180, "id").alias("n")
    )
    first, again = df.collect(), df.repartition(5).collect()
    assert sorted(first) == sorted(again)
    assert all(0 <= r.u < 1 and 30 <= r.n <= 180 for r in first)
    assert len({r.u for r in first}) == 1000


def test_split_is_stable_disjoint_and_whole(spark):
    df = spark.range(5000).select(F.format_string("F%06d", "id").alias("fault_id"))
    train, test = fl.split_train_test(df)
    a, b = ({r[0] for r in d.collect()} for d in (train, test))
    assert not a & b and len(a | b) == 5000
    assert 0.77 < len(a) / 5000 < 0.83


# --- text ---------------------------------------------------------------------

@pytest.mark.parametrize("pad", ["", "\t\n ", "  "])
def test_strip_equals_the_usual_strip(spark, pad):
    value = f"{pad}a b\x0b c{pad}"
    assert one(spark, s=text.strip(F.lit(value))) == (value.strip(),)


def python_excerpt(content, query, size=500):
    pos = content.lower().find(query.lower())
    if pos < 0:
        return content[:size] + ("..." if len(content) > size else "")
    start, end = max(0, pos - 100), min(len(content), pos + size - 100)
    return ("..." if start > 0 else "") + content[start:end] + ("..." if end < len(content) else "")


@pytest.mark.parametrize("at", [0, 50, 100, 101, 600, 1000])
@pytest.mark.parametrize("tail", [0, 10, 900])
def test_excerpt(spark, at, tail):
    content = "x" * at + "NeedLe" + "y" * tail
    for query in ("needle", "absent"):
        got = one(spark, e=text.excerpt(F.lit(content), F.lit(query)))
        assert got == (python_excerpt(content, query),)


@pytest.mark.parametrize(
    "body, query, wild, literal",
    [("Cable cut", "CABLE", True, True), ("axb", "a_b", True, False), ("a_b", "a_b", True, True),
     ("a--b", "a%b", True, False), ("abc", "", True, True), ("a\\b", "a\\b", True, True),
     ("abc", "a\\", False, False), (None, "a", None, None)],
)
def test_matches(spark, body, query, wild, literal):
    b, q = F.lit(body).cast("string"), F.lit(query)
    assert one(spark, w=text.matches(b, q), l=text.matches(b, q, literal=True)) == (wild, literal)


def test_relevance_order(spark):
    score = lambda t, s, d, q: text.relevance(F.lit(t), F.lit(s), F.lit(d), F.lit(q))
    got = one(
        spark,
        full=score("cable fault here", "", "", "cable fault"),
        first=score("a cable", "cable fault", "cable fault", "cable fault"),
        section=score("x", "cable fault", "cable fault", "cable fault"),
        title=score("x", "y", "cable fault", "cable fault"),
        none=score("x", "y", "z", "cable fault"),
        blank=score("x", "y", "z", ""),
        leading=score("x", "y", "z", " q"),
    )
    assert got == (0.9, 0.7, 0.6, 0.5, 0.3, 0.9, 0.7)


def test_templates(spark):
    none = F.lit(None).cast("string")
    body = text.render_procedure(F.lit("cut"), F.lit("Box"), none)
    got = one(
        spark, body=body, gone=text.render_procedure(F.lit("cut"), none, F.lit("1")),
        q=text.procedure_query(F.lit("cut"), F.lit("Box"), none),
        c=text.compose_question(F.lit("why"), none, F.lit("812.3")),
        e=text.enhance_query(F.lit("q"), F.lit(""), F.lit("Box")),
    )
    assert "fault code: N/A\n" in got[0] and "equipment: Box\n" in got[0] and "fault: cut\n" in got[0]
    assert got[1:] == (None, "cut Box", "why  812.3", "q Box")


def test_answers(spark):
    none = F.lit(None).cast("string")
    found = text.format_answer(F.lit("D1"), F.lit("T"), F.lit(0.9), F.lit("Major"), F.lit("text"))
    missing = text.format_answer(none, none, F.lit(None).cast("double"), none, none)
    got = one(spark, f=found, m=missing)
    assert "**Source:** T (D1)\n**Confidence:** 90.0%\n**Category:** Major" in got[0]
    assert got[1].startswith("I couldn't find")


def test_chunk_ids_grow_past_three_digits(spark):
    got = one(spark, a=text.chunk_id(F.lit("D"), F.lit(7)), b=text.chunk_id(F.lit("D"), F.lit(1234)))
    assert got == ("D-C007", "D-C1234")
