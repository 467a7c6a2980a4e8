"""Fault rules as Column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of: str | dt.datetime | Column) -> Column:
    """The explicit "now" of every time-relative operator, without a time zone."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def first_match(branches, default) -> Column:
    """CASE over (condition, value) pairs, in order."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    (cond, val), *rest = branches
    chain = reduce(lambda acc, b: acc.when(b[0], value(b[1])), rest, F.when(cond, value(val)))
    return chain.otherwise(value(default))


def least_or_null(x: Column, bound: Column) -> Column:
    """`least` that is NULL when x is; the built-in skips NULLs."""
    return F.when(x.isNotNull(), F.least(x, bound))


# --- time -------------------------------------------------------------------

def day_of_week(ts: Column | str) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(col(ts)) - 1


def business_hours(ts: Column | str, dow_lo: int = 1, dow_hi: int = 5, keep_null: bool = False) -> Column:
    """Hours 8-17 (17:59 counts) on the given weekdays; the training preset is 2..6."""
    inside = F.hour(col(ts)).between(*fixed.BUSINESS_HOURS) & day_of_week(ts).between(dow_lo, dow_hi)
    return inside if keep_null else F.coalesce(inside, F.lit(False))


def hours_since(start: Column | str, end: Column | str, mode: str = "boundary") -> Column:
    """Hours between two zone-less timestamps.

    boundary: how many clock hours begin in between (08:59 to 09:01 is 1), an integer.
    fraction: elapsed hours to the microsecond, a double.
    """
    start, end = col(start), col(end)
    if mode == "boundary":
        return F.datediff(F.to_date(end), F.to_date(start)) * 24 + F.hour(end) - F.hour(start)
    if mode == "fraction":
        return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)
    raise ValueError(f"unknown mode {mode!r}")


# --- fault rules ------------------------------------------------------------

def is_resolved(resolution: Column | str = "resolution_timestamp") -> Column:
    return col(resolution).isNotNull()


def risk_level(score: Column | str) -> Column:
    score = col(score)
    return first_match([(score > low, name) for low, name in fixed.RISK_BANDS], fixed.RISK_DEFAULT)


def sla_breach(category: Column | str, hours: Column | str) -> Column:
    """By category; which category and which hours is the caller's preset. NULL is no risk."""
    category, hours = col(category), col(hours)
    late = [(category == name) & (hours > limit) for name, limit in fixed.SLA_HOURS.items()]
    return F.coalesce(reduce(lambda a, b: a | b, late), F.lit(False))


def sla_breach_by_score(score: Column | str, hours: Column | str) -> Column:
    return F.coalesce(
        (col(score) > fixed.SLA_SCORE) & (col(hours) > fixed.SLA_SCORE_HOURS), F.lit(False)
    )


def classify_fault(code: Column | str, customers: Column | str, calls: Column | str) -> Column:
    code, customers, calls = col(code), col(customers), col(calls)
    branches = []
    for name, prefixes, customers_above, calls_above in fixed.CLASSIFIER:
        tests = [code.startswith(p) for p in prefixes] + [customers > customers_above, calls > calls_above]
        branches.append((reduce(lambda a, b: a | b, tests), name))
    return first_match(branches, fixed.CLASSIFIER_DEFAULT)


def _dec(text: str) -> Column:
    return F.lit(Decimal(text))


def _weighted(count: Column, weight: str, bound: str) -> Column:
    return least_or_null(count.cast("decimal(18,6)") * _dec(weight), _dec(bound))


def priority_score(category, customers, calls, business, equipment) -> Column:
    """Sum of five parts in exact decimals, cast to double last; not clamped at 1.

    A NULL count makes the score NULL.
    """
    category, equipment = col(category), col(equipment)
    base = first_match(
        [(category == name, _dec(v)) for name, v in fixed.BASE_SCORE.items()],
        _dec(fixed.BASE_SCORE_DEFAULT),
    )
    boost = F.when(col(business), _dec(fixed.BUSINESS_BOOST)).otherwise(_dec("0.0"))
    vendor = first_match(
        [(equipment.contains(name), _dec(v)) for name, v in fixed.VENDOR_BOOST], _dec("0.00")
    )
    total = (
        base
        + _weighted(col(customers), fixed.CUSTOMER_WEIGHT, fixed.CUSTOMER_LIMIT)
        + _weighted(col(calls), fixed.CALL_WEIGHT, fixed.CALL_LIMIT)
        + boost
        + vendor
    )
    return total.cast("double")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _per_category(category: Column, pick) -> Column:
    return first_match(
        [(category == name, pick(spec)) for name, spec in fixed.DISPATCH.items()],
        pick(fixed.DISPATCH_DEFAULT),
    )


def recommend_technician(category: Column | str, score: Column | str) -> Column:
    """Struct of technician type, skills, hours and tools."""
    category = col(category)
    kind = first_match(
        [
            (category == "Cable Fault", fixed.TECHNICIAN_SPECIALIST),
            (col(score) > fixed.SENIOR_SCORE, fixed.TECHNICIAN_SENIOR),
        ],
        fixed.TECHNICIAN_GENERAL,
    )
    return F.struct(
        kind.alias("technician_type"),
        _per_category(category, lambda s: strings(s["skills"])).alias("skill_requirements"),
        _per_category(category, lambda s: F.lit(s["hours"])).alias("estimated_duration_hours"),
        _per_category(category, lambda s: strings(s["tools"])).alias("tools_required"),
    )


def time_and_tools(category: Column | str) -> Column:
    category = col(category)
    pick = lambda i, wrap: first_match(
        [(category == name, wrap(spec[i])) for name, spec in fixed.REPAIR_TIME.items()],
        wrap(fixed.REPAIR_TIME_DEFAULT[i]),
    )
    return F.struct(
        pick(0, F.lit).alias("estimated_time"), pick(1, strings).alias("required_tools")
    )


# --- chunk rules ------------------------------------------------------------

def chunk_keyword(upper: Column | str) -> Column:
    """The first rule word in an upper-cased text, NULL if none. Type and section follow from it:
    both rule lists test the same words in the same order."""
    upper = col(upper)
    return first_match(
        [(upper.contains(word), word) for word, _ in fixed.CHUNK_TYPES], F.lit(None).cast("string")
    )


def _by_keyword(keyword: Column | str, rules, default: str) -> Column:
    return first_match([(col(keyword) == word, name) for word, name in rules], default)


def type_of_keyword(keyword: Column | str) -> Column:
    return _by_keyword(keyword, fixed.CHUNK_TYPES, fixed.CHUNK_TYPE_DEFAULT)


def section_of_keyword(keyword: Column | str) -> Column:
    """Has no rule for REPAIR, unlike the type."""
    return _by_keyword(keyword, fixed.SECTION_NAMES, fixed.SECTION_DEFAULT)


def chunk_type(text: Column | str) -> Column:
    return type_of_keyword(chunk_keyword(F.upper(col(text))))


def section_name(text: Column | str) -> Column:
    return section_of_keyword(chunk_keyword(F.upper(col(text))))


def is_meaningful(text: Column | str, min_len: int) -> Column:
    """Longer than min_len without surrounding spaces (spaces only, not tabs)."""
    return F.length(F.trim(col(text))) > min_len


# --- hash split and seeded draws --------------------------------------------

def hash_bucket(key: Column | str, buckets: int = 10) -> Column:
    """Stable bucket of a string key: its first 32 md5 bits modulo `buckets`."""
    return F.conv(F.substring(F.md5(col(key)), 1, 8), 16, 10).cast("long") % buckets


def uniform(seed: int, *key: Column | str) -> Column:
    """Repeatable draw in [0, 1) per key: the same row gets the same value on any executor."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]))
    return F.conv(F.substring(draw, 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))


def uniform_int(seed: int, lo: int, hi: int, *key: Column | str) -> Column:
    """Repeatable integer in lo..hi, both included."""
    return (F.floor(uniform(seed, *key) * (hi - lo + 1)) + lo).cast("int")
