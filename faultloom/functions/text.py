"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .rules import col


def strip(text: Column | str) -> Column:
    """Drop surrounding white space of any kind."""
    return F.btrim(col(text), F.lit(fixed.WHITESPACE))


def any_prefix(text: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.startswith(m)
    return out


def like_pattern(query: Column | str) -> Column:
    """%QUERY% for a case-blind LIKE. Wildcards in the query act as such, a backslash does not."""
    return F.concat(F.lit("%"), F.replace(F.upper(col(query)), F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def matches(text: Column | str, query: Column, literal: bool = False) -> Column:
    """Case-blind substring test; literal=True takes % and _ as plain characters."""
    upper = F.upper(col(text))
    if literal:
        return upper.contains(F.upper(query))
    return F.call_function("like", upper, like_pattern(query))


def first_word(query: Column | str) -> Column:
    return F.split_part(col(query), F.lit(" "), F.lit(1))


def relevance(text, section, title, query: Column, literal: bool = False) -> Column:
    """Score of the best kind of hit. A first-word hit outranks section and title hits."""
    return (
        F.when(matches(text, query, literal), fixed.SCORE_TEXT)
        .when(matches(text, first_word(query), literal), fixed.SCORE_FIRST_WORD)
        .when(matches(section, query, literal), fixed.SCORE_SECTION)
        .when(matches(title, query, literal), fixed.SCORE_TITLE)
        .otherwise(fixed.SCORE_NONE)
    )


def chunk_id(document: Column | str, sequence: Column | str) -> Column:
    """DOC-C001, three digits at least."""
    return F.format_string("%s-C%03d", col(document), col(sequence))


def excerpt(content: Column | str, query: Column | str, max_len: int = 500) -> Column:
    """The surroundings of the first case-blind hit, or the start of the text; dots mark cuts."""
    content, query = col(content), col(query)
    hit = F.position(F.lower(query), F.lower(content))
    size = F.length(content)
    start = F.greatest(F.lit(0), hit - 1 - 100)
    end = F.least(size, hit - 1 + (max_len - 100))
    dots = lambda cut: F.when(cut, F.lit("...")).otherwise(F.lit(""))
    around = F.concat(
        dots(start > 0), F.substr(content, start + 1, F.greatest(end - start, F.lit(0))), dots(end < size)
    )
    head = F.concat(F.substr(content, F.lit(1), F.lit(max_len)), dots(size > max_len))
    return F.when(hit > 0, around).otherwise(head)


def enhance_query(query, code=None, equipment=None) -> Column:
    """Query text plus code and equipment where given (NULL and '' are left out)."""
    parts = [col(query)] + [F.nullif(col(c), F.lit("")) for c in (code, equipment) if c is not None]
    return F.concat_ws(" ", *parts)


def compose_question(question, equipment, code) -> Column:
    """Question, equipment and code with single blanks between, absent parts empty."""
    blank = lambda c: F.coalesce(col(c), F.lit(""))
    return F.concat(col(question), F.lit(" "), blank(equipment), F.lit(" "), blank(code))


def _fill(template: str, **values: Column) -> Column:
    """Concatenate a template's literal parts and columns; NULL if any column is."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def render_procedure(description, equipment, code) -> Column:
    """Templated repair text. NULL equipment or description gives NULL, NULL code gives N/A."""
    return _fill(
        fixed.REPAIR_TEMPLATE,
        code=F.coalesce(col(code), F.lit("N/A")),
        equipment=col(equipment),
        fault=col(description),
    )


def procedure_query(description, equipment, code) -> Column:
    """The search text that goes with a rendered procedure."""
    tail = F.coalesce(F.concat(F.lit(" "), col(code)), F.lit(""))
    return F.concat(col(description), F.lit(" "), col(equipment), tail)


def format_answer(document, title, score, category, excerpt_) -> Column:
    """Chat answer for a hit; the not-found text where there is none."""
    filled = _fill(
        fixed.ANSWER_TEMPLATE,
        title=col(title),
        document=col(document),
        confidence=F.format_string("%.1f%%", col(score) * 100),
        category=col(category),
        excerpt=col(excerpt_),
    )
    return F.when(col(document).isNotNull(), filled).otherwise(F.lit(fixed.ANSWER_NONE))
