"""Repair procedures: step parsing, best document per fault, assembled procedures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, rules, text
from ..functions.rules import first_match
from ..sources.tables import settle
from .textmatch import containing

SECTIONS = tuple(name for name, _ in fixed.STEP_SECTIONS)


def _section_of(upper: Column) -> Column:
    """Section an upper-cased line opens, NULL if none. A step with a keyword opens one, too."""
    has = lambda words: reduce(lambda a, b: a | b, [upper.contains(w) for w in words])
    return first_match(
        [(has(words), name) for name, words in fixed.STEP_SECTIONS], F.lit(None).cast("string")
    )


def section_fill(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """document_id, carried columns and `blocks`: an array of (section, first, lines).

    The current section is carried down to the next opener. This works inside the row: the lines
    between two openers are one slice, so a document costs one pass, whatever its length, and needs
    no window. Lines before the first opener belong to no section.

    Each step is a column of its own: an array named twice in one lambda would be built anew for
    every element. For the same reason, unfold the result with outer generators: for an inner one
    the optimizer adds a size test and copies the whole expression into it.
    """
    lines = F.transform(F.split("content", "\n"), text.strip)
    opened = F.filter(
        F.transform(
            F.transform("_lines", F.upper),
            lambda u, i: F.struct(i.alias("at"), _section_of(u).alias("section")),
        ),
        lambda t: t["section"].isNotNull(),
    )
    stops = F.concat(
        F.transform(F.slice("_openers", 2, F.size("_openers")), lambda o: o["at"]),
        F.array(F.size("_lines")),
    )
    block = lambda o, stop: F.struct(
        o["section"].alias("section"),
        (o["at"] + 1).alias("first"),
        F.slice("_lines", o["at"] + 2, stop - o["at"] - 1).alias("lines"),
    )
    return (
        documents.select("document_id", *carry, lines.alias("_lines"))
        .withColumn("_openers", opened)
        .withColumn("_stops", F.slice(stops, 1, F.size("_openers")))
        .select("document_id", *carry, F.zip_with("_openers", "_stops", block).alias("blocks"))
    )


def repair_steps(documents: DataFrame) -> DataFrame:
    """Steps in long form: document_id, section, position (line number from 0), step.

    A line that starts with 1. to 5. or a dash is a step of the current section.
    """
    return (
        section_fill(documents).select("document_id", F.inline_outer("blocks"))
        .select(
            "document_id", "section", "first", F.posexplode_outer("lines").alias("offset", "step")
        )
        .filter(text.any_prefix(F.col("step"), fixed.STEP_MARKS))
        .select("document_id", "section", (F.col("first") + F.col("offset")).alias("position"), "step")
    )


def step_lists(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Steps per document as one array column per section, built inside the row."""
    def steps(name: str) -> Column:
        mine = F.filter("blocks", lambda b: b["section"] == name)
        every = F.flatten(F.transform(mine, lambda b: b["lines"]))
        return F.filter(every, lambda l: text.any_prefix(l, fixed.STEP_MARKS)).alias(f"{name}_steps")

    return section_fill(documents, carry).select(
        "document_id", *carry, *[steps(s) for s in SECTIONS]
    )


# --- which document fits a fault --------------------------------------------

def _equipment_matches(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, equipment) where the fault's equipment occurs in a document's name, case-blind.

    Both sides are distinct labels; they meet through the token lookup.
    """
    lower = lambda c: F.lower(F.col(c)).alias("_lower")
    wanted = wanted.select("equipment_type", lower("equipment_type"))
    hits = containing(names.select("name", lower("name")), ["name"], "_lower", wanted, "_lower")
    return hits.join(wanted, "_lower").select("name", "equipment_type").distinct()


def best_sop(faults: DataFrame, sops: DataFrame) -> DataFrame:
    """The best document per distinct (fault_code, equipment_type), with its score.

    A document earns 0.8 for listing the code, 0.6 for a matching equipment and 0.4 for the code
    in its text (or title, when it has no text). Highest score wins, then the lowest document_id.
    Pairs that no document fits are absent.

    No fault meets every document: faults are reduced to distinct pairs, codes reach documents by
    equality and by token lookup, equipment by equality on name parts, and documents are reduced
    to the first one per (code, kind of hit, equipment list) before pairs are formed.
    """
    pairs = settle(faults.select("fault_code", "equipment_type").distinct(), "pairs")
    codes = pairs.select("fault_code").filter(F.col("fault_code").isNotNull()).distinct()
    wanted = pairs.select("equipment_type").filter(F.col("equipment_type").isNotNull()).distinct()

    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    signature = F.array_sort(F.array_distinct(lists("equipment_types"))).alias("sig")
    described = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("title"), F.lit(""))
    first_document = F.min("document_id").alias("document_id")

    # documents that know a code, with the tenths each kind of knowledge earns
    listed = (
        sops.select("document_id", signature,
                    F.explode(F.array_distinct(lists("fault_codes"))).alias("fault_code"))
        .join(codes, "fault_code", "left_semi")
        .withColumn("tenths", F.lit(fixed.MATCH_CODE))
    )
    mentioned = (
        containing(
            sops.select("document_id", described.alias("body")), ["document_id"], "body", codes, "fault_code"
        )
        .join(sops.select("document_id", signature), "document_id")
        .select("document_id", "sig", "fault_code", F.lit(fixed.MATCH_CONTENT).alias("tenths"))
    )
    known = (
        listed.unionByName(mentioned).groupBy("document_id", "sig", "fault_code")
        .agg(F.sum("tenths").alias("tenths"))
        .groupBy("fault_code", "tenths", "sig").agg(first_document)
    )

    # equipment lists, and which of them fit which equipment
    kits = sops.select(signature, "document_id").groupBy("sig").agg(first_document)
    named = kits.select("sig", F.explode("sig").alias("name"))
    fitting = (
        named.join(_equipment_matches(named.select("name").distinct(), wanted), "name")
        .select("sig", "equipment_type").distinct()
    )

    # the first document per kind of knowledge, for a code, an equipment, or both (NULL: not asked)
    unknown = kits.select(
        F.lit(None).cast("string").alias("fault_code"), F.lit(0).cast("long").alias("tenths"),
        "sig", "document_id",
    )
    fitted = known.unionByName(unknown).join(fitting, "sig").select(
        "fault_code", "equipment_type", (F.col("tenths") + fixed.MATCH_EQUIPMENT).alias("tenths"),
        "document_id",
    )
    bare = known.select(
        "fault_code", F.lit(None).cast("string").alias("equipment_type"), "tenths", "document_id"
    )
    top = F.min(F.struct((-F.col("tenths")).alias("minus"), "document_id")).alias("top")
    offers = settle(
        fitted.unionByName(bare).groupBy("fault_code", "equipment_type").agg(top)
        .select(F.col("fault_code").alias("_code"), F.col("equipment_type").alias("_kit"), "top"),
        "offers",
    )

    # a pair takes the best of the three offers it qualifies for
    no = F.lit(None).cast("string")
    ask = lambda code, kit: F.struct(code.alias("ask_code"), kit.alias("ask_kit"))
    code, kit = F.col("fault_code"), F.col("equipment_type")
    asks = F.array_distinct(F.array(ask(code, kit), ask(code, no), ask(no, kit)))
    qualifies = F.col("ask_code").eqNullSafe(F.col("_code")) & F.col("ask_kit").eqNullSafe(F.col("_kit"))
    return (
        pairs.select("fault_code", "equipment_type", F.inline(asks)).join(offers, qualifies)
        .groupBy("fault_code", "equipment_type").agg(F.min("top").alias("top"))
        .select(
            "fault_code", "equipment_type", F.col("top.document_id").alias("document_id"),
            (-F.col("top.minus") / 10).alias("confidence"),
        )
    )


def match_sop(faults: DataFrame, sops: DataFrame) -> DataFrame:
    """Faults with the id and score of their best document; GENERIC and 0 where none fits."""
    return _with_best(faults, settle(best_sop(faults, sops), "best"))


def _with_best(faults: DataFrame, best: DataFrame) -> DataFrame:
    keyed = best.select(
        F.col("fault_code").alias("_code"), F.col("equipment_type").alias("_kit"),
        "document_id", "confidence",
    )
    same = F.col("fault_code").eqNullSafe(F.col("_code")) & F.col("equipment_type").eqNullSafe(
        F.col("_kit")
    )
    return faults.join(keyed, same, "left").drop("_code", "_kit").withColumns({
        "document_id": F.coalesce("document_id", F.lit(fixed.GENERIC["document_id"])),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
    })


def repair_procedures(faults: DataFrame, sops: DataFrame) -> DataFrame:
    """The assembled procedure of every fault.

    Only documents that won some pair are parsed, each once; faults meet the parsed ones by id.
    """
    best = settle(best_sop(faults, sops), "best")
    needed = sops.join(best.select("document_id").distinct(), "document_id", "left_semi")
    body = F.coalesce("content", "title", F.lit("No content available"))
    parsed = step_lists(
        needed.withColumn("content", body).withColumn("full_content", F.col("content")),
        ("title", "category", "full_content"),
    ).withColumn("_plan", rules.time_and_tools("category"))
    parsed = settle(parsed.withColumn("_parsed", F.lit(True)), "parsed")
    pick = lambda value, fallback: F.when(F.col("_parsed"), value).otherwise(fallback)
    matched = _with_best(
        faults.select("fault_id", "fault_code", "equipment_type", "fault_description"), best
    )
    return matched.join(parsed, "document_id", "left").select(
        "fault_id", "document_id",
        pick(F.col("title"), F.lit(fixed.GENERIC["title"])).alias("document_title"),
        "category",
        F.when(F.col("_parsed"), F.col("confidence")).alias("confidence"),
        *[
            pick(F.col(f"{s}_steps"), rules.strings(fixed.GENERIC[s])).alias(f"{s}_steps")
            for s in SECTIONS
        ],
        pick(F.col("_plan.estimated_time"), F.lit(fixed.GENERIC["time"])).alias("estimated_time"),
        pick(F.col("_plan.required_tools"), rules.strings(fixed.GENERIC["tools"]))
        .alias("required_tools"),
        pick(
            F.col("full_content"), F.concat(F.lit(fixed.GENERIC["content"]), "fault_description")
        ).alias("full_content"),
    )
