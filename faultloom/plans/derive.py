"""Fault and procedure tables derived from the given event and document tables.

Map-only projections: each derived row comes from one source row. The multipliers are primes, so
values spread over their ranges without random draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import strings
from ..operators.chunks import chunk_table

AS_OF = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, at: Column) -> Column:
    return F.get(strings(values), at.cast("int"))


def _sql_list(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fault per event: 6 of 10 are Minor, 3 Major, 1 a Cable Fault.

    Every 97th has no customer count (nor revenue) and every 101st no category.
    """
    names = list(fixed.CATEGORIES)
    spec = [fixed.CATEGORIES[n] for n in names]
    tier = lambda a, b, c: f"(case when tier < 6 then {a} when tier < 9 then {b} else {c} end)"
    fixed_text = lambda key: tier(*[f"'{s[key]}'" for s in spec])
    choice = lambda key, every: (
        "get(" + tier(*[_sql_list(s[key]) for s in spec]) + f", cast(e div {every} % 5 as int))"
    )
    at = lambda values, every: f"get({values}, cast(u div {every} % {{n}} as int))"
    kit = "if(u % 2 = 0, " + ", ".join(_sql_list(fixed.EQUIPMENT[n]) for n in ("COAX", "FIBER")) + ")"
    seconds = tier("1800 + e * 15485863 % 12601", "7200 + e * 15485863 % 36001",
                   "28800 + e * 15485863 % 144001")
    customers = tier("1 + e * 7919 % 50", "50 + e * 7919 % 451", "500 + e * 7919 % 4501")
    calls = tier("e * 104729 % 6", "5 + e * 104729 % 46", "50 + e * 104729 % 451")
    percent = tier("10 + e * 49979687 % 91", "40 + e * 49979687 % 41", "70 + e * 49979687 % 31")
    events = load(spark, sf_dir, "events").selectExpr(
        "event_id as e", "user_id as u", "ts", "event_type", "event_id % 10 as tier"
    )
    drawn = events.selectExpr(
        "*", f"{seconds} as seconds", f"if(e % 97 <> 0, {customers}, null) as customers"
    ).selectExpr("*", "cast(timestampadd(SECOND, cast(seconds as int), ts) as timestamp_ntz) as done")
    return drawn.selectExpr(
        "'F' || lpad(cast(e as string), 9, '0') as fault_id",
        "ts as fault_timestamp",
        f"{choice('codes', 10)} as fault_code",
        f"{choice('descriptions', 50)} as fault_description",
        f"if(e % 101 <> 0, {tier(*[repr(n) for n in names])}, null) as fault_category",
        "if(u % 2 = 0, 'COAX', 'FIBER') as network_type",
        f"{at(kit, 2).format(n=4)} as equipment_type",
        f"{at(_sql_list(fixed.LOCATIONS), 8).format(n=10)} as location",
        f"{fixed_text('severity')} as severity",
        f"{fixed_text('customer_impact')} as customer_impact",
        "cast(customers as int) as customers_affected",
        f"cast({calls} as int) as service_calls_generated",
        f"if(event_type = 'error' or done > timestamp_ntz '{AS_OF}', null, done) as resolution_timestamp",
        "cast(seconds as double) / 3600 as resolution_time_hours",
        f"e * 32452843 % 100 < {tier('42', '35', '20')} as first_time_fix",
        "if(tier < 9, 'General', 'Specialist') as technician_type_required",
        "cast(customers as double) * (10 + e % 91) as estimated_revenue_impact",
        f"cast({percent} as double) / 100 as priority_score",
    )


def _document_id(number: Column) -> Column:
    """Six digits at least; lpad alone would cut longer numbers, so that several rows shared one id."""
    digits = number.cast("string")
    return F.concat(F.lit("SOP-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0")))


def sop_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One procedure document per text, with attributes, file state and content."""
    d = F.col("doc_id")
    kind = (d % 5).cast("int")
    heading = (
        "SAFETY REQUIREMENTS:", "DIAGNOSTIC STEPS:", "REPAIR PROCEDURE:", "VERIFICATION:",
        "EQUIPMENT REPAIR NOTES:",
    )
    lists = lambda values: F.get(F.array(*[strings(v) for v in values]), kind)
    return load(spark, sf_dir, "documents").select(
        _document_id(d).alias("document_id"),
        F.concat(_document_id(d), F.lit(".pdf")).alias("file_path"),
        _pick(fixed.SOP_TITLES, kind).alias("title"),
        _pick(fixed.SOP_CATEGORIES, kind).alias("category"),
        lists(fixed.SOP_EQUIPMENT).alias("equipment_types"),
        lists(fixed.SOP_CODES).alias("fault_codes"),
        (d % 17 != 0).alias("is_active"),
        F.when(d % 19 == 0, "DELETED").otherwise("ACTIVE").alias("file_status"),
        F.concat(_pick(heading, kind), F.lit("\n"), "text").alias("content"),
    )


def sop_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The procedure documents with their lines made into headed, numbered and dashed steps.

    Every ninth line opens a section; the others get a mark by position, and dashed ones also
    name a fault code.
    """
    heading = (
        "SAFETY REQUIREMENTS:", "DIAGNOSTIC STEPS:", "REPAIR PROCEDURES:", "VERIFICATION:",
        "Notes on tools:",
    )
    marks = ("1. ", "2. ", "3. ", "4. ", "5. ", "6. ", "- ", "")
    codes = [c for spec in fixed.CATEGORIES.values() for c in spec["codes"]]
    d = F.col("_number")

    def line(text: Column, i: Column) -> Column:
        at = i % 9
        opened = F.concat(
            F.when(i > 0, "\n").otherwise(""), _pick(heading, (F.floor(i / 9) + d) % 5),
            F.lit("\n  "), text,
        )
        named = F.concat(F.lit("Check code "), _pick(codes, (d + i) % 15), F.lit(" "))
        step = F.concat(_pick(marks, at - 1), F.when(at == 7, named).otherwise(""), text)
        return F.when(at == 0, opened).otherwise(step)

    documents = sop_documents(spark, sf_dir).withColumn(
        "_number", F.substring("document_id", 5, 12).cast("long")
    )
    body = F.expr("substring(content, locate('\n', content) + 1)")
    rewritten = F.array_join(F.transform(F.split(body, "\n"), line), "\n")
    return documents.withColumn("content", rewritten).drop("_number")


def sop_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows of the documents; the text column is not read."""
    return sop_documents(spark, sf_dir).select(
        "document_id", "file_path", "title", "category", "equipment_types", "fault_codes",
        F.lit("1.0").alias("document_version"),
        F.lit(AS_OF).cast("timestamp_ntz").cast("date").alias("last_reviewed"),
        "is_active",
    )


def sop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows of the documents."""
    return sop_documents(spark, sf_dir).select(
        "file_path", F.concat(F.lit("stage/"), "file_path").alias("file_url"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("last_modified"), "file_status",
    )


def sop_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(sop_documents(spark, sf_dir))


def labelled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the labelled documents only, as an earlier load left it."""
    d = F.col("doc_id")
    return load(spark, sf_dir, "labels").select(
        _document_id(d).alias("document_id"),
        F.concat(F.lit("Reviewed, quality "), F.col("quality").cast("string")).alias("title"),
        F.lit("Reviewed").alias("category"),
        (F.col("toxic") == 0).alias("is_active"),
    )


def listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing made from the pages: path, url, size and checksum."""
    p = F.col("page_id")
    return load(spark, sf_dir, "pages").select(
        F.concat(_document_id(p * 7), F.lit(".pdf")).alias("file_path"),
        F.col("url").alias("file_url"),
        F.length("html").cast("long").alias("file_size"),
        F.md5("html").alias("md5"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts: every distinct sentence of the benchmark passages."""
    sentences = F.explode(F.split("text", r"\.")).alias("query_text")
    return (
        load(spark, sf_dir, "benchmark").select(sentences)
        .select(F.btrim("query_text", F.lit(" \n")).alias("query_text"))
        .filter(F.col("query_text") != "").distinct()
    )


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose number 20 divides, with a search text by number."""
    asked = (
        "diagnostic steps", "safety requirements", "repair procedure", "verification", "cable fault",
        "signal level", "equipment repair notes", "service degradation", "network security",
    )
    v = F.col("vec_id")
    return load(spark, sf_dir, "embeddings").filter(v % 20 == 0).select(
        v.alias("query_id"), _pick(asked, F.floor(v / 20) % len(asked)).alias("query_text"),
        F.col("embedding").alias("vector"),
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors by document; vec_id is the number of a document."""
    return load(spark, sf_dir, "embeddings").select(
        _document_id(F.col("vec_id")).alias("document_id"), F.col("embedding").alias("vector")
    )


def fault_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct question a fault gives rise to."""
    return faults(spark, sf_dir).select(
        F.col("fault_description").alias("question"), "equipment_type", "fault_code"
    ).distinct()
