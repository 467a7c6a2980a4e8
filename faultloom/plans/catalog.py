"""Registered queries: name -> function of (spark, sf_dir) -> DataFrame.

Each reads the given tables whole. Arrays and structs are flattened to text and doubles rounded to
six places, so that results can be compared value for value with the SQL of plans.oracle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import objects, rules, sql, text
from ..operators import chunks as ch
from ..operators import faults as fl
from ..operators import cube, deltas, merge, metrics, procedures, quality, search, vector_index, vectors
from ..session import tune, work_dir
from ..sources import files, tables
from ..sources.tables import settle
from ..streaming import chunk_refresh, index_refresh, ingest
from . import batch, derive
from .derive import AS_OF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query; it runs with the library's session settings."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def flat(df: DataFrame) -> DataFrame:
    """Round doubles, join string arrays."""
    def shape(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        return c.alias(f.name)

    return df.select(*[shape(f) for f in df.schema.fields])


def enhanced(spark, sf):
    return fl.enhance(derive.faults(spark, sf), AS_OF)


def analysis(spark, sf):
    return fl.fault_analysis(enhanced(spark, sf), AS_OF)


def dashboard(spark, sf):
    return fl.with_predictions(enhanced(spark, sf), AS_OF)


def index(spark, sf, **options):
    """The index, cut from the documents as it is read; no chunk moves."""
    return search.index_documents(derive.sop_documents(spark, sf), derive.sop_metadata(spark, sf), **options)


def cut_index(spark, sf):
    """The index written once, for searches that read it more than once."""
    return settle(index(spark, sf), "index")


def stored_index(spark, sf, **options):
    """The index written as build_corpus writes it: chunks and postings."""
    return search.store_index(index(spark, sf, **options), work_dir(spark, "index"))


# --- fault projections and rules ----------------------------------------------

@query
def faults_enhanced(spark, sf):
    return flat(enhanced(spark, sf))


@query
def hours_since_modes(spark, sf):
    now = rules.moment(AS_OF)
    end = F.coalesce("resolution_timestamp", now)
    return flat(derive.faults(spark, sf).select(
        "fault_id",
        rules.hours_since("fault_timestamp", end).alias("to_resolution_or_now"),
        rules.hours_since("fault_timestamp", now).alias("to_now"),
        rules.hours_since("fault_timestamp", now, "fraction").alias("to_now_exact"),
    ))


@query
def business_hours_presets(spark, sf):
    return derive.faults(spark, sf).select(
        "fault_id",
        rules.business_hours("fault_timestamp").alias("weekdays"),
        rules.business_hours("fault_timestamp", 2, 6).alias("training"),
    )


@query
def risk_levels(spark, sf):
    return analysis(spark, sf).select(
        "fault_id",
        rules.risk_level("original_priority_score").alias("original_risk"),
        rules.risk_level("calculated_priority_score").alias("calculated_risk"),
    )


@query
def sla_breach_variants(spark, sf):
    e = enhanced(spark, sf)
    now = rules.moment(AS_OF)
    exact = rules.hours_since("fault_timestamp", now, "fraction")
    whole = rules.hours_since("fault_timestamp", now)
    predicted = rules.classify_fault("fault_code", "customers_affected", "service_calls_generated")
    return e.select(
        "fault_id",
        F.col("sla_breach_risk").alias("by_category"),
        rules.sla_breach(predicted, whole).alias("by_prediction"),
        rules.sla_breach_by_score("priority_score", exact).alias("by_score"),
    )


@query
def classify_faults(spark, sf):
    return derive.faults(spark, sf).select(
        "fault_id", "fault_code", "fault_category",
        rules.classify_fault("fault_code", "customers_affected", "service_calls_generated")
        .alias("predicted_category"),
    )


@query
def priority_scores(spark, sf):
    return analysis(spark, sf).select("fault_id", "calculated_priority_score")


@query
def technician_recommendation(spark, sf):
    return flat(analysis(spark, sf).select("fault_id", "technician_recommendation.*"))


@query
def fault_features(spark, sf):
    df = fl.fault_features(enhanced(spark, sf))
    return df.withColumn("features", F.to_json("features"))


@query
def training_features(spark, sf):
    df = fl.training_features(derive.faults(spark, sf))
    return df.withColumn("features", F.to_json("features"))


@query
def train_split(spark, sf):
    train, _ = fl.split_train_test(fl.fault_features(enhanced(spark, sf)).drop("features"))
    return train


@query
def test_split(spark, sf):
    _, test = fl.split_train_test(fl.fault_features(enhanced(spark, sf)).drop("features"))
    return test


@query
def fault_analysis(spark, sf):
    df = analysis(spark, sf)
    kind = F.col("technician_recommendation")
    return flat(df.withColumns({
        "technician_type": kind["technician_type"],
        "skill_requirements": kind["skill_requirements"],
        "estimated_duration_hours": kind["estimated_duration_hours"],
        "tools_required": kind["tools_required"],
    }).drop("technician_recommendation"))


@query
def fault_triage(spark, sf):
    return flat(fl.fault_triage(analysis(spark, sf)).orderBy(*fl.triage_order()))


@query
def faults_with_predictions(spark, sf):
    return flat(dashboard(spark, sf).select(
        "fault_id", "predicted_category", "calculated_priority_score", "risk_level",
        "sla_breach_risk", "hours_since_fault", "created_date", "resolution_date",
        "business_hours_fault", "is_resolved",
    ))


@query
def joined_predictions(spark, sf):
    """The joining form: a triage table built apart, joined on fault_id."""
    stored = fl.fault_triage(analysis(spark, sf))
    df = fl.join_predictions(enhanced(spark, sf), stored, AS_OF, sla="score")
    return flat(df.select(
        "fault_id", "predicted_category", "calculated_priority_score", "risk_level",
        "sla_breach_risk", "hours_since_fault",
    ))


@query
def dashboard_slice(spark, sf):
    df = fl.dashboard_slice(
        dashboard(spark, sf), "2024-01-05", "2024-01-25", location="Aarhus North", risk="HIGH"
    )
    return flat(df.select(
        "fault_id", "fault_timestamp", "location", "fault_category", "risk_level",
        "calculated_priority_score",
    ))


@query
def triage_display(spark, sf):
    shown = fl.triage_display(dashboard(spark, sf))
    return shown.withColumn("highlight", fl.triage_highlight("risk_level"))


@query
def critical_alerts(spark, sf):
    return flat(fl.critical_alerts(dashboard(spark, sf)))


@query
def priority_timeline(spark, sf):
    return flat(fl.priority_timeline(dashboard(spark, sf)))


@query
def assigned_faults(spark, sf):
    return flat(fl.assigned_faults(dashboard(spark, sf)))


@query
def repair_template(spark, sf):
    return derive.faults(spark, sf).select(
        "fault_id",
        text.render_procedure("fault_description", "equipment_type", "fault_code")
        .alias("procedure_text"),
        text.procedure_query("fault_description", "equipment_type", "fault_code")
        .alias("search_query"),
        text.enhance_query("fault_description", "fault_code", "equipment_type")
        .alias("enhanced_query"),
    )


# --- aggregations ---------------------------------------------------------------

@query
def technician_metrics(spark, sf):
    return flat(metrics.technician_metrics(enhanced(spark, sf), AS_OF))


@query
def equipment_reliability(spark, sf):
    return flat(metrics.equipment_reliability(enhanced(spark, sf), AS_OF))


@query
def fault_quality_summary(spark, sf):
    return flat(metrics.fault_quality_summary(enhanced(spark, sf)))


@query
def model_confusion(spark, sf):
    return flat(metrics.model_confusion(analysis(spark, sf)))


@query
def model_accuracy(spark, sf):
    return flat(metrics.model_accuracy(analysis(spark, sf)))


@query
def kpi_row(spark, sf):
    return flat(metrics.kpis(dashboard(spark, sf)))


@query
def category_impact(spark, sf):
    return flat(metrics.category_impact(dashboard(spark, sf)))


@query
def location_impact(spark, sf):
    return flat(metrics.location_impact(dashboard(spark, sf)))


@query
def location_rollup(spark, sf):
    return flat(metrics.location_rollup(metrics.location_impact(dashboard(spark, sf))))


@query
def fault_profile(spark, sf):
    return flat(metrics.fault_profile(derive.faults(spark, sf)))


@query
def facet_values(spark, sf):
    return metrics.facet_values(derive.faults(spark, sf), "location")


@query
def load_summary(spark, sf):
    e = enhanced(spark, sf)
    return metrics.load_summary({
        "Network Faults": derive.faults(spark, sf),
        "Training Data": fl.training_features(derive.faults(spark, sf)),
        "Technician Metrics": metrics.technician_metrics(e, AS_OF),
        "Equipment Reliability": metrics.equipment_reliability(e, AS_OF),
        "PDF Files": derive.sop_files(spark, sf),
        "Document Metadata": derive.sop_metadata(spark, sf),
        "Document Chunks": derive.sop_chunks(spark, sf),
    })


# --- documents ------------------------------------------------------------------

@query
def chunk_documents(spark, sf):
    return ch.chunk_text(derive.sop_documents(spark, sf))


@query
def searchable_chunks(spark, sf):
    return flat(ch.searchable_documents(
        derive.sop_documents(spark, sf), derive.sop_metadata(spark, sf), derive.sop_files(spark, sf)
    ))


@query
def chunk_stats(spark, sf):
    return flat(metrics.chunk_stats(derive.sop_chunks(spark, sf)))


@query
def searchable_summary(spark, sf):
    return metrics.searchable_summary(ch.searchable_documents(
        derive.sop_documents(spark, sf), derive.sop_metadata(spark, sf), derive.sop_files(spark, sf)
    ))


@query
def chunk_inventory(spark, sf):
    return metrics.chunk_inventory(derive.sop_chunks(spark, sf))


@query
def chunk_preview(spark, sf):
    return ch.chunk_preview(derive.sop_chunks(spark, sf))


@query
def chunk_metrics(spark, sf):
    return ch.chunk_metrics(derive.sop_chunks(spark, sf))


@query
def document_list(spark, sf):
    return ch.document_list(derive.sop_metadata(spark, sf))


@query
def document_stats(spark, sf):
    return ch.document_stats(derive.sop_documents(spark, sf))


@query
def document_lines(spark, sf):
    return ch.classify_lines(derive.sop_procedures(spark, sf))


@query
def reassembled_texts(spark, sf):
    pieces = ch.chunk_text(derive.sop_documents(spark, sf), min_len=-1)
    return ch.reassemble(pieces).select(
        "document_id", "chunk_count", F.length("content").alias("char_count"),
        F.md5("content").alias("content_md5"),
    )


@query
def context_chunks(spark, sf):
    chunks = derive.sop_chunks(spark, sf)
    targets = chunks.filter(F.col("chunk_type") != "CONTENT").select(
        F.col("chunk_id").alias("target_chunk_id"), "document_id", "chunk_sequence"
    )
    return ch.context_chunks(chunks, targets)


@query
def context_window(spark, sf):
    df = ch.context_window(derive.sop_chunks(spark, sf))
    return df.withColumn("neighbour_ids", F.array_join(F.array_sort("neighbour_ids"), "|"))


@query
def conversation_tail(spark, sf):
    return ch.conversation_tail(derive.load(spark, sf, "conversations"), 3)


# --- search and retrieval ---------------------------------------------------------

@query
def search_chunks(spark, sf):
    return search.search_chunks(index(spark, sf), "safety requirements")


@query
def search_chunks_filtered(spark, sf):
    return search.search_chunks(
        index(spark, sf), "the", category="Major", equipment="Nokia 7750", k=25
    )


@query
def search_chunks_wildcard(spark, sf):
    return search.search_chunks(index(spark, sf), "d_agnostic%steps", chunk_type="DIAGNOSTIC")


@query
def search_many(spark, sf):
    return search.search_many(cut_index(spark, sf), derive.benchmark_queries(spark, sf))


@query
def find_similar(spark, sf):
    return flat(search.find_similar(index(spark, sf, min_len=None), "cable fault", k=20))


@query
def indexed_similar(spark, sf):
    """find_similar by the postings of a stored index."""
    return flat(search.find_similar(stored_index(spark, sf, min_len=None), "cable fault", k=20))


@query
def search_documents(spark, sf):
    return search.search_documents(derive.sop_procedures(spark, sf), "check code 812", k=20)


@query
def excerpts(spark, sf):
    return derive.sop_procedures(spark, sf).select(
        "document_id", text.excerpt("content", F.lit("check code")).alias("excerpt")
    )


@query
def fault_context(spark, sf):
    df = search.fault_context(derive.faults(spark, sf), index(spark, sf))
    shown = lambda x: F.concat_ws("/", x["position"].cast("string"), x["chunk_id"], x["document_id"], x["chunk_type"])
    return df.withColumn("context", F.array_join(F.transform("context", shown), "|"))


@query
def ask_questions(spark, sf):
    return _asked(search.ask_questions(cut_index(spark, sf), derive.fault_questions(spark, sf)))


@query
def indexed_questions(spark, sf):
    """ask_questions by the postings of a stored index."""
    return _asked(search.ask_questions(stored_index(spark, sf), derive.fault_questions(spark, sf)))


def _asked(df):
    shown = lambda x: F.concat_ws(
        "/", x["rank"].cast("string"), x["chunk_id"], x["document_id"], F.format_string("%.2f", x["relevance_score"])
    )
    return df.withColumn("source_chunks", F.array_join(F.transform("source_chunks", shown), "|"))


@query
def chat_answers(spark, sf):
    return search.chat_answers(cut_index(spark, sf), derive.benchmark_queries(spark, sf))


@query
def vector_topk(spark, sf):
    vectors_ = derive.load(spark, sf, "embeddings")
    return flat(vectors.vector_topk(vectors_, vectors_, skip_same=True))


@query
def vector_index_topk(spark, sf):
    """The nearest rows of every vector whose number 20 divides, through a stored index."""
    vectors_ = derive.load(spark, sf, "embeddings")
    made = vector_index.write_index(vectors_, work_dir(spark, "vectors"))
    return flat(vector_index.index_topk(made, vectors_.filter("vec_id % 20 = 0"), skip_same=True))


@query
def hybrid_search(spark, sf):
    """For every vector whose number 20 divides, the best documents by similarity and text, blended."""
    return flat(search.hybrid_many(
        derive.hybrid_queries(spark, sf), derive.document_vectors(spark, sf),
        derive.sop_documents(spark, sf), k=50,
    ))


@query
def search_in_document(spark, sf):
    return search.search_chunks(index(spark, sf), "the", document_id="SOP-000001", k=10)


# --- the SQL surface ----------------------------------------------------------------

def _sql(spark, sf, statement: str) -> DataFrame:
    """A statement over the library's SQL functions and views of the derived tables."""
    sql.create_views(
        spark, AS_OF, faults=derive.faults(spark, sf), chunks=derive.sop_chunks(spark, sf),
        metadata=derive.sop_metadata(spark, sf), files=derive.sop_files(spark, sf),
    )
    sql.register_functions(spark)
    return spark.sql(statement)


@query
def sql_classify(spark, sf):
    return _sql(spark, sf, """
        select fault_id, fault_code, fault_category, classify_fault(fault_code, network_type, equipment_type, location,
          customers_affected, service_calls_generated, hour(fault_timestamp), dayofweek(fault_timestamp), true)
          as predicted_category from network_faults""")


@query
def sql_scores(spark, sf):
    return _sql(spark, sf, """
        select fault_id, round(calculate_priority_score(fault_category, customers_affected, service_calls_generated,
          business_hours_fault, equipment_type), 6) as calculated_priority_score
        from vw_network_faults_enhanced""")


@query
def sql_technician(spark, sf):
    return flat(_sql(spark, sf, """
        select fault_id, t.* from (select fault_id, recommend_technician(actual_category, equipment_type, location,
          original_priority_score) as t from vw_fault_analysis)"""))


@query
def sql_chunks(spark, sf):
    derive.sop_documents(spark, sf).createOrReplaceTempView("sop_documents")
    return _sql(spark, sf, """
        select d.document_id, c.chunk_sequence, c.chunk_text, c.chunk_type, c.section_name, c.char_start as char_start_position,
          c.char_end as char_end_position
        from sop_documents d, lateral create_meaningful_chunks(d.content, d.document_id, d.file_path) c""")


@query
def sql_context(spark, sf):
    return _sql(spark, sf, "select * from get_contextual_chunks('SOP-000001-C002', 2)")


@query
def sql_search(spark, sf):
    return _sql(spark, sf, "select * from search_sop_chunks('safety requirements', result_limit => 10)")


@query
def sql_similar(spark, sf):
    return flat(_sql(spark, sf, "select * from find_similar_faults('cable fault', 0.3, 20)"))


# --- repair procedures ------------------------------------------------------------

@query
def best_sop(spark, sf):
    return flat(procedures.best_sop(derive.faults(spark, sf), settle(derive.sop_procedures(spark, sf), "procedures")))


@query
def repair_steps(spark, sf):
    return procedures.repair_steps(derive.sop_procedures(spark, sf))


@query
def repair_procedures(spark, sf):
    df = procedures.repair_procedures(derive.faults(spark, sf), settle(derive.sop_procedures(spark, sf), "procedures"))
    return flat(df.withColumn("full_content", F.md5("full_content")))


# --- merges and quality -----------------------------------------------------------

@query
def upsert_files(spark, sf):
    stamp = F.lit(AS_OF).cast("timestamp_ntz")
    target = derive.sop_files(spark, sf).withColumns({
        "file_size": F.lit(0).cast("long"), "md5": F.lit("old"),
        "updated_timestamp": F.lit("2024-01-01").cast("timestamp_ntz"),
    })
    return merge.upsert(
        target, derive.listed_pages(spark, sf), ["file_path"], ["file_url", "file_size", "md5"],
        on_update={"updated_timestamp": stamp},
        on_insert={"file_status": F.lit("ACTIVE"), "updated_timestamp": stamp},
    )


@query
def insert_missing_metadata(spark, sf):
    source = derive.sop_metadata(spark, sf).select("document_id", "title", "category", "is_active")
    return merge.insert_missing(derive.labelled_metadata(spark, sf), source, ["document_id"])


@query
def chunk_orphans(spark, sf):
    orphaned = quality.orphans(
        derive.sop_chunks(spark, sf), derive.labelled_metadata(spark, sf), "document_id"
    )
    return orphaned.select("chunk_id", "document_id")


@query
def null_counts(spark, sf):
    return quality.null_counts(derive.faults(spark, sf))


@query
def dq_report(spark, sf):
    return quality.dq_report(
        derive.faults(spark, sf), derive.labelled_metadata(spark, sf).withColumn(
            "file_path", F.concat("document_id", F.lit(".pdf"))
        ),
        derive.sop_files(spark, sf), derive.sop_chunks(spark, sf),
    )


@query
def schema_report(spark, sf):
    """Required columns that loads lack, with the rows of these loads."""
    loads = {
        "network_faults": (derive.faults(spark, sf).drop("location"), quality.REQUIRED_FAULT_COLUMNS),
        "sop_documents": (derive.sop_documents(spark, sf).drop("title", "content"), quality.REQUIRED_DOCUMENT_COLUMNS),
    }
    rows = [
        df.agg(F.count(F.lit(1)).alias("record_count")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(quality.missing_columns(df, required))).alias("missing"), "record_count"
        )
        for name, (df, required) in loads.items()
    ]
    return rows[0].unionByName(rows[1])


@query
def count_report(spark, sf):
    made = metrics.load_summary({"Network Faults": derive.faults(spark, sf), "PDF Files": derive.sop_files(spark, sf)})
    return quality.record_counts(made, {"Network Faults": 1000, "PDF Files": 1000})


# --- sources, batch jobs and streams ------------------------------------------------

@query
def normalized_faults(spark, sf):
    """Faults as another system names them: upper case, another time column, no score."""
    raw = derive.faults(spark, sf).select("fault_id", F.col("fault_timestamp").alias("created_at"), "fault_code", "location")
    made = fl.normalize_schema(raw.toDF(*[c.upper() for c in raw.columns]))
    return made.select("fault_id", "fault_timestamp", "resolution_timestamp", "fault_code", "location", "fault_category", "priority_score")


@query
def appended_training(spark, sf):
    """Training rows appended in two loads."""
    path = work_dir(spark, "training")
    rows = fl.training_features(derive.faults(spark, sf))
    for part in (0, 1):
        tables.write_append(rows.filter(rules.hash_bucket("fault_id", 2) == part), path)
    return tables.read_table(spark, path).withColumn("features", F.to_json("features"))


@query
def filled_defaults(spark, sf):
    """Metadata that gives no version, author or dates, filled at ingest."""
    raw = derive.sop_metadata(spark, sf).drop("document_version", "last_reviewed").withColumn(
        "is_active", F.when(F.col("is_active"), True)
    )
    made = files.metadata_defaults(raw, AS_OF)
    return made.select("document_id", "document_version", "author", "creation_date", "last_reviewed", "is_active",
                       "created_timestamp", "updated_timestamp")


@query
def json_documents(spark, sf):
    """Documents written as JSON lines and read back."""
    path = work_dir(spark, "json")
    named = ("document_id", "title", "category", "equipment_types", "fault_codes", "content")
    files.export_json(derive.sop_documents(spark, sf).select(*named), path)
    return flat(files.read_sop_json(spark, path, one_per_file=False).withColumn("content", F.md5("content")))


@query
def rejected_rows(spark, sf):
    """What the CSV load rejects: every thirteenth fault has a count that is no number."""
    path = work_dir(spark, "faults-csv")
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("null"))
    spoilt = F.substring("fault_id", 2, 12).cast("long") % 13 == 0
    rows = derive.faults(spark, sf).withColumns({c: shown(c) for c in ("fault_timestamp", "resolution_timestamp")})
    files.export_csv(rows.withColumn("customers_affected", F.when(spoilt, "many").otherwise(F.col("customers_affected").cast("string"))), path)
    _, bad = files.read_faults_csv(spark, path)
    return bad.select(F.get_json_object("raw", "$.fault_id").alias("fault_id"), F.col("_reason").alias("reason"))


def _faults_as_csv(spark, sf):
    """The derived faults as CSV files, with a null token in place of an unknown resolution."""
    path = work_dir(spark, "faults-csv")
    times = ("fault_timestamp", "resolution_timestamp")
    shown = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("null"))
    files.export_csv(derive.faults(spark, sf).withColumns({c: shown(c) for c in times}), path)
    return path


@query
def csv_load(spark, sf):
    good, _ = files.read_faults_csv(spark, _faults_as_csv(spark, sf))
    return flat(good)


@query
def batch_load(spark, sf):
    """CSV to fault table and derived tables; the load summary."""
    made = batch.load_faults(spark, _faults_as_csv(spark, sf), work_dir(spark, "load"), AS_OF)
    return made["summary"]


@query
def corpus_build(spark, sf):
    """Documents to files, metadata, chunks and index; rows per table and per chunk type."""
    made = batch.build_corpus(
        spark, derive.sop_documents(spark, sf), derive.sop_metadata(spark, sf),
        derive.sop_files(spark, sf), work_dir(spark, "corpus"),
    )
    types = made["chunk_stats"].select(
        F.concat(F.lit("Chunks "), "chunk_type").alias("table_name"),
        F.col("chunk_count").alias("record_count"),
    )
    indexed = metrics.load_summary({"Index": made["index"]})
    return made["summary"].unionByName(types).unionByName(indexed)


@query
def streamed_faults(spark, sf):
    """Faults that arrive as CSV files, through the ingest stream."""
    root = work_dir(spark, "ingest")
    ingest.stream_faults(
        spark, _faults_as_csv(spark, sf), f"{root}/good", f"{root}/bad", f"{root}/checkpoint"
    ).awaitTermination()
    return flat(ingest.ingested(spark, f"{root}/good"))


@query
def streamed_chunks(spark, sf):
    """Documents that arrive in two versions, through the refresh stream, every other one with the
    newer version first. The older version holds the title only and must not replace the newer."""
    root = work_dir(spark, "refresh")
    documents = derive.sop_documents(spark, sf).select("document_id", "file_path", "title", "content")
    late = F.substring("document_id", -1, 1).cast("int") % 2 == 1
    for newer in (late, ~late):
        documents.select(
            "document_id", "file_path", F.when(newer, F.col("content")).otherwise(F.col("title")).alias("content"),
            F.when(newer, AS_OF).otherwise("2024-01-30").cast("timestamp_ntz").alias("updated_timestamp"),
        ).write.mode("append").parquet(f"{root}/documents")
        chunk_refresh.stream_chunks(
            spark, f"{root}/documents", f"{root}/log", f"{root}/checkpoint", interval=None
        ).awaitTermination()
    return chunk_refresh.current_chunks(spark, f"{root}/log").drop("page_number", "is_meaningful")




@query
def streamed_index(spark, sf):
    """The postings of documents that arrive in two versions, every other one with the newer version first."""
    root = work_dir(spark, "index-refresh")
    documents = derive.sop_documents(spark, sf).select("document_id", "title", "content")
    late = F.substring("document_id", -1, 1).cast("int") % 2 == 1
    for newer in (late, ~late):
        documents.select(
            "document_id", F.when(newer, F.col("content")).otherwise(F.col("title")).alias("content"),
            F.when(newer, AS_OF).otherwise("2024-01-30").cast("timestamp_ntz").alias("updated_timestamp"),
        ).write.mode("append").parquet(f"{root}/documents")
        index_refresh.stream_index(
            spark, f"{root}/documents", f"{root}/log", f"{root}/checkpoint"
        ).awaitTermination()
    left = index_refresh.current_index(spark, f"{root}/log")
    return left.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(F.size("places")).alias("places"),
        F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x)).alias("place_sum"),
    )


@query
def streamed_faults_dedup(spark, sf):
    """Faults that arrive week by week, some of them again and some weeks late, through the stream that
    takes each once by event time."""
    root = work_dir(spark, "dedup")
    faults = derive.faults(spark, sf)
    e, day = F.substring("fault_id", 2, 9).cast("long"), F.dayofmonth("fault_timestamp")
    held = (e % 101 == 0) & (day < 8)
    for week, (first, last) in enumerate(((0, 8), (8, 15), (15, 22), (22, 32))):
        own = (day >= first) & (day < last) & ~held
        again = (e % 7 == 0) & (day >= first - 7) & (day < first) & ~held
        rows = faults.filter(own).unionAll(faults.filter((e % 7 == 0) & own)).unionAll(faults.filter(again))
        if week == 3:
            rows = rows.unionAll(faults.filter(held))
        rows.write.mode("append").parquet(f"{root}/landed")
        # a week is one batch, however many files it came in: within a week nothing is late
        ingest.dedup_faults(
            spark, f"{root}/landed", f"{root}/faults", f"{root}/checkpoint", faults.schema, files_per_batch=2**31 - 1
        ).awaitTermination()
    accepted = ingest.ingested(spark, f"{root}/faults")
    late = ingest.late_faults(spark.read.schema(faults.schema).parquet(f"{root}/landed"), accepted)
    state = lambda df, name: df.select("fault_id", "fault_timestamp", F.lit(name).alias("state"))
    return state(accepted, "accepted").unionByName(state(late, "late"))


def _event_objects(spark, sf):
    """A JSON object per event, with the event's own object inside, an array, and texts that are no JSON."""
    e = F.col("event_id")
    made = F.to_json(F.struct(
        F.col("event_type").alias("technician_type"), (F.col("user_id") / 4).alias("estimated_duration_hours"),
        F.array(e % 3, e % 5).alias("skills"), F.struct(F.from_json("props", "k int").alias("props"), F.when(e % 2 == 0, "yes").alias("flag")).alias("detail"),
    ))
    return derive.load(spark, sf, "events").select("event_id", F.when(e % 50 == 49, F.concat(F.lit("{broken "), made)).when(e % 51 != 50, made).alias("recommendation"))


@query
def object_paths(spark, sf):
    """Typed columns of paths into raw JSON objects."""
    return flat(objects.shred(_event_objects(spark, sf), "recommendation", {
        "technician_type": ("technician_type", "string"), "duration": ("estimated_duration_hours", "double"),
        "second_skill": ("skills[1]", "int"), "k": ("detail.props.k", "int"), "flag": ("detail.flag", "string"),
        "absent": ("detail.none", "string"), "not_a_number": ("technician_type", "int"),
    }).drop("recommendation"))


@query
def upsert_in_buckets(spark, sf):
    """upsert_files as a merge in place that touches the buckets of the listing only."""
    path, stamp = work_dir(spark, "files"), F.lit(AS_OF).cast("timestamp_ntz")
    target = derive.sop_files(spark, sf).withColumns({
        "file_size": F.lit(0).cast("long"), "md5": F.lit("old"),
        "updated_timestamp": F.lit("2024-01-01").cast("timestamp_ntz"),
    })
    merge.write_buckets(target, path, ["file_path"], 32)
    merge.upsert_buckets(
        spark, path, derive.listed_pages(spark, sf), ["file_path"], 32, ["file_url", "file_size", "md5"],
        on_update={"updated_timestamp": stamp},
        on_insert={"file_status": F.lit("ACTIVE"), "updated_timestamp": stamp},
    )
    return merge.read_buckets(spark, path)


@query
def kpi_row_incremental(spark, sf):
    """kpi_row kept by deltas: two thirds of the faults first, then corrections of a sixth with the rest, then
    the sixth as it is in the end."""
    path, keys, buckets = work_dir(spark, "faults"), ["fault_id"], 16
    faults = derive.faults(spark, sf)
    e = F.substring("fault_id", 2, 9).cast("long")
    wrong = faults.withColumns({"customers_affected": F.lit(7), "resolution_timestamp": F.lit(None).cast("timestamp_ntz")})
    first = faults.filter((e % 3 < 2) & (e % 6 != 0)).unionByName(wrong.filter((e % 3 < 2) & (e % 6 == 0)))
    second = faults.filter(e % 3 == 2).unionByName(wrong.filter(e % 6 == 1))
    third = faults.filter(e % 6 < 2)
    shown = lambda rows: fl.with_predictions(fl.enhance(rows, AS_OF), AS_OF)
    merge.write_buckets(first, path, keys, buckets)
    state = settle(deltas.kpi_sums(shown(merge.read_buckets(spark, path))), "state")
    for batch in (second, third):
        old, new = merge.changed_rows(spark, path, batch, keys, buckets)
        state = settle(deltas.apply_changes(state, shown(old), shown(new)), "state")
        merge.upsert_buckets(spark, path, batch, keys, buckets, [c for c in faults.columns if c not in keys])
    return flat(deltas.kpi_view(state))


@query
def dashboard_cube(spark, sf):
    """The KPI rows of all combinations of location, category, risk and four date ranges, from one build."""
    frame = dashboard(spark, sf)
    made = settle(cube.build_cube(frame), "cube")
    values = lambda c: F.concat(F.array(F.lit("All")), F.sort_array(F.collect_set(c)))
    found = made.agg(*[values(c).alias(c) for c in cube.KEYS])
    day = lambda d: F.lit(d).cast("date")
    ranges = F.array(*[F.struct(F.lit(n).alias("range"), day(a).alias("first_day"), day(b).alias("last_day")) for n, a, b in (
        ("all", None, None), ("week 2", "2024-01-08", "2024-01-14"), ("from 20", "2024-01-20", None), ("to 3", None, "2024-01-03"))])
    slices = found.select(ranges.alias("r"), *cube.KEYS).select(F.inline("r"), *cube.KEYS)
    for c in cube.KEYS:
        slices = slices.withColumn(c, F.explode(c))
    slices = slices.withColumn("slice_id", F.concat_ws("|", "range", *cube.KEYS))
    return flat(cube.slice_kpis(made, slices))
