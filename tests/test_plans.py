"""Physical plans: what must not be in them, what must, and behaviour under skew."""

import pytest
from pyspark.sql import functions as F

from faultloom.operators import chunks as ch
from faultloom.operators import faults as fl
from faultloom.operators import metrics
from faultloom.operators.textmatch import first_per
from faultloom.plans import catalog, derive
from faultloom.schemas import FAULTS

SF = "/root/testdata/sf0.001"
MAP_ONLY = """faults_enhanced hours_since_modes business_hours_presets risk_levels sla_breach_variants
 classify_faults priority_scores technician_recommendation fault_features training_features
 train_split test_split fault_analysis faults_with_predictions dashboard_slice triage_display
 repair_template chunk_documents chunk_metrics document_list document_stats document_lines excerpts
 repair_steps""".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_nested_loops_and_no_row_python(spark, name):
    shown = plan(catalog.QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in shown
    if name in MAP_ONLY:
        assert "Exchange" not in shown


def test_top_k_per_key_is_cut_before_the_shuffle(spark):
    messages = derive.load(spark, SF, "conversations")
    for df in (ch.conversation_tail(messages, 3), first_per(messages, "conv_id", ["turn"], 2)):
        shown = plan(df)
        assert shown.count("WindowGroupLimit") == 2
        assert "Partial" in shown


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = f"{tmp_path}/faults"
    derive.faults(spark, SF).write.parquet(path)
    frame = fl.with_predictions(fl.enhance(spark.read.parquet(path), derive.AS_OF), derive.AS_OF)
    sliced = fl.dashboard_slice(frame, "2024-01-05", "2024-01-25", location="Vejle")
    shown = plan(metrics.location_impact(sliced))
    for pushed in (
        "IsNull(resolution_timestamp)", "EqualTo(location,Vejle)",
        "GreaterThanOrEqual(fault_timestamp", "LessThan(fault_timestamp",
    ):
        assert pushed in shown
    read = shown[shown.index("ReadSchema"):]
    assert "fault_description" not in read and "severity" not in read
    meta = plan(derive.sop_metadata(spark, SF))
    assert "text" not in meta[meta.index("ReadSchema"):]


def test_one_hot_key_in_every_grouped_report(spark):
    """A third of all faults share one equipment, location, technician and category."""
    n = 30000
    hot = F.col("id") % 3 == 0
    pick = lambda name: F.when(hot, "hot").otherwise(F.concat(F.lit(name), (F.col("id") % 500).cast("string")))
    made = spark.range(n).select(*[
        {
            "fault_id": F.col("id").cast("string"),
            "fault_timestamp": F.lit("2024-01-10 10:00:00").cast("timestamp_ntz"),
            "equipment_type": pick("e"), "location": pick("l"), "fault_category": pick("c"),
            "network_type": pick("n"), "technician_type_required": pick("t"),
            "first_time_fix": F.lit(True), "customers_affected": F.lit(1),
            "service_calls_generated": F.lit(0), "priority_score": F.lit(0.5),
        }.get(f.name, F.lit(None).cast(f.dataType)).cast(f.dataType).alias(f.name) for f in FAULTS.fields
    ])
    frame = fl.with_predictions(fl.enhance(made, derive.AS_OF), derive.AS_OF)
    impact = {r.location: r.fault_count for r in metrics.location_impact(frame).collect()}
    assert impact["hot"] == n // 3 and sum(impact.values()) == n
    rows = metrics.equipment_reliability(fl.enhance(made, derive.AS_OF), derive.AS_OF).collect()
    assert sum(r.fault_count_30_days for r in rows) == n


def test_one_document_with_a_third_of_all_chunks(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("document_id"),
        F.when(F.col("id") % 3 == 0, F.col("id") / 3 + 1).otherwise(1).cast("int").alias("chunk_sequence"),
        F.lit("text").alias("chunk_text"), F.lit("CONTENT").alias("chunk_type"),
    ).withColumn("chunk_id", F.format_string("%s-C%03d", "document_id", "chunk_sequence"))
    targets = rows.select(F.col("chunk_id").alias("target_chunk_id"), "document_id", "chunk_sequence")
    around = ch.context_chunks(rows, targets, 2)
    assert around.count() == 6000 + 5 * 3000 - 6
    windows = ch.context_window(rows, 2, block=64)
    assert windows.count() == 9000
    assert windows.agg(F.sum(F.size("neighbour_ids"))).first()[0] == 6000 + 5 * 3000 - 6
    texts = ch.reassemble(rows, block=64)
    assert texts.filter("document_id = 'HOT'").first().chunk_count == 3000


@pytest.mark.parametrize("name", ["hybrid_search", "vector_index_topk", "indexed_similar"])
def test_no_nested_loops_in_any_step(spark, monkeypatch, name):
    """Steps that a search writes on its way are planned like its result."""
    from faultloom.operators import postings, search, textmatch, vectors
    from faultloom.sources import tables

    plans = []

    def settle(df, *args, **kwargs):
        plans.append(plan(df))
        return tables.settle(df, *args, **kwargs)

    for module in (postings, search, textmatch, vectors):
        monkeypatch.setattr(module, "settle", settle)
    plans.append(plan(catalog.QUERIES[name](spark, SF)))
    shown = "\n".join(plans)
    if name != "indexed_similar":
        assert "NestedLoop" not in shown
    assert "CartesianProduct" not in shown and "BatchEvalPython" not in shown


def test_chunks_by_sql_stay_in_the_row(spark):
    """The pieces were joined back to their texts by the texts, twice through a shuffle."""
    assert "Exchange" not in plan(catalog.QUERIES["sql_chunks"](spark, SF))
    assert "Join" not in plan(catalog.QUERIES["sql_chunks"](spark, SF))
    texts = ("a safety " * 60, "x" * 200 + " " * 200 + "Verification", "short", "", None, "a safety " * 60)
    rows = [(f"D{i}", f"D{i}.pdf", t) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "document_id string, file_path string, content string")
    made.createOrReplaceTempView("some_texts")
    got = spark.sql("select d.document_id, c.* from some_texts d, lateral create_meaningful_chunks(d.content, d.document_id, d.file_path) c")
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    assert shown(got) == shown(ch.chunk_text(made).drop("file_path")) and got.count() == 8
