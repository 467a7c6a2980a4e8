"""Sources, merges, quality jobs, streams, SQL functions and batch jobs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from faultloom.functions import sql
from faultloom.operators import faults as fl
from faultloom.operators import merge, metrics, quality
from faultloom.plans import batch, catalog, derive
from faultloom.schemas import DASHBOARD_COLUMNS, FAULT_COLUMNS, FAULTS
from faultloom.sources import files, generate, tables
from faultloom.streaming import chunk_refresh, ingest

AS_OF = "2024-01-17 00:00:00"
HEADER = ",".join(FAULT_COLUMNS)


def line(fault_id, **changes):
    values = dict(zip(FAULT_COLUMNS, (
        fault_id, "2024-01-15 08:30:00", "812.3", '"cut, again"', "Cable Fault", "HFC", " Box ", "North",
        "High", "Outage", "150", "12", "NULL", "4.25", "TRUE", "Senior", "25000", "0.85",
    )))
    values.update(changes)
    return ",".join(values.values())


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")


LINES = [
    line("F1"), line("F2", fault_category="null", customers_affected="", first_time_fix="false"),
    line("F3", customers_affected="many"), "4", line("F5") + ",extra",
    line("F6", resolution_timestamp="2024-01-16T10:00:00"), line("F7", fault_timestamp="yesterday"),
]


def test_csv_rules(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", *LINES)
    good, bad = files.read_faults_csv(spark, f"{tmp_path}/in")
    assert good.schema == FAULTS
    rows = {r.fault_id: r for r in good.collect()}
    assert set(rows) == {"F1", "F2", "F6"}
    assert rows["F1"].fault_description == "cut, again" and rows["F1"].equipment_type == "Box"
    assert rows["F1"].resolution_timestamp is None and rows["F1"].customers_affected == 150
    assert rows["F2"].fault_category is None and rows["F2"].customers_affected is None
    assert rows["F6"].resolution_timestamp == dt.datetime(2024, 1, 16, 10)
    reasons = sorted(r["_reason"] for r in bad.collect())
    assert reasons == ["customers_affected", "fault_timestamp", "malformed row", "malformed row"]


def test_stream_of_csv_files_lands_each_row_once(spark, tmp_path):
    root = str(tmp_path)
    go = lambda mark: ingest.stream_faults(
        spark, f"{root}/in", f"{root}/good", f"{root}/bad", f"{root}/{mark}", files_per_batch=1
    ).awaitTermination()
    write(f"{root}/in/a.csv", *LINES)
    go("mark")
    write(f"{root}/in/b.csv", line("F9"))
    go("mark")
    ids = lambda: sorted(r.fault_id for r in ingest.ingested(spark, f"{root}/good").collect())
    assert ids() == ["F1", "F2", "F6", "F9"]
    go("lost-mark")  # a replay from the start overwrites the same batches
    assert ids() == ["F1", "F2", "F6", "F9"]
    assert ingest.ingested(spark, f"{root}/bad").count() == 4
    triage = fl.fault_triage(fl.fault_analysis(fl.enhance(ingest.ingested(spark, f"{root}/good"), AS_OF), AS_OF))
    assert triage.count() == 3


def test_chunk_refresh_follows_changes_and_replays(spark, tmp_path):
    root = str(tmp_path)
    schema = "document_id string, file_path string, content string, updated_timestamp timestamp_ntz"
    at = lambda day: dt.datetime(2024, 1, day)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{root}/docs")

    def go(mark="mark"):
        chunk_refresh.stream_chunks(
            spark, f"{root}/docs", f"{root}/log", f"{root}/{mark}", None, files_per_batch=1
        ).awaitTermination()

    def texts():
        rows = chunk_refresh.current_chunks(spark, f"{root}/log").collect()
        return sorted((r.document_id, r.chunk_sequence, r.chunk_text) for r in rows)

    arrive(("A", "a", "old version of a", at(1)), ("A", "a", "new version of a", at(2)), ("B", "b", "b" * 300, at(1)))
    go()
    assert texts() == [("A", 1, "new version of a"), ("B", 1, "b" * 200), ("B", 2, "b" * 100)]
    arrive(("B", "b", "short text of b", at(3)), ("C", "c", "text of c now", at(3)))
    arrive(("A", "a", "", at(4)))
    go()
    after = [("B", 1, "short text of b"), ("C", 1, "text of c now")]
    assert texts() == after
    go("lost-mark")
    assert texts() == after
    chunk_refresh.compact(spark, f"{root}/log", f"{root}/small")
    rows = chunk_refresh.current_chunks(spark, f"{root}/small").collect()
    assert sorted((r.document_id, r.chunk_sequence, r.chunk_text) for r in rows) == after


def test_json_documents(spark, tmp_path):
    body = '{"document_id": "S1",\n "title": "T", "category": "Major", "equipment_types": ["a"],\n "fault_codes": [], "content": "x"}'
    (tmp_path / "one.json").write_text(body)
    (tmp_path / "two.json").write_text(body.replace("S1", "S2"))
    got = files.read_sop_json(spark, str(tmp_path))
    assert sorted(r.document_id for r in got.collect()) == ["S1", "S2"]
    out = f"{tmp_path}/lines"
    files.export_json(got, out)
    assert files.read_sop_json(spark, out, one_per_file=False).count() == 2


def test_file_listing_and_refresh(spark, tmp_path):
    root = tmp_path / "stage"
    (root / "sub").mkdir(parents=True)
    (root / "a.pdf").write_bytes(b"abc")
    (root / "sub" / "b.pdf").write_bytes(b"b")
    (root / "c.txt").write_bytes(b"no")
    listing = {r.file_path: r for r in files.list_sop_files(spark, str(root), checksum=True).collect()}
    assert set(listing) == {"a.pdf", "sub/b.pdf"}
    assert listing["a.pdf"].file_size == 3 and listing["a.pdf"].md5 == "900150983cd24fb0d6963f7d28e17f72"
    plain = files.list_sop_files(spark, str(root))
    assert plain.first().md5 is None
    target = spark.createDataFrame(
        [("a.pdf", "old", 1, "KEPT", None), ("gone.pdf", "old", 9, "ACTIVE", None)],
        "file_path string, file_url string, file_size long, file_status string, md5 string",
    ).withColumns({
        c: F.lit("2024-01-01").cast("timestamp_ntz") for c in ("last_modified", "created_timestamp", "updated_timestamp")
    }).withColumn("etag", F.lit("old"))
    got = {r.file_path: r for r in files.refresh_files(spark, str(root), target, AS_OF).collect()}
    assert set(got) == {"a.pdf", "sub/b.pdf", "gone.pdf"}
    now, then = dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 1)
    a, b, gone = got["a.pdf"], got["sub/b.pdf"], got["gone.pdf"]
    assert (a.file_size, a.file_status, a.etag, a.created_timestamp, a.updated_timestamp) == (3, "KEPT", None, then, now)
    assert (b.file_status, b.created_timestamp) == ("ACTIVE", now)
    assert (gone.file_size, gone.updated_timestamp) == (9, then)


def test_upsert_writes_nulls_and_rejects_duplicate_keys(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, keep string")
    source = spark.createDataFrame([(1, None), (3, "c")], "k int, v string")
    got = merge.upsert(target, source, ["k"], ["v"], on_insert={"keep": F.lit("new")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, None, "x"), (2, "b", "y"), (3, "c", "new")]
    twice = source.unionAll(source)
    assert merge.duplicate_keys(twice, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate source key"):
        merge.upsert(target, twice, ["k"], ["v"]).collect()


def test_insert_missing_and_defaults(spark):
    target = spark.createDataFrame([(1, "a", 5)], "k int, v string, n int")
    source = spark.createDataFrame([(1, "z"), (2, "b")], "k int, v string")
    got = sorted(tuple(r) for r in merge.insert_missing(target, source, ["k"]).collect())
    assert got == [(1, "a", 5), (2, "b", None)]
    filled = merge.with_defaults(source, {"v": "d", "w": 1}).first()
    assert (filled.v, filled.w) == ("z", 1)
    meta = files.metadata_defaults(generate.sop_catalog(spark), AS_OF).collect()
    assert {(r.document_version, r.is_active, r.last_reviewed) for r in meta} == {("1.0", True, dt.date(2024, 1, 17))}
    assert [r.page_count for r in meta] == [8, 6, 4, 12, 10]
    stamped = files.fault_defaults(generate.seed_faults(spark), AS_OF)
    assert "created_timestamp" in fl.enhance(stamped, AS_OF).columns


def test_steps_go_with_their_scope(spark):
    from faultloom.session import steps

    with steps(spark):
        gone, stays = tables.settle(spark.range(3)), tables.settle(spark.range(2), keep=True)
        assert gone.count() == 3
    assert stays.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()


def test_quality_jobs(spark):
    faults = generate.seed_faults(spark).withColumn(
        "fault_code", F.when(F.col("fault_id") != "F001", F.col("fault_code"))
    )
    nulls = {r.column_name: r.null_count for r in quality.null_counts(faults).collect()}
    assert nulls["fault_code"] == 1 and sum(nulls.values()) == 1
    assert quality.missing_columns(faults.drop("location")) == ["location"]
    counts = quality.record_counts(metrics.load_summary({"a": faults, "b": faults}), {"a": 5, "b": 6})
    assert {r.table_name: r.matches for r in counts.collect()} == {"a": True, "b": False}


def test_normalised_schema(spark):
    df = spark.createDataFrame([("2024-01-15 08:00:00", "x")], "TIMESTAMP string, Location string")
    got = fl.normalize_schema(df)
    row = got.first()
    assert row.fault_timestamp == dt.datetime(2024, 1, 15, 8) and row.resolution_timestamp is None
    assert (row.fault_category, row.priority_score) == ("Unknown", 0.5) and row.fault_id.isdigit()
    with pytest.raises(ValueError, match="no timestamp column"):
        fl.normalize_schema(spark.createDataFrame([(1,)], "a int"))
    assert files.empty_faults(spark).columns == DASHBOARD_COLUMNS


def test_seed_faults(spark):
    enhanced = fl.enhance(generate.seed_faults(spark), AS_OF)
    rows = {r.fault_id: r for r in enhanced.collect()}
    assert (rows["F001"].hours_since_fault, rows["F001"].sla_breach_risk, rows["F001"].risk_level) == (4, False, "CRITICAL")
    assert (rows["F002"].hours_since_fault, rows["F002"].sla_breach_risk) == (34, True)
    triage = fl.fault_triage(fl.fault_analysis(enhanced, AS_OF)).orderBy(*fl.triage_order()).collect()
    assert [r.fault_id for r in triage] == ["F004", "F002"]


def test_dashboard_frame_with_no_rows_and_all_null_groups(spark):
    none = fl.with_predictions(fl.enhance(spark.createDataFrame([], FAULTS), AS_OF), AS_OF)
    row = metrics.kpis(none).first()
    assert (row.active_faults, row.customers_affected, row.first_time_fix_pct) == (0, 0, None)
    accuracy = metrics.model_accuracy(fl.fault_analysis(fl.enhance(spark.createDataFrame([], FAULTS), AS_OF), AS_OF))
    assert accuracy.first().accuracy is None


def test_inline_and_joined_predictions_agree(spark, sf_dir):
    enhanced = fl.enhance(derive.faults(spark, sf_dir), derive.AS_OF)
    triage = fl.fault_triage(fl.fault_analysis(enhanced, derive.AS_OF))
    for sla in ("category", "score"):
        a = fl.with_predictions(enhanced, derive.AS_OF, sla)
        b = fl.join_predictions(enhanced, triage, derive.AS_OF, sla).select(*a.columns)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_generated_faults_follow_their_ranges(spark):
    n = 20000
    df = generate.generate_faults(spark.range(n), 1, AS_OF).persist()
    assert df.schema.fieldNames() == FAULT_COLUMNS and df.count() == n
    again = generate.generate_faults(spark.range(n).repartition(7), 1, AS_OF)
    assert df.exceptAll(again).count() == 0
    share = {r.fault_category: r.n / n for r in df.groupBy("fault_category").agg(F.count("*").alias("n")).collect()}
    assert share == pytest.approx({"Minor": 0.6, "Major": 0.3, "Cable Fault": 0.1}, abs=0.02)
    bad = df.filter(
        "fault_category = 'Minor' and not (customers_affected between 1 and 50 and resolution_time_hours between 0.5 and 4)"
        " or fault_category = 'Cable Fault' and not (service_calls_generated between 50 and 500 and fault_code like '81%')"
        f" or resolution_timestamp > timestamp_ntz '{AS_OF}' or fault_timestamp >= timestamp_ntz '{AS_OF}'"
    )
    assert bad.count() == 0
    fixed = {r.fault_category: r.f for r in df.groupBy("fault_category").agg(F.avg(F.col("first_time_fix").cast("int")).alias("f")).collect()}
    assert fixed == pytest.approx({"Minor": 0.425, "Major": 0.35, "Cable Fault": 0.2}, abs=0.03)


def test_batch_load_and_dashboard(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", *LINES)
    made = batch.load_faults(spark, f"{tmp_path}/in", f"{tmp_path}/out", AS_OF)
    assert {r.table_name: r.record_count for r in made["summary"].collect()} == {
        "Network Faults": 3, "Training Data": 2, "Technician Metrics": 1, "Equipment Reliability": 1,
    }
    assert made["rejected"].count() == 4
    board = batch.dashboard(made["Network Faults"], AS_OF, start="2024-01-15", end="2024-01-15", location="North")
    got = {name: df.count() for name, df in board.results.items()}
    board.close()
    assert got["kpis"] == 1 and got["triage"] == 2 and got["locations"] == 1


def test_sql_functions_agree_with_the_operators(spark, sf_dir):
    faults = derive.faults(spark, sf_dir)
    chunks, meta = derive.sop_chunks(spark, sf_dir), derive.sop_metadata(spark, sf_dir)
    sql.create_views(spark, derive.AS_OF, faults, chunks, meta, derive.sop_files(spark, sf_dir))
    sql.register_functions(spark)
    wrong = spark.sql("""
        select a.fault_id from vw_fault_analysis a where
         classify_fault(fault_code, network_type, equipment_type, location, customers_affected,
          service_calls_generated, 0, 0, false) <> predicted_category
         or not calculate_priority_score(actual_category, customers_affected, service_calls_generated,
          business_hours_fault, equipment_type) <=> calculated_priority_score
         or recommend_technician(actual_category, equipment_type, location, original_priority_score)
          <> technician_recommendation""")
    assert wrong.count() == 0
    assert spark.sql("select count(*) n from vw_fault_triage").first().n > 0
    assert spark.sql("select sum(prediction_count) n from vw_model_accuracy").first().n > 0
    assert spark.sql("select * from vw_training_data").count() + spark.sql("select * from vw_test_data").count() == (
        spark.sql("select * from vw_fault_features").count()
    )
    from faultloom.operators import chunks as ch
    from faultloom.operators import search as se

    index = se.search_index(chunks, meta)
    ids = lambda df: [r.chunk_id for r in df.orderBy(F.desc("relevance_score"), "document_id", "chunk_sequence").collect()]
    assert ids(spark.sql("select * from search_sop_chunks('safety requirements', result_limit => 7)")) == ids(
        se.search_chunks(index, "safety requirements", k=7)
    )
    assert ids(spark.sql("select * from search_sop_chunks('the', null, 'Major', 'Nokia 7750')")) == ids(
        se.search_chunks(index, "the", category="Major", equipment="Nokia 7750")
    )
    target = chunks.filter("chunk_sequence = 3").orderBy("chunk_id").first().chunk_id
    a = spark.sql(f"select * from get_contextual_chunks('{target}')")
    b = ch.context_of(chunks, target).select(*a.columns)
    assert a.count() > 1 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    a = spark.sql("select * from find_similar_faults('cable fault')")
    b = se.find_similar(se.search_index(chunks, meta, None), "cable fault").select(*a.columns)
    assert a.count() == 5 and a.exceptAll(b).count() == 0
    text = "SAFETY " + "x" * 250
    made = spark.sql(f"select * from create_meaningful_chunks('{text}', 'D', 'd.pdf')").collect()
    assert [(r.chunk_sequence, r.chunk_type, r.char_start, r.char_end) for r in made] == [
        (1, "SAFETY", 1, 200), (2, "CONTENT", 201, 257)
    ]
    r = spark.sql("select generate_repair_procedure('cut', 'Box') p, ask_technical_question('why', 'Box') q").first()
    assert "fault code: N/A\n" in r.p.procedure_text and r.q.query == "why Box " and r.q.chunks_used == 5


def test_reliability_draws_fit_their_band(spark, sf_dir):
    enhanced = fl.enhance(derive.faults(spark, sf_dir), derive.AS_OF)
    rows = metrics.equipment_reliability(enhanced, derive.AS_OF, 3).collect()
    bands = {"High": (0.7, 1.0), "Medium": (0.3, 0.7), "Low": (0.0, 0.3)}
    for r in rows:
        lo, hi = bands[r.maintenance_priority]
        assert lo <= r.predicted_failure_risk <= hi
        assert 365 <= (dt.date(2024, 1, 31) - r.installation_date).days <= 1095
        assert 30 <= (dt.date(2024, 1, 31) - r.last_maintenance_date).days <= 180
    assert sorted(rows) == sorted(metrics.equipment_reliability(enhanced, derive.AS_OF, 3).collect())


def numbered_files(spark, root, documents, pages):
    """Documents and pages with the given numbers, as the files that the registered queries read."""
    spark.createDataFrame([(d, "text", "en", "web") for d in documents], "doc_id long, text string, lang string, source string").write.parquet(
        f"{root}/documents.parquet"
    )
    spark.createDataFrame([(p, f"u{p}", "x" * (p % 5)) for p in pages], "page_id long, url string, html string").write.parquet(
        f"{root}/pages.parquet"
    )
    return str(root)


def check_numbered(got):
    """Documents 7, 1000006 and 1000013 meet pages 1, 142858 and no page; numbers of 6 and 7 digits stay apart."""
    rows = {r.file_path: r for r in got.collect()}
    assert set(rows) == {f"SOP-{n}.pdf" for n in ("000007", "1000006", "1000013", "999999", "1000020", "1000027")}
    assert (rows["SOP-000007.pdf"].file_url, rows["SOP-000007.pdf"].file_size) == ("u1", 1)
    assert (rows["SOP-1000006.pdf"].file_url, rows["SOP-1000006.pdf"].file_size) == ("u142858", 3)
    assert rows["SOP-1000013.pdf"].md5 == "old"
    assert rows["SOP-1000020.pdf"].file_url == "u142860" and rows["SOP-1000027.pdf"].file_url == "u142861"


NUMBERED = [7, 1000006, 1000013], [1, 142857, 142858, 142860, 142861]


def test_upsert_files_tells_numbers_over_six_digits_apart(spark, tmp_path):
    check_numbered(catalog.QUERIES["upsert_files"](spark, numbered_files(spark, tmp_path, *NUMBERED)))


def test_upsert_in_buckets_tells_numbers_over_six_digits_apart(spark, tmp_path):
    check_numbered(catalog.QUERIES["upsert_in_buckets"](spark, numbered_files(spark, tmp_path, *NUMBERED)))
