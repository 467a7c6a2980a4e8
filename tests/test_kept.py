"""Tables kept up to date: buckets, signed deltas, the cube, streams by event time and version, raw JSON."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from faultloom.functions import objects
from faultloom.operators import cube, deltas, merge, metrics
from faultloom.operators import faults as fl
from faultloom.plans import catalog
from faultloom.schemas import FAULTS
from faultloom.streaming import index_refresh, ingest

SF = "/root/testdata/sf0.001"


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    path, keys, n = str(tmp_path / "t"), ["k"], 16
    table = spark.range(400).selectExpr("cast(id as string) as k", "id as v", "'old' as note")
    merge.write_buckets(table, path, keys, n)
    before = files(path)
    source = spark.createDataFrame([("7", 70), ("new", 1)], "k string, v long")
    touched = {r[0] for r in source.select(merge.bucket_of(keys, n)).collect()}
    merge.upsert_buckets(spark, path, source, keys, n, ["v"], on_insert={"note": F.lit("in")})
    same = {f for f, t in files(path).items() if before.get(f) == t}
    assert len(same) == n - len(touched)
    assert not any(f"{merge.BUCKET}={b}/" in f for f in same for b in touched)
    rows = {r.k: (r.v, r.note) for r in merge.read_buckets(spark, path).collect()}
    assert len(rows) == 401 and rows["7"] == (70, "old") and rows["new"] == (1, "in") and rows["8"] == (8, "old")
    merge.insert_buckets(spark, path, spark.createDataFrame([("7", 0), ("x", 5)], "k string, v long"), keys, n)
    rows = {r.k: (r.v, r.note) for r in merge.read_buckets(spark, path).collect()}
    assert len(rows) == 402 and rows["7"] == (70, "old") and rows["x"] == (5, None)
    merge.upsert_buckets(spark, path, source.limit(0), keys, n, ["v"])
    assert merge.read_buckets(spark, path).count() == 402
    old, new = merge.changed_rows(spark, path, source, keys, n)
    assert {r.k for r in old.collect()} == {"7", "new"} and new.count() == 2


def shown(df):
    return [tuple(r) for r in df.collect()]


def test_deltas_cancel_out(spark):
    frame = catalog.dashboard(spark, SF).persist()
    state = deltas.kpi_sums(frame)
    assert shown(catalog.flat(deltas.kpi_view(state))) == shown(catalog.flat(metrics.kpis(frame)))
    some = frame.filter("fault_id > 'F000000300'")
    assert shown(deltas.apply_changes(state, some, some)) == shown(state)
    emptied = deltas.kpi_view(deltas.apply_changes(state, frame, frame.limit(0)))
    assert shown(emptied) == [(0, 0, 0, 0, None, 0, 0.0)]


def test_any_slice_of_the_cube(spark):
    frame = catalog.dashboard(spark, SF).persist()
    made = cube.build_cube(frame).persist()
    d = dt.date
    asked = [
        ("a", None, None, "All", None, "All"), ("b", d(2024, 1, 5), d(2024, 1, 9), "Vejle", "All", "All"),
        ("c", d(2024, 1, 9), d(2024, 1, 5), "All", "All", "All"), ("d", d(2030, 1, 1), None, "All", "Major", "LOW"),
        ("e", None, d(2024, 1, 2), "nowhere", "All", "All"), ("f", d(2024, 1, 30), d(2025, 1, 1), "All", "Minor", "All"),
    ]
    slices = spark.createDataFrame(asked, "slice_id string, first_day date, last_day date, location string, fault_category string, risk_level string")
    got = {r.slice_id: tuple(r)[1:] for r in catalog.flat(cube.slice_kpis(made, slices)).collect()}
    for name, first, last, *keys in asked:
        kept = fl.dashboard_slice(frame, first, last, *[k or "All" for k in keys])
        assert got[name] == shown(catalog.flat(metrics.kpis(kept)))[0], name


def test_event_time_stream_takes_each_fault_once(spark, tmp_path):
    schema = FAULTS
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)

    def land(*rows):
        full = [tuple({"fault_id": i, "fault_timestamp": t}.get(f.name) for f in schema.fields) for i, t in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.dedup_faults(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", schema).awaitTermination()

    land(("a", at(10)), ("a", at(10)), ("b", at(10, 3)))
    land(("b", at(10, 3)), ("c", at(12)))
    land(("late", at(3)), ("late", at(3)), ("d", at(12, 1)), ("a", at(10)))
    accepted = ingest.ingested(spark, f"{tmp_path}/out")
    assert sorted(r.fault_id for r in accepted.collect()) == ["a", "b", "c", "d"]
    landed = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    assert [r.fault_id for r in ingest.late_faults(landed, accepted).collect()] == ["late"]


def test_index_follows_versions_in_any_order(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, day)

    def land(*rows):
        spark.createDataFrame(rows, "document_id string, content string, updated_timestamp timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index_refresh.stream_index(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        left = index_refresh.current_index(spark, f"{tmp_path}/out").collect()
        return sorted((r.document_id, r.token, list(r.places)) for r in left)

    assert land(("a", "one two one", at(2)), ("b", "", at(1)), ("c", None, at(1)), (None, "x", at(1)), ("d", "x", None)) == [
        ("a", "ONE", [0, 2]), ("a", "TWO", [1]), ("b", "", [0])]
    assert land(("a", "old text", at(1)), ("b", "now two", at(3)), ("b", "not yet", at(2))) == [
        ("a", "ONE", [0, 2]), ("a", "TWO", [1]), ("b", "NOW", [0]), ("b", "TWO", [1])]
    assert land(("a", None, at(4)), ("b", "two now", at(5)), ("c", "here", at(2))) == [
        ("b", "NOW", [1]), ("b", "TWO", [0]), ("c", "HERE", [0])]


def test_paths_into_objects(spark):
    texts = ['{"a": {"b": [1, "x"]}, "n": 1.5}', '{"a": 3, "n": "7"}', "[]", "null", "{broken", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")
    got = objects.shred(df, "raw", {"first": ("a.b[0]", "int"), "second": ("a.b[1]", "string"), "n": ("n", "double"), "a": ("a", "int")}, keep="v")
    assert [tuple(r) for r in got.orderBy("id").select("first", "second", "n", "a").collect()] == [
        (1, "x", 1.5, None), (None, None, 7.0, 3), *[(None,) * 4] * 5]
    schema = objects.object_schema(df.filter("id < 2"), "raw").first()
    assert schema.malformed == 0 and "n: VARIANT" in schema.schema
    assert objects.object_schema(df, "raw").first().malformed == 2
    assert pytest.approx(1.5) == got.filter("id = 0").selectExpr("variant_get(v, '$.n', 'double')").first()[0]


def test_no_task_lands_a_whole_week(spark, tmp_path, monkeypatch):
    """Weeks were written by one task each; now they come in many files and are still a batch each."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    root = f"{tmp_path}/sf"
    events.repartition(5).write.parquet(f"{root}/events.parquet")
    landed, plain = [], ingest.dedup_faults

    def dedup(spark, source, *args, **options):
        landed.append(len([f for f in os.listdir(source) if f.endswith(".parquet")]))
        return plain(spark, source, *args, **options)

    monkeypatch.setattr(ingest, "dedup_faults", dedup)
    with_cap = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = catalog.QUERIES["streamed_faults_dedup"](spark, root).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_cap)
    assert len(landed) == 4 and landed[0] > 4
    held = lambda r: int(r.fault_id[1:]) % 101 == 0 and r.fault_timestamp.day < 8
    assert all(r.state == ("late" if held(r) else "accepted") for r in got)
    assert sorted(r.fault_id for r in got) == sorted(f"F{r.event_id:09d}" for r in events.collect())


def test_changed_texts_are_unfolded_many_at_once():
    """Every document made a frame of its postings and kept them as state; now it hands on two texts."""
    import pandas as pd
    import pyarrow as pa

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def arrive(state, *rows):
        frame = pd.DataFrame(rows, columns=["updated_timestamp", "content"]).astype({"updated_timestamp": "datetime64[ns]"})
        return [tuple(r) for f in index_refresh._changes(("D",), iter([frame]), state) for r in f[["before", "after"]].itertuples(index=False)]

    state, day = State(), lambda n: dt.datetime(2024, 1, n)
    assert arrive(state, (None, "no time")) == [] and not state.exists
    assert arrive(state, (day(2), "a b"), (day(1), "z"), (day(2), "a a b")) == [(None, "a b")]
    assert state.get[1] == "a b"
    assert arrive(state, (day(1), "late")) == [] and arrive(state, (day(3), "a b")) == []
    assert arrive(state, (day(4), "b b"), (day(4), None)) == [("a b", None)] and state.get[1] is None
    batch = pa.RecordBatch.from_pydict({
        "document_id": ["D", "E", "F"], "version": [day(1), day(2), day(3)], "before": [None, "a b", "x"], "after": ["a b a", "a c", None],
    })
    (made,) = index_refresh._unfolded(iter([batch]))
    assert [tuple(r.values()) for r in made.to_pylist()] == [
        ("D", day(1), "A", [0, 2], 1), ("D", day(1), "B", [1], 1), ("E", day(2), "B", [1], -1), ("E", day(2), "C", [1], 1), ("F", day(3), "X", [0], -1),
    ]


def test_documents_come_to_the_index_in_groups(spark, tmp_path, monkeypatch):
    """Every document was a group of its own, which cost some milliseconds however short its text was."""
    monkeypatch.setattr(index_refresh, "GROUPS", 3, raising=False)
    groups = tmp_path / "groups"
    groups.mkdir()
    plain, at = index_refresh._group_changes, lambda day: dt.datetime(2024, 1, day)

    def counted(key, frames, state):
        (groups / f"{key[0]}-{state.exists}").touch()
        yield from plain(key, frames, state)

    monkeypatch.setattr(index_refresh, "_group_changes", counted)

    def land(rows):
        spark.createDataFrame(rows, "document_id string, content string, updated_timestamp timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index_refresh.stream_index(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        left = index_refresh.current_index(spark, f"{tmp_path}/out").collect()
        return sorted((r.document_id, r.token, list(r.places)) for r in left)

    first = [(f"D{i}", f"t{i} same", at(2)) for i in range(40)]
    want = {(f"D{i}", t, p) for i in range(40) for t, p in ((f"T{i}", 0), ("SAME", 1))}
    assert land(first) == sorted((d, t, [p]) for d, t, p in want)
    # one is older, one comes twice, one goes, one is new; the others of their groups stay
    second = [("D1", "old", at(1)), ("D2", "mid", at(3)), ("D2", "same", at(4)), ("D3", None, at(3)), ("E", "x", at(1))]
    want = {w for w in want if w[0] not in ("D2", "D3")} | {("D2", "SAME", 0), ("E", "X", 0)}
    assert land(second) == sorted((d, t, [p]) for d, t, p in want)
    log = spark.read.parquet(f"{tmp_path}/out/postings").filter("batch_id = 1")
    assert {r.document_id for r in log.collect()} == {"D2", "D3", "E"}
    assert 3 <= len(list(groups.iterdir())) <= 6
