"""Streams over restarts: resends, attachments, the ledger, and the ingest of lines."""

import json
from datetime import date, datetime, timedelta, timezone

from marram.streaming import contract
from marram.streaming import events as streams
from pyspark.sql import functions as F

T = datetime(2024, 3, 1, 12)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_a_resend_two_days_late_is_dropped(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    own = [(i, T + timedelta(days=i % 3), i, "view") for i in range(9)]
    put(spark, path, own, EVENTS)
    streams.store_once(source(spark, path, EVENTS), out, ["event_id"]).awaitTermination()
    put(spark, path, [(20, T + timedelta(days=3), 1, "view")], EVENTS)
    streams.store_once(source(spark, path, EVENTS), out, ["event_id"]).awaitTermination()
    other = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    for p in (tmp_path / "out" / "event_date=2024-03-03").glob("*.parquet"):
        p.write_bytes(b"not read")  # a day that the next batch does not name
    put(spark, path, [own[0], own[3], own[4], (21, T, 1, "view"), (21, T, 1, "view")], EVENTS)
    streams.store_once(source(spark, path, EVENTS), out, ["event_id"]).awaitTermination()
    stored = spark.read.parquet(out).where(F.col("event_date") != date(2024, 3, 3))
    assert sorted(r.event_id for r in stored.collect()) == sorted([0, 3, 6, 1, 4, 7, 20, 21])
    assert sum(p not in other for p in (tmp_path / "out").rglob("*.parquet")) == 1


def test_an_expired_attachment_adds_nothing(spark, tmp_path):
    events, extras, out = (str(tmp_path / x) for x in ("events", "extras", "out"))
    kind = "event_id long, attached_at timestamp, note string"

    def run():
        left, right = source(spark, events, EVENTS), source(spark, extras, kind)
        return {r.event_id: r.note for r in streams.run(streams.attached(left, right, "event_id"), out).collect()}

    put(spark, events, [(1, T, 1, "view"), (2, T, 1, "view"), (3, T, 1, "view")], EVENTS)
    put(spark, extras, [(1, T + timedelta(days=2), "in time"), (9, T, "no event")], kind)
    assert run() == {1: "in time"}
    put(spark, extras, [(2, T + timedelta(days=31), "too late"), (3, T + timedelta(days=30), "on the last day")], kind)
    put(spark, events, [(4, T + timedelta(days=40), 1, "view")], EVENTS)
    found = {1: "in time", 2: None, 3: "on the last day"}  # the second event's term is over
    assert run() == found
    put(spark, extras, [(2, T + timedelta(days=31), "replayed"), (8, T + timedelta(days=45), "moves time on")], kind)
    put(spark, events, [(5, T + timedelta(days=46), 1, "view")], EVENTS)
    assert run() == found


def test_a_batch_writes_no_key_that_it_does_not_change(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "ledger")
    put(spark, path, [(i, T, i, "view") for i in range(200)] + [(900, T, None, "view")], EVENTS)
    put(spark, path, [(i, T - timedelta(days=i), 7, "error") for i in range(3)], EVENTS)
    streams.keep_ledger(source(spark, path, EVENTS), out).awaitTermination()
    put(spark, path, [(300, T - timedelta(days=1), 5, "view"), (301, T + timedelta(days=1), 6, "view"), (302, T, 500, "view")], EVENTS)
    streams.keep_ledger(source(spark, path, EVENTS), out).awaitTermination()
    changed = spark.read.parquet(f"{out}/changes").where("batch = 1")
    assert {(r.user_id, r.first_success_at) for r in changed.collect()} == {(5, T - timedelta(days=1)), (500, T)}
    want = {i: T for i in range(200)} | {5: T - timedelta(days=1), 500: T}
    assert {r.user_id: r.first_success_at for r in streams.ledger(spark, out).collect()} == want
    streams.fold_ledger(spark, out)
    put(spark, path, [(310, T - timedelta(days=2), 5, "view"), (311, T, 8, "view")], EVENTS)
    streams.keep_ledger(source(spark, path, EVENTS), out).awaitTermination()
    assert {r.user_id for r in spark.read.parquet(f"{out}/changes").where("batch = 2").collect()} == {5}
    assert {r.user_id: r.first_success_at for r in streams.ledger(spark, out).collect()} == want | {5: T - timedelta(days=2)}


def test_an_empty_stream_writes_no_window(spark, tmp_path):
    put(spark, str(tmp_path / "events.parquet"), [], EVENTS + ", value double")
    found = streams.sessions(streams.read_events(spark, str(tmp_path)))
    assert streams.run(found, str(tmp_path / "out")).collect() == []


LAST = [(1, T, 7, "view", 1.0), (2, T + timedelta(minutes=10), 7, "view", 1.0), (3, T + timedelta(minutes=40), 7, "error", 1.0), (4, T + timedelta(minutes=41), 0, "view", 1.0), (5, T, None, "view", 1.0)]


def at_end(spark, tmp_path, name, rows=LAST):
    """A query's rows over a table whose last windows no later event closes, in two files."""
    from marram import queries

    for part in (rows[::2], rows[1::2]):
        put(spark, str(tmp_path / "events.parquet"), part, EVENTS + ", value double")
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())


def test_sessions_open_at_the_end_are_written(spark, tmp_path):
    found = at_end(spark, tmp_path, "stream_sessions")
    first = int(T.replace(tzinfo=timezone.utc).timestamp()) * 10**6
    minutes = lambda n: first + n * 60 * 10**6
    assert found == [(0, minutes(41), minutes(71), 1), (7, minutes(0), minutes(40), 2), (7, minutes(40), minutes(70), 1)]


def test_the_last_day_is_counted(spark, tmp_path):
    assert at_end(spark, tmp_path, "stream_daily_counts") == [(T.date(), "error", 1), (T.date(), "view", 4)]


def test_the_last_week_is_counted(spark, tmp_path):
    late = (6, datetime(2024, 3, 3, 16), 7, "view", 1.0)  # Monday in Taipei
    assert at_end(spark, tmp_path, "stream_weekly_counts", [*LAST, late]) == [(date(2024, 2, 26), "error", 1), (date(2024, 2, 26), "view", 4), (date(2024, 3, 4), "view", 1)]


def test_a_stream_run_to_its_end_twice_writes_nothing_more(spark, tmp_path):
    put(spark, str(tmp_path / "events.parquet"), LAST, EVENTS + ", value double")
    run = lambda: streams.run_to_end(streams.read_events(spark, str(tmp_path)), streams.sessions, str(tmp_path / "out"), user_id=0).count()
    assert (run(), run()) == (3, 3)


GOOD = {
    "schema_version": "1.0", "event_name": "analytics_request_completed", "event_time": "2024-03-01T12:00:00Z", "interaction_id": "i1", "transport": "mcp", "user_id": None, "identity_status": "verified", "host": "other", "authorization_result": "allowed",
    "tool_name": "traffic_summary", "tenant_id": "005", "resolution": "supported", "status": "success", "latency_ms": 0, "requested_days": 7, "result_row_count": None, "metrics": ["a", "b", "a"], "dimensions": [], "error_code": None, "raw_request": "never stored",
}


def test_lines_are_judged_one_by_one(spark):
    cases = [(GOOD, None), ({**GOOD, "tenant_id": 5}, None), (GOOD | {"metrics": []}, None), ("", "not_an_object"), (None, "not_an_object"), ("[1]", "not_an_object"), ('{"a": ', "not_an_object"), ("3", "not_an_object")]
    cases += [({**GOOD, k: v}, r) for k, v, r in [("schema_version", "2.0", "unknown_schema_version"), ("schema_version", 1.0, "unknown_schema_version"), ("interaction_id", None, "missing_interaction_id"), ("interaction_id", " ", "missing_interaction_id"), ("interaction_id", 7, "wrong_type_interaction_id"), ("host", "browser", "unknown_host"), ("user_id", {"a": 1}, "wrong_type_user_id"), ("event_time", "2024-03-01T12:00:00+08:00", "invalid_event_time"), ("event_time", "2024-13-01T12:00:00Z", "invalid_event_time"), ("latency_ms", None, "invalid_latency_ms"), ("latency_ms", -1, "invalid_latency_ms"), ("latency_ms", "5", "invalid_latency_ms"), ("requested_days", 0, "invalid_requested_days"), ("metrics", None, "invalid_metrics"), ("metrics", ["a", 1], "invalid_metrics")]]
    cases += [({k: v for k, v in GOOD.items() if k != "status"}, "missing_status")]
    lines = [(x if isinstance(x, str) or x is None else json.dumps(x),) for x, _ in cases]
    got = contract.judged(spark.createDataFrame(lines, "value string")).collect()
    assert [(r.value, r.reason) for r in got] == [(line[0], want) for line, (_, want) in zip(lines, cases, strict=True)]
    first, second = got[0].event, got[1].event
    assert (first.event_time, first.tenant_id, first.metrics, first.flaw, first.latency_ms, first.event_date) == (T, "005", ["a", "b"], None, 0, T.date()) and "raw_request" not in first
    assert (second.tenant_id, second.flaw) == (None, "wrong_type_tenant_id")


def test_judged_lines_are_parsed_once_and_not_kept(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(json.dumps(GOOD),), ("{",), (None,)], "value string")
    for rows in (contract.judged(lines), contract.judged(lines).where("reason IS NULL").select("event.*"), contract.judged(lines).where("reason IS NOT NULL").select("value", "reason")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parse_json(") + plan.count("parseJson") == 1, plan

    def kept(*_):
        raise AssertionError("a batch is kept")

    monkeypatch.setattr(type(lines), "persist", kept)
    lines.write.text(str(tmp_path / "in"))
    contract.ingest(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert (spark.read.parquet(str(tmp_path / "out" / "events")).count(), spark.read.parquet(str(tmp_path / "out" / "quarantine")).count()) == (1, 2)


def test_no_line_is_lost_over_restarts(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in range(3):
        lines = [(json.dumps(GOOD | {"interaction_id": f"{batch}-{i}"}),) for i in range(20)] + [("{",), ("{",)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)
        contract.ingest(spark.readStream.text(path), out).awaitTermination()
    assert spark.read.parquet(f"{out}/events").select("interaction_id").distinct().count() == spark.read.parquet(f"{out}/events").count() == 60
    assert [tuple(r) for r in spark.read.parquet(f"{out}/quarantine").groupBy("reason").count().collect()] == [("not_an_object", 6)]


def test_retention_is_null_past_the_recorded_watermark(spark, tmp_path):
    from marram.operators import usage

    kind = "event_id long, ts timestamp, user_id string, status string"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        rows = source(spark, path, kind).withWatermark("ts", "9 days").dropDuplicatesWithinWatermark(["event_id"])
        rows = streams.run_recorded(rows.select("user_id", F.col("ts").alias("event_time"), "status"), out)
        return {r.cohort: (r.cohort_size, r.w1, r.w2) for r in usage.retention(rows, streams.coverage(spark, out)).collect()}, {r.cohort: (r.cohort_size, r.w1, r.w2) for r in usage.retention(rows).collect()}

    monday = datetime(2024, 1, 1, 4)
    put(spark, path, [(1, monday, "u", "succeeded"), (2, monday + timedelta(days=7), "u", "failed"), (3, monday + timedelta(days=20), "u", "failed")], kind)
    covered, last_event = run()
    assert covered == {date(2024, 1, 1): (1, None, None)} and last_event == {date(2024, 1, 1): (1, 1, 1)}  # whole up to January 11
    put(spark, path, [(4, monday + timedelta(days=24), "v", "failed")], kind)
    covered, _ = run()
    assert covered == {date(2024, 1, 1): (1, 1, None)}  # up to January 15


def test_expired_days_leave_storage_and_readers_keep_their_version(spark, tmp_path):
    from marram.sources import daily

    root, schema = str(tmp_path / "t"), "id long, ts timestamp"
    days = [T + timedelta(days=i) for i in range(5)]
    assert daily.read(spark, root, schema).collect() == [] and daily.vacuum(spark, root) == [] and daily.newest(spark, root) is None
    for k in range(6):
        daily.append(spark.createDataFrame([(10 * k + i, d) for i, d in enumerate(days)] + [(999, None)], schema), root)
    ids = lambda df: sorted(r.id for r in df.collect())
    every = sorted(10 * k + i for k in range(6) for i in range(5))
    before = daily.read(spark, root, schema)
    assert ids(before) == every and daily.compact(spark, root, schema, most_parts=9) is None
    compacted = daily.compact(spark, root, schema)
    assert ids(daily.read(spark, root, schema)) == every and daily.manifest(spark, root).count() == 5
    assert daily.manifest(spark, root).where("bytes > 0").count() == 5
    assert ids(daily.read(spark, root, schema, days[1].date(), days[2].date())) == [i for i in every if i % 10 in (1, 2)]
    kept = daily.expire(spark, root, days[-1].date(), 3)
    left = [i for i in every if i % 10 >= 2]
    assert ids(daily.read(spark, root, schema)) == left and ids(before) == every  # files are there as long as a version names them
    assert ids(daily.read(spark, root, schema, version=compacted)) == every
    gone = daily.vacuum(spark, root, keep_versions=1)
    assert len(gone) == 32 and not list((tmp_path / "t").rglob("day=2024-03-01")) and not list((tmp_path / "t").rglob("day=2024-03-02"))
    assert daily.newest(spark, root) == kept and ids(daily.read(spark, root, schema)) == left
    daily.append(spark.createDataFrame([(7000, days[0])], schema), root)  # a late row of an expired day goes with the next expiry
    daily.expire(spark, root, days[-1].date() + timedelta(days=9), 3)
    assert ids(daily.read(spark, root, schema)) == [] and daily.manifest(spark, root).count() == 0
    assert len(daily.vacuum(spark, root, 1)) == 4
