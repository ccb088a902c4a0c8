"""The session table as a step of its own, and what is read from it."""

import random
from datetime import date, datetime, timedelta

import pytest
from marram import queries
from marram.operators import scan, traffic
from marram.plans import models, sessions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def write(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def visits(rng, days, users, first=0):
    """Events of some days; some sessions go on over midnight."""
    rows = []
    for day in days:
        for user in users:
            at = datetime(2024, 1, day) + timedelta(minutes=rng.choice([0, 5, 400, 1430]))
            for _ in range(rng.randrange(4)):
                rows.append((first + len(rows), at, user, rng.choice(["view", "purchase"]), 1.0, f'{{"k": {rng.randrange(20)}}}'))
                at += timedelta(minutes=rng.choice([3, 20, 31, 100]))
    return [r for r in rows if r[1].day in days]


def all_rows(df):
    return sorted(map(tuple, df.select(*models.SESSION_COLUMNS).collect()))


def counted(spark, directory, first, last):
    a, b = traffic.aggregates(sessions.sessions(spark, directory), first, last), traffic.stored_aggregates(sessions.visitors(spark, directory), first, last)
    return sorted(map(str, a.collect())), sorted(map(str, b.collect()))


def test_days_are_added_and_open_sessions_go_on(spark, tmp_path):
    rng, directory = random.Random(8), str(tmp_path)
    path, users = f"{directory}/events.parquet", range(1, 30)
    with pytest.raises(sessions.NotBuilt):
        sessions.sessions(spark, directory)
    write(spark, path, visits(rng, [1, 2], users) + [(9000, datetime(2024, 1, 2, 23, 50), 99, "view", 1.0, '{"k": 3}'), (9001, datetime(2024, 1, 2, 23, 55), None, "view", 1.0, '{"k": 3}')])
    first = sessions.prepare(spark, directory)
    assert sessions.prepare(spark, directory) is first
    seen = all_rows(sessions.sessions(spark, directory))
    old = sessions.sessions(spark, directory)
    write(spark, path, visits(rng, [3], [*users, 40], 10_000) + [(20_000, datetime(2024, 1, 3, 0, 15), 99, "purchase", 1.0, '{"k": 5}'), (20_001, datetime(2024, 1, 3, 23, 58), 40, "view", 1.0, '{"k": 5}')])
    second = sessions.prepare(spark, directory)
    assert second.version == first.version + 1 and second.days[date(2024, 1, 1)] == first.version and second.days[date(2024, 1, 2)] == second.days[date(2024, 1, 3)] == second.version
    assert all_rows(sessions.sessions(spark, directory)) == all_rows(models.build_sessions(spark, directory))
    assert all_rows(old) == seen  # a reader's version stays
    going_on = next(r for r in sessions.sessions(spark, directory).collect() if r.user_pseudo_id == "99")
    assert (going_on.session_date, going_on.n_events, going_on.exit_event, going_on.bounced) == (date(2024, 1, 2), 2, "purchase", False)
    write(spark, path, visits(rng, [4, 5], users, 30_000) + [(40_000, datetime(2024, 1, 4, 0, 10), 40, "view", 1.0, '{"k": 5}')])
    third = sessions.prepare(spark, directory)
    assert third.version == second.version + 1 and third.days[date(2024, 1, 1)] == first.version
    assert all_rows(sessions.sessions(spark, directory)) == all_rows(models.build_sessions(spark, directory))
    own, stored = counted(spark, directory, date(2024, 1, 3), date(2024, 1, 5))
    assert own == stored
    sessions._built.clear()  # another application finds what is stored
    assert sessions.prepare(spark, directory) == third
    write(spark, path, visits(rng, [2], [7, 50], 50_000))  # late events: everything anew
    fourth = sessions.prepare(spark, directory)
    assert set(fourth.days.values()) == {fourth.version} and all_rows(sessions.sessions(spark, directory)) == all_rows(models.build_sessions(spark, directory))
    own, stored = counted(spark, directory, date(2024, 1, 2), date(2024, 1, 3))
    assert own == stored


def test_late_days_go_on_from_the_version_before_them(spark, tmp_path):
    rng, directory = random.Random(18), str(tmp_path)
    path, users, built = f"{directory}/events.parquet", range(1, 25), []

    def add(days, users, late=()):
        write(spark, path, visits(rng, days, users, 10_000 * (1 + len(built))) + list(late))
        built.append(sessions.prepare(spark, directory))
        assert all_rows(sessions.sessions(spark, directory)) == all_rows(models.build_sessions(spark, directory))
        for first, last in ((date(2024, 1, 3), date(2024, 1, 6)), (date(2024, 1, 5), date(2024, 1, 5))):
            own, stored = counted(spark, directory, first, last)
            assert own == stored
        assert sessions.cost(spark, directory, date(2024, 1, 1), date(2024, 1, 31), "visitors") > 0
        return built[-1]

    first, second, third = add([1, 2], users), add([3, 4], [*users, 40]), add([5, 6], users)
    assert third.chain == (first.version, second.version, third.version)
    # Late events of day 5, of users known, new, and new in the version that is left out; one joins a session of day 4.
    late = add([5], [3, 41, 42], [(90_000, datetime(2024, 1, 5, 0, 1), 40, "purchase", 1.0, '{"k": 4}')])
    assert late.chain == (first.version, second.version, late.version)
    assert {d.day: v for d, v in late.days.items() if d.day < 4} == {1: first.version, 2: first.version, 3: second.version} and late.days[date(2024, 1, 6)] == late.version
    seventh = add([7], [*users, 42])
    assert seventh.chain == (*late.chain, seventh.version)
    sessions._built.clear()  # another application finds the chain
    assert sessions.prepare(spark, directory) == seventh
    assert add([3], [5]).chain[:1] == (first.version,)
    whole = add([1], [6])
    assert whole.chain == (whole.version,) and set(whole.days.values()) == {whole.version}


def input_rows(spark, f):
    """Records that all jobs of a call read."""
    context = spark.sparkContext
    jvm, store = context._jvm, context._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).inputRecords() for i in range(found.size())}

    context._jsc.sc().listenerBus().waitUntilEmpty()
    before = set(stages())
    f()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for s, n in stages().items() if s not in before)


def test_a_report_reads_a_few_rows_of_the_wanted_days(spark):
    queries.QUERIES["traffic_summary_nested"](spark, SF)
    n = input_rows(spark, lambda: traffic.traffic_summary(spark, SF, queries.START, queries.END).collect())
    assert 0 < n < 300 < spark.read.parquet(f"{SF}/events.parquet").count()
    assert input_rows(spark, lambda: queries.QUERIES["traffic_summary_nested"](spark, SF)) <= 10  # the files are listed


def test_costs_come_from_listed_files(spark):
    sessions.prepare(spark, SF)
    sizes = {r.session_date: r.bytes for r in sessions.sizes(spark, SF).collect()}
    assert sessions.cost(spark, SF, queries.START, queries.END) == sum(n for d, n in sizes.items() if queries.START <= d <= queries.END) > 0
    assert sessions.cost(spark, SF, date(2030, 1, 1), date(2030, 1, 2)) == 0


def test_scans_equal_one_pass(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), i, rng.choice([None, rng.randrange(-9, 20)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "at int, id int, v int").repartition(5)
    got = scan.running(df, ["at", "id"], {"total": scan.Step("sum", F.col("v")), "most": scan.Step("max", F.col("v"), exclusive=True)}).collect()
    total, most, want = 0, None, {}
    for at, i, v in sorted(rows):
        want[i] = (total := total + (v or 0), most)
        most = v if most is None else max(most, v if v is not None else most)
    assert {r.id: (r.total, r.most) for r in got} == want and len(got) == 3000
    assert sorted(r.n for r in scan.numbered(df, ["at", "id"], "n", 7).collect()) == list(range(7, 3007))
    assert scan.numbered(df.limit(0), ["at"], "n").collect() == []


def test_scans_leave_no_rows_to_one_task(spark):
    df = spark.range(1000).withColumn("v", F.lit(1))
    ranged = scan.dealt(df, ["id"])
    plan = scan.scanned(ranged, ["id"], {"n": scan.Step("sum", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    # What one task gets is aggregated by range before.
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate(keys=[_range" in part
    assert "Exchange SinglePartition" in plan and plan.count("Window") >= 2


def test_islands_of_a_whole_table(spark):
    rng = random.Random(4)
    spans = [(s := rng.randrange(3000), s + rng.randrange(-2, 9)) for _ in range(500)]
    covered, want = sorted((s, e) for s, e in spans if s <= e), []
    for s, e in covered:
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    got = scan.islands(spark.createDataFrame(spans, "start long, end long").repartition(4)).collect()
    assert sorted([r.start, r.end] for r in got) == want
    days = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 5)), (date(2024, 1, 6), date(2024, 1, 9)), (date(2024, 1, 11), date(2024, 1, 11))], "start date, end date")
    assert sorted((r.start.day, r.end.day) for r in scan.islands(days).collect()) == [(1, 9), (11, 11)]
    assert scan.islands(days.limit(0)).collect() == []


def test_flows_go_on_over_midnight_and_are_ordered_once(spark, tmp_path):
    rng, directory = random.Random(12), str(tmp_path)
    rows = visits(rng, [1, 2, 3, 4], range(1, 40))
    at = datetime(2024, 1, 2, 23, 40)
    for minutes, kind in ((0, "view"), (0, "cart"), (30, "purchase"), (30, "view"), (60, "error"), (91, "view")):  # gaps of 30 minutes go on, of 31 do not
        rows.append((90_000 + len(rows), at + timedelta(minutes=minutes), 99, kind, 1.0, "{}"))
    rows += [(99_998, at, None, "view", 1.0, "{}"), (99_999, datetime(2024, 1, 3), 98, "view", 1.0, "{}")]
    write(spark, f"{directory}/events.parquet", rows)
    want, ordered = [], sorted((u, t, i, kind) for i, t, u, kind, *_ in rows if u is not None)
    for (u, t, _, a), (v, s, _, b) in zip(ordered, ordered[1:], strict=False):
        if u == v and s - t <= timedelta(minutes=30):
            want.append((u, t.date(), a, b))
    flows = models.traffic_flows(spark, directory)
    assert sorted(map(tuple, flows.select("user_id", "session_date", "traffic_flow_source", "traffic_flow_target").collect())) == sorted(want)
    assert sum(u == 99 for u, *_ in want) == 4 and any(d != e for (_, d, *_), (_, e, *_) in zip(want, want[1:], strict=False))
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
