"""Plans that must hold at scale: what is scanned, pushed down and never shuffled."""

from marram import queries
from marram.operators import intervals, traffic, usage
from marram.plans import sessions
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = physical(queries.QUERIES["total_revenue"](spark, SF))
    assert "ReadSchema: struct<o_totalprice:double>" in plan
    plan = physical(queries.QUERIES["traffic_flow_edges"](spark, SF))
    assert "value:double" not in plan and "props:string" not in plan


def test_top_k_does_not_sort_everything(spark):
    for name in ("top_k_limit_plus_one", "name_match_union", "top_reasons"):
        assert "TakeOrderedAndProject" in physical(queries.QUERIES[name](spark, SF))


def test_no_plan_multiplies_rows(spark):
    run_jobs = ("ingest_reasons", "retained_days", "fleet_summary")
    names = [n for n in queries.QUERIES if not n.startswith("stream_") and n not in ("repeat_rate", "retention_w1_w4", *run_jobs)]
    for name in names:
        plan = physical(queries.QUERIES[name](spark, SF))
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_overlap_joins_are_equi_joins(spark):
    a = spark.range(10).select(F.lit(1).alias("k"), F.current_date().alias("start"), F.current_date().alias("end"))
    plan = physical(intervals.overlap_join(a, a, ["k"]))
    assert "NestedLoop" not in plan and ("SortMergeJoin" in plan or "HashJoin" in plan)


def test_distinct_users_use_two_phases(spark):
    plan = physical(usage.active_users(usage.usage_events(spark, SF), "day"))
    assert plan.count("HashAggregate") >= 3 and "BatchEvalPython" not in plan


def test_report_scans_the_wanted_days_once(spark):
    sessions.prepare(spark, SF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plans = [physical(x) for x in (traffic.traffic_summary(spark, SF, queries.START, queries.END), traffic.report(sessions.sessions(spark, SF), queries.START, queries.END))]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for plan in plans:
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(scans) == 1 and "sessions-" in scans[0]
        assert "PartitionFilters: [isnotnull(session_date" in scans[0] and ">= 2024-01-01)" in scans[0] and "<= 2024-01-30)" in scans[0]
        assert "session_source" not in scans[0].split("ReadSchema")[1]


def test_usage_scans_the_events_once(spark):
    assert physical(usage.deduplicated(usage.usage_events(spark, SF))).count("FileScan") == 1
