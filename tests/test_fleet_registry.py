"""All tenants' reports in one pruned plan, and names looked up by rare substrings."""

import random

from marram import queries
from marram.functions.text import fold
from marram.operators import fleet, registry, traffic
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fleet_report_prunes_tenants_and_days(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows, active = queries._fleet(spark, SF)
    found = fleet.reports(rows, active, queries.START, queries.END)
    plan = physical(found)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    (scan,) = [line for line in plan.splitlines() if "FileScan" in line and "fleet-" in line]
    filters = scan.split("PartitionFilters: ")[1].split("]")[0]
    assert "dynamicpruning" in filters and "session_date" in filters
    assert "session_source" not in scan.split("ReadSchema")[1] and "NestedLoop" not in plan
    found.collect()
    read = physical(found)  # as it ran
    assert "ArrowEvalPython" not in read


def test_fleet_reports_equal_one_report_a_tenant(spark):
    rows, active = queries._fleet(spark, SF)
    some = active.where(F.col("tenant_id").isin("1", "2", "23"))  # the last one has no sessions
    got = fleet.reports(rows, some, queries.START, queries.END)
    columns = ["period_key", "day_index", "metric_date", "is_headline", *traffic.COUNTS]
    for tenant in ("1", "2", "23"):
        own = traffic.aggregates(rows.where(F.col("tenant_id") == tenant), queries.START, queries.END)
        assert sorted(map(str, got.where(F.col("tenant_id") == tenant).select(*columns).collect())) == sorted(map(str, own.select(*columns).collect()))
    assert fleet.reports(rows, active.limit(0), queries.START, queries.END).collect() == []


def test_more_tenants_than_are_broadcast(spark, monkeypatch):
    rows, active = queries._fleet(spark, SF)
    want = sorted(map(str, fleet.reports(rows, active, queries.START, queries.END).collect()))
    monkeypatch.setattr(fleet, "BROADCAST_TENANTS", 3)
    assert sorted(map(str, fleet.reports(rows, active, queries.START, queries.END).collect())) == want


def test_partial_matches_equal_brute_force(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abＡé ß") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = [(str(i), n, "p", "active", None, f"{n[:2]}|x{i}") for i, n in enumerate(names)] + [("900", None, "p", "active", None, "ab"), ("901", " ", "p", "active", None, None)]
    r = registry.prepared(registry.from_rows(spark, rows))
    requests = ["", " ", None, "a", "A", "ab", "zz", "bab", "ＡＢ", "ßa", "é", "abab", "a b", "aab", "aab"] + names[:20]
    found = registry.partial_matches(registry.postings(r), spark.createDataFrame([(x,) for x in requests], "name string"))
    want = {(q, i) for q in requests if q and fold(q) for i, n, *_ in rows if n and n.strip() and fold(q) in fold(n)}
    got = found.collect()
    assert {(x["name"], x.tenant_id) for x in got} == want and len(got) == len(want)
    assert "NestedLoop" not in physical(found) and "Cartesian" not in physical(found)
    for q in ("ab", "a", names[3]):
        one = [(x.tenant_id, x.match_type) for x in registry.candidates(r, q).collect()]
        many = registry.resolutions(r, registry.postings(r), spark.createDataFrame([(q,), ("zz",)], "name string")).where(F.col("name") == q).orderBy("rank").collect()
        assert [(x.tenant_id, x.match_type) for x in many] == one


def test_candidates_of_many_names_are_read_where_they_are(spark, monkeypatch):
    assert "hashpartitioning(gram" not in physical(queries.QUERIES["batch_candidates"](spark, SF))
    r = queries._registry(spark, SF)
    want = sorted(map(str, registry.postings(r).collect()))
    monkeypatch.setattr(registry, "NAMES_A_TASK", 20)
    many = registry.postings(r)
    assert many.rdd.getNumPartitions() == registry.named(r).count() // 20 + 1 > 3 and sorted(map(str, many.collect())) == want


def test_partial_matches_shuffle_no_index(spark):
    plan = physical(queries.QUERIES["batch_partial_matches"](spark, SF))
    assert "hashpartitioning(gram" not in plan and plan.count("FileScan") == 2


def test_lookups_shuffle_no_index_where_spark_broadcasts_nothing(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(queries.QUERIES["batch_partial_matches"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(gram" not in plan and "BroadcastHashJoin" in plan


def test_many_lookups_take_no_frequent_substring_into_one_task(spark, monkeypatch):
    names = [f"customer {i}" for i in range(400)]
    r = registry.prepared(registry.from_rows(spark, [(str(i), n, "p", "active", None, None) for i, n in enumerate(names)]))
    requests = ["CUS", "us", "r 39", "7", "mer 12", "zz"]
    monkeypatch.setattr(registry, "NAMES_A_TASK", 20)
    monkeypatch.setattr(registry, "SENT_BYTES", 0, raising=False)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = registry.partial_matches(registry.postings(r), spark.createDataFrame([(x,) for x in requests], "name string"))
        got = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((q, str(i), n) for q in requests for i, n in enumerate(names) if q.lower() in n)
    assert sorted((x["name"], x.tenant_id, x.normalized_name) for x in got) == want
    for q in ("CUS", "us"):
        tasks = [x.task for x in got if x["name"] == q]
        assert max(map(tasks.count, set(tasks))) < 200, q


def test_a_frequent_substring_that_nobody_asks_for_is_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(registry, "NAMES_A_TASK", 20)
    rows = [(str(i), f"customer {i}", "p", "active", None, None) for i in range(400)]
    index = registry.postings(registry.prepared(registry.from_rows(spark, rows)))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    dealt = registry._in_groups(index, counts, counts.where("gram IN ('cus', '7', '399')").withColumns({"name": F.col("gram"), "key": F.col("gram")})).groupBy("gram", "group").count().collect()
    size = {g: [x["count"] for x in dealt if x.gram == g] for g in ("cus", "ust", "7", "399", "38")}
    assert sum(size["cus"]) == 400 and max(size["cus"]) < 60 and len(size["7"]) > 1 and size["ust"] == [] and size["399"] == [1] and size["38"] == [14]


def test_a_prepared_registry_answers_without_python(spark):
    r = queries._registry(spark, SF)
    for name in ("registry_issues", "unique_active_customers", "alias_explode", "name_match_union", "registry_duplicates"):
        plan = physical(queries.QUERIES[name](spark, SF))
        assert "ArrowEvalPython" not in plan and plan.count("FileScan") <= 6, name
    raw = registry.from_rows(spark, [("1", "Ｓｕｎ", "p", "active", True, "ｂ|B"), ("2", "Plain", "p", "active", None, "b"), ("3", " ", "p", "active", None, "q")])
    assert sorted(map(str, registry.quality_issues(raw).collect())) == sorted(map(str, registry.quality_issues(registry.prepared(raw)).collect()))
    assert {(x.tenant_id, x.normalized_alias, x.alias_no) for x in registry.alias_rows(raw).collect()} == {("1", "b", 0), ("1", "b", 1), ("2", "b", 0)}
    assert set(registry.SCHEMA.replace(",", "").split()[::2]) < set(r.columns)
