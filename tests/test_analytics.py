from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from marram import queries
from marram.functions import dates, text
from marram.operators import intervals, metrics, registry, traffic, usage
from marram.plans import catalog, models, policy
from marram.plans import sessions as session_table
from marram.sources import tables
from marram.streaming import events as streams
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SESSIONS = "session_date date, session_uid string, user_pseudo_id string, user_label string"
D = date


def sessions(spark, rows):
    return spark.createDataFrame([(d, u, p, n) for d, u, p, n in rows], SESSIONS)


def report(spark, rows, start, end):
    return traffic.contract(traffic.report(sessions(spark, rows), start, end).collect())


def test_distinct_users_do_not_add_up_and_days_are_filled(spark):
    rows = [(D(2024, 1, 8), "a", "u1", "new_user"), (D(2024, 1, 9), "b", "u1", "returning_user"), (D(2024, 1, 9), "c", "u2", "odd"), (D(2024, 1, 9), "c", "u2", "odd"), (D(2024, 1, 4), "d", "u3", "new_user"), (D(2024, 1, 12), "x", "u9", "new_user"), (None, "y", "u8", "new_user")]
    out = report(spark, rows, D(2024, 1, 8), D(2024, 1, 11))
    assert out["current"] == {"total_sessions": 3, "total_users": 2, "new_users": 1, "returning_users": 1}
    assert out["previous"] == {"total_sessions": 1, "total_users": 1, "new_users": 1, "returning_users": 0}
    assert [d["current"]["total_users"] for d in out["daily_series"]] == [1, 2, 0, 0]
    assert out["change_pct"] == {"total_sessions": 200.0, "total_users": 100.0, "new_users": 0.0, "returning_users": None}


@pytest.mark.parametrize("days", [1, 7, 90])
def test_empty_periods(spark, days):
    start = D(2024, 3, 1)
    out = report(spark, [], start, start + timedelta(days=days - 1))
    assert len(out["daily_series"]) == days and out["change_pct"]["total_users"] is None and out["current"]["total_sessions"] == 0


def test_changes_are_rounded(spark):
    pairs = spark.createDataFrame([(100, 120), (80, 90), (60, 70), (30, 35), (1, 0)], "a long, b long")
    assert [r[0] for r in pairs.select(traffic.change(F.col("a"), F.col("b"))).collect()] == [-16.67, -11.11, -14.29, -14.29, None]


@pytest.mark.parametrize("bad", [None, -1, 1.5, Decimal("1.5"), True, "1"])
def test_contract_refuses_bad_counts(spark, bad):
    row = traffic.report(sessions(spark, []), D(2024, 1, 1), D(2024, 1, 1)).first().asDict(recursive=True)
    row["current_period"]["total_users"] = bad
    with pytest.raises(traffic.ContractError):
        traffic.contract([row])
    with pytest.raises(traffic.ContractError):
        traffic.contract([])


def test_contract_accepts_whole_decimals_and_checks_days(spark):
    row = traffic.report(sessions(spark, []), D(2024, 1, 1), D(2024, 1, 2)).first().asDict(recursive=True)
    row["current_period"]["total_users"] = Decimal("3")
    assert traffic.contract([row])["current"]["total_users"] == 3
    row["daily_series"][1]["day_index"] = 0
    with pytest.raises(traffic.ContractError):
        traffic.contract([row])


def naive_sessions(rows):
    last, number, out = {}, {}, {}
    for user, ts, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        if user not in last or ts - last[user] > timedelta(minutes=30):
            number[user] = number.get(user, 0) + 1
        last[user] = ts
        out[i] = number[user]
    return out


def test_sessions_over_days_equal_one_pass(spark):
    t = datetime(2024, 1, 1, 23, 0)
    steps = [0, 30, 29, 31, 5, 0, 600, 1440, 30, 4000, 25, 25, 25, 25]
    rows = []
    for user in (1, 2, None):
        ts = t
        for k, s in enumerate(steps if user != 2 else steps[::-1]):
            ts += timedelta(minutes=s)
            rows.append((user, ts, len(rows)))
    df = spark.createDataFrame([(i, ts, u) for u, ts, i in rows], "event_id long, ts timestamp_ntz, user_id long")
    got = {r.event_id: r.session_no for r in models.sessionize(df).collect()}
    assert got == naive_sessions(rows)
    assert models.sessionize(df.limit(0)).collect() == []


def test_metric_requests(spark):
    session_table.prepare(spark, SF)
    period = (queries.START, queries.END)
    out = metrics.request(spark, SF, ["total_sessions", "sessions_by_source", "total_sessions"], period, limit=2)
    assert [m["metric_id"] for m in out] == ["total_sessions", "sessions_by_source"] and not out[0]["truncated"] and out[1]["truncated"] and len(out[1]["rows"]) == 2
    both = metrics.fused(spark, SF, ["total_sessions", "total_users"], period).first()
    assert both.total_sessions == out[0]["rows"][0]["total_sessions"] and both.total_users > 0
    assert catalog.metric("purchase_count_hist").date_scope == "all_available_data"


@pytest.mark.parametrize(
    ("ids", "profile", "code"),
    [([], None, "invalid_metric_request"), (["Bad id"], None, "invalid_metric_request"), (["total_users"] * 6, None, "too_many_metrics"), (["invented_roas"], None, "unsupported_metric"), (["orders_by_label"], "non_ecommerce", "unsupported_metric"), (["total_users"], "x", "invalid_semantic_profile")],
)
def test_refused_requests(ids, profile, code):
    with pytest.raises(catalog.CatalogError) as e:
        metrics.check_request(ids, profile)
    assert e.value.code == code


def test_search_ranks_and_limits(spark):
    found = [tuple(r)[:2] for r in metrics.search(spark, "sessions by source").collect()]
    assert found[0][0] == "sessions_by_source" and found == sorted(found, key=lambda r: (-r[1], r[0]))
    assert metrics.search(spark, "平均回購次數", "ecommerce").first().metric_id == "avg_repurchase_count"
    assert {tuple(r.profiles) for r in metrics.search(spark, "conversions").where("metric_id = 'total_conversions'").collect()} == {("ecommerce",), ("non_ecommerce",)}
    assert metrics.search(spark, "", limit=99).count() == 25 and metrics.search(spark, "qqqq").count() == 0


ROWS = [
    ("1", "Ｓｕｎｎｙ Digital", "p-1", "active", True, "小太陽| |Sunny||"),
    ("2", "Other", "p 2", " ACTIVE ", None, None),
    ("3", "Third", None, "active", False, "sunny"),
    ("4", None, "p", "active", None, "x"),
    ("5", "Brand", "p", "provisioning", None, "Brand|ｂｒａｎｄ|公司"),
    ("6", "third", "p", "active", None, "OTHER"),
]


def code_of(f, *args):
    with pytest.raises(registry.TenantError) as e:
        f(*args)
    return e.value.code


def test_names_resolve_across_widths_and_cases(spark):
    r = registry.prepared(registry.from_rows(spark, ROWS)).cache()
    assert registry.resolve(r, " sunny DIGITAL ") == registry.Tenant("1", "Ｓｕｎｎｙ Digital", "p-1", "ecommerce", "exact")
    assert registry.resolve(r, "小太陽").match_type == "alias"
    expected = {"": "invalid_customer_name", "nobody": "tenant_not_found", "Sunny": "ambiguous_tenant", "THIRD": "ambiguous_tenant", "digi": "tenant_confirmation_required", "r": "customer_name_too_broad", "Brand": "tenant_inactive", "other": "invalid_tenant_routing"}
    assert {n: code_of(registry.resolve, r, n) for n in expected} == expected
    assert {x.tenant_id for x in registry.active_customers(r).collect()} == {"1", "2"}


def test_registry_rules(spark):
    found = {(r.code, tuple(r.tenant_ids), r.n_tenants, r.alias) for r in registry.quality_issues(registry.from_rows(spark, ROWS)).collect()}
    assert found == {
        ("empty_alias", ("1",), 1, None),
        ("duplicate_alias_across_tenants", ("1", "3"), 2, "Sunny"),
        ("generic_alias", ("5",), 1, "公司"),
        ("duplicate_alias_within_tenant", ("5",), 1, "ｂｒａｎｄ"),
        ("duplicate_alias_across_tenants", ("5",), 1, "Brand"),
        ("alias_matches_formal_name", ("5",), 1, "Brand"),
        ("alias_matches_formal_name", ("5",), 1, "ｂｒａｎｄ"),
        ("duplicate_formal_name", ("3", "6"), 2, None),
        ("alias_conflicts_with_formal_name", ("2", "6"), 2, "OTHER"),
    }
    row = registry.quality_report(registry.from_rows(spark, ROWS)).first()
    assert (row.status, row.tenant_count, row.skipped_unnamed_tenant_count, row.alias_count) == ("failed", 6, 1, 7)
    assert registry.quality_report(registry.from_rows(spark, [])).first().status == "passed"


def test_generic_names_and_aliases_of_very_many_tenants(spark, monkeypatch):
    rows = [(f"{i:03}", f"Name {i}", "p", "active", None, "Shared" if i % 2 else "ＬＴＤ．") for i in range(40)]
    monkeypatch.setattr(registry, "SHOWN", 5)
    r = registry.prepared(registry.from_rows(spark, rows)).cache()
    found = {i.alias: i for i in registry.quality_issues(r).where("code = 'duplicate_alias_across_tenants'").collect()}
    assert found["Shared"].n_tenants == 20 and found["Shared"].tenant_ids == ["001", "003", "005", "007", "009"]
    assert registry.quality_issues(r).where("code = 'generic_alias'").count() == 20
    wide = registry.prepared(registry.from_rows(spark, [("1", "Brand company", "p", "active", None, None), ("2", "Co. of brands", "p", "active", None, None)])).cache()
    assert code_of(registry.resolve, wide, "company") == code_of(registry.resolve, wide, "co.") == "customer_name_too_broad"
    assert code_of(registry.resolve, wide, "brands") == "tenant_confirmation_required"


def test_metrics_that_profiles_define_differently():
    for ids, profile, code in ((["total_conversions"], None, "semantic_profile_required"), (["session_value"], "ecommerce", "metric_definition_conflict"), (["session_value"], None, "metric_definition_conflict")):
        with pytest.raises(catalog.CatalogError) as e:
            metrics.check_request(ids, profile)
        assert e.value.code == code
    assert {p: catalog.metric("total_conversions", p).filter for p in catalog.PROFILES} == {"ecommerce": "event_type = 'purchase'", "non_ecommerce": "event_type = 'signup'"}
    assert catalog.resolved_profile(["aov", "total_users"], None) == ("ecommerce", "only_common_profile")
    assert catalog.resolved_profile(["total_users"], None) == ("ecommerce", "same_in_all_profiles")
    assert catalog.resolved_profile(["total_conversions"], "non_ecommerce") == ("non_ecommerce", "requested")


def test_service_answers_and_refuses(spark, tmp_path):
    from marram.plans.service import Service

    asked = Service(spark, registry.from_rows(spark, ROWS), lambda t: SF, D(2024, 2, 1))
    models_before = dict(session_table._built)
    session_table._built.clear()
    missing = Service(spark, asked.tenants, lambda t: str(tmp_path), asked.today)  # no application has built a table there
    for call in (lambda: missing.traffic_summary("小太陽", "2024-01-16", "2024-01-30"), lambda: missing.metrics("小太陽", ["total_users"], "2024-01-16", "2024-01-30")):
        with pytest.raises(session_table.NotBuilt) as e:
            call()
        assert e.value.code == "data_unavailable" and e.value.request["resolved_name"] and not session_table._built
    session_table._built.update(models_before)
    session_table.prepare(spark, SF)
    report = asked.traffic_summary("小太陽", "2024-01-16", "2024-01-30", include_query=True)
    assert report["customer"] == {"requested_name": "小太陽", "resolved_name": "Ｓｕｎｎｙ Digital", "match_type": "alias"}
    assert report["report"]["period"]["days"] == 15 and report["report"] == traffic.contract(queries.traffic_summary_nested(spark, SF).collect())
    (record,) = report["query_provenance"]
    assert record["status"] == "executed" and record["estimated_bytes"] > 0 and record["job_ids"] and 0 < record["rows_read"] < 300 and record["arguments"] == {"start_date": "2024-01-16", "end_date": "2024-01-30"}
    answer = asked.metrics("sunny digital", ["total_users", "sessions_by_source", "aov", "total_sessions", "total_users"], "2024-01-16", "2024-01-30", limit=2)
    assert [m["metric_id"] for m in answer["metrics"]] == ["total_users", "sessions_by_source", "aov", "total_sessions"] and answer["profile"] == "ecommerce" and "query_provenance" not in answer
    assert [len(m["rows"]) for m in answer["metrics"]] == [1, 2, 1, 1] and answer["metrics"][1]["truncated"] and answer["metrics"][0]["rows"][0]["total_users"] == report["report"]["current"]["total_users"]
    for call, code, resolved in (
        (lambda: asked.traffic_summary("nobody", "2024-01-16", "2024-01-30"), "tenant_not_found", None),
        (lambda: asked.traffic_summary("Sunny Digital", "2024-01-16", "2024-02-30"), "invalid_date_format", None),
        (lambda: asked.metrics("Sunny Digital", ["invented_roas"], "2024-01-16", "2024-01-30"), "unsupported_metric", None),
        (lambda: asked.metrics("Sunny Digital", ["total_users"], "2024-01-16", "2024-02-10"), "future_date_not_allowed", None),
        (lambda: Service(spark, asked.tenants, asked.directory, asked.today, policy.Policy(max_bytes_per_job=1)).metrics("Sunny Digital", ["total_users"], "2024-01-16", "2024-01-30"), "query_cost_limit_exceeded", "Ｓｕｎｎｙ Digital"),
    ):
        with pytest.raises((LookupError, ValueError)) as e:
            call()
        assert e.value.code == code and e.value.request["resolved_name"] == resolved


def test_policy_from_environment():
    own = policy.Policy.from_environment({"MARRAM_MAX_DAYS": "30", "MARRAM_EARLIEST_DATE": "2022-01-01", "MARRAM_TIMEOUT_S": "2.5"})
    assert own == policy.Policy(earliest=D(2022, 1, 1), max_days=30, timeout_s=2.5)
    for bad in ({"MARRAM_MAX_DAYS": "x"}, {"MARRAM_EARLIEST_DATE": "1"}, {"MARRAM_MAX_BYTES_PER_JOB": "0"}):
        with pytest.raises(ValueError):
            policy.Policy.from_environment(bad)
    assert policy.label("a_b" * 40) == ("a-b" * 40)[:63]


def test_folding(spark):
    cases = ["Straße", "ＳＵＮ", "ひ", "ヒ", " a\t", "ǅ", "", None, "ﬁ"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(text.folded(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [None if c is None else text.fold(c) for c in cases]


def test_period_families(spark):
    def of(kind, today, n=1):
        p = spark.range(1).select(dates.period(kind, F.lit(today), n).alias("p"), dates.days_of(dates.period(kind, F.lit(today), n)).alias("n")).first()
        return p.p.start, p.p.end, p.n

    assert of("rolling_months", D(2026, 9, 14), 3)[2] == 92 and of("rolling_months", D(2026, 9, 14), 6)[2] == 184
    assert of("rolling_weeks", D(2026, 9, 14), 13)[2] == 91 and of("completed_weeks", D(2026, 9, 16), 2) == (D(2026, 8, 31), D(2026, 9, 13), 14)
    assert of("rolling_years", D(2024, 2, 29))[2] == 366 and of("completed_years", D(2026, 9, 14)) == (D(2025, 1, 1), D(2025, 12, 31), 365)
    assert of("year_to_date", D(2026, 9, 14))[2] == 257 and dates.previous(D(2026, 6, 17), D(2026, 9, 14)) == (D(2026, 3, 19), D(2026, 6, 16))
    with pytest.raises(ValueError):
        dates.period("fortnight", F.lit(D(2026, 1, 1)))


def test_interval_unions(spark):
    import random

    rng, base = random.Random(3), D(2024, 1, 1)
    rows = [(k, base + timedelta(days=(s := rng.randrange(100))), base + timedelta(days=s + rng.randrange(-1, 12))) for k in range(6) for _ in range(25)]
    df = spark.createDataFrame(rows, "k int, start date, end date")
    days = {k: {s + timedelta(days=i) for q, s, e in rows if q == k for i in range((e - s).days + 1)} for k in range(6)}
    assert {r.k: r.union_days for r in intervals.union_days(df, "k").collect()} == {k: len(d) for k, d in days.items()}
    pairs = sorted((r.k, r.start, r.end, r.other_start, r.other_end) for r in intervals.overlap_join(df, df, ["k"], 7).collect())
    real = [r for r in rows if r[1] <= r[2]]
    assert pairs == sorted((a[0], a[1], a[2], b[1], b[2]) for a in real for b in real if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    met = {}
    for k, start, end, *_ in pairs:
        last, n = met.get((k, start), (end, 0))
        met[k, start] = (max(last, end), n + 1)
    counts = intervals.overlap_counts(df, "k")
    assert {(r.k, r.start): (r.end, r.n) for r in counts.collect()} == met
    assert intervals.overlap_counts(df.limit(0), "k").collect() == [] and "Join" not in counts._jdf.queryExecution().executedPlan().toString()
    touching = spark.createDataFrame([(D(2024, 1, 1), D(2024, 1, 5)), (D(2024, 1, 6), D(2024, 1, 9)), (D(2024, 1, 11), D(2024, 1, 11))], "start date, end date")
    assert sorted((r.start.day, r.end.day) for r in intervals.islands(touching).collect()) == [(1, 9), (11, 11)]


@pytest.mark.parametrize(
    ("args", "code"),
    [
        (("2024-1-01", "2024-01-02"), "invalid_date_format"),
        (("2024-02-30", "2024-03-02"), "invalid_date_format"),
        (("2024-02-03", "2024-02-02"), "invalid_date_range"),
        (("2020-10-13", "2020-10-20"), "date_before_available_range"),
        (("2024-01-01", "2024-03-31"), "date_range_too_large"),
        (("2020-10-20", "2020-11-20"), "date_before_available_range"),
        (("2026-09-01", "2026-09-15"), "future_date_not_allowed"),
    ],
)
def test_date_limits(args, code):
    with pytest.raises(policy.PolicyError) as e:
        policy.Policy().dates(*args, today=D(2026, 9, 14), comparison_periods=1)
    assert e.value.code == code


def test_date_limits_of_a_table(spark):
    cases = [("2024-1-01", "2024-01-02"), ("2024-02-30", "2024-03-02"), ("2024-02-03", "2024-02-02"), ("2020-10-13", "2020-10-20"), ("2024-01-01", "2024-03-31"), ("2020-10-20", "2020-11-20"), ("2026-09-01", "2026-09-15"), ("2026-06-17", "2026-09-14"), (None, "2024-01-01"), ("2024-01-01 ", "2024-01-01"), ("2024-01-01", "２024-01-01")]
    rows = spark.createDataFrame(cases, "a string, b string").select(policy.Policy().code(F.col("a"), F.col("b"), F.lit(D(2026, 9, 14)), 1)).collect()

    def one(a, b):
        try:
            policy.Policy().dates(a, b, D(2026, 9, 14), 1)
        except policy.PolicyError as e:
            return e.code

    assert [r[0] for r in rows] == [one(a, b) for a, b in cases] and rows[7][0] is None


def test_date_limits_allow_ninety_days():
    assert policy.Policy().dates("2026-06-17", "2026-09-14", D(2026, 9, 14), 1) == (D(2026, 6, 17), D(2026, 9, 14))


def test_preflight_and_guarded_runs(spark):
    made = []
    rows = lambda n, read=100: lambda watch: (made.append(n), watch(spark.range(read)).limit(n))[1]
    limit = policy.Policy(max_bytes_per_job=10, max_bytes_per_request=15, max_bytes_per_day=20)
    for costs, spent, code in (({"a": 5, "b": 11}, 0, "query_cost_limit_exceeded"), ({"a": 8, "b": 8}, 0, "query_cost_limit_exceeded"), ({"a": 8, "b": 5}, 8, "daily_query_quota_exceeded")):
        with pytest.raises(policy.PolicyError) as e:
            policy.execute(spark, {"a": rows(1), "b": rows(2)}, {k: lambda v=v: v for k, v in costs.items()}, limit, spent_today=spent)
        assert e.value.code == code and e.value.details["query"] == "b" and made == []
    with pytest.raises(policy.PolicyError) as e:
        limit.preflight({"a": lambda: 1 // 0})
    assert e.value.code == "query_cost_estimate_failed"
    free = {"a": lambda: 1, "b": lambda: 2}
    runs = policy.execute(spark, {"a": rows(3), "b": lambda watch: watch(spark.range(70)).groupBy(F.col("id") % 9).count()}, free, policy.Policy(), most_rows=5)
    assert [r.status for r in runs] == ["executed"] * 2 and [len(r.rows) for r in runs] == [3, 6] and [r.estimated_bytes for r in runs] == [1, 2]
    assert runs[1].rows_read == 70 and all(r.job_ids and r.stages >= 1 and r.record()["job_ids"] == r.job_ids for r in runs) and not set(runs[0].job_ids) & set(runs[1].job_ids)
    with pytest.raises(policy.PolicyError) as e:
        policy.execute(spark, {"a": lambda watch: spark.range(3).select(F.raise_error(F.lit("no"))), "b": rows(1)}, free, policy.Policy())
    assert [r.status for r in e.value.details["runs"]] == ["failed", "not_executed"] and e.value.code == "query_failed"
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(policy.PolicyError) as e:
        policy.execute(spark, {"a": lambda watch: spark.range(1).select(slow("id"))}, {"a": lambda: 1}, policy.Policy(timeout_s=2))
    assert e.value.code == "query_timeout"


def test_sources(spark, tmp_path):
    with pytest.raises(tables.UnknownTable):
        tables.table(spark, SF, "secrets")
    path = tmp_path / "m.csv"
    path.write_text('﻿id,name\n1,"a\nb"\n2,\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(path), ["id", "name"])
    assert [tuple(r) for r in rows.collect()] == [("1", "a\nb"), ("2", None)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), ["id"])
    with pytest.raises(Exception, match="a row lacks name"):
        tables.read_csv(spark, str(path), ["id", "name"], ["name"]).collect()
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,x\n", encoding="utf-8")
    (folder / "b.csv").write_text("name,id\ny,2\n", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(folder), ["id", "name"]).collect()
    tables.write_json_document(spark, {"b": 1, "a": "é"}, str(tmp_path / "d.json"))
    assert tables.read_json_document(spark, str(tmp_path / "d.json")) == {"a": "é", "b": 1}
    events = spark.createDataFrame([(1, D(2024, 1, 1)), (2, D(2024, 1, 20))], "id int, event_date date")
    tables.write_events(events, str(tmp_path / "e"))
    kept = tables.retained(spark.read.parquet(str(tmp_path / "e")), D(2024, 1, 31), 20)
    assert [r.id for r in kept.collect()] == [2] and "PartitionFilters: [isnotnull(event_date" in kept._jdf.queryExecution().executedPlan().toString()


def test_percentiles_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [(s, rng.choice([None, float(rng.randrange(n)), rng.random()])) for s, n in (("a", 5), ("b", 1000)) for _ in range(700)] + [("c", 2.5), ("d", None)]
    got = {r.status: tuple(r)[1:] for r in usage.latency(spark.createDataFrame(rows, "status string, latency_ms double").repartition(3)).collect()}
    for s in "abcd":
        own = [v for k, v in rows if k == s and v is not None]
        want = tuple(round(float(np.percentile(own, q)), 4) for q in (50, 95)) if own else (None, None)
        assert got[s] == (*want, sum(k == s for k, _ in rows))


def test_usage_measures(spark):
    t = lambda s: datetime.fromisoformat(s)
    rows = [("a", t("2024-01-01T15:59:00"), "u", "succeeded"), ("b", t("2024-01-01T16:01:00"), "u", "failed"), ("c", t("2024-01-09T00:00:00"), "u", "succeeded"), ("c", t("2024-01-09T00:00:00"), "u", "succeeded"), ("d", t("2024-01-20T00:00:00"), None, "failed")]
    df = spark.createDataFrame([(i, "request", x, u, s, 5.0, None) for i, x, u, s in rows], "interaction_id string, event_name string, event_time timestamp, user_id string, status string, latency_ms double, reason string")
    own = usage.deduplicated(df)
    assert own.count() == 4 and {(r.day.day, r.active_users) for r in usage.active_users(own, "day").collect()} == {(1, 1), (2, 1), (9, 1)}
    row = usage.retention(own).first()
    assert (row.cohort, row.cohort_size, row.w1, row.w2, row.w3) == (D(2024, 1, 1), 1, 1, None, None)
    assert tuple(usage.funnel(own).first()) == (1, 1, 1) and usage.rates(own).first().repeat_rate == 1.0


def test_streams_agree_with_batch(spark, tmp_path):
    path = tmp_path / "x" / "events.parquet"
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.unionByName(rows.where("event_id % 3 = 0")).write.parquet(str(path))
    found = streams.deduplicated(streams.read_events(spark, str(tmp_path / "x")), "event_id").select("event_id")
    assert streams.run(found, str(tmp_path / "dedup")).count() == rows.count()
    closed = streams.run(streams.sessions(streams.read_events(spark, SF)), str(tmp_path / "sessions"))
    batch = models.sessionize(rows).groupBy("user_id", "session_no").agg(F.min("ts").cast("timestamp").alias("started_at"), F.count("*").alias("n_events"))
    assert closed.select("user_id", "started_at", "n_events").exceptAll(batch.select("user_id", "started_at", "n_events")).count() == 0
    assert batch.count() - 5 <= closed.count() <= batch.count()


def test_ledger_is_lowered_by_late_events(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string"
    t = datetime(2024, 1, 5)
    for k, batch in enumerate(([(1, t, 1, "view"), (2, t, 2, "error")], [(3, t - timedelta(days=2), 1, "view"), (4, t, 2, "view")], [(5, t + timedelta(days=9), 1, "view")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        streams.keep_ledger(spark.readStream.schema(schema).parquet(path), str(tmp_path / "ledger")).awaitTermination()
        got = {r.user_id: r.first_success_at for r in streams.ledger(spark, str(tmp_path / "ledger")).collect()}
        assert got == ({1: t}, {1: t - timedelta(days=2), 2: t}, {1: t - timedelta(days=2), 2: t})[k]


def test_every_query_has_a_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(queries.SQL) <= set(queries.QUERIES) and len(queries.QUERIES) > 60


def test_definitions(spark):
    from marram.operators import definitions

    columns = "metric_id string, position int, context string, category string, model string, agg string, expr string, filter string, dimensions string"
    rows = [("a", 1, "x", "simple", "s", "AVG", "v", "k <> NULL", "a,b"), ("a", 2, "y", "simple", "s", "average ", "v", "k IS NOT NULL", "a , b"), ("b", 3, "x", "simple", "s", "sum", "v", " ", None), ("b", 4, "x", "simple", "s", "sum", "w", None, None), ("c", 5, "x", "simple", "s", "max", "v", None, None)]
    df = spark.createDataFrame(rows, columns)
    assert {r.metric_id: r.status for r in definitions.catalog_status(df).collect()} == {"a": "published", "b": "conflict", "c": "published"}
    labelled = df.withColumn("label", F.when(F.col("position") == 1, F.col("metric_id")).otherwise("own")).withColumn("order_by", F.when(F.col("position") == 4, "v"))
    assert {(r.metric_id, r.position, r.uses) for r in definitions.preferred(labelled).collect()} == {("a", 2, 2), ("b", 3, 1), ("b", 4, 1), ("c", 5, 1)}
    assert [r["agg"] for r in definitions.normalized(df).orderBy("position").collect()] == ["average", "average", "sum", "sum", None]
    report = definitions.validate(spark, {"good": SF, "bad": "/nowhere"})
    assert {(r["dataset"], r["status"]) for r in report} == {("good", "passed"), ("bad", "failed")}
    fleet = {r.dataset: (r.n_failed > 0, r.any_passed, r.status) for r in definitions.fleet_status(spark, report).collect()}
    assert fleet == {"good": (False, True, "passed"), "bad": (True, False, "failed"), None: (True, True, "failed")}
    assert [r.status for r in definitions.fleet_status(spark, []).collect()] == ["failed"]


def test_catalog_from_two_csv_files(spark, tmp_path):
    from marram.operators import definitions

    metrics_csv, dimensions_csv = tmp_path / "metrics.csv", tmp_path / "dimensions.csv"
    metrics_csv.write_text("metric_id,position,context,category,model,agg,expr,filter,dimensions,label,order_by\na,1,x,simple,s,AVG,v,k <> NULL,\"d1,d2\",A,\na,2,y,simple,s,average,v,k IS NOT NULL,\"d1 , d2\",a,\nb,3,x,simple,s,sum,v,,,B,v\nb,4,x,simple,s,sum,w,,,B,\n", encoding="utf-8")
    dimensions_csv.write_text("dimension_id,label\nd1,One\nd2,Two\n", encoding="utf-8")
    made = definitions.build_from_csv(spark, str(metrics_csv), str(dimensions_csv), "2.0.0")
    assert made["catalog_version"] == "2.0.0" and made["dimensions"] == {"d1": {"label": "One"}, "d2": {"label": "Two"}}
    assert {k: (m["status"], m["variants"], m["dimensions"], m["label"]) for k, m in made["metrics"].items()} == {"a": ("published", 1, ["d1", "d2"], "A"), "b": ("conflict", 2, [], "B")}
    again = definitions.build_from_csv(spark, str(metrics_csv), str(dimensions_csv), "2.0.0")
    dimensions_csv.write_text("dimension_id,label\nd1,Uno\nd2,Two\n", encoding="utf-8")
    assert again == made != definitions.build_from_csv(spark, str(metrics_csv), str(dimensions_csv), "2.0.0")
    dimensions_csv.write_text("dimension_id,label\nd1,One\n", encoding="utf-8")
    with pytest.raises(ValueError, match="unknown dimensions"):
        definitions.build_from_csv(spark, str(metrics_csv), str(dimensions_csv), "2.0.0")


def test_relational_operators(spark):
    from marram.operators import relational

    rows = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "a", 0), (2, "a", 5), (3, None, 1)], "k int, v string, at int")
    need = spark.createDataFrame([("a",), ("b",)], "v string")
    assert [r.k for r in relational.divide(rows, "k", "v", need).collect()] == [1]
    assert {r.k for r in relational.divide(rows, "k", "v", need.limit(0)).collect()} == {1, 2, 3}
    assert {r.k: r.v_list for r in relational.ordered_distinct(rows, ["k"], "v", "at").collect()} == {1: ["a", "b"], 2: ["a"], 3: [None]}
    assert {(r.k, r.v, r.at) for r in relational.best_rows(rows, ["k"], F.col("at")).collect()} == {(1, "a", 3), (2, "a", 5), (3, None, 1)}
    assert {(r.k, r.w) for r in relational.attach(rows.select("k").distinct(), spark.createDataFrame([(1, "z"), (1, "y")], "k int, w string"), "k").collect()} == {(1, "y"), (2, None), (3, None)}


def test_session():
    from marram.session import get_session

    assert get_session().conf.get("spark.sql.session.timeZone") == "UTC"
