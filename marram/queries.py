"""All queries of the analytics library by name, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.functions import dates, text
from marram.operators import definitions, fleet, intervals, metrics, registry, relational, scan, traffic, usage
from marram.plans import models, oracle, sessions
from marram.plans.catalog import METRICS, TIME, Metric, metric
from marram.plans.policy import Policy
from marram.sources import daily
from marram.sources.tables import derived, shared_dir, table
from marram.streaming import contract
from marram.streaming import events as streams

START, END = date(2024, 1, 16), date(2024, 1, 30)
_FIRST, _LAST = dates.previous(START, END)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, of_sessions: bool = False) -> Callable[[Query], Query]:
    """Registers a query and its SQL; one ``of_sessions`` builds what its dataset's session table lacks first."""

    def add(f: Query) -> Query:
        if of_sessions:
            f = _prepared(f)
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _prepared(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        sessions.prepare(spark, d)
        return f(spark, d)

    return run


# Traffic report

_AGGREGATES = f"""{oracle.SESSIONS},
spine AS (SELECT p AS period_key, i AS day_index, CAST(s + INTERVAL (i) DAY AS DATE) AS metric_date
  FROM (VALUES ('current', DATE '{START}'), ('previous', DATE '{_FIRST}')) v(p, s), range(0, {(END - START).days + 1}) r(i)),
aggregates AS (SELECT period_key, day_index, metric_date, grouping(day_index) AS is_headline, count(DISTINCT session_uid) AS total_sessions, count(DISTINCT user_pseudo_id) AS total_users,
  count(DISTINCT CASE WHEN user_label = 'new_user' THEN user_pseudo_id END) AS new_users, count(DISTINCT CASE WHEN user_label = 'returning_user' THEN user_pseudo_id END) AS returning_users
  FROM spine LEFT JOIN sessions ON session_date = metric_date GROUP BY GROUPING SETS ((period_key), (period_key, day_index, metric_date)))"""
_HEAD = "".join(f", max(CASE WHEN period_key = '{k}' THEN {c} END) AS {k}_{c}" for k in ("current", "previous") for c in traffic.COUNTS)


def _aggregates(spark: SparkSession, d: str) -> DataFrame:
    return traffic.aggregates(sessions.sessions(spark, d), START, END)


@query(f"WITH {_AGGREGATES} SELECT period_key, total_sessions, total_users, new_users, returning_users FROM aggregates WHERE is_headline = 1", of_sessions=True)
def traffic_headline(spark: SparkSession, d: str) -> DataFrame:
    return _aggregates(spark, d).where("is_headline = 1").select("period_key", *traffic.COUNTS)


@query(f"WITH {_AGGREGATES} SELECT period_key, CAST(day_index AS INT) AS day_index, metric_date, total_sessions, total_users, new_users, returning_users FROM aggregates WHERE is_headline = 0", of_sessions=True)
def traffic_daily(spark: SparkSession, d: str) -> DataFrame:
    return _aggregates(spark, d).where("is_headline = 0").select("period_key", "day_index", "metric_date", *traffic.COUNTS)


@query(f"WITH {_AGGREGATES} SELECT CAST(day_index AS INT) AS day_index{_HEAD} FROM aggregates GROUP BY day_index", of_sessions=True)
def pivot_current_previous(spark: SparkSession, d: str) -> DataFrame:
    return traffic.pivoted(_aggregates(spark, d)).drop("is_headline", "current_metric_date", "previous_metric_date")


@query(
    f"WITH {_AGGREGATES}, h AS (SELECT 1 AS one{_HEAD} FROM aggregates WHERE is_headline = 1) SELECT "
    + ", ".join(f"CASE WHEN previous_{c} = 0 THEN NULL ELSE round(CAST(current_{c} - previous_{c} AS DOUBLE) / previous_{c} * 100, 2) END AS {c}_change_pct" for c in traffic.COUNTS)
    + " FROM h",
    of_sessions=True,
)
def traffic_change_pct(spark: SparkSession, d: str) -> DataFrame:
    row = traffic.traffic_summary(spark, d, START, END)
    return row.select(*[F.col(f"change_pct.{c}").alias(f"{c}_change_pct") for c in traffic.COUNTS])


@query(of_sessions=True)
def traffic_summary_nested(spark: SparkSession, d: str) -> DataFrame:
    return traffic.traffic_summary(spark, d, START, END)


@query(
    f"WITH {_AGGREGATES}, h AS (SELECT 1 AS one{_HEAD} FROM aggregates WHERE is_headline = 1), s AS (SELECT count(*) AS n_days, CAST(sum(total_sessions) AS BIGINT) AS day_sessions FROM aggregates WHERE is_headline = 0 AND period_key = 'current') "
    f"SELECT DATE '{START}' AS start_date, DATE '{END}' AS end_date, DATE '{_FIRST}' AS previous_start_date, DATE '{_LAST}' AS previous_end_date, n_days, day_sessions, "
    + ", ".join(f"{k}_{c}" for k in ("current", "previous") for c in traffic.COUNTS)
    + " FROM h, s",
    of_sessions=True,
)
def traffic_summary_flat(spark: SparkSession, d: str) -> DataFrame:
    """The report's row with its structs spread out and its daily series added up."""
    row, n = traffic.traffic_summary(spark, d, START, END), F.lit(0).cast("long")
    days = F.aggregate("daily_series", n, lambda acc, x: acc + x["current"]["total_sessions"])
    dates_ = [f"{k}{e}_date" for k in ("", "previous_") for e in ("start", "end")]
    return row.select(*dates_, F.size("daily_series").cast("long").alias("n_days"), days.alias("day_sessions"), *[F.col(f"{k}_period.{c}").alias(f"{k}_{c}") for k in ("current", "previous") for c in traffic.COUNTS])


@query(f"WITH {_AGGREGATES} SELECT CAST(day_index AS INT) AS day_index{_HEAD} FROM aggregates WHERE is_headline = 0 GROUP BY day_index", of_sessions=True)
def daily_series_rows(spark: SparkSession, d: str) -> DataFrame:
    day = traffic.traffic_summary(spark, d, START, END).select(F.inline("daily_series"))
    return day.select("day_index", *[F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("current", "previous") for c in traffic.COUNTS])


@query(f"SELECT p AS period_key, CAST(i AS INT) AS day_index, CAST(s + INTERVAL (i) DAY AS DATE) AS metric_date FROM (VALUES ('current', DATE '{START}'), ('previous', DATE '{_FIRST}')) v(p, s), range(0, 15) r(i)")
def date_spine(spark: SparkSession, d: str) -> DataFrame:
    return traffic.spine(spark, START, END).where("day_index >= 0")


@query(f"WITH {oracle.SESSIONS} SELECT session_source, session_medium, CAST(grouping(session_medium) AS INT) AS all_media, count(DISTINCT user_pseudo_id) AS users FROM sessions GROUP BY GROUPING SETS ((session_source), (session_source, session_medium))", of_sessions=True)
def grouping_sets_sessions(spark: SparkSession, d: str) -> DataFrame:
    s, m = F.col("session_source"), F.col("session_medium")
    return sessions.sessions(spark, d).groupingSets([[s], [s, m]], s, m).agg(F.grouping("session_medium").cast("int").alias("all_media"), F.count_distinct("user_pseudo_id").alias("users"))


@query(f"WITH {oracle.SESSIONS} SELECT session_uid, session_date, user_pseudo_id, user_label, n_events, exit_event FROM sessions", of_sessions=True)
def inferred_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessions(spark, d).select("session_uid", "session_date", "user_pseudo_id", "user_label", "n_events", "exit_event")


_BITMAPS = f"WITH {oracle.SESSIONS} SELECT {{0}} AS {{1}}, count(DISTINCT user_pseudo_id) AS active_users FROM sessions GROUP BY 1"


@query(f"WITH {_AGGREGATES} SELECT period_key, CAST(day_index AS INT) AS day_index, metric_date, CAST(is_headline AS INT) AS is_headline, total_sessions, total_users, new_users, returning_users FROM aggregates", of_sessions=True)
def traffic_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Headline and days of both periods from the bitmaps of days alone."""
    return traffic.stored_aggregates(sessions.visitors(spark, d), START, END)


@query(_BITMAPS.format("CAST(date_trunc('week', session_date) AS DATE)", "week"), of_sessions=True)
def session_wau(spark: SparkSession, d: str) -> DataFrame:
    return traffic.active_users(sessions.visitors(spark, d), "week")


@query(_BITMAPS.format("CAST(date_trunc('month', session_date) AS DATE)", "month"), of_sessions=True)
def session_mau(spark: SparkSession, d: str) -> DataFrame:
    return traffic.active_users(sessions.visitors(spark, d), "month")


# Metrics: one query each, by the catalog


def _aggregate_sql(aggregation: str, expression: str, condition: str | None) -> str:
    of = {"average": f"avg({expression})", "count": f"count({expression})", "count_distinct": f"count(DISTINCT {expression})", "min": f"min({expression})", "sum": f"CAST(sum({expression}) AS BIGINT)"}[aggregation]
    return of + (f" FILTER (WHERE {condition})" if condition else "")


def _metric_sql(m: Metric, period: bool) -> str:
    if m.ratio:
        top, bottom = (_aggregate_sql(*part) for part in m.ratio)
        out = f"CASE WHEN {bottom} = 0 THEN NULL ELSE round(CAST({top} AS DOUBLE) / {bottom}, 6) END"
    else:
        out = _aggregate_sql(m.aggregation, m.expression, None)
        out = f"round({out}, 6)" if m.aggregation == "average" else out
    where = [m.filter] if m.filter else []
    if period and TIME[m.model]:
        where.append(f"{TIME[m.model]} BETWEEN DATE '{START}' AND DATE '{END}'")
    dims = ", ".join(m.dimensions)
    return f"WITH {oracle.MODELS[m.model]} SELECT {dims + ', ' if dims else ''}{out} AS {m.id} FROM {m.model}" + (f" WHERE {' AND '.join(where)}" if where else "") + (f" GROUP BY {dims}" if dims else "")


def _metric_queries() -> None:
    for base in METRICS.values():
        for profile in base.profiles if base.filters else base.profiles[:1]:
            m = metric(base.id, profile)
            name = f"{m.id}_{profile}" if base.filters else m.id
            period = None if m.model in ("labelled_orders", "all_orders") else (START, END)
            compute = lambda spark, d, m=m, period=period, profile=profile: metrics.compute(spark, d, m.id, period, profile)
            QUERIES[name] = _prepared(compute) if m.model == "sessions" else compute
            SQL[name] = _metric_sql(m, period is not None)


_metric_queries()


@query("WITH " + oracle.WEB_EVENTS + " SELECT event_type, count(*) AS n, count(DISTINCT user_pseudo_id) AS users, round(avg(CASE WHEN event_hour >= 12 THEN 1.0 ELSE 0.0 END), 6) AS afternoon_share FROM web_events GROUP BY event_type")
def count_distinct_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = models.web_events(spark, d)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_pseudo_id").alias("users"), F.round(F.avg(F.when(F.col("event_hour") >= 12, 1.0).otherwise(0.0)), 6).alias("afternoon_share"))


@query(
    f"WITH {oracle.SESSIONS} SELECT count(DISTINCT session_uid) AS total_sessions, count(DISTINCT user_pseudo_id) AS total_users, CAST(sum(n_events) FILTER (WHERE NOT bounced) AS BIGINT) AS engagement, "
    f"round(CAST(count(DISTINCT user_pseudo_id) FILTER (WHERE user_label = 'returning_user') AS DOUBLE) / count(DISTINCT user_pseudo_id), 6) AS returning_user_share FROM sessions WHERE session_date BETWEEN DATE '{START}' AND DATE '{END}'",
    of_sessions=True,
)
def fused_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fused(spark, d, ["total_sessions", "total_users", "engagement", "returning_user_share"], (START, END))


@query("SELECT p_name AS item_name, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_name")
def items_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Lines are added up by part before parts give their names. Quantities are whole numbers, so their sum is exact in any order."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    sold = lines.groupBy("l_partkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    rows = sold.join(parts, sold["l_partkey"] == parts["p_partkey"]).groupBy(F.col("p_name").alias("item_name"))
    return rows.agg(F.sum("lines").alias("lines"), F.sum("quantity").cast("long").alias("quantity"))


@query("SELECT l_orderkey AS order_id, count(*) AS n_items, string_agg(p_name, '|' ORDER BY p_name, l_quantity, l_linenumber) AS items FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def order_items(spark: SparkSession, d: str) -> DataFrame:
    items = models.order_items(spark, d)
    return items.select("order_id", F.size("items").cast("long").alias("n_items"), F.array_join("items.item_name", "|").alias("items"))


@query(f"WITH {oracle.WEB_EVENTS} SELECT event_date, page_location_clean, count(*) AS n FROM web_events GROUP BY ALL ORDER BY n DESC, event_date, page_location_clean LIMIT 51")
def top_k_limit_plus_one(spark: SparkSession, d: str) -> DataFrame:
    rows = models.web_events(spark, d).groupBy("event_date", "page_location_clean").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "event_date", "page_location_clean").limit(metrics.ROWS + 1)


# All tenants at once

_TENANTS = 20
_FLEET = f"""{oracle.SESSIONS}, owned AS (SELECT *, CAST(CAST(user_pseudo_id AS BIGINT) % {_TENANTS} + 1 AS VARCHAR) AS tenant_id FROM sessions),
spine AS (SELECT p AS period_key, i AS day_index, CAST(s + INTERVAL (i) DAY AS DATE) AS metric_date FROM (VALUES ('current', DATE '{START}'), ('previous', DATE '{_FIRST}')) v(p, s), range(0, {(END - START).days + 1}) r(i)),
active AS (SELECT CAST(c_custkey AS VARCHAR) AS tenant_id FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND c_custkey <= {_TENANTS + 5}),
places AS (SELECT * FROM active, spine),
found AS (SELECT places.tenant_id, period_key, day_index, metric_date, CAST(grouping(day_index) AS INT) AS is_headline, count(DISTINCT session_uid) AS total_sessions, count(DISTINCT user_pseudo_id) AS total_users,
  count(DISTINCT CASE WHEN user_label = 'new_user' THEN user_pseudo_id END) AS new_users, count(DISTINCT CASE WHEN user_label = 'returning_user' THEN user_pseudo_id END) AS returning_users
  FROM places LEFT JOIN owned ON owned.tenant_id = places.tenant_id AND session_date = metric_date GROUP BY GROUPING SETS ((places.tenant_id, period_key), (places.tenant_id, period_key, day_index, metric_date)))"""
_fleets: dict[tuple[str, str, int], str] = {}


def _fleet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sessions by tenant and day, written once for each version of the session table; and the active tenants."""
    key = (spark.sparkContext.applicationId, d, sessions.prepare(spark, d).version)
    if key not in _fleets:
        _fleets[key] = f"{shared_dir(spark)}/fleet-{uuid.uuid4().hex}"
        tenant = (F.col("user_pseudo_id").cast("long") % _TENANTS + 1).cast("string")
        fleet.write(sessions.sessions(spark, d).withColumn("tenant_id", tenant), _fleets[key])
    active = registry.active_customers(_registry(spark, d)).where(F.col("tenant_id").cast("long") <= _TENANTS + 5)
    return spark.read.schema(models.SESSIONS + ", tenant_id string").parquet(_fleets[key]), active


@query(f"WITH {_FLEET} SELECT tenant_id, period_key, CAST(day_index AS INT) AS day_index, metric_date, is_headline, total_sessions, total_users, new_users, returning_users FROM found")
def fleet_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every active tenant's headline and days in one plan."""
    return fleet.reports(*_fleet(spark, d), START, END)


@query(
    f"WITH {_FLEET}, h AS (SELECT tenant_id{_HEAD} FROM found WHERE is_headline = 1 GROUP BY tenant_id) SELECT *, "
    + ", ".join(f"CASE WHEN previous_{c} = 0 THEN NULL ELSE round(CAST(current_{c} - previous_{c} AS DOUBLE) / previous_{c} * 100, 2) END AS {c}_change_pct" for c in traffic.COUNTS)
    + " FROM h"
)
def fleet_summary(spark: SparkSession, d: str) -> DataFrame:
    return fleet.summary(fleet.reports(*_fleet(spark, d), START, END))


# Scans over one global order


@query("SELECT o_orderkey, spent, spent <= 1000000000 AS admitted FROM (SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM orders)")
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests in time, admitted while their cost in cents is within one budget."""
    requests = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    return scan.admitted(requests, ["o_orderdate", "o_orderkey"], "cost", 1_000_000_000).select("o_orderkey", "spent", "admitted")


_BUSY = "SELECT epoch_us(ts) AS s, epoch_us(ts) + 60000000 * (1 + event_id % 20) AS e FROM events WHERE event_type = 'purchase'"


@query(
    f"SELECT min(s) AS start_us, max(e) AS end_us FROM (SELECT s, e, sum(opens) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT s, e, CASE WHEN s > max(e) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM (SELECT s, max(e) AS e FROM ({_BUSY}) GROUP BY s))) GROUP BY island"
)
def busy_periods(spark: SparkSession, d: str) -> DataFrame:
    """The times in which any purchase was under way, over all users at once."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, d, "events").where("event_type = 'purchase'").select(start.alias("start"), (start + 60_000_000 * (1 + F.col("event_id") % 20)).alias("end"))
    return scan.islands(spans).select(F.col("start").alias("start_us"), F.col("end").alias("end_us"))


# Registry

_REGISTRY = """r AS (SELECT CAST(c_custkey AS VARCHAR) AS tenant_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS tenant_name, CASE WHEN c_custkey % 3 = 0 THEN 'provisioning' ELSE ' Active ' END AS status,
  CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS ec, 'client ' || c_custkey || '| |' || c_mktsegment || CASE WHEN c_custkey % 50 = 0 THEN '|Ltd.' ELSE '' END AS aliases FROM customer),
n AS (SELECT *, lower(trim(tenant_name)) AS normalized_name FROM r WHERE nullif(trim(tenant_name), '') IS NOT NULL),
a AS (SELECT tenant_id, normalized_name, trim(x) AS alias, lower(trim(x)) AS normalized_alias FROM (SELECT *, unnest(string_split(aliases, '|')) AS x FROM n) WHERE trim(x) <> '')"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry with its names folded, stored once for the customers as they are."""
    return derived(spark, "registry", f"{d}/customer.parquet", lambda: registry.prepared(registry.from_customers(table(spark, d, "customer"))))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, "postings", f"{d}/customer.parquet", lambda: registry.postings(_registry(spark, d)))


@query(f"WITH {_REGISTRY} SELECT tenant_id, tenant_name, normalized_name, CASE WHEN ec THEN 'ecommerce' ELSE 'non_ecommerce' END AS profile FROM n WHERE lower(trim(status)) = 'active' AND normalized_name IN (SELECT normalized_name FROM n GROUP BY 1 HAVING count(*) = 1)")
def unique_active_customers(spark: SparkSession, d: str) -> DataFrame:
    return registry.active_customers(_registry(spark, d))


@query(f"WITH {_REGISTRY} SELECT tenant_id, alias, normalized_alias FROM a")
def alias_explode(spark: SparkSession, d: str) -> DataFrame:
    return registry.alias_rows(_registry(spark, d)).select("tenant_id", "alias", "normalized_alias")


@query(
    f"WITH {_REGISTRY} SELECT tenant_id, normalized_name, match_type FROM (SELECT tenant_id, normalized_name, 'exact' AS match_type, 0 AS o FROM n WHERE normalized_name = 'client 12' UNION ALL SELECT tenant_id, normalized_name, 'alias', 1 FROM a WHERE normalized_alias = 'client 12' UNION ALL SELECT tenant_id, normalized_name, 'partial', 2 FROM n WHERE contains(normalized_name, 'client 12')) ORDER BY o, normalized_name, tenant_id LIMIT 22"
)
def name_match_union(spark: SparkSession, d: str) -> DataFrame:
    return registry.candidates(_registry(spark, d), " CLIENT 12 ").select("tenant_id", "normalized_name", "match_type")


@query(f"WITH {_REGISTRY} SELECT tenant_id, normalized_name FROM n WHERE contains(normalized_name, '00001') ORDER BY normalized_name, tenant_id LIMIT 22")
def substring_candidates(spark: SparkSession, d: str) -> DataFrame:
    return registry.candidates(_registry(spark, d), "00001").where("match_type = 'partial'").select("tenant_id", "normalized_name")


@query(f"WITH {_REGISTRY} SELECT q.name, tenant_id, 'alias' AS match_type FROM (SELECT DISTINCT upper(c_mktsegment) AS name FROM customer) q JOIN a ON normalized_alias = lower(q.name)")
def batch_resolution(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.upper("c_mktsegment").alias("name")).distinct()
    return registry.matches_of(_registry(spark, d), wanted)


_REQUESTS = "q AS (SELECT DISTINCT upper(substr(c_name, 8 + c_custkey % 8, 2 + c_custkey % 5)) AS name FROM customer WHERE c_custkey % 25 = 0)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").where(key % 25 == 0).select(F.upper(F.substr("c_name", (8 + key % 8).cast("int"), (2 + key % 5).cast("int"))).alias("name"))


@query(f"WITH {_REGISTRY}, {_REQUESTS} SELECT name, tenant_id, normalized_name FROM q JOIN n ON contains(normalized_name, lower(name))")
def batch_partial_matches(spark: SparkSession, d: str) -> DataFrame:
    """Many requested substrings against all names, by their rarest three characters."""
    return registry.partial_matches(_postings(spark, d), _requests(spark, d))


@query(
    f"WITH {_REGISTRY}, {_REQUESTS}, w AS (SELECT name FROM q UNION SELECT upper(c_mktsegment) FROM customer), m AS (SELECT name, tenant_id, normalized_name, 'exact' AS match_type, 1 AS o FROM w JOIN n ON normalized_name = lower(name) "
    "UNION ALL SELECT name, tenant_id, normalized_name, 'alias', 2 FROM w JOIN a ON normalized_alias = lower(name) UNION ALL SELECT name, tenant_id, normalized_name, 'partial', 3 FROM w JOIN n ON contains(normalized_name, lower(name))) "
    "SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY o, normalized_name, tenant_id) AS INT) AS rank, tenant_id, match_type FROM m QUALIFY rank <= 22"
)
def batch_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first 22 matches of every request: exact, by alias, partial."""
    requests = _requests(spark, d).union(table(spark, d, "customer").select(F.upper("c_mktsegment")))
    return registry.resolutions(_registry(spark, d), _postings(spark, d), requests)


@query(f"WITH {_REGISTRY} SELECT normalized_alias AS alias_key, count(*) AS n_rows, count(DISTINCT tenant_id) AS n_tenants FROM a GROUP BY 1 HAVING count(*) > 1")
def registry_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = registry.alias_rows(_registry(spark, d)).groupBy(F.col("normalized_alias").alias("alias_key"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("tenant_id").alias("n_tenants")).where("n_rows > 1")


@query(f"""WITH {_REGISTRY} SELECT code, count(*) AS n FROM (SELECT 'empty_alias' AS code FROM n UNION ALL SELECT 'duplicate_alias_across_tenants' FROM (SELECT normalized_alias FROM a GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_formal_name' FROM (SELECT normalized_name FROM n GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'alias_matches_formal_name' FROM a WHERE normalized_alias = normalized_name UNION ALL SELECT 'generic_alias' FROM a WHERE normalized_alias = 'ltd.') GROUP BY code""")
def registry_issues(spark: SparkSession, d: str) -> DataFrame:
    return registry.quality_issues(_registry(spark, d)).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, lower(c_name) AS name_key, regexp_replace(lower(c_name), '[^0-9a-z]+', '', 'g') AS compact_key FROM customer")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Unicode-aware keys of names in full-width letters."""
    wide = F.translate("c_name", "CustomerABC#0123456789", "Ｃｕｓｔｏｍｅｒ" + "ＡＢＣ＃０１２３４５６７８９")
    rows = table(spark, d, "customer").select("c_custkey", text.folded(wide).alias("name_key"))
    return rows.withColumn("compact_key", text.compact(F.col("name_key")))


def _search_sql(short: str, tokens: tuple[str, ...]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = []
    for m in METRICS.values():
        terms = [m.label.lower(), *[x.replace("_", " ") for x in m.dimensions]]
        text = " ".join([m.id, terms[0], *m.aliases, *m.dimensions, *terms[1:]]).lower()
        rows += [f"({quoted(m.id)}, {quoted(terms[0])}, {quoted(text)}, [{', '.join(map(quoted, terms))}], {quoted(p)}, {quoted(repr(metric(m.id, p)))})" for p in m.profiles]
    k = lambda c: f"regexp_replace({c}, '[^0-9a-z㐀-鿿]+', '', 'g')"
    hits = [f"30 * CAST(contains({k('txt')}, '{short}') AS INT)"] + [f"20 * CAST({k(c)} <> '' AND contains('{short}', {k(c)}) AS INT)" for c in ("label", "metric_id")] + [f"5 * CAST(contains(txt, '{t}') AS INT)" for t in tokens]
    score = " + ".join([*hits, f"8 * len(list_filter(terms, lambda t: {k('t')} <> '' AND contains('{short}', {k('t')})))"])
    return f"WITH c(metric_id, label, txt, terms, profile, definition) AS (VALUES {', '.join(rows)}), s AS (SELECT *, {score} AS score FROM c) SELECT metric_id, CAST(max(score) AS INT) AS score, string_agg(profile, ',' ORDER BY profile) AS profiles FROM s WHERE score > 0 GROUP BY metric_id, definition ORDER BY score DESC, metric_id, definition LIMIT 25"


@query(_search_sql("sessionsbysource", ("sessions", "by", "source")))
def metric_search(spark: SparkSession, d: str) -> DataFrame:
    return metrics.search(spark, "sessions by source", limit=25).withColumn("profiles", F.array_join("profiles", ","))


_PARTS = "SELECT 'part_' || p_partkey AS metric_id, lower(p_name) AS label, lower(p_brand || ' ' || p_type) AS words, [lower(p_name), lower(p_brand), lower(p_type)] AS terms, CASE WHEN p_size % 2 = 0 THEN 'ecommerce' ELSE 'non_ecommerce' END AS profile FROM part"


def _part_search_sql(short: str, tokens: tuple[str, ...]) -> str:
    k = lambda c: f"regexp_replace({c}, '[^0-9a-z㐀-鿿]+', '', 'g')"
    hits = [f"30 * CAST(contains({k('txt')}, '{short}') AS INT)"] + [f"20 * CAST({k(c)} <> '' AND contains('{short}', {k(c)}) AS INT)" for c in ("label", "metric_id")] + [f"5 * CAST(contains(txt, '{t}') AS INT)" for t in tokens]
    score = " + ".join([*hits, f"8 * len(list_filter(terms, lambda t: {k('t')} <> '' AND contains('{short}', {k('t')})))"])
    return f"WITH p AS ({_PARTS}), s AS (SELECT *, metric_id || ' ' || label || ' ' || words AS txt FROM p) SELECT metric_id, CAST({score} AS INT) AS score, profile AS profiles FROM s WHERE {score} > 0 ORDER BY score DESC, metric_id LIMIT 25"


@query(_part_search_sql("smallringofbrand17economy", ("small", "ring", "of", "brand#17", "economy")))
def part_search(spark: SparkSession, d: str) -> DataFrame:
    """The search over a catalog of the parts: by phrase, name, tokens and terms."""
    name, brand, kind = (F.lower(c) for c in ("p_name", "p_brand", "p_type"))
    key = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    profile = F.when(F.col("p_size") % 2 == 0, "ecommerce").otherwise("non_ecommerce")
    rows = table(spark, d, "part").select(key.alias("metric_id"), name.alias("label"), F.concat_ws(" ", brand, kind).alias("words"), F.array(name, brand, kind).alias("terms"), profile.alias("profile"), key.alias("definition"))
    return metrics.search_rows(rows, "Small ring of Brand#17, ECONOMY", limit=25).withColumn("profiles", F.array_join("profiles", ","))


# Periods

_LIMITS = """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN strftime(s, '%Y/%m/%d') WHEN o_orderkey % 17 = 0 THEN '2024-02-30' ELSE strftime(s, '%Y-%m-%d') END AS start_text, strftime(e, '%Y-%m-%d') AS end_text, s, e, date_diff('day', s, e) + 1 AS n,
  o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 AS bad FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 9400 AS s, CAST(o_orderdate AS DATE) + 9400 + CAST(o_orderkey % 120 - 5 AS INT) AS e FROM orders)"""


@query(
    f"SELECT o_orderkey, start_text, end_text, CASE WHEN bad THEN 'invalid_date_format' WHEN n < 1 THEN 'invalid_date_range' WHEN s < DATE '2020-10-14' THEN 'date_before_available_range' WHEN n > 90 THEN 'date_range_too_large' WHEN s - CAST(n AS INT) < DATE '2020-10-14' THEN 'date_before_available_range' WHEN e > DATE '2026-09-14' THEN 'future_date_not_allowed' END AS code FROM ({_LIMITS})"
)
def request_limits(spark: SparkSession, d: str) -> DataFrame:
    """A table of requested periods, as texts, against the policy with a comparison period."""
    key, start = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 9400)
    end = F.date_format(F.date_add(start, (key % 120 - 5).cast("int")), "yyyy-MM-dd")
    text_ = F.when(key % 13 == 0, F.date_format(start, "yyyy/MM/dd")).when(key % 17 == 0, "2024-02-30").otherwise(F.date_format(start, "yyyy-MM-dd"))
    rows = table(spark, d, "orders").select("o_orderkey", text_.alias("start_text"), end.alias("end_text"))
    return rows.withColumn("code", Policy().code(F.col("start_text"), F.col("end_text"), F.lit(date(2026, 9, 14)), 1))


_SPANS = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate + INTERVAL (1 + o_orderkey % 90) DAY AS DATE) AS e FROM orders"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_custkey", start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 90).cast("int") + 1).alias("end"))


@query(f"SELECT o_custkey, count(DISTINCT day) AS union_days FROM (SELECT o_custkey, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS day FROM ({_SPANS})) GROUP BY o_custkey")
def interval_union_days(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_days(_spans(spark, d), "o_custkey")


@query(
    f"SELECT o_custkey, s AS start, max(e) AS \"end\", count(*) AS n FROM (SELECT x.o_custkey, x.s, x.e FROM ({_SPANS}) x JOIN ({_SPANS}) y ON x.o_custkey = y.o_custkey AND x.s <= y.e AND y.s <= x.e) GROUP BY o_custkey, s"
)
def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """What a join of overlapping spans counts, without its pairs."""
    return intervals.overlap_counts(_spans(spark, d), "o_custkey")


@query(
    f"SELECT x.o_custkey, x.s AS start, x.e AS \"end\", y.s AS other_start, y.e AS other_end, count(*) AS n FROM ({_SPANS}) x JOIN ({_SPANS}) y ON x.o_custkey = y.o_custkey AND x.s <= y.e AND y.s <= x.e GROUP BY ALL"
)
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Equal intervals are counted first, so a customer's pairs are bounded by the pairs of days."""
    spans = _spans(spark, d).groupBy("o_custkey", "start", "end").agg(F.count("*").alias("n"))
    pairs = intervals.overlap_join(spans, spans.withColumnRenamed("n", "other_n"), ["o_custkey"])
    return pairs.select("o_custkey", "start", "end", "other_start", "other_end", (F.col("n") * F.col("other_n")).alias("n"))


def _period_sql(kind: str, start: str, end: str) -> str:
    return f"SELECT d AS today, '{kind}' AS kind, CAST({start} AS DATE) AS start, CAST({end} AS DATE) AS \"end\" FROM d"


_W, _M, _Y = "date_trunc('week', d)", "date_trunc('month', d)", "date_trunc('year', d)"
_PERIODS = {
    "single_day": ("d - INTERVAL 3 DAY", "d - INTERVAL 3 DAY"),
    "rolling_days": ("d - INTERVAL 2 DAY", "d"),
    "previous_days": ("d - INTERVAL 3 DAY", "d - INTERVAL 1 DAY"),
    "rolling_weeks": ("d - INTERVAL 20 DAY", "d"),
    "completed_weeks": (f"{_W} - INTERVAL 21 DAY", f"{_W} - INTERVAL 1 DAY"),
    "week_to_date": (_W, "d"),
    "rolling_months": ("d - INTERVAL 3 MONTH + INTERVAL 1 DAY", "d"),
    "completed_months": (f"{_M} - INTERVAL 3 MONTH", f"{_M} - INTERVAL 1 DAY"),
    "month_to_date": (_M, "d"),
    "rolling_years": ("d - INTERVAL 3 YEAR + INTERVAL 1 DAY", "d"),
    "completed_years": (f"{_Y} - INTERVAL 3 YEAR", f"{_Y} - INTERVAL 1 DAY"),
    "year_to_date": (_Y, "d"),
}


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) " + " UNION ALL ".join(_period_sql(k, *v) for k, v in _PERIODS.items()))
def period_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every period family (three of each unit) at every order date."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()
    rows = days.select("today", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), dates.period(k, F.col("today"), 3).alias("p")) for k in dates.KINDS])).alias("x"))
    return rows.select("today", "x.kind", "x.p.start", "x.p.end")


# Usage

_USAGE = """e AS (SELECT event_id, 'i' || event_id AS interaction_id, ts, ts + INTERVAL 8 HOUR AS local, CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, round(value * 10, 2) AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'reason_' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) % 7) END AS reason FROM events),
f AS (SELECT user_id, min(ts) AS first_success_at FROM e WHERE status = 'succeeded' AND user_id IS NOT NULL GROUP BY user_id),
c AS (SELECT user_id, CAST(date_trunc('week', first_success_at + INTERVAL 8 HOUR) AS DATE) AS cohort FROM f),
w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', local) AS DATE) AS week FROM e WHERE user_id IS NOT NULL)"""


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.deduplicated(usage.usage_events(spark, d))


@query(f"WITH {_USAGE} SELECT interaction_id, user_id, status, reason FROM e")
def event_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d).select("interaction_id", "user_id", "status", "reason")


def _active(bucket: str) -> Query:
    return lambda spark, d: usage.active_users(_usage(spark, d), bucket)


for _name, _bucket in (("dau", "day"), ("wau", "week"), ("mau", "month")):
    QUERIES[_name] = _active(_bucket)
    SQL[_name] = f"WITH {_USAGE} SELECT CAST(date_trunc('{_bucket}', local) AS DATE) AS {_bucket}, count(DISTINCT user_id) AS active_users FROM e WHERE user_id IS NOT NULL GROUP BY 1"


@query(f"WITH {_USAGE} SELECT user_id, count(DISTINCT CAST(local AS DATE)) AS active_days, count(*) AS requests FROM e WHERE user_id IS NOT NULL GROUP BY user_id")
def active_days(spark: SparkSession, d: str) -> DataFrame:
    return usage.activity(_usage(spark, d))


@query(f"""WITH {_USAGE}, x AS (SELECT user_id, count(DISTINCT CAST(local AS DATE)) AS n FROM e WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT (SELECT round(CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*), 6) FROM x) AS repeat_rate, round(CAST(count(*) FILTER (WHERE status = 'succeeded') AS DOUBLE) / count(*), 6) AS success_rate, round(CAST(count(*) FILTER (WHERE status = 'failed') AS DOUBLE) / count(*), 6) AS failure_rate FROM e""")
def repeat_rate(spark: SparkSession, d: str) -> DataFrame:
    return usage.rates(_usage(spark, d))


@query(
    f"WITH {_USAGE}, l AS (SELECT max(CAST(local AS DATE)) AS last_day FROM e) SELECT cohort, count(DISTINCT user_id) AS cohort_size, "
    + ", ".join(f"CASE WHEN cohort + {7 * i + 6} <= any_value(last_day) THEN count(*) FILTER (WHERE week = cohort + {7 * i}) END AS w{i}" for i in range(1, 5))
    + " FROM c JOIN w USING (user_id), l GROUP BY cohort"
)
def retention_w1_w4(spark: SparkSession, d: str) -> DataFrame:
    return usage.retention(_usage(spark, d))


@query(f"WITH {_USAGE} SELECT user_id, epoch_us(first_success_at) AS first_success_us FROM f")
def first_success_ledger(spark: SparkSession, d: str) -> DataFrame:
    return usage.first_success(_usage(spark, d)).select("user_id", F.unix_micros("first_success_at").alias("first_success_us"))


@query(f"WITH {_USAGE} SELECT status, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, count(*) AS n FROM e GROUP BY status")
def latency_p50_p95(spark: SparkSession, d: str) -> DataFrame:
    return usage.latency(_usage(spark, d))


@query(f"WITH {_USAGE} SELECT reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 5")
def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_reasons(_usage(spark, d))


@query(
    f"WITH {_USAGE}, u AS (SELECT user_id, min(CAST(local AS DATE)) FILTER (WHERE status = 'succeeded') AS a, max(CAST(local AS DATE)) FILTER (WHERE status = 'succeeded') AS b FROM e WHERE user_id IS NOT NULL GROUP BY user_id) SELECT count(*) AS requested, count(a) AS succeeded, count(*) FILTER (WHERE b > a) AS succeeded_again FROM u"
)
def usage_funnel(spark: SparkSession, d: str) -> DataFrame:
    return usage.funnel(_usage(spark, d))


# Catalog building and relational operators

def _definitions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("metric_id"), F.col("p_partkey").alias("position"), F.lit("page").alias("context"), F.lit("simple").alias("category"), F.lit("sessions").alias("model"),
        F.when(size % 5 == 0, " Count Distinct ").otherwise("count_distinct").alias("agg"), F.concat(F.lit("expr_"), (size % 3).cast("string")).alias("expr"),
        F.when(size % 2 == 0, "k <> null").otherwise("k IS NOT NULL").alias("filter"), F.when(size % 7 == 0, "a,b").otherwise("a , b").alias("dimensions"),
        F.when(size % 4 == 0, F.col("p_brand")).otherwise("label").alias("label"), F.when(size % 6 == 0, "x").otherwise(" ").alias("order_by"),
    )


@query("SELECT p_brand AS metric_id, count(DISTINCT p_size % 3) AS variants, CASE WHEN count(DISTINCT p_size % 3) = 1 THEN 'published' ELSE 'conflict' END AS status FROM part GROUP BY p_brand")
def catalog_status(spark: SparkSession, d: str) -> DataFrame:
    return definitions.catalog_status(_definitions(spark, d))


@query("SELECT metric_id, uses, position FROM (SELECT p_brand AS metric_id, p_partkey AS position, count(*) OVER (PARTITION BY p_brand, p_size % 3) AS uses, row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY p_size % 6 <> 0, p_size % 4 = 0, p_partkey) AS rank FROM part) WHERE rank = 1")
def preferred_definitions(spark: SparkSession, d: str) -> DataFrame:
    return definitions.preferred(_definitions(spark, d)).select("metric_id", "uses", "position")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return relational.divide(orders, "o_custkey", "o_orderpriority", orders)


@query("SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY first_key, o_orderpriority) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def ordered_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.ordered_distinct(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return rows.select("o_custkey", F.array_join("o_orderpriority_list", "|").alias("priorities"))


@query("SELECT event_id, event_type, reason FROM events LEFT JOIN (SELECT event_id, min(event_type || '!') AS reason FROM events WHERE event_type = 'error' GROUP BY event_id) USING (event_id)")
def summary_attachment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    extras = e.where("event_type = 'error'").select("event_id", F.concat("event_type", F.lit("!")).alias("reason"))
    return relational.attach(e.select("event_id", "event_type"), extras, "event_id")


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY CAST(o_orderdate AS DATE) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders GROUP BY 1")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals up to each day: rows are aggregated by day first, so the ordered part has one row a day."""
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("running", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 20")
def customers_without_or_many_orders(spark: SparkSession, d: str) -> DataFrame:
    """Anti-join, union and distinct."""
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    none = customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey")
    many = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 20").select(F.col("o_custkey").alias("c_custkey"))
    return none.union(many).distinct()


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 20 GROUP BY 1")
def retained_days(spark: SparkSession, d: str) -> DataFrame:
    """Events appended in five parts to a table by day, compacted, and expired after 20 days."""
    root, events = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}", table(spark, d, "events").select("event_id", "ts")
    for k in range(5):
        daily.append(events.where(F.col("event_id") % 5 == k), root)
    schema = "event_id long, ts " + dict(events.dtypes)["ts"]
    daily.compact(spark, root, schema)
    today = events.agg(F.max(F.to_date("ts"))).first()[0]
    daily.expire(spark, root, today, 20)
    daily.vacuum(spark, root, 1)
    return daily.read(spark, root, schema).groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY event_type")
def named_parameters(spark: SparkSession, d: str) -> DataFrame:
    """SQL text with bound parameters; the table is a parameter too."""
    sql = "SELECT event_type, count(*) AS n FROM {events} WHERE ts >= :start AND ts < :end GROUP BY event_type"
    return spark.sql(sql, args={"start": datetime(2024, 1, 10), "end": datetime(2024, 1, 20)}, events=table(spark, d, "events"))


# Streams


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = streams.deduplicated(streams.read_events(spark, d), "event_id")
    return streams.run(found.select("event_id", "user_id", "event_type"), streams.work_dir(spark))


# A stream writes a window once its end is an hour behind the newest event; watermarks are whole milliseconds.
_MARK = "SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 FROM events"


@query(
    """WITH n AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events WHERE user_id IS NOT NULL))
SELECT user_id, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) + 1800000000 AS closes_us, count(*) AS n_events FROM n GROUP BY user_id, no"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What the stream has written at the table's end: all sessions."""
    found = streams.run_to_end(streams.read_events(spark, d), streams.sessions, streams.work_dir(spark), user_id=0)
    return found.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("closes_at").alias("closes_us"), "n_events")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the stream has written at the table's end: all days."""
    return streams.run_to_end(streams.read_events(spark, d), streams.daily_counts, streams.work_dir(spark))


@query("SELECT CAST(date_trunc('week', ts + INTERVAL 8 HOUR) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the stream has written at the table's end: all weeks, opening on Monday in Taipei."""
    weeks = lambda e: streams.windowed_counts(e.withWatermark("ts", streams.LATENESS)).withColumnRenamed("start", "week")
    return streams.run_to_end(streams.read_events(spark, d), weeks, streams.work_dir(spark))


@query("SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS event_date FROM events")
def stream_stored_once(spark: SparkSession, d: str) -> DataFrame:
    """The events, of which every third has been sent again, stored by day, each once."""
    path, sent = streams.work_dir(spark), streams.read_events(spark, d)
    again = sent.select("*", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")
    streams.store_once(again, path, ["event_id"]).awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", "event_date")


_ATTACHED = "ts + INTERVAL (event_id % 50) HOUR"


@query(
    f"WITH x AS (SELECT event_id, ts, {_ATTACHED} AS attached_at FROM events WHERE event_type = 'error'), mark AS (SELECT (least((SELECT max(epoch_us(ts)) FROM events), (SELECT max(epoch_us(attached_at)) FROM x)) // 1000 - 3600000) * 1000 AS m) "
    "SELECT e.event_id, CAST(date_diff('hour', e.ts, x.attached_at) AS BIGINT) AS hours FROM events e LEFT JOIN x ON x.event_id = e.event_id AND x.attached_at <= e.ts + INTERVAL 48 HOUR, mark WHERE x.event_id IS NOT NULL OR epoch_us(e.ts) + 172800000000 < m"
)
def stream_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Events with what is attached to errors some hours later, if within two days; others once their two days are over."""
    events = streams.read_events(spark, d).select("event_id", "ts")
    late = F.col("ts") + F.make_interval(hours=(F.col("event_id") % 50).cast("int"))
    extras = streams.read_events(spark, d).where("event_type = 'error'").select("event_id", late.alias("attached_at"))
    found = streams.run(streams.attached(events, extras, "event_id", "48 hours"), streams.work_dir(spark))
    return found.select("event_id", ((F.unix_micros("attached_at") - F.unix_micros("ts")) / 3_600_000_000).cast("long").alias("hours"))


@query(
    "SELECT reason, count(*) AS n FROM (SELECT CASE event_id % 20 WHEN 0 THEN 'not_an_object' WHEN 1 THEN 'unknown_schema_version' WHEN 2 THEN 'missing_transport' WHEN 3 THEN 'wrong_type_user_id' WHEN 4 THEN 'unknown_status' WHEN 5 THEN 'invalid_event_time' "
    "WHEN 6 THEN 'invalid_latency_ms' WHEN 7 THEN 'invalid_requested_days' WHEN 8 THEN 'invalid_metrics' WHEN 9 THEN 'stored: wrong_type_tenant_id' ELSE 'stored' END AS reason FROM events) GROUP BY reason"
)
def ingest_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, half of them broken in some way, through the ingest: lines stored and in quarantine, by reason."""
    path, fault = streams.work_dir(spark), F.col("event_id") % 20
    line = F.concat(
        F.lit('{"schema_version": "'), F.when(fault == 1, "0.9").otherwise("1.0"), F.lit('", "event_name": "analytics_request_completed", "event_time": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(fault == 5, "+08:00").otherwise("Z"),
        F.lit('", "interaction_id": "i'), F.col("event_id").cast("string"), F.when(fault == 2, '", ').otherwise('", "transport": "mcp", '), F.lit('"user_id": '), F.when(fault == 3, "7").otherwise('"u7"'),
        F.lit(', "identity_status": "verified", "host": "other", "authorization_result": "allowed", "tool_name": "traffic_summary", "tenant_id": '), F.when(fault == 9, "5").otherwise('"005"'), F.lit(', "resolution": "supported", "status": "'), F.when(fault == 4, "ok").otherwise("success"),
        F.lit('", "latency_ms": '), F.when(fault == 6, "1.5").otherwise("12"), F.lit(', "requested_days": '), F.when(fault == 7, "0").otherwise("null"), F.lit(', "error_code": null, "metrics": '), F.when(fault == 8, '"total_users"').otherwise('["total_users", "total_users"]'), F.lit(', "dimensions": []'), F.when(fault == 0, "").otherwise("}"),
    )
    contract.ingest(streams.read_events(spark, d).select(line.alias("value")), path).awaitTermination()
    stored = spark.read.schema(contract.EVENT).parquet(f"{path}/events").select(F.concat_ws(": ", F.lit("stored"), "flaw").alias("reason"))
    return stored.unionByName(spark.read.parquet(f"{path}/quarantine").select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"WITH {_USAGE}, mark AS (SELECT CAST(make_timestamp(({_MARK} WHERE user_id % 10 <> 0)) + INTERVAL 8 HOUR AS DATE) - 1 AS last_day) SELECT cohort, count(DISTINCT user_id) AS cohort_size, "
    + ", ".join(f"CASE WHEN cohort + {7 * i + 6} <= any_value(last_day) THEN count(*) FILTER (WHERE week = cohort + {7 * i}) END AS w{i}" for i in range(1, 5))
    + " FROM c JOIN w USING (user_id), mark GROUP BY cohort"
)
def stream_retention(spark: SparkSession, d: str) -> DataFrame:
    """Retention of a stream's known users: weeks count as complete up to the watermark that the stream has recorded."""
    path, known = streams.work_dir(spark), streams.read_events(spark, d).where("user_id % 10 <> 0")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    rows = streams.run_recorded(streams.deduplicated(known, "event_id").select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("event_time"), status.alias("status")), path)
    return usage.retention(rows, streams.coverage(spark, path))


@query("SELECT user_id, epoch_us(min(ts)) AS first_success_us FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL GROUP BY user_id")
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    path = streams.work_dir(spark)
    streams.keep_ledger(streams.read_events(spark, d), path).awaitTermination()
    return streams.ledger(spark, path).select("user_id", F.unix_micros("first_success_at").alias("first_success_us"))
