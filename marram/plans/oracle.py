"""The model tables in DuckDB's SQL, written apart from the DataFrame versions so that the two check each other."""

from __future__ import annotations

from .models import CAMPAIGNS, COUNTRIES, DEVICES, MEDIUMS, REGIONS, SOURCES


def _pick(values: tuple[str, ...], k: str) -> str:
    return f"(CAST({list(values)} AS VARCHAR[]))[CAST(({k}) % {len(values)} AS INT) + 1]"


_K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT)"

NUMBERED = f"""numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (
    SELECT *, {_K} AS k, CASE WHEN lag(ts) OVER u IS NULL OR ts - lag(ts) OVER u > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens
    FROM events WHERE user_id IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)))"""

SESSIONS = f"""{NUMBERED}, grouped AS (
  SELECT user_id, session_no, min(ts) AS ts, arg_min(k, (ts, event_id)) AS k, arg_min(event_type, (ts, event_id)) AS landing, arg_max(event_type, (ts, event_id)) AS exit_event, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases
  FROM numbered GROUP BY user_id, session_no),
sessions AS (SELECT user_id || '-' || CAST(session_no AS BIGINT) AS session_uid, CAST(ts AS DATE) AS session_date, CAST(user_id AS VARCHAR) AS user_pseudo_id,
  CASE WHEN session_no = 1 THEN 'new_user' ELSE 'returning_user' END AS user_label,
  {_pick(SOURCES, "k")} AS session_source, {_pick(MEDIUMS, "k // 5")} AS session_medium, {_pick(CAMPAIGNS, "k")} AS session_campaign,
  {_pick(DEVICES, "k")} AS device_category, {_pick(COUNTRIES, "k")} AS country, {_pick(REGIONS, "k // 4")} AS region,
  'Page ' || landing AS first_page_title, exit_event, n_events, n_purchases, n_events = 1 AS bounced FROM grouped)"""

WEB_EVENTS = f"""web_events AS (SELECT event_id, ts, CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INT) AS event_hour, CAST(dayofweek(ts) + 1 AS INT) AS event_day_of_week,
  CAST(user_id AS VARCHAR) AS user_pseudo_id, event_type, value, 'Page ' || event_type AS page_title, 'https://shop.example/' || event_type || '/' || (k % 10) AS page_location_clean,
  CASE WHEN event_type = 'view' AND k % 3 = 0 THEN 'term' || (k % 7) END AS search_term FROM (SELECT *, {_K} AS k FROM events))"""

USERS = """users AS (SELECT c_custkey AS user_id, c_mktsegment, count(o_orderkey) AS purchase_count, sum(o_totalprice) AS purchase_revenue,
  CASE WHEN coalesce(sum(o_totalprice), 0) < 100000 THEN '0-100k' WHEN sum(o_totalprice) < 500000 THEN '100k-500k' WHEN sum(o_totalprice) < 1000000 THEN '500k-1m' ELSE '1m+' END AS revenue_range
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment)"""

LABELLED_ORDERS = """labelled_orders AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'first' ELSE 'repeat' END AS order_label FROM orders)"""

ORDERS = """all_orders AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS order_date FROM orders)"""

TRAFFIC_FLOWS = f"""{NUMBERED}, traffic_flows AS (SELECT * FROM (SELECT user_id, session_no, CAST(ts AS DATE) AS session_date, event_type AS traffic_flow_source,
  lead(event_type) OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS traffic_flow_target FROM numbered) WHERE traffic_flow_target IS NOT NULL)"""

MODELS = {"sessions": SESSIONS, "web_events": WEB_EVENTS, "users": USERS, "labelled_orders": LABELLED_ORDERS, "all_orders": ORDERS, "traffic_flows": TRAFFIC_FLOWS}
