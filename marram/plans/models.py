"""The four model tables of web analytics, derived from events, orders and parts.

``sessions``       a row per inferred session: gaps of over 30 minutes between a user's events start a new one
``web_events``     a row per event with page, search term and calendar columns
``order_items``    a row per order with its items nested
``users``          a row per customer with purchase counts and revenue
``all_orders``     a row per order; ``labelled_orders`` says too whether it is its customer's first
``traffic_flows``  a row per step from one event type to the next inside a session
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.sources.tables import table

GAP_MINUTES = 30
SESSIONS = "session_uid string, session_date date, user_pseudo_id string, user_label string, session_source string, session_medium string, session_campaign string, device_category string, country string, region string, first_page_title string, exit_event string, n_events long, n_purchases long, bounced boolean, ended_at timestamp_ntz"
SESSION_COLUMNS = [c.split()[0] for c in SESSIONS.split(", ")]

#: What the events' integer property selects. Fixed values.
SOURCES = ("google", "newsletter", "direct", "facebook", "partner")
MEDIUMS = ("organic", "email", "none", "cpc", "referral")
CAMPAIGNS = ("spring", "summer", "autumn", "winter")
DEVICES = ("desktop", "mobile", "tablet")
COUNTRIES = ("TW", "JP", "US", "DE")
REGIONS = ("north", "south", "east")


def pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.lit(list(values)), (k % len(values)).cast("int") + 1)


def prop(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def sessionize(events: DataFrame, minutes: int = GAP_MINUTES, carried: DataFrame | None = None) -> DataFrame:
    """``events`` with ``session_no``, counted from 1 for each user.

    A user's days are ordered one by one, and only a row per day is looked at across days: a user with a large share
    of all events is still spread over as many tasks as there are days. Events without a user are left out. ``carried`` has,
    by user_id, the sessions before these events (n_sessions) and the end of the last one (ended_at), which may go on.
    """
    known = events.where("user_id IS NOT NULL").withColumn("_day", F.to_date("ts"))
    day = Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")
    gap = F.make_interval(mins=F.lit(minutes))
    after = F.lag("ts").over(day)
    known = known.withColumn("_new", F.when(after.isNotNull() & (F.col("ts") > after + gap), 1).otherwise(0))
    known = known.withColumn("_in_day", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    days = known.groupBy("user_id", "_day").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.sum("_new").alias("_n"))
    across = Window.partitionBy("user_id").orderBy("_day")
    before, counted = F.lag("_last").over(across), F.lit(0)
    if carried is not None:
        days = days.join(carried.select("user_id", F.col("n_sessions").alias("_had"), F.col("ended_at").cast(events.schema["ts"].dataType).alias("_ended")), "user_id", "left")
        before, counted = F.coalesce(before, "_ended"), F.coalesce("_had", F.lit(0))
    opens = F.when(before.isNull() | (F.col("_first") > before + gap), 1).otherwise(0)
    days = days.withColumn("_opens", opens)
    earlier = F.coalesce(F.sum(F.col("_opens") + F.col("_n")).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("user_id", "_day", (counted + earlier + F.col("_opens")).alias("_base"))
    return known.join(days, ["user_id", "_day"]).withColumn("session_no", F.col("_base") + F.col("_in_day")).drop("_day", "_new", "_in_day", "_base")


def session_rows(events: DataFrame) -> DataFrame:
    """A row per session of ``events`` (as ``sessionize``, with ``prop``), with user_id and session_no."""
    at = F.struct("ts", "event_id", "k", "event_type")
    rows = events.groupBy("user_id", "session_no").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"))
    k = F.col("first.k")
    return rows.select(
        "user_id",
        "session_no",
        F.concat_ws("-", "user_id", "session_no").alias("session_uid"),
        F.to_date("first.ts").alias("session_date"),
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        F.when(F.col("session_no") == 1, "new_user").otherwise("returning_user").alias("user_label"),
        pick(SOURCES, k).alias("session_source"),
        pick(MEDIUMS, F.floor(k / 5)).alias("session_medium"),
        pick(CAMPAIGNS, k).alias("session_campaign"),
        pick(DEVICES, k).alias("device_category"),
        pick(COUNTRIES, k).alias("country"),
        pick(REGIONS, F.floor(k / 4)).alias("region"),
        F.concat(F.lit("Page "), "first.event_type").alias("first_page_title"),
        F.col("last.event_type").alias("exit_event"),
        "n_events",
        "n_purchases",
        (F.col("n_events") == 1).alias("bounced"),
        F.col("last.ts").cast("timestamp_ntz").alias("ended_at"),
    )


def build_sessions(spark: SparkSession, directory: str) -> DataFrame:
    """All sessions from all events; ``plans/sessions.py`` keeps them as a table."""
    return session_rows(sessionize(prop(table(spark, directory, "events")))).select(*SESSION_COLUMNS)


def web_events(spark: SparkSession, directory: str) -> DataFrame:
    e = prop(table(spark, directory, "events"))
    location = F.concat(F.lit("https://shop.example/"), "event_type", F.lit("/"), (F.col("k") % 10).cast("string"), F.lit("?k="), F.col("k").cast("string"), F.lit("#top"))
    return e.select(
        "event_id",
        "ts",
        F.to_date("ts").alias("event_date"),
        F.hour("ts").alias("event_hour"),
        F.dayofweek("ts").alias("event_day_of_week"),
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        "event_type",
        "value",
        F.concat(F.lit("Page "), "event_type").alias("page_title"),
        location.alias("page_location"),
        F.regexp_replace(location, "[?#].*$", "").alias("page_location_clean"),
        F.when((F.col("event_type") == "view") & (F.col("k") % 3 == 0), F.concat(F.lit("term"), (F.col("k") % 7).cast("string"))).alias("search_term"),
    )


def order_items(spark: SparkSession, directory: str) -> DataFrame:
    """Orders have a handful of lines, so nesting them bounds every array."""
    lines, parts = table(spark, directory, "lineitem"), table(spark, directory, "part")
    item = F.struct(F.col("p_name").alias("item_name"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"))
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def revenue_range(revenue: Column) -> Column:
    return F.when(revenue < 100_000, "0-100k").when(revenue < 500_000, "100k-500k").when(revenue < 1_000_000, "500k-1m").otherwise("1m+")


def users(spark: SparkSession, directory: str) -> DataFrame:
    orders, customers = table(spark, directory, "orders"), table(spark, directory, "customer")
    bought = orders.groupBy("o_custkey").agg(F.count("*").alias("purchase_count"), F.sum("o_totalprice").alias("purchase_revenue"), F.min("o_orderdate").alias("first_order"))
    rows = customers.join(bought, customers["c_custkey"] == bought["o_custkey"], "left")
    count = F.coalesce("purchase_count", F.lit(0))
    return rows.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", count.alias("purchase_count"), "purchase_revenue", revenue_range(F.coalesce("purchase_revenue", F.lit(0.0))).alias("revenue_range"), "first_order")


def labelled_orders(spark: SparkSession, directory: str) -> DataFrame:
    """Orders with ``order_label``: a customer's first one, or a repeat. The first is found by a combinable minimum, not by ordering."""
    orders = table(spark, directory, "orders")
    first = orders.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    rows = orders.join(first, "o_custkey")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("order_date"), F.when(F.col("o_orderkey") == F.col("first.o_orderkey"), "first").otherwise("repeat").alias("order_label"))


def all_orders(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("order_date"))


def traffic_flows(spark: SparkSession, directory: str) -> DataFrame:
    """Events are ordered once, by user and day: only an event of a day's first minutes can go on from the day before, so these few
    are dealt to that day too, where they end a step but begin none.
    """
    events = table(spark, directory, "events").where("user_id IS NOT NULL")
    gap, own = F.make_interval(mins=F.lit(GAP_MINUTES)), F.to_date("ts")
    before = F.to_date(F.col("ts") - gap)
    dealt = events.withColumn("_day", F.explode(F.when(before < own, F.array(own, before)).otherwise(F.array(own))))
    step = Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")
    goes_on = F.lead("ts").over(step) <= F.col("ts") + gap
    rows = dealt.select("user_id", "_day", own.alias("session_date"), F.col("event_type").alias("traffic_flow_source"), F.when(goes_on, F.lead("event_type").over(step)).alias("traffic_flow_target"))
    return rows.where("session_date = _day AND traffic_flow_target IS NOT NULL").drop("_day")


#: By name, with what reads them; sessions come from their table (``plans/sessions.py``).
MODELS = {"web_events": web_events, "users": users, "labelled_orders": labelled_orders, "all_orders": all_orders, "traffic_flows": traffic_flows}
