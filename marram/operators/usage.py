"""Product-usage measures over an append-only event stream.

A usage event has interaction_id, event_name, event_time (UTC), user_id (null: unknown), status, latency_ms, reason.
Days are calendar days of Asia/Taipei, weeks open on Monday.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import scan
from marram.sources.tables import table

ZONE = "Asia/Taipei"
RETENTION_WEEKS = 4


def usage_events(spark: SparkSession, directory: str) -> DataFrame:
    """The events table as usage events: errors are failures, every fourth event has been sent twice."""
    e = table(spark, directory, "events")
    rows = e.select(
        F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("interaction_id"),
        F.lit("request").alias("event_name"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        F.round(F.col("value") * 10, 2).alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("reason_"), F.get_json_object("props", "$.k").cast("int") % 7)).alias("reason"),
    )
    again = F.pmod(F.substring("interaction_id", 2, 20).cast("long"), F.lit(4)) == 0
    return rows.withColumn("_sent", F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_sent")


def deduplicated(events: DataFrame) -> DataFrame:
    """One event of each identity. Resends are alike, so a combinable pick serves; nothing is ordered."""
    return events.dropDuplicates(["event_name", "interaction_id"])


def local_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def local_week(ts: Column) -> Column:
    return F.date_trunc("week", local_day(ts)).cast("date")


def active_users(events: DataFrame, bucket: str) -> DataFrame:
    """Distinct known users by ``day``, ``week`` or ``month``."""
    day = local_day(F.col("event_time"))
    at = {"day": day, "week": local_week(F.col("event_time")), "month": F.trunc(day, "month")}[bucket]
    return events.where("user_id IS NOT NULL").groupBy(at.alias(bucket)).agg(F.count_distinct("user_id").alias("active_users"))


def activity(events: DataFrame) -> DataFrame:
    """Active days and requests of each known user."""
    return events.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count_distinct(local_day(F.col("event_time"))).alias("active_days"), F.count("*").alias("requests"))


def rates(events: DataFrame) -> DataFrame:
    """One row: share of users active on two days or more, share of requests that succeed or fail."""
    users = activity(events).agg(F.round(F.try_divide(F.count_if(F.col("active_days") > 1), F.count("*")), 6).alias("repeat_rate"))
    all_ = events.agg(*[F.round(F.try_divide(F.count_if(F.col("status") == s), F.count("*")), 6).alias(n) for s, n in (("succeeded", "success_rate"), ("failed", "failure_rate"))])
    return users.crossJoin(all_)  # two single rows


def first_success(events: DataFrame) -> DataFrame:
    """The ledger: each user's first success. A late event may move it earlier."""
    return events.where("status = 'succeeded' AND user_id IS NOT NULL").groupBy("user_id").agg(F.min("event_time").alias("first_success_at"))


def retention(events: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Cohorts by week of first success, and how many of them come back 1 to 4 weeks later; null while a week is not complete.

    ``covered`` (one row, through: a time before which all events are known, or null) says up to which day events are whole;
    without it the day of the last event counts as whole.
    """
    cohorts = first_success(events).select("user_id", local_week(F.col("first_success_at")).alias("cohort"))
    weeks = events.where("user_id IS NOT NULL").select("user_id", local_week(F.col("event_time")).alias("week")).distinct()
    joined = cohorts.join(weeks, "user_id").withColumn("offset", (F.datediff("week", "cohort") / 7).cast("int"))
    if covered is None:
        last = events.agg(F.max(local_day(F.col("event_time"))).alias("last_day"))
    else:
        last = covered.select(F.date_sub(local_day(F.col("through")), 1).alias("last_day"))
    back = [F.count_if(F.col("offset") == i).alias(f"w{i}") for i in range(1, RETENTION_WEEKS + 1)]
    found = joined.groupBy("cohort").agg(F.count_distinct("user_id").alias("cohort_size"), *back).crossJoin(F.broadcast(last))  # one row
    complete = lambda i: F.date_add("cohort", 7 * i + 6) <= F.col("last_day")
    return found.select("cohort", "cohort_size", *[F.when(complete(i), F.col(f"w{i}")).alias(f"w{i}") for i in range(1, RETENTION_WEEKS + 1)])


def latency(events: DataFrame) -> DataFrame:
    """Exact 50th and 95th percentiles by status, interpolated between neighbours; null latencies count as requests only.

    Equal latencies are counted first; a scan over all statuses and values then tells which of them hold a percentile's ranks, so no
    status is ordered in one task, however many values it has.
    """
    counts = events.where("latency_ms IS NOT NULL").groupBy("status", "latency_ms").agg(F.count("*").alias("n"))
    placed = scan.running(counts, ["status", "latency_ms"], {"upto": scan.Step("sum", F.col("n"))})
    own = placed.groupBy("status").agg(F.min(F.col("upto") - F.col("n")).alias("before"), F.sum("n").alias("total"))
    rows = placed.join(own, "status").withColumn("last", F.col("upto") - F.col("before") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("latency_ms")))

    def percentile(q: float) -> Column:
        rank = F.lit(q) * (F.col("total") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        return F.round(low + F.max(rank - F.floor(rank)) * (high - low), 4)

    found = rows.groupBy("status").agg(percentile(0.5).alias("p50"), percentile(0.95).alias("p95"))
    return events.groupBy("status").agg(F.count("*").alias("n")).join(found, "status", "left").select("status", "p50", "p95", "n")


def top_reasons(events: DataFrame, k: int = 5) -> DataFrame:
    return events.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def funnel(events: DataFrame) -> DataFrame:
    """Known users by the furthest of three steps: any request, a success, a success on a later day than the first."""
    day = local_day(F.col("event_time"))
    ok = F.when(F.col("status") == "succeeded", day)
    users = events.where("user_id IS NOT NULL").groupBy("user_id").agg(F.min(ok).alias("first"), F.max(ok).alias("last"))
    return users.agg(F.count("*").alias("requested"), F.count("first").alias("succeeded"), F.count_if(F.col("last") > F.col("first")).alias("succeeded_again"))
