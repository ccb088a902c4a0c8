"""The period-over-period traffic report: exact distinct counts, zero-filled days, change against the period before.

Sessions are aggregated first, by grouping sets over the arithmetic position of their date; the spine of 2 (n + 1)
rows is joined afterwards, so the join never sees a session. Both periods, the headline and the days come from one
scan: of sessions (``aggregates``), or of the bitmaps of users kept for each day (``stored_aggregates``), whose size does not
depend on how often users come.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.dates import previous
from marram.plans import sessions

COUNTS = ("total_sessions", "total_users", "new_users", "returning_users")
CONTRACT_VERSION = "1.0.0"


def aggregates(rows: DataFrame, start: date, end: date) -> DataFrame:
    """(period_key, day_index, is_headline, counts) of both periods; days without sessions have zeros.

    ``rows`` has session_date, session_uid, user_pseudo_id, user_label; session dates are taken as they are.
    """
    days, before = (end - start).days + 1, previous(start, end)[0]
    since = F.datediff("session_date", F.lit(before))
    bounded = rows.where(F.col("session_date").between(F.lit(before), F.lit(end))).select(
        F.when(since < days, "previous").otherwise("current").alias("period_key"), (since % days).alias("day_index"), "session_uid", "user_pseudo_id", "user_label"
    )
    # Repeats of a session do not count: all four are distinct counts, combined map-side.
    found = bounded.groupingSets(
        [[F.col("period_key")], [F.col("period_key"), F.col("day_index")]], F.col("period_key"), F.col("day_index")
    ).agg(
        F.grouping("day_index").cast("int").alias("is_headline"),
        F.count_distinct("session_uid").alias("total_sessions"),
        F.count_distinct("user_pseudo_id").alias("total_users"),
        F.expr("count(DISTINCT user_pseudo_id) FILTER (WHERE user_label = 'new_user')").alias("new_users"),
        F.expr("count(DISTINCT user_pseudo_id) FILTER (WHERE user_label = 'returning_user')").alias("returning_users"),
    )
    return _filled(found, start, end)


def stored_aggregates(visitors: DataFrame, start: date, end: date) -> DataFrame:
    """``aggregates`` from rows of (session_date, user_label, bucket, bitmap, n_sessions), a session in one of them only."""
    days, before = (end - start).days + 1, previous(start, end)[0]
    since = F.datediff("session_date", F.lit(before))
    period, day, bucket = (F.col(c) for c in ("period_key", "day_index", "bucket"))
    rows = visitors.where(F.col("session_date").between(F.lit(before), F.lit(end))).withColumns({"period_key": F.when(since < days, "previous").otherwise("current"), "day_index": since % days})
    seen = lambda label=None: F.bitmap_count(F.bitmap_or_agg(F.col("bitmap") if label is None else F.when(F.col("user_label") == label, F.col("bitmap"))))
    parts = rows.groupingSets([[period, bucket], [period, day, bucket]], period, day, bucket).agg(F.sum("n_sessions").alias("total_sessions"), seen().alias("total_users"), seen("new_user").alias("new_users"), seen("returning_user").alias("returning_users"))
    return _filled(parts.groupBy("period_key", "day_index").agg(*[F.sum(c).alias(c) for c in COUNTS]), start, end)


def active_users(visitors: DataFrame, bucket: str) -> DataFrame:
    """Distinct users by ``day``, ``week`` or ``month`` of their sessions, from the bitmaps of days."""
    at = {"day": F.col("session_date"), "week": F.date_trunc("week", "session_date").cast("date"), "month": F.trunc("session_date", "month")}[bucket]
    parts = visitors.groupBy(at.alias(bucket), "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    return parts.groupBy(bucket).agg(F.sum("n").alias("active_users"))


def _filled(found: DataFrame, start: date, end: date) -> DataFrame:
    """Every row of the spine; what was not found is zero."""
    return spine(found.sparkSession, start, end).join(found.select("period_key", F.coalesce("day_index", F.lit(-1)).alias("day_index"), *COUNTS), ["period_key", "day_index"], "left").select(
        "period_key", F.when(F.col("day_index") >= 0, F.col("day_index")).alias("day_index"), "metric_date", F.when(F.col("day_index") < 0, 1).otherwise(0).alias("is_headline"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS]
    )


def spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every day of both periods, and day_index -1 for each period's headline."""
    days = (end - start).days + 1
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("period_key"), F.lit(d).alias("first")) for k, d in (("current", start), ("previous", previous(start, end)[0]))])).alias("p")
    rows = spark.range(-1, days, 1, 1).select(F.col("id").cast("int").alias("day_index"), keys)
    return rows.select("p.period_key", "day_index", F.when(F.col("day_index") >= 0, F.date_add("p.first", F.col("day_index"))).alias("metric_date"))


def pivoted(found: DataFrame) -> DataFrame:
    """Current and previous side by side: a row per day, and the headline with a null day_index."""

    def of(key: str, c: str) -> Column:
        return F.max(F.when(F.col("period_key") == key, F.col(c)))

    return found.groupBy("day_index", "is_headline").agg(*[of(k, c).alias(f"{k}_{c}") for k in ("current", "previous") for c in ("metric_date", *COUNTS)])


def change(current: Column, before: Column) -> Column:
    """Percentage change to two places; null against zero."""
    return F.round(F.try_divide((current - before).cast("double"), before.cast("double")) * 100, 2)


def report(rows: DataFrame, start: date, end: date) -> DataFrame:
    """The report of sessions."""
    return report_of(aggregates(rows, start, end), start, end)


def report_of(found: DataFrame, start: date, end: date) -> DataFrame:
    """One row: the dates, both periods, change_pct, and the ordered daily series."""
    p = pivoted(found)
    head = lambda c: F.max(F.when(F.col("is_headline") == 1, F.col(c)))
    group = lambda k: F.struct(*[F.col(f"{k}_{c}").alias(c) for c in COUNTS])
    day = F.struct("day_index", F.col("current_metric_date").alias("date"), F.col("previous_metric_date").alias("comparison_date"), group("current").alias("current"), group("previous").alias("previous"))
    first, last = previous(start, end)
    return p.agg(
        *[F.lit(d).alias(n) for n, d in (("start_date", start), ("end_date", end), ("previous_start_date", first), ("previous_end_date", last))],
        *[F.struct(*[head(f"{k}_{c}").alias(c) for c in COUNTS]).alias(f"{k}_period") for k in ("current", "previous")],
        F.struct(*[change(head(f"current_{c}"), head(f"previous_{c}")).alias(c) for c in COUNTS]).alias("change_pct"),
        F.array_sort(F.collect_list(F.when(F.col("is_headline") == 0, day))).alias("daily_series"),
    )


def traffic_summary(spark: SparkSession, directory: str, start: date, end: date, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The report from the stored bitmaps of the wanted days; ``watch`` is applied to their rows."""
    rows = sessions.visitors(spark, directory).where(F.col("session_date").between(F.lit(previous(start, end)[0]), F.lit(end)))
    return report_of(stored_aggregates(watch(rows), start, end), start, end)


class ContractError(ValueError):
    code = "invalid_report_contract"


def _count(v) -> int:
    if isinstance(v, bool) or v is None or isinstance(v, (str, float)) or v != int(v) or v < 0:
        raise ContractError(f"{v!r} is not a count")
    return int(v)


def contract(rows: list) -> dict:
    """The report's single row as a validated JSON document; anything out of shape is an error."""
    if len(rows) != 1:
        raise ContractError(f"{len(rows)} rows")
    r = rows[0].asDict(recursive=True) if hasattr(rows[0], "asDict") else rows[0]
    start, end = r["start_date"], r["end_date"]
    days = (end - start).days + 1
    if (r["previous_start_date"], r["previous_end_date"]) != previous(start, end) or len(r["daily_series"]) != days:
        raise ContractError("periods are not aligned")
    for c, v in r["change_pct"].items():
        if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v)):
            raise ContractError(f"change of {c} is {v!r}")
    counts = lambda d: {c: _count(d[c]) for c in COUNTS}
    series = []
    for i, d in enumerate(r["daily_series"]):
        if isinstance(d["day_index"], (bool, float)) or d["day_index"] != i or d["date"] != start + timedelta(days=i) or d["comparison_date"] != r["previous_start_date"] + timedelta(days=i):
            raise ContractError(f"day {i} is not aligned")
        series.append({"day_index": i, "date": d["date"].isoformat(), "comparison_date": d["comparison_date"].isoformat(), "current": counts(d["current"]), "previous": counts(d["previous"])})
    return {
        "contract_version": CONTRACT_VERSION,
        "period": {"start_date": start.isoformat(), "end_date": end.isoformat(), "days": days},
        "comparison_period": {"start_date": r["previous_start_date"].isoformat(), "end_date": r["previous_end_date"].isoformat(), "days": days},
        "current": counts(r["current_period"]),
        "previous": counts(r["previous_period"]),
        "change_pct": {c: r["change_pct"][c] for c in COUNTS},
        "daily_series": series,
    }
