"""Reports of all tenants at once, over one table of sessions partitioned by tenant and day.

The registry decides which tenants are reported: it is joined on the partition column, so Spark prunes the other tenants'
partitions while the query runs, as the dates prune days. One plan serves all tenants.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions.dates import previous
from marram.operators import traffic

#: Tenants that are broadcast at most; more are joined by shuffling, without pruning by tenant.
BROADCAST_TENANTS = 200_000


def write(rows: DataFrame, path: str) -> None:
    """Sessions (tenant_id, session_date, ...) by tenant and day; a large tenant's day is dealt to several tasks, small ones share a task."""
    rows.hint("rebalance", "tenant_id", "session_date").write.mode("overwrite").partitionBy("tenant_id", "session_date").parquet(path)


def of_tenants(fleet: DataFrame, tenants: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of the days ``first`` to ``last`` of the ``tenants`` (tenant_id), which are broadcast if there are not too many."""
    wanted = tenants.select("tenant_id").distinct()
    if wanted.limit(BROADCAST_TENANTS + 1).count() <= BROADCAST_TENANTS:
        wanted = F.broadcast(wanted)
    return fleet.where(F.col("session_date").between(F.lit(first), F.lit(last))).join(wanted, "tenant_id")


def reports(fleet: DataFrame, tenants: DataFrame, start: date, end: date) -> DataFrame:
    """(tenant_id, period_key, day_index, metric_date, is_headline, counts) as ``traffic.aggregates`` has them, for every tenant of
    ``tenants`` (tenant_id); tenants and days without sessions have zeros.
    """
    days, before = (end - start).days + 1, previous(start, end)[0]
    since = F.datediff("session_date", F.lit(before))
    rows = of_tenants(fleet, tenants, before, end).withColumns({"period_key": F.when(since < days, "previous").otherwise("current"), "day_index": since % days})
    tenant, period, day = (F.col(c) for c in ("tenant_id", "period_key", "day_index"))
    users = lambda label: F.expr(f"count(DISTINCT user_pseudo_id) FILTER (WHERE user_label = '{label}')")
    found = rows.groupingSets([[tenant, period], [tenant, period, day]], tenant, period, day).agg(
        F.count_distinct("session_uid").alias("total_sessions"), F.count_distinct("user_pseudo_id").alias("total_users"), users("new_user").alias("new_users"), users("returning_user").alias("returning_users")
    )
    found = found.withColumn("day_index", F.coalesce("day_index", F.lit(-1)))
    # Every tenant's rows of the spine, made where the tenant is: no join with the spine.
    first = {"current": start, "previous": before}
    spine = F.explode(F.array(*[F.struct(F.lit(k).alias("period_key"), F.lit(d).alias("first")) for k, d in first.items()]))
    places = tenants.select("tenant_id").distinct().select("tenant_id", spine.alias("p")).select("tenant_id", "p.*", F.explode(F.sequence(F.lit(-1), F.lit(days - 1))).alias("day_index"))
    joined = places.join(found, ["tenant_id", "period_key", "day_index"], "left")
    return joined.select(
        "tenant_id",
        "period_key",
        F.when(F.col("day_index") >= 0, F.col("day_index")).alias("day_index"),
        F.when(F.col("day_index") >= 0, F.date_add("first", F.col("day_index"))).alias("metric_date"),
        F.when(F.col("day_index") < 0, 1).otherwise(0).alias("is_headline"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in traffic.COUNTS],
    )


def summary(found: DataFrame) -> DataFrame:
    """A row a tenant from the rows of ``reports``: both periods' headline and its change in percent."""
    head = lambda key, c: F.max(F.when((F.col("is_headline") == 1) & (F.col("period_key") == key), F.col(c)))
    counts = [head(k, c).alias(f"{k}_{c}") for k in ("current", "previous") for c in traffic.COUNTS]
    return found.groupBy("tenant_id").agg(*counts).select("*", *[traffic.change(F.col(f"current_{c}"), F.col(f"previous_{c}")).alias(f"{c}_change_pct") for c in traffic.COUNTS])
