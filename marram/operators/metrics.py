"""Metric requests: one scan and one aggregation for all metrics that share a model and dimensions."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.text import search_score
from marram.plans import models, sessions
from marram.plans.catalog import METRICS, TIME, CatalogError, Metric, common_profiles, metric, resolved_profile

MODELS = models.MODELS | {"sessions": sessions.sessions}
MOST_METRICS, MOST_ROWS, ROWS, MOST_HITS = 5, 200, 50, 25


def aggregate(aggregation: str, expression: str, condition: str | None) -> Column:
    """An aggregation with its filter inside, so that several share one pass."""
    of = F.lit(1) if expression == "*" else F.expr(expression)
    of = of if condition is None else F.when(F.expr(condition), of)
    return {"average": F.avg, "count": F.count, "count_distinct": F.count_distinct, "min": F.min, "sum": F.sum}[aggregation](of)


def value(m: Metric, filtered: bool = False) -> Column:
    """A metric's aggregate; ``filtered``: its filter is applied to the rows already."""
    own = None if filtered else m.filter
    if m.ratio:
        top, bottom = (aggregate(a, e, c) for a, e, c in m.ratio)
        out = F.round(F.try_divide(top.cast("double"), bottom.cast("double")), 6)
    else:
        out = aggregate(m.aggregation, m.expression, own)
        out = F.round(out, 6) if m.aggregation == "average" else out
    return out.alias(m.id)


def bounded(rows: DataFrame, model: str, period: tuple[date, date] | None) -> DataFrame:
    """Rows of a closed period, by literals, so that partitions and row groups are pruned."""
    column = TIME[model]
    return rows if period is None or column is None else rows.where(F.col(column).between(F.lit(period[0]), F.lit(period[1])))


def compute(spark: SparkSession, directory: str, metric_id: str, period: tuple[date, date] | None = None, profile: str | None = None, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """A row per combination of the metric's dimensions (one row without dimensions), in no order. ``watch`` is applied to the period's rows."""
    m = metric(metric_id, profile)
    return over(MODELS[m.model](spark, directory), m, period, watch)


def over(rows: DataFrame, m: Metric, period: tuple[date, date] | None = None, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """A metric of rows of its model."""
    rows = watch(bounded(rows, m.model, period))
    if m.filter:
        rows = rows.where(m.filter)
    return rows.groupBy(*m.dimensions).agg(value(m, filtered=True))


def fused(spark: SparkSession, directory: str, metric_ids: list[str], period: tuple[date, date] | None = None, profile: str | None = None, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Several metrics of one model and the same dimensions in a single aggregation, a column each.

    Unlike ``compute``, a group stays if any of the metrics has rows in it; a count is then 0.
    """
    own = [metric(m, profile) for m in metric_ids]
    if len({(m.model, m.dimensions) for m in own}) != 1:
        raise CatalogError("invalid_metric_request", "metrics of different models or dimensions")
    rows = watch(bounded(MODELS[own[0].model](spark, directory), own[0].model, period))
    return rows.groupBy(*own[0].dimensions).agg(*[value(m) for m in own])


def request_ids(metric_ids: list[str]) -> list[str]:
    """Distinct ids in their order, of one profile at least. The limit counts ids before repeats go."""
    if not isinstance(metric_ids, list) or not metric_ids or not all(isinstance(m, str) and re.fullmatch("[a-z0-9_]+", m) for m in metric_ids):
        raise CatalogError("invalid_metric_request", str(metric_ids))
    if len(metric_ids) > MOST_METRICS:
        raise CatalogError("too_many_metrics", str(len(metric_ids)))
    ids = list(dict.fromkeys(metric_ids))
    common_profiles(ids)
    return ids


def check_request(metric_ids: list[str], profile: str | None = None) -> list[str]:
    """Ids of a request that ``profile``, or any that all profiles agree on, can answer."""
    ids = request_ids(metric_ids)
    resolved_profile(ids, profile)
    return ids


def top_rows(rows: DataFrame, order: list[Column], limit: int = ROWS) -> tuple[list[dict], bool]:
    """At most ``limit`` (1 to 200) rows in order, and whether there are more: one more row is asked for."""
    limit = max(1, min(MOST_ROWS, limit))
    found = [r.asDict(recursive=True) for r in rows.orderBy(*order).limit(limit + 1).collect()]
    return found[:limit], len(found) > limit


def request(spark: SparkSession, directory: str, metric_ids: list[str], period: tuple[date, date], profile: str | None = None, limit: int = ROWS) -> list[dict]:
    """The service's answer: for each metric its rows, date scope and whether they were cut off."""
    out = []
    ids = check_request(metric_ids, profile)
    profile, _ = resolved_profile(ids, profile)
    for m in (metric(i, profile) for i in ids):
        rows, truncated = top_rows(compute(spark, directory, m.id, period, profile), [F.desc(m.id), *map(F.col, m.dimensions)], limit)
        out.append({"metric_id": m.id, "date_scope": m.date_scope, "dimensions": list(m.dimensions), "rows": rows, "truncated": truncated})
    return out


def catalog(spark: SparkSession) -> DataFrame:
    """A row per metric and profile that publishes it: metric_id, label, words, terms, profile, definition."""
    rows = []
    for m in METRICS.values():
        terms = [m.label.casefold(), *[d.replace("_", " ") for d in m.dimensions]]
        words = " ".join([*m.aliases, *m.dimensions, *terms[1:]]).casefold()
        for p in m.profiles:
            rows.append((m.id, terms[0], words, terms, p, repr(metric(m.id, p))))
    return spark.createDataFrame(rows, "metric_id string, label string, words string, terms array<string>, profile string, definition string")


def search(spark: SparkSession, query: str, profile: str | None = None, limit: int = 10) -> DataFrame:
    """``search_rows`` over the published catalog."""
    return search_rows(catalog(spark), query, profile, limit)


def search_rows(found: DataFrame, query: str, profile: str | None = None, limit: int = 10) -> DataFrame:
    """Entries of ``found`` (as ``catalog``) by relevance, then id; ``limit`` is 1 to 25. Profiles that define an entry alike are one hit, with the
    best of their scores. The first hits are found without sorting the others.
    """
    if profile is not None:
        found = found.where(F.col("profile") == profile)
    found = found.withColumn("score", search_score(query, F.col("metric_id"), F.col("label"), F.col("words"), F.col("terms")))
    hits = found.where("score > 0").groupBy("metric_id", "definition").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("profile")).alias("profiles"))
    return hits.orderBy(F.desc("score"), "metric_id", "definition").limit(max(1, min(MOST_HITS, limit))).select("metric_id", "score", "profiles")
