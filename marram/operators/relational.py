"""Relational operators that Spark has no name for: division, argmax rows, ordered distinct, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divide(rows: DataFrame, key: str, value: str, required: DataFrame) -> DataFrame:
    """Keys of ``rows`` that occur with every value of ``required`` (value); with none required, all keys.

    The required values are counted and joined, so neither side is ever collected.
    """
    wanted = required.select(F.col(value)).distinct()
    found = rows.select(key, value).join(wanted, value, "left_semi").groupBy(key).agg(F.count_distinct(value).alias("_n"))
    counts = wanted.agg(F.count("*").alias("_all"))
    keys = rows.select(key).distinct().join(found, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return keys.crossJoin(F.broadcast(counts)).where("_n = _all").select(key)  # one row


def best_rows(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key with the largest ``order``; a combinable maximum, nothing is sorted. Make ``order`` total."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Each key's distinct values in order of their first position. Distinct values of a key must fit a row."""
    first = rows.groupBy(*keys, value).agg(F.min(position).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", value)))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda x: x[value]).alias(f"{value}_list"))


def attach(events: DataFrame, extras: DataFrame, key: str) -> DataFrame:
    """All events, with the columns of ``extras`` where there is a row of their key (one at most is used: the smallest)."""
    rest = [c for c in extras.columns if c != key]
    one = extras.groupBy(key).agg(F.min(F.struct(*rest)).alias("_extra"))
    return events.join(one, key, "left").select(*events.columns, *[F.col(f"_extra.{c}").alias(c) for c in rest])
