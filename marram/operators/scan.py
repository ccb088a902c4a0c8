"""Prefix sums and maxima over one global order, without a window that takes all rows into one task.

Rows are dealt to ranges of the order; each range is scanned by itself; what the ranges before add comes from one row a
range. The dealt rows are stored, since both passes must see the same ranges.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.sources.tables import shared_dir


@dataclass(frozen=True)
class Step:
    """A column that a scan adds: ``sum`` or ``max`` of an expression over all rows up to this one, or before it (``exclusive``)."""

    kind: str
    value: Column
    exclusive: bool = False


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in ranges of ``order``, numbered from 0 in ``_range``, stored in the shared folder: as many as the session's shuffle
    partitions, fewer for small tables. Rows of equal order are of one range: end the order with a column that tells rows
    apart.
    """
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/ranges-{uuid.uuid4().hex}"
    out = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def scanned(ranged: DataFrame, order: list[str], steps: dict[str, Step]) -> DataFrame:
    """Columns of ``ranged`` (as ``dealt``) and one for each of ``steps``; nulls add nothing. Before the first row a sum is 0, a maximum null."""
    by = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    aggregate = {"sum": F.sum, "max": F.max}
    totals = ranged.groupBy("_range").agg(*[aggregate[s.kind](s.value).alias(f"_{n}") for n, s in steps.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_range", *[aggregate[s.kind](f"_{n}").over(before).alias(f"_{n}") for n, s in steps.items()])
    own = {n: aggregate[s.kind](s.value).over(by.rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0)) for n, s in steps.items()}
    rows = ranged.select("*", *[c.alias(n) for n, c in own.items()]).join(F.broadcast(offsets), "_range")
    joined = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)) if s.kind == "sum" else F.greatest(n, f"_{n}") for n, s in steps.items()}
    return rows.withColumns(joined).drop(*[f"_{n}" for n in steps])


def running(rows: DataFrame, order: list[str], steps: dict[str, Step]) -> DataFrame:
    """``rows`` with a column for each of ``steps``, over the whole table in ``order``."""
    return scanned(dealt(rows, order), order, steps).drop("_range")


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``rows`` with gapless numbers from ``first`` on, in ``order``."""
    return running(rows, order, {name: Step("sum", F.lit(1), exclusive=True)}).withColumn(name, F.col(name) + first)


def admitted(requests: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """Requests in order with ``spent``, the cost of all up to this one, and ``admitted``: whether that is within the budget. After the
    first request that is not, none is.
    """
    return running(requests, order, {"spent": Step("sum", F.col(cost))}).withColumn("admitted", F.col("spent") <= budget)


def islands(intervals: DataFrame) -> DataFrame:
    """Maximal disjoint closed intervals (start, end) of a whole table; overlapping ones, and dates that follow each other, merge."""
    near = F.date_add("_reach", 1) if dict(intervals.dtypes)["start"] == "date" else F.col("_reach")
    longest = intervals.where("start <= end").groupBy("start").agg(F.max("end").alias("end"))
    reached = scanned(dealt(longest, ["start"]), ["start"], {"_reach": Step("max", F.col("end"), exclusive=True)})
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > near), 1).otherwise(0)
    again = scanned(reached.withColumn("_opens", opens), ["start"], {"_island": Step("sum", F.col("_opens"))})
    return again.groupBy("_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
