"""Closed date intervals: unions by gaps and islands, overlap joins in day buckets, overlap counts by a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.operators import scan


def islands(intervals: DataFrame, *keys: str) -> DataFrame:
    """Maximal disjoint intervals (start, end) of each key; overlapping and adjacent ones merge.

    Repeats go first with a map-side combine: of intervals that start together only the longest matters. Without keys the whole
    table is one order, which is scanned in ranges.
    """
    if not keys:
        return scan.islands(intervals)
    by = Window.partitionBy(*keys).orderBy("start")
    longest = intervals.where("start <= end").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > F.date_add(before, 1)), 1).otherwise(0)
    numbered = longest.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def union_days(intervals: DataFrame, *keys: str) -> DataFrame:
    """Days in the union of each key's intervals."""
    return islands(intervals, *keys).groupBy(*keys).agg(F.sum(F.datediff("end", "start") + 1).alias("union_days"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_days: int = 30) -> DataFrame:
    """Pairs of intervals (start, end) of equal keys that share a day; right's become other_start, other_end.

    Both sides are dealt into buckets of days and joined on key and bucket: an equi-join where a plain range
    condition would compare all with all. A pair is kept only in the first bucket that it shares.
    """

    def dealt(df: DataFrame) -> DataFrame:
        number = lambda c: F.floor(F.unix_date(c) / bucket_days)
        return df.where("start <= end").withColumn("_bucket", F.explode(F.sequence(number("start"), number("end"))))

    a, b = dealt(left), dealt(right).withColumnsRenamed({"start": "other_start", "end": "other_end"})
    meets = (F.col("start") <= F.col("other_end")) & (F.col("other_start") <= F.col("end"))
    first = F.floor(F.unix_date(F.greatest("start", "other_start")) / bucket_days) == F.col("_bucket")
    return a.join(b, [*keys, "_bucket"]).where(meets & first).drop("_bucket")


def overlap_counts(intervals: DataFrame, *keys: str) -> DataFrame:
    """By key and start: the latest end, and n, the pairs that intervals of this start form with all of the key's intervals that
    share a day with them, themselves included.

    No pair is formed. An interval meets those that have begun by its end, but for those that had ended before its start; both are
    running sums over the key's starts and ends in one order. Equal intervals are counted first.
    """
    spans = intervals.where("start <= end").groupBy(*keys, "start", "end").agg(F.count("*").alias("_n"))
    ends = F.explode(F.array(F.struct(F.col("start").alias("day"), F.lit(0).alias("kind")), F.struct(F.col("end").alias("day"), F.lit(1).alias("kind"))))
    points = spans.select("*", ends.alias("_at"))
    sweep = Window.partitionBy(*keys).orderBy("_at.day", "_at.kind")  # a day's starts come before its ends
    is_end = F.col("_at.kind") == 1
    begun, ended = (F.sum(F.when(c, F.col("_n")).otherwise(0)).over(sweep) for c in (~is_end, is_end))
    met = points.select(*keys, "start", "end", (F.col("_n") * F.when(is_end, begun).otherwise(-ended)).alias("_met"))
    return met.groupBy(*keys, "start").agg(F.max("end").alias("end"), F.sum("_met").alias("n"))
