"""Usage events as streams: dedup of resends, 30-minute sessions, attachments, and the first-success ledger.

Sources are file streams over the same tables as in batch; sinks are Parquet tables in the shared folder, with their
checkpoints beside them, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marram.sources.tables import shared_dir

LATENESS, GAP = "1 hour", "30 minutes"
#: Parts that the ledger's users are dealt to by hash.
LEDGER_BUCKETS = 64
#: When the mark behind a finished table comes, in seconds: after any time that a timestamp's text can name (year 9999).
END_SECONDS = 2**39


def work_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; a local master may go without that setting."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, directory: str) -> DataFrame:
    """The events table as a stream. Watermarks need an instant, so the zoneless ``ts`` is read as UTC."""
    schema = spark.read.parquet(f"{directory}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{directory}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, *keys: str, lateness: str = LATENESS) -> DataFrame:
    """The first event of each identity; state for an identity is dropped once the watermark has passed it."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, lateness: str = LATENESS, gap: str = GAP) -> DataFrame:
    """Closed sessions of known users: emitted when the watermark has passed the gap after their last event. An event that comes the
    whole gap later opens a session; a session window would still take it, so the window is a microsecond shorter.
    """
    known = events.where("user_id IS NOT NULL").withWatermark("ts", lateness)
    found = known.groupBy(F.session_window("ts", f"{gap} -1 microsecond").alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("session_value"))
    return found.select("user_id", F.col("w.start").alias("started_at"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("closes_at"), "n_events", "session_value")


def daily_counts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events of each type by UTC day, as windows close."""
    return windowed_counts(events.withWatermark("ts", lateness), "1 day", "0 days").withColumnRenamed("start", "day")


def windowed_counts(events: DataFrame, width: str = "7 days", offset: str = "-80 hours") -> DataFrame:
    """Events of each type by window of ``width``. The default offset makes weeks that open on Monday in Taipei (the epoch
    was a Thursday, and days there open at 16:00 UTC); ``1 day`` and ``-8 hours`` make its calendar days. ``start`` is the
    first day by the clock of the offset.
    """
    hours = 8 if "-" in offset else 0
    found = events.groupBy(F.window("ts", width, startTime=offset).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.to_date(F.col("w.start") + F.make_interval(hours=F.lit(hours))).alias("start"), "event_type", "n")


def attached(events: DataFrame, extras: DataFrame, key: str, within: str = "30 days", lateness: str = LATENESS) -> DataFrame:
    """Events (``key``, ts, ...) with the columns of their attachment (``key``, attached_at, ...), both streams.

    An attachment counts if it comes from its event's time until ``within`` later; an older one is refused, whenever it
    is replayed. State is kept that long: an event without one comes out with nulls once the watermark has passed its term.
    """
    rest = [c for c in extras.columns if c != key]
    left = events.withWatermark("ts", lateness)
    right = extras.select(F.col(key).alias("_key"), *rest).withWatermark("attached_at", lateness)
    meets = F.expr(f"{key} = _key AND attached_at >= ts AND attached_at <= ts + INTERVAL {within}")
    return left.join(right, meets, "leftOuter").drop("_key")


def append(stream: DataFrame, path: str) -> StreamingQuery:
    """Write a stream's rows to a Parquet table until all that is there has been read."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").option("path", path).trigger(availableNow=True).start()


def run(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all available data and read what it wrote."""
    query = append(stream, path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_end(events: DataFrame, windows: Callable[[DataFrame], DataFrame], path: str, **mark: object) -> DataFrame:
    """Run ``windows`` of a stream over a table that gets no more rows, and read all that it wrote: every window, the last ones too.

    A mark follows the events once all are read: an event of its own, far behind any other, with the values that ``windows`` asks an
    event for in ``mark``. The watermark that it moves closes every window before it; its own window stays open and is never written.
    """
    spark = events.sparkSession
    # No glob finds the mark before it is written.
    marks = spark.readStream.schema(events.schema).parquet(f"{path}-end*")
    stream = windows(events.unionByName(marks))
    run(stream, path)
    end = spark.range(1).select(F.timestamp_seconds(F.lit(END_SECONDS)).alias("ts"), *[F.lit(v).cast(events.schema[c].dataType).alias(c) for c, v in mark.items()])
    end.write.mode("ignore").parquet(f"{path}-end")
    return run(stream, path)


def run_recorded(stream: DataFrame, path: str) -> DataFrame:
    """``run``, and beside the rows what the stream knows to be whole: each batch's watermark, at ``path``-progress."""
    query = append(stream, path)
    query.awaitTermination()
    spark = stream.sparkSession
    found = [(p["batchId"], p["eventTime"].get("watermark")) for p in query.recentProgress]
    marks = spark.createDataFrame([(b, w) for b, w in found if w], "batch long, watermark string").withColumn("watermark", F.to_timestamp("watermark"))
    marks.coalesce(1).write.mode("append").parquet(f"{path}-progress")
    return spark.read.schema(stream.schema).parquet(path)


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """One row (through): the time before which all events have come; null before any batch has a watermark. The epoch is none."""
    return spark.read.schema("batch long, watermark timestamp").parquet(f"{path}-progress").agg(F.max(F.when(F.unix_micros("watermark") > 0, F.col("watermark"))).alias("through"))


def store_once(events: DataFrame, path: str, keys: list[str], at: str = "ts") -> StreamingQuery:
    """Append a stream to a table by UTC day, each identity (``keys``, which must not change between resends, nor may ``at``) once, however late it
    is sent again. A batch is compared with the stored days that its own times name; no other day is read, and no
    state is kept. A batch that is replayed finds its rows there.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys).withColumn("event_date", F.to_date(at)).persist()
        try:
            days = [r.event_date for r in rows.select("event_date").distinct().collect()]
            try:
                stored = spark.read.schema(rows.schema).parquet(path)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                stored = spark.createDataFrame([], rows.schema)
            seen = stored.where(F.col("event_date").isin(days)).select(*keys)
            new = rows.join(seen, keys, "left_anti")
            new.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()


def keep_ledger(events: DataFrame, path: str) -> StreamingQuery:
    """Upkeep of (user_id, first_success_at). A batch writes the users that are new or whose time it lowers, and no others: it reads the
    buckets of users that it touches and adds its changes to them. A batch that is replayed writes the same changes again; late
    events can only lower a time. ``fold_ledger`` joins changes that have piled up.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.where("user_id IS NOT NULL AND event_type <> 'error'").groupBy("user_id").agg(F.min("ts").alias("first_success_at")).withColumn("bucket", _bucket()).persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # of LEDGER_BUCKETS
            known = _changes(batch.sparkSession, path, new.schema, before=number).where(F.col("bucket").isin(touched))
            known = known.groupBy("user_id").agg(F.min("first_success_at").alias("_known"))
            lowered = new.join(known, "user_id", "left").where(F.col("_known").isNull() | (F.col("first_success_at") < F.col("_known"))).drop("_known")
            lowered.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/changes/batch={number}")
        finally:
            new.unpersist()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()


def _bucket() -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(LEDGER_BUCKETS)).cast("int")


def _changes(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """What the batches before a number have written, as folded so far: folded ones count by the last batch in them."""
    empty, out, through = spark.createDataFrame([], schema), None, -1
    for part in ("folded", "changes"):
        try:
            rows = spark.read.parquet(f"{path}/{part}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        rows = rows if before is None else rows.where(F.col("batch") < before)
        if part == "folded":
            through = rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
            rows = rows.where(F.col("batch") == through)
        else:
            rows = rows.where(F.col("batch") > through)
        rows = rows.select(*empty.columns)
        out = rows if out is None else out.unionByName(rows)
    return empty if out is None else out


def fold_ledger(spark: SparkSession, path: str) -> None:
    """Join all changes so far into one table by bucket: readers and later batches read that and the changes after it."""
    last = spark.read.parquet(f"{path}/changes").agg(F.max("batch")).first()[0]
    if last is not None:
        rows = ledger(spark, path).withColumn("bucket", _bucket())
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/folded/batch={last}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, first_success_at) as of now."""
    schema = spark.read.parquet(f"{path}/changes").drop("batch").schema
    return _changes(spark, path, schema).groupBy("user_id").agg(F.min("first_success_at").alias("first_success_at"))
