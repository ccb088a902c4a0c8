"""Event tables by day behind a manifest: appended, compacted, and emptied of expired days, while readers hold to one version.

Rows lie in ``data/part=.../day=...``; a version of the manifest names the (day, part) pairs that make up the table. Every
change writes a version of its own, whole or not at all, so a reader that has begun sees neither half a change nor two. What
no recent version names is deleted by ``vacuum``, whole partitions at a time.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.sources.tables import listing

#: Days that usage events and attachments are kept. Fixed values.
EVENT_DAYS, ATTACHMENT_DAYS = 180, 30
MANIFEST = "day date, part string, bytes long"


def newest(spark: SparkSession, root: str) -> int | None:
    """The manifest's newest version; null if there is no table."""
    try:
        return spark.read.schema("version int").parquet(f"{root}/manifest").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(day, part, bytes) of a version, of the newest one by default."""
    version = newest(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}").where("day IS NOT NULL")


def _commit(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """Write the next version; another writer that took it meanwhile is an error, and nothing is lost."""
    version = newest(spark, root)
    version = 0 if version is None else version + 1
    # A row without a day keeps a version of an empty table.
    rows.unionByName(spark.createDataFrame([(None, "", 0)], MANIFEST)).coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")
    return version


def _put(rows: DataFrame, root: str) -> DataFrame:
    """Write rows (with ``day``) as one part; its lines of the manifest."""
    spark, part = rows.sparkSession, uuid.uuid4().hex
    rows.hint("rebalance", "day").write.partitionBy("day").parquet(f"{root}/data/part={part}")
    files = listing(spark, f"{root}/data/part={part}").select(F.try_to_date(F.regexp_extract("path", "day=([0-9-]+)", 1)).alias("day"), "bytes").where("day IS NOT NULL")
    return files.groupBy("day").agg(F.sum("bytes").alias("bytes")).select("day", F.lit(part).alias("part"), "bytes")


def append(rows: DataFrame, root: str, at: str = "ts") -> int:
    """Add rows, by the UTC day of ``at``; rows without a time are left out. The new version."""
    spark = rows.sparkSession
    return _commit(spark, root, manifest(spark, root).unionByName(_put(rows.where(F.col(at).isNotNull()).withColumn("day", F.to_date(at)), root)))


def read(spark: SparkSession, root: str, schema: str, first: date | None = None, last: date | None = None, version: int | None = None) -> DataFrame:
    """The rows (``schema``, and ``day``) of a version's days from ``first`` to ``last``: only their partitions are listed."""
    wanted = manifest(spark, root, version)
    if first is not None:
        wanted = wanted.where(F.col("day") >= F.lit(first))
    if last is not None:
        wanted = wanted.where(F.col("day") <= F.lit(last))
    paths = [f"{root}/data/part={r.part}/day={r.day}" for r in wanted.collect()]  # a row a day and part
    if not paths:
        return spark.createDataFrame([], schema + ", day date")
    return spark.read.schema(schema + ", part string, day date").option("basePath", f"{root}/data").parquet(*paths).drop("part")


def compact(spark: SparkSession, root: str, schema: str, most_parts: int = 4) -> int | None:
    """Join the parts of every day that has more than ``most_parts``, in one job. The new version, or null if no day has."""
    own = manifest(spark, root)
    small = [r.day for r in own.groupBy("day").agg(F.count("*").alias("n")).where(F.col("n") > most_parts).collect()]
    if not small:
        return None
    own.persist()
    try:
        paths = [f"{root}/data/part={r.part}/day={r.day}" for r in own.where(F.col("day").isin(small)).collect()]
        rows = spark.read.schema(schema + ", part string, day date").option("basePath", f"{root}/data").parquet(*paths).drop("part")
        return _commit(spark, root, own.where(~F.col("day").isin(small)).unionByName(_put(rows, root)))
    finally:
        own.unpersist()


def expire(spark: SparkSession, root: str, today: date, days: int) -> int:
    """A version without the days that are older than ``days``: they go with the day of the event, however late a row was written."""
    return _commit(spark, root, manifest(spark, root).where(F.col("day") > F.lit(today - timedelta(days=days))))


def vacuum(spark: SparkSession, root: str, keep_versions: int = 2) -> list[str]:
    """Delete the partitions that none of the last ``keep_versions`` versions names, and return them. Readers of these versions go on."""
    last = newest(spark, root)
    if last is None:
        return []
    named = spark.read.schema(MANIFEST + ", version int").parquet(f"{root}/manifest").where(F.col("version") > last - keep_versions).select("day", "part").distinct()
    place = lambda p: F.regexp_extract("path", p, 1)
    found = listing(spark, f"{root}/data").select(F.try_to_date(place("day=([0-9-]+)")).alias("day"), place("part=([0-9a-f]+)").alias("part")).distinct()
    gone = [f"{root}/data/part={r.part}/day={r.day}" for r in found.join(named, ["day", "part"], "left_anti").where("day IS NOT NULL").collect()]
    for path in gone:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return gone
