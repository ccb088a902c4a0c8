"""Sources and sinks: Parquet tables by name, strict CSV, JSON documents, partitioned event tables with retention."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local master may go without, with a folder of its own until the end."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="marram-tables-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class UnknownTable(KeyError):
    """A table that is not on the list of approved ones."""


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """An approved table of a dataset directory."""
    if name not in TABLES:
        raise UnknownTable(name)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, modified) of the Parquet files under ``path``: they are listed, not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


#: Tables that ``derived`` has stored.
_derived: set[str] = set()


def derived(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made from the files under ``source``, stored in the shared folder for as long as these stay as they are."""
    files = listing(spark, source).agg(F.count("*"), F.sum("bytes"), F.bit_xor(F.xxhash64("path", "bytes", "modified"))).first()
    path = f"{shared_dir(spark)}/{label}-{hashlib.sha256(repr((source, tuple(files))).encode()).hexdigest()[:16]}"
    if path not in _derived:
        make().write.mode("overwrite").parquet(path)
        _derived.add(path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, columns: list[str], required: list[str] = ()) -> DataFrame:
    """A CSV of text columns. Every file's header must be ``columns`` in that order: of the first file it is checked now, of all when they are
    read; rows lacking a required cell are an error when read.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    found = spark.read.option("header", True).option("multiLine", True).csv(path).columns
    if [c.lstrip("\ufeff") for c in found] != list(columns):
        raise ValueError(f"header is {found}, not {list(columns)}")
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("enforceSchema", False).csv(path)
    for c in required:
        empty = F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).isNull()
        rows = rows.withColumn(c, F.when(empty, F.raise_error(F.lit(f"a row lacks {c}"))).otherwise(F.col(f"`{c}`")))
    return rows


def read_json_document(spark: SparkSession, path: str) -> dict:
    """One JSON document from any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document with sorted keys, in a folder of any store that Spark writes."""
    text = json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def content_digest(spark: SparkSession, paths: list[str]) -> str:
    """SHA-256 over the SHA-256 of every file under ``paths``, in order of their names; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    each = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("digest"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: x["digest"]), ""), 256)).first()[0]  # a row a file


def write_events(events: DataFrame, path: str, day: str = "event_date") -> None:
    """Append events to a table partitioned by day, so that reads prune and retention drops whole partitions. A day is
    written by as many tasks as its size asks for, and small days share one.
    """
    events.hint("rebalance", day).write.mode("append").partitionBy(day).parquet(path)


def retained(events: DataFrame, today: date, days: int, day: str = "event_date") -> DataFrame:
    """Events not older than ``days``; a partition filter on tables that ``write_events`` wrote."""
    return events.where(F.col(day) > F.lit(today - timedelta(days=days)))
