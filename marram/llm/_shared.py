"""What the corpus operators share: durable intermediate tables, bounded Arrow batches, safe column picks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Rows and bytes handed to Python at once; together they bound a worker's memory whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

#: Frequent keys that a join spreads, at most (a broadcast of some 2 MB); the others are the less frequent ones.
HOT_KEYS = 100_000

_local: dict[str, str] = {}
_kept: dict[Hashable, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Unset, a temporary folder serves a local master (tests); on a cluster it is an error, since no
    machine's own folder is visible to the others.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="marram-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def store(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``store`` wrote, once everything made from them is stored itself."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.stored_at
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def skew_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", heavy: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, spread so that no frequent key is one task's.

    The most frequent keys of ``rows``, of those with over ``heavy`` rows, are dealt to several tasks by the hash of the
    column ``by``, and their rows of ``table`` go to each of these. ``rows`` is read twice: store it first if it is costly.
    """
    salt, n = free(rows, "_salt", "_n")
    # Any key that is left out has at most 1 / HOT_KEYS of the rows.
    hot = rows.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > heavy).orderBy(F.desc("c")).limit(HOT_KEYS)
    hot = F.broadcast(hot.select(F.col(key).alias("_key"), F.ceil(F.col("c") / heavy).cast("int").alias(n)))
    count = F.coalesce(F.col(n), F.lit(1))
    rows = rows.join(hot, rows[key] == hot["_key"], "left").withColumn(salt, F.pmod(F.xxhash64(by), count).cast("int")).drop("_key", n)
    table = table.join(hot, table[key] == hot["_key"], "left").withColumn(salt, F.explode(F.sequence(F.lit(0), count - 1))).drop("_key", n)
    return rows.join(table, [key, salt], how).drop(salt)


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores put before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def kept[T](name: Hashable, make: Callable[[], T]) -> T:
    """What a worker keeps from batch to batch under ``name``. Workers serve one operator after another: asking for another name drops it."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless its user has set bounds."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
