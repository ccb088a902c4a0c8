"""The session table as a step of its own: built by day, read by reports.

``prepare`` lists the events' files. New files whose events are all of later days are sessionised alone: what each user had
before (sessions so far, end of the last one) comes from a state table, and the sessions that were open are carried
on, which rewrites only the days they began on. Late days go on from the last version that ended before them: days up to that
one stay as they are. Changed files, and days before every version's end, build the table anew. A build writes a version;
readers hold to the version that was newest when they asked, so none sees half a build.

Beside the sessions a build keeps what reports count distinct users by: every user's number, and for each day and label
bitmaps of the numbers seen. Distinct users of any days come from these bitmaps alone.

``sessions``, ``visitors`` and ``cost`` never build: without a table they raise ``NotBuilt``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import scan
from marram.plans import models
from marram.sources.tables import listing, shared_dir, table

STATE = "user_id long, n_sessions long, open_date date, ended_at timestamp_ntz, number long"
VISITORS = "session_date date, user_label string, bucket long, bitmap binary, n_sessions long"
#: A version's days, each with the version that its rows are of, and the version that it goes on from.
DAYS = "session_date date, in_version int, parent int"


class NotBuilt(LookupError):
    code = "data_unavailable"


@dataclass(frozen=True)
class Built:
    """A version: where each day's partition is, the last day, the digest of the events' files, and the versions that it goes on
    from, from the last whole build up to itself.
    """

    root: str
    version: int
    digest: tuple
    through: date | None
    days: dict[date, int]
    chain: tuple[int, ...]


#: The newest version by application and dataset, as known.
_built: dict[tuple[str, str], Built] = {}


def _root(spark: SparkSession, directory: str) -> str:
    return f"{shared_dir(spark)}/sessions-chain-{hashlib.sha256(directory.encode()).hexdigest()[:16]}"


def _digest(files: DataFrame) -> tuple:
    return tuple(files.agg(F.count("*"), F.sum("bytes"), F.bit_xor(F.xxhash64("path", "bytes", "modified"))).first())


def prepare(spark: SparkSession, directory: str) -> Built:
    """Build what is missing of a dataset's session table; without new files only these are listed."""
    key, files = (spark.sparkContext.applicationId, directory), listing(spark, f"{directory}/events.parquet")
    digest, newest = _digest(files), _newest(spark, directory)
    if newest and newest.digest == digest:
        return newest
    events, old, state = table(spark, directory, "events"), None, None
    if newest:
        among = lambda v: spark.read.parquet(f"{newest.root}/files/version={v}")
        of = lambda listed: spark.read.schema(events.schema).parquet(*[r.path for r in listed.select("path").collect()])
        if not among(newest.version).join(files, ["path", "bytes", "modified"], "left_anti").limit(1).count():
            first = of(files.join(among(newest.version), ["path"], "left_anti")).where("user_id IS NOT NULL").agg(F.min(F.to_date("ts"))).first()[0]
            old = _before(spark, newest, first)
        if old:
            events, state = of(files.join(among(old.version), ["path"], "left_anti")), spark.read.schema(STATE).parquet(f"{old.root}/state/version={old.version}")
    _built[key] = _build(spark, _root(spark, directory), old, files, digest, events, state)
    return _built[key]


def _before(spark: SparkSession, newest: Built, first: date | None) -> Built | None:
    """The last of the versions that ``newest`` goes on from, itself included, whose days all lie before ``first``. What the versions after it
    added is of later days too, so all files that it lacks can be added to it at once.
    """
    if first is None:
        return None
    ends = _days(spark, newest.root).where(F.col("version").isin(list(newest.chain))).groupBy("version").agg(F.max("session_date").alias("through"))
    version = ends.where(F.col("through") < F.lit(first)).agg(F.max("version")).first()[0]
    return newest if version == newest.version else None if version is None else _stored(spark, newest.root, version)


def _build(spark: SparkSession, root: str, old: Built | None, files: DataFrame, digest: tuple, events: DataFrame, state: DataFrame | None) -> Built:
    number = _next(spark, root)
    place = lambda name: f"{root}/{name}/version={number}"
    rows = models.session_rows(models.sessionize(models.prop(events), carried=state))
    store = lambda df, name: (df.write.parquet(place(name)), spark.read.schema(df.schema).parquet(place(name)))[1]
    rows = store(rows, "grouped")  # read several times below
    n = F.col("session_no")
    if state is None:
        fresh, kept = rows, {}
    else:
        carried = rows.join(state.select("user_id", "n_sessions", "open_date"), "user_id").where(n <= F.col("n_sessions")).select("session_uid", "open_date", *[F.col(c).alias(f"_{c}") for c in ("ended_at", "exit_event", "n_events", "n_purchases")])
        carried = store(carried, "carried")
        fresh = rows.join(carried, "session_uid", "left_anti")
        again = [r.open_date for r in carried.select("open_date").distinct().collect()]  # the last day, and days of sessions that go on and on
        kept = {d: v for d, v in old.days.items() if d not in again}
        before = _read(spark, old, again).join(carried.drop("open_date"), "session_uid", "left") if again else None
        if before is not None:
            total = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
            changed = {"ended_at": F.coalesce("_ended_at", "ended_at"), "exit_event": F.coalesce("_exit_event", "exit_event"), "n_events": total("n_events"), "n_purchases": total("n_purchases"), "bounced": total("n_events") == 1}
            before = before.select(*[changed.get(c, F.col(c)).alias(c) for c in models.SESSION_COLUMNS])
            _write(before, place("rows"))
    written = fresh.select(*models.SESSION_COLUMNS)
    _write(written, place("rows"))
    if state is None:
        users = rows.select("user_id").distinct()
        numbers = scan.numbered(users, ["user_id"], "number")
    else:
        first = state.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        users = rows.select("user_id").distinct().join(state, "user_id", "left_anti")
        numbers = state.select("user_id", "number").unionByName(scan.numbered(users, ["user_id"], "number", first))
    numbers = store(numbers, "numbers")
    latest = rows.groupBy("user_id").agg(F.max(F.struct("session_no", "ended_at", "session_date")).alias("x")).select("user_id", F.col("x.session_no").alias("n_sessions"), F.col("x.session_date").alias("open_date"), F.col("x.ended_at").alias("ended_at"))
    if state is not None:  # a session that goes on keeps the day that it began on
        merged = latest.unionByName(state.drop("number")).groupBy("user_id").agg(F.max("n_sessions").alias("n_sessions"), F.max("ended_at").alias("ended_at"), F.max(F.struct("n_sessions", F.unix_date("open_date") * -1, "open_date")).alias("x"))
        latest = merged.select("user_id", "n_sessions", F.col("x.open_date").alias("open_date"), "ended_at")
    latest.join(numbers, "user_id").select("user_id", "n_sessions", "open_date", "ended_at", "number").write.parquet(place("state"))
    seen = fresh.join(numbers, "user_id").groupBy("session_date", "user_label", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"), F.count("*").alias("n_sessions"))
    seen.hint("rebalance", "session_date").write.partitionBy("session_date").parquet(place("visitors"))
    files.write.parquet(place("files"))
    found = {r.session_date: number for r in written.select("session_date").distinct().collect()}
    days = kept | ({d: number for d in again} if state is not None else {}) | found
    parent = old.version if old else None
    spark.createDataFrame([(d, v, parent) for d, v in days.items()] or [(None, number, parent)], DAYS).coalesce(1).write.parquet(place("days"))
    return Built(root, number, digest, max(days, default=None), days, ((*old.chain, number) if old else (number,)))


def _write(rows: DataFrame, path: str) -> None:
    """By day, in files as large as the session wants them: a hot day is dealt to several tasks, small ones share a task."""
    rows.hint("rebalance", "session_date").write.mode("append").partitionBy("session_date").parquet(path)


def _newest(spark: SparkSession, directory: str) -> Built | None:
    """The newest whole version, as this application knows it or as it is stored: the list of days is what a build writes last."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _built:
        root = _root(spark, directory)
        try:
            version = _days(spark, root).agg(F.max("version")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        _built[key] = _stored(spark, root, version)
    return _built[key]


def _days(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DAYS + ", version int").parquet(f"{root}/days")


def _stored(spark: SparkSession, root: str, version: int) -> Built:
    days = _days(spark, root)
    own = {r.session_date: r.in_version for r in days.where(F.col("version") == version).where("session_date IS NOT NULL").collect()}
    parents, chain = dict(days.select("version", "parent").distinct().collect()), [version]
    while parents[chain[-1]] is not None:
        chain.append(parents[chain[-1]])
    return Built(root, version, _digest(spark.read.parquet(f"{root}/files/version={version}")), max(own, default=None), own, tuple(reversed(chain)))


def _next(spark: SparkSession, root: str) -> int:
    """A version that no build has begun."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.max(F.regexp_extract("path", "version=(\\d+)", 1).cast("int"))).first()[0] + 1
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0


def _of(spark: SparkSession, directory: str) -> Built:
    built = _newest(spark, directory)
    if built is None:
        raise NotBuilt(f"the session table of {directory} has not been built")
    return built


def _read(spark: SparkSession, built: Built, days: list[date] | None = None) -> DataFrame:
    wanted = built.days if days is None else {d: built.days[d] for d in days}
    if len(set(wanted.values())) == 1 and days is None and set(wanted.values()) == {built.version}:
        paths = [f"{built.root}/rows/version={built.version}"]
    else:
        paths = [f"{built.root}/rows/version={v}/session_date={d}" for d, v in sorted(wanted.items())]
    reader = spark.read.schema(models.SESSIONS + ", version int").option("basePath", f"{built.root}/rows")
    return (reader.parquet(*paths) if paths else spark.createDataFrame([], models.SESSIONS)).select(*models.SESSION_COLUMNS)


def sessions(spark: SparkSession, directory: str) -> DataFrame:
    """The sessions of the newest version, by day of the directory tree: a filter on session_date prunes."""
    return _read(spark, _of(spark, directory))


def visitors(spark: SparkSession, directory: str) -> DataFrame:
    """(session_date, user_label, bucket, bitmap, n_sessions): which users, by number, began how many sessions on a day with a label.

    A day is of the version that first had it: later ones only carry its sessions on.
    """
    built = _of(spark, directory)
    paths = [f"{built.root}/visitors/version={v}" for v in built.chain]
    return spark.read.schema(VISITORS + ", version int").option("basePath", f"{built.root}/visitors").parquet(*paths).drop("version")


def sizes(spark: SparkSession, directory: str, of: str = "rows") -> DataFrame:
    """(session_date, bytes) of the newest version's files of sessions (``rows``) or of ``visitors``, by listing them."""
    built = _of(spark, directory)
    day, version = (F.regexp_extract("path", p, 1) for p in ("session_date=([0-9-]+)", "version=(\\d+)"))
    files = listing(spark, f"{built.root}/{of}").select(F.try_to_date(day).alias("session_date"), version.cast("int").alias("in_version"), "bytes")
    if of == "rows":
        files = files.join(spark.read.parquet(f"{built.root}/days/version={built.version}").select("session_date", "in_version"), ["session_date", "in_version"])
    else:
        files = files.where(F.col("in_version").isin(list(built.chain)))
    return files.groupBy("session_date").agg(F.sum("bytes").alias("bytes"))


def cost(spark: SparkSession, directory: str, first: date, last: date, of: str = "rows") -> int:
    """File bytes of the wanted days: what a scan of them reads at most."""
    return sizes(spark, directory, of).where(F.col("session_date").between(F.lit(first), F.lit(last))).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
