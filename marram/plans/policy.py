"""Gates before a query runs: date limits, costs from listed files, and guarded execution with measured provenance."""

from __future__ import annotations

import contextlib
import io
import os
import re
import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from marram.functions.dates import explicit

#: What makes a query: it is given a function to watch the rows that the query reads, and applies it to them.
Watch = Callable[[DataFrame], DataFrame]
Make = Callable[[Watch], DataFrame]


class PolicyError(ValueError):
    def __init__(self, code: str, **details):
        super().__init__(f"{code} {details}")
        self.code, self.details = code, details


@dataclass(frozen=True)
class Policy:
    earliest: date = date(2020, 10, 14)
    max_days: int = 90
    max_bytes_per_job: int = 2_000_000_000
    max_bytes_per_request: int = 10_000_000_000
    max_bytes_per_day: int = 49_999_167_488
    timeout_s: float = 60.0

    @classmethod
    def from_environment(cls, values: Mapping[str, str] | None = None) -> Policy:
        """Limits from ``MARRAM_EARLIEST_DATE``, ``MARRAM_MAX_DAYS``, ``MARRAM_MAX_BYTES_PER_JOB``, ``MARRAM_MAX_BYTES_PER_REQUEST``,
        ``MARRAM_MAX_BYTES_PER_DAY`` and ``MARRAM_TIMEOUT_S``; what is not set keeps its default, what cannot be read is an error.
        """
        values, found = os.environ if values is None else values, {}
        kinds = {"earliest": ("EARLIEST_DATE", date.fromisoformat), "max_days": ("MAX_DAYS", int), "max_bytes_per_job": ("MAX_BYTES_PER_JOB", int), "max_bytes_per_request": ("MAX_BYTES_PER_REQUEST", int), "max_bytes_per_day": ("MAX_BYTES_PER_DAY", int), "timeout_s": ("TIMEOUT_S", float)}
        for name, (key, kind) in kinds.items():
            if (text := values.get(f"MARRAM_{key}")) is not None:
                try:
                    found[name] = kind(text)
                except ValueError as e:
                    raise ValueError(f"MARRAM_{key}: {e}") from e
                if name != "earliest" and found[name] <= 0:
                    raise ValueError(f"MARRAM_{key} is not positive")
        return cls(**found)

    def dates(self, start: str, end: str, today: date, comparison_periods: int = 0) -> tuple[date, date]:
        """The two dates, or the first limit that they break: form, order, earliest day, span, look-back, future."""
        if comparison_periods < 0:
            raise ValueError("comparison_periods is negative")
        if not all(isinstance(d, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", d) for d in (start, end)):
            raise PolicyError("invalid_date_format")
        try:
            first, last = date.fromisoformat(start), date.fromisoformat(end)
        except ValueError:
            raise PolicyError("invalid_date_format") from None
        days = (last - first).days + 1
        if days < 1:
            raise PolicyError("invalid_date_range")
        if first < self.earliest:
            raise PolicyError("date_before_available_range", earliest_scanned_date=first)
        if days > self.max_days:
            raise PolicyError("date_range_too_large", requested_days=days)
        if first - timedelta(days=days * comparison_periods) < self.earliest:
            raise PolicyError("date_before_available_range", earliest_scanned_date=first - timedelta(days=days * comparison_periods))
        if last > today:
            raise PolicyError("future_date_not_allowed", today=today)
        return first, last

    def code(self, start: Column, end: Column, today: Column, comparison_periods: int = 0) -> Column:
        """``dates`` for a column of requests: the code of the first limit that two texts break, null if they break none."""
        first, last = explicit(start), explicit(end)
        days = F.datediff(last, first) + 1
        earliest = F.lit(self.earliest)
        rules = [
            (first.isNull() | last.isNull(), "invalid_date_format"),
            (days < 1, "invalid_date_range"),
            (first < earliest, "date_before_available_range"),
            (days > self.max_days, "date_range_too_large"),
            (F.date_sub(first, days * comparison_periods) < earliest, "date_before_available_range"),
            (last > today, "future_date_not_allowed"),
        ]
        return F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])

    def preflight(self, costs: Mapping[str, Callable[[], int]], spent_today: int = 0) -> dict[str, int]:
        """Bytes of every query; the first over the job's cap, or that takes the sum over the request's or the day's, is refused. No query
        has been made by then: a cost comes from listed files.
        """
        found, total = {}, 0
        for name, cost in costs.items():
            try:
                found[name] = n = cost()
            except Exception as e:
                if hasattr(e, "code"):
                    raise
                raise PolicyError("query_cost_estimate_failed", query=name) from e
            if n > self.max_bytes_per_job:
                raise PolicyError("query_cost_limit_exceeded", query=name, estimated_bytes=n)
            total += n
            if total > self.max_bytes_per_request:
                raise PolicyError("query_cost_limit_exceeded", query=name, request_bytes=total)
            if spent_today + total > self.max_bytes_per_day:
                raise PolicyError("daily_query_quota_exceeded", query=name, day_bytes=spent_today + total)
        return found


@dataclass
class Run:
    """What a guarded query did. ``estimated_bytes`` are those of the files in question; ``rows_read`` were counted while it ran, null if it
    reads nothing that is watched; its jobs and stages are Spark's.
    """

    name: str
    tag: str
    status: str = "not_executed"
    estimated_bytes: int = 0
    plan: str = ""
    arguments: dict = field(default_factory=dict)
    seconds: float = 0.0
    rows: list[Row] = field(default_factory=list)
    rows_read: int | None = None
    job_ids: list[int] = field(default_factory=list)
    stages: int = 0

    def record(self) -> dict:
        """What the answer says about the query, without its rows. The tag finds its jobs in Spark's own records."""
        return {"query": self.name, "tag": self.tag, "status": self.status, "estimated_bytes": self.estimated_bytes, "rows_read": self.rows_read, "rows_returned": len(self.rows), "job_ids": self.job_ids, "stages": self.stages, "arguments": self.arguments, "seconds": round(self.seconds, 3), "plan": self.plan}


def label(text: str) -> str:
    """A name as a label may have it: no underscores, 63 characters at most."""
    return text.replace("_", "-")[:63]


def failure(error: Exception, late: bool) -> str:
    """The code of a failed query."""
    name = type(error).__name__
    if late:
        return "query_timeout"
    if hasattr(error, "code"):
        return error.code
    if name == "AnalysisException" or name == "ParseException":
        return "query_invalid"
    if "PATH_NOT_FOUND" in str(error) or "FileNotFoundException" in str(error):
        return "data_unavailable"
    return "query_failed"


def described(df: DataFrame) -> str:
    """A query's plan as Spark prints it."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def execute(spark: SparkSession, queries: Mapping[str, Make], costs: Mapping[str, Callable[[], int]], policy: Policy, most_rows: int = 200, arguments: dict | None = None, spent_today: int = 0) -> list[Run]:
    """Make and run bounded queries one after the other, each as a job group and under a time limit, after all of them passed the preflight.

    Making counts in the time limit. After a failure the rest is reported as not executed, with the records so far in the
    error's details.
    """
    estimates = policy.preflight(costs, spent_today)
    runs = [Run(n, f"marram-{label(n)}-{uuid.uuid4().hex}", estimated_bytes=estimates[n], arguments=arguments or {}) for n in queries]
    context = spark.sparkContext
    for run, make in zip(runs, queries.values(), strict=True):
        late, seen = threading.Event(), []

        def stop(tag=run.tag, late=late):
            late.set()
            context.cancelJobGroup(tag)  # tags belong to the thread that set them, groups do not

        def watch(rows: DataFrame, seen=seen) -> DataFrame:
            seen.append(Observation())
            return rows.observe(seen[-1], F.count(F.lit(1)).alias("n"))

        timer = threading.Timer(policy.timeout_s, stop)
        context.setJobGroup(run.tag, run.name, interruptOnCancel=True)
        timer.start()
        began = time.monotonic()
        try:
            df = make(watch)
            run.plan = described(df)
            run.rows, run.status = df.limit(most_rows + 1).collect(), "executed"
            run.rows_read = sum(o.get["n"] for o in seen) if seen else None
        except Exception as e:
            run.status = "failed"
            raise PolicyError(failure(e, late.is_set()), query=run.name, runs=runs) from e
        finally:
            run.seconds = time.monotonic() - began
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
            tracker = context.statusTracker()
            run.job_ids = sorted(tracker.getJobIdsForGroup(run.tag))
            run.stages = sum(len(job.stageIds) for i in run.job_ids if (job := tracker.getJobInfo(i)))
    return runs
