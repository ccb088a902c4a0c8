"""Typed ingest of usage events from JSON lines: what keeps the contract goes to the table, what breaks it to quarantine with its reason.

No line is lost: each is in one of the two tables. A tenant id that is no string, or is missing, is written as null and counted as
a flaw; it does not cost the event. Fields that the contract does not name are dropped, never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

VERSION = "1.0"
#: The contract's fields as text or arrays, and their codes. Fixed values.
TEXTS = ("schema_version", "event_name", "event_time", "interaction_id", "transport", "user_id", "identity_status", "host", "authorization_result", "tool_name", "resolution", "status", "error_code", "unsupported_reason")
CODES = {
    "event_name": ("analytics_request_completed",),
    "transport": ("mcp", "rest"),
    "host": ("chatgpt", "claude", "web_app", "other"),
    "identity_status": ("verified", "unavailable"),
    "authorization_result": ("allowed", "denied", "unknown"),
    "resolution": ("supported", "needs_clarification", "unsupported", "unknown"),
    "status": ("success", "failure", "denied", "unsupported", "needs_clarification"),
}
REQUIRED = ("interaction_id", "event_time", *CODES)
#: Whole numbers and the least that each may be; null is allowed where ``OPTIONAL`` says so.
NUMBERS = {"latency_ms": 0, "requested_days": 1, "result_row_count": 0}
OPTIONAL = ("requested_days", "result_row_count")
LISTS = ("metrics", "dimensions")
EVENT = "schema_version string, event_name string, event_time timestamp, interaction_id string, transport string, user_id string, identity_status string, host string, authorization_result string, tool_name string, resolution string, status string, error_code string, unsupported_reason string, tenant_id string, latency_ms long, requested_days long, result_row_count long, metrics array<string>, dimensions array<string>, event_date date, flaw string"


def judged(lines: DataFrame) -> DataFrame:
    """``lines`` (value) with ``reason``, the first rule that a line breaks (null: none), and ``event``, what it says in the contract's types.

    Null and empty lines are not JSON. A value of another JSON type than the contract's breaks it: nothing is converted.
    """
    names = (*TEXTS, "tenant_id", *NUMBERS, *LISTS)
    # Step by step, so that a line is parsed and a field looked up once, whatever the rules ask of it.
    rows = lines.select("value", F.try_parse_json("value").alias("line"))
    rows = rows.select("value", F.schema_of_variant("line").alias("shape"), *[F.try_variant_get("line", f"$.{c}", "variant").alias(c) for c in names])
    rows = rows.select("*", *[F.schema_of_variant(c).alias(f"{c}_kind") for c in names])
    typed = {c: ("string", ("STRING",)) for c in (*TEXTS, "tenant_id")} | {c: ("long", ("BIGINT",)) for c in NUMBERS} | {c: ("array<string>", ("ARRAY<STRING>", "ARRAY<VOID>")) for c in LISTS}
    rows = rows.select("value", "shape", *[f"{c}_kind" for c in names], *[F.when(F.col(f"{c}_kind").isin(*kinds), F.try_variant_get(c, "$", of)).alias(c) for c, (of, kinds) in typed.items()])
    kind = lambda c: F.col(f"{c}_kind")
    text = number = F.col
    missing = lambda c: kind(c).isNull() | (kind(c) == "VOID")
    items = lambda c: F.array_distinct(c)
    at = F.when(text("event_time").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?Z$"), F.try_to_timestamp(text("event_time")))
    rules: list[tuple[Column, str]] = [(F.coalesce("shape", F.lit("")).startswith("OBJECT") == F.lit(False), "not_an_object"), (~F.coalesce(text("schema_version") == VERSION, F.lit(False)), "unknown_schema_version")]
    rules += [(missing(c), f"missing_{c}") for c in REQUIRED]
    rules += [(~missing(c) & text(c).isNull(), f"wrong_type_{c}") for c in TEXTS]
    rules += [(~F.coalesce(text(c).isin(*values), F.lit(False)), f"unknown_{c}") for c, values in CODES.items()]
    rules += [(at.isNull(), "invalid_event_time"), (F.coalesce(F.trim(text("interaction_id")), F.lit("")) == "", "missing_interaction_id")]
    for c, least in NUMBERS.items():
        bad = ~F.coalesce(number(c) >= least, F.lit(False))
        rules.append((~missing(c) & bad if c in OPTIONAL else bad, f"invalid_{c}"))
    rules += [(items(c).isNull(), f"invalid_{c}") for c in LISTS]
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])
    flaw = F.when(missing("tenant_id"), "missing_tenant_id").when(text("tenant_id").isNull(), "wrong_type_tenant_id")
    values = {c: text(c) for c in TEXTS} | {"event_time": at, "tenant_id": text("tenant_id")} | {c: number(c) for c in NUMBERS} | {c: items(c) for c in LISTS} | {"event_date": F.to_date(at), "flaw": flaw}
    event = F.struct(*[values[name].cast(of).alias(name) for name, of in (c.split(" ", 1) for c in EVENT.split(", "))])
    # A list of one: filters on the reason stay behind it and do not repeat all steps.
    return rows.select("value", F.inline(F.array(F.struct(reason.alias("reason"), event.alias("event")))))


def ingest(lines: DataFrame, path: str) -> StreamingQuery:
    """Write a stream of lines (value) to ``path``/events, by day, and ``path``/quarantine, by reason. A batch that is replayed writes its own
    folder anew, so no line is there twice. Both read the batch from its source: judged lines are many times larger than what they come
    from, and are not kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = judged(batch)
        found.where("reason IS NULL").select("event.*").write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/events/batch={number}")
        found.where("reason IS NOT NULL").select("value", "reason").write.mode("overwrite").partitionBy("reason").parquet(f"{path}/quarantine/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
