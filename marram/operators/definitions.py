"""Building a metric catalog from definition rows: normal forms, signatures, conflicts.

A definition row has metric_id, position, context, category, model, agg, expr, filter, dimensions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators.metrics import over
from marram.operators.relational import best_rows
from marram.plans import models
from marram.plans.catalog import METRICS, metric
from marram.sources.tables import content_digest, read_csv

#: Accepted spellings of aggregations. Fixed values.
SPELLINGS = {"average": "average", "avg": "average", "count": "count", "count distinct": "count_distinct", "count_distinct": "count_distinct", "min": "min", "sum": "sum"}
SIGNATURE = ("category", "model", "agg", "expr", "filter", "dimensions")


def normalized(rows: DataFrame) -> DataFrame:
    """Rows in normal form: aggregations by one name (an unknown one is null), ``x <> null`` as ``x IS NOT NULL``, blanks as null."""
    names = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    condition = F.regexp_replace(blank("filter"), r"(?i)(\w+)\s*(<>|!=)\s*null\b", "$1 IS NOT NULL")
    return rows.withColumns({"agg": F.try_element_at(names, F.lower(F.trim("agg"))), "filter": condition, "dimensions": F.regexp_replace(blank("dimensions"), r"\s*,\s*", ", ")})


def signature() -> Column:
    return F.to_json(F.struct(*SIGNATURE), {"ignoreNullFields": "false"})


def catalog_status(rows: DataFrame) -> DataFrame:
    """metric_id, variants, status: published if one meaning remains, else a conflict."""
    return normalized(rows).groupBy("metric_id").agg(F.count_distinct(signature()).alias("variants")).withColumn("status", F.when(F.col("variants") == 1, "published").otherwise("conflict"))


def preferred(rows: DataFrame) -> DataFrame:
    """Of the rows of each metric and meaning one: with an order (order_by) before without, then with a label of its own
    before one that repeats the id; of equals, the one that comes first. ``uses`` counts the rows.
    """
    own = normalized(rows).withColumn("signature", signature())
    blank = F.coalesce(F.trim("order_by"), F.lit("")) != ""
    order = F.struct(blank.alias("a"), (~F.col("label").eqNullSafe(F.col("metric_id"))).alias("b"), (-F.col("position")).alias("c"))
    return own.groupBy("metric_id", "signature").agg(F.count("*").alias("uses"), F.max_by(F.struct("position", "label", "order_by"), order).alias("best")).select("metric_id", "signature", "uses", "best.*")


def build(rows: DataFrame, dimensions: DataFrame, digest: str, version: str) -> dict:
    """The catalog document of definition rows and dimension rows (dimension_id, label): a metric a row of ``preferred``,
    published if it has one meaning. It names the digest of its sources.
    """
    status = catalog_status(rows).withColumnRenamed("status", "state")
    chosen = best_rows(preferred(rows), ["metric_id"], F.col("uses"), -F.col("position")).join(status, "metric_id").orderBy("metric_id")
    known = {r.dimension_id: {"label": r.label} for r in dimensions.orderBy("dimension_id").collect()}
    metrics = {}
    for r in chosen.collect():  # a catalog has a row a metric
        own = json.loads(r.signature)
        names = [d for d in (own["dimensions"] or "").split(", ") if d]
        if missing := [d for d in names if d not in known]:
            raise ValueError(f"{r.metric_id} has unknown dimensions {missing}")
        metrics[r.metric_id] = own | {"dimensions": names, "label": r.label, "status": r.state, "variants": r.variants}
    return {"catalog_version": version, "source_sha256": digest, "dimensions": known, "metrics": metrics}


def build_from_csv(spark: SparkSession, metrics: str, dimensions: str, version: str) -> dict:
    """``build`` from two CSV files of strict headers."""
    rows = read_csv(spark, metrics, ["metric_id", "position", "context", "category", "model", "agg", "expr", "filter", "dimensions", "label", "order_by"], ["metric_id", "model", "agg"])
    return build(rows.withColumn("position", F.col("position").cast("int")), read_csv(spark, dimensions, ["dimension_id", "label"], ["dimension_id"]), content_digest(spark, [metrics, dimensions]), version)


def fleet_status(spark: SparkSession, results: list[dict]) -> DataFrame:
    """Of ``validate``'s results: passed and failed checks of each dataset and of all (dataset null), and whether all passed. No
    results at all are a failure.
    """
    rows = spark.createDataFrame([(r["dataset"], r["status"] == "passed") for r in results], "dataset string, passed boolean")
    found = [F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.bool_and("passed").alias("all_passed"), F.bool_or("passed").alias("any_passed")]
    every = rows.agg(F.lit(None).cast("string").alias("dataset"), *found)  # a row even without results
    out = rows.groupBy("dataset").agg(*found).unionByName(every)
    return out.select("dataset", "n_passed", "n_failed", F.coalesce("any_passed", F.lit(False)).alias("any_passed"), F.when(F.coalesce("all_passed", F.lit(False)), "passed").otherwise("failed").alias("status"))


def validate(spark: SparkSession, directories: dict[str, str]) -> list[dict]:
    """Analyse every published metric against every dataset without reading data; failures do not stop the rest."""
    out, analysed = [], models.MODELS | {"sessions": models.build_sessions}  # analysed from the events' schema, never built
    for name, directory in directories.items():
        for m, profiles in ((m, METRICS[m].profiles) for m in METRICS if METRICS[m].profiles):
            try:
                own = metric(m, profiles[0])
                columns, error = over(analysed[own.model](spark, directory), own).columns, None
            except Exception as e:  # whatever the analysis says belongs to the report
                columns, error = [], type(e).__name__
            out.append({"dataset": name, "metric_id": m, "columns": columns, "error": error, "status": "failed" if error else "passed"})
    return out
