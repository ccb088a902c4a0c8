"""How filters of a corpus interact: what each removes in every order that they can be applied in.

A document's failures are the bits of a mask, and documents are counted by part and mask: at most 32 cells a part for
five filters, whatever the corpus. The cells are unpivoted against all steps of all orders. A running bit-or over the
steps before tells what had failed earlier; conditional sums over cells give a step's counts; a window over all orders
gives each filter's total.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

SPACE = "[\\x20\\x09-\\x0D]+"
WORDS, DISTINCT, CAPITALS = 100, 80, 10
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> dict[str, Column]:
    """The conditions that look at one text, by filter: few words, repeated words, capitals, odd signs. The text is not null."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < WORDS, "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * n, "C": 100 * capitals > CAPITALS * F.length(text), "D": text.rlike("[#$%&*|]")}


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and failures; bit i of ``mask`` is the i-th filter's.

    ``docs`` has doc_id, text, lang; ``labels`` doc_id, quality, toxic; other columns are ignored. A null text is empty, a null
    lang the empty part. The last filter (E) is failed by a text that a smaller doc_id has too: no row fails it by
    a repeat of its own doc_id, and rows without a doc_id neither fail it nor make others fail. A doc_id is good or toxic if any
    of its labels says so. Texts are compared by SHA-256. Copies are counted before they meet, so no group of them
    grows with the corpus; empty tables have no cells.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), part.alias("part"))
    own = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own.cast("int").alias("own"))
    rows = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    # Rows without a doc_id have no label: a second key deals them to many tasks.
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    rows = rows.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").drop("spread")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # Of each text and kind, all rows, those of the smallest doc_id, and those without one. A row a doc_id comes in, so the first ones are found by a combinable minimum.
    kinds = ["digest", "own", "part", "good", "toxic"]
    rows = rows.groupBy("doc_id", *kinds).agg(F.sum("n").alias("n"))
    texts = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    stays = F.col("nameless") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    texts = texts.withColumn("stays", stays)
    copied = F.inline(F.array(F.struct(F.col("own").alias("mask"), F.col("stays").alias("c")), F.struct((F.col("own") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("stays")).alias("c"))))
    counted = texts.select("part", "good", "toxic", copied).where("c > 0")
    return counted.groupBy("part", "mask").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("good")).alias("good"), F.sum(F.col("c") * F.col("toxic")).alias("toxic"))


def evaluate(found: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row per part, order of ``filters`` and step, with ``METRICS``; ``found`` has part, mask, n, good, toxic (as ``cells``).

    Bit i of a mask is the failure of ``filters[i]``. Every part has all orders and steps, zeros included; cells of one part and mask
    are added up. All orders are a fixed table (six filters at most): nothing here grows with the corpus.
    """
    if not 0 < len(set(filters)) == len(filters) <= 6:
        raise ValueError("one to six different filters")
    orders = [{"filter_order": "".join(o), "step": i + 1, "bit": 1 << filters.index(f)} for o in permutations(filters) for i, f in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(orders)), "array<struct<filter_order:string,step:int,bit:int>>")
    cells_ = found.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    long = cells_.select("*", F.inline(steps)).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.expr("bit_or(failed)").over(before), F.lit(0)))
    gone, fails = F.col("earlier") != 0, F.col("failed") != 0
    total = lambda c, of: F.coalesce(F.sum(F.when(c, F.col(of))), F.lit(0)).cast("long")
    rows = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(~gone & ~fails, "n").alias("kept"),
        total(~gone & fails, "n").alias("removed"),
        total(gone & fails, "n").alias("redundant"),
        total(F.col("mask") == F.col("bit"), "n").alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return rows.withColumn("shapley", shapley).select("part", "filter_order", "step", *METRICS)


def marginal(audit: DataFrame, n_filters: int = 5) -> DataFrame:
    """(part, filter, shapley): each filter's removals on average over all orders, from the rows of ``evaluate``."""
    name = F.substr("filter_order", F.col("step"), F.lit(1))
    return audit.groupBy("part", name.alias("filter")).agg((F.max("shapley") / factorial(n_filters)).alias("shapley"))


def op12_filter_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return evaluate(cells(docs, _shared.read(spark, sf_dir, "labels")))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
OP12_SQL = f"""WITH l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {{'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)}} AS x FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, CAST(x.A AS INT) AS a, CAST(x.B AS INT) AS b, CAST(x.C AS INT) AS c, CAST(x.D AS INT) AS d, CAST(x.E AS INT) AS e, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT * FROM (VALUES {_ORDERS}) v(filter_order)),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier, good, toxic, n, a + b + c + d + e AS fails,
  (CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS own,
  (CASE WHEN contains(substr(filter_order, 1, step - 1), 'A') THEN a ELSE 0 END + CASE WHEN contains(substr(filter_order, 1, step - 1), 'B') THEN b ELSE 0 END + CASE WHEN contains(substr(filter_order, 1, step - 1), 'C') THEN c ELSE 0 END
   + CASE WHEN contains(substr(filter_order, 1, step - 1), 'D') THEN d ELSE 0 END + CASE WHEN contains(substr(filter_order, 1, step - 1), 'E') THEN e ELSE 0 END) AS gone FROM g, o, (SELECT CAST(i AS INT) AS step FROM range(1, 6) r(i))),
r AS (SELECT part, filter_order, step, letter, CAST(sum(CASE WHEN gone = 0 AND own = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = 0 AND own = 1 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone > 0 AND own = 1 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN gone = 0 AND own = 1 THEN n * good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = 0 AND own = 1 THEN n * toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
