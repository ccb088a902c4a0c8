"""Best-fit packing of documents into token sequences, planned over the histogram of lengths.

A length has at most ``capacity`` values, so best-fit decreasing runs over counts on the driver in memory
that does not depend on the corpus. The plan says which ranks of each length go where; documents learn
their rank within their length from two-level counts and take the planned slots by a join.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared, tokens

CAPACITY, END_ID = 1024, 2
#: Rows of one length that are ranked in one task, about.
RANKED = 200_000
#: Most rows of a plan that are broadcast.
PLAN_ROWS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, sequence_from long, offset_from long, per_sequence long"


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence_from, offset_from, per_sequence).

    The item of rank k, with q = k - rank_from, goes to sequence sequence_from + q // per_sequence, at
    offset_from + (q % per_sequence) * length. Equal items are interchangeable, so whole runs of sequences
    with the same room are filled at once; the number of rows depends on ``capacity`` alone.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs (first sequence, how many) by room left
    heap: list[int] = []
    rows, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not room[left]:
                heappush(heap, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        n, rank, small = histogram[length], 0, []
        while n:
            while heap and (heap[0] < length or not room[heap[0]]):
                left = heappop(heap)
                if room[left]:
                    small.append(left)
            left = heap[0] if heap else capacity
            per = left // length
            if heap:
                first, have = room[left].pop()
            else:
                have = -(-n // per)
                first, opened = opened, opened + have
            whole = min(have, n // per)
            if whole:
                rows.append((length, rank, rank + whole * per, first, capacity - left, per))
                put(left - per * length, first, whole)
                rank, n = rank + whole * per, n - whole * per
            used = whole
            if used < have and n and n < per:
                rows.append((length, rank, rank + n, first + used, capacity - left, per))
                put(left - n * length, first + used, 1)
                used, n = used + 1, 0
            put(left, first + used, have - used)
        for left in small:  # too small for this length, not for the next ones
            heappush(heap, left)
    return rows


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(path).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(encode(text or "") + end)
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut those over ``capacity``: a row per piece. The first piece of a cut document is the short one."""
    _shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, capacity, end_id), PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``pieces`` (doc_id, piece, length, ...) its sequence_id and offset.

    ``pieces`` is read several times: store it first if it is costly. A length that a third of all rows share
    is ranked in cells of about ``RANKED`` rows; cell offsets come from counts.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = plan_best_fit(histogram, capacity)
    cells = 16
    while cells * RANKED < sum(histogram.values()):
        cells *= 2
    keyed = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)).cast("int"))
    counted = keyed.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*order)) - 1)
    ranked = ranked.join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    plan = spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "_length")
    plan = F.broadcast(plan) if len(rows) <= PLAN_ROWS else plan
    inside: Column = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    q = F.col("_rank") - F.col("rank_from")
    return ranked.join(plan, inside).select(
        *pieces.columns,
        (F.col("sequence_from") + F.floor(q / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + (q % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; a row per piece with its place.

    A null or empty text is the end id alone. Repeated rows are packed like any others. Columns of ``docs``
    other than doc_id and text are not read.
    """
    return place(_shared.store(cut(docs, path, capacity, end_id), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_shared.read(spark, sf_dir, "documents"), tokens.public_path("byte_bpe_50k.json"))
