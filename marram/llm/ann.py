"""Nearest neighbours by randomly rotated one-bit codes.

Candidates are dealt to coarse centres, fitted on a bounded sample, in two levels where rows are many. What is left of a vector after its centre is
rotated and reduced to the signs of its coordinates, packed into 64-bit words; with two correction scalars (its
length over the alignment of code and vector, and the deviation of the error) the bits give an unbiased estimate of
its inner product with any query. A query is rotated too and its coordinates are rounded to four bits, so that an
estimate is a sum of population counts of words.

In a block of candidates a query's best estimates are computed exactly first; then every candidate whose estimate
plus the error bound reaches the k-th best score known is reranked exactly. A query visits the centres nearest to it,
as many as a calibration on the sample needs: few if the vectors lie in clusters, most if they do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

K = 20
#: Standard deviations that the error bound covers.
BOUND = 1.5
#: Rows of a block of candidates and of queries, and blocks of either side that meet in one group of a join.
CANDIDATES, QUERIES, MEETING = 8192, 512, 4
#: Numbers of the sample that centres are fitted on, rows of it, rows a centre, and most centres.
SAMPLE_VALUES, SAMPLE_ROWS, ROWS_A_CENTRE, CENTRES = 4_000_000, 20_000, 4096, 256
#: Where more centres are wanted, each has so many of its own at most, fitted on so many rows for each; and scores held at once.
UNDER, ROWS_UNDER, HELD = 256, 32, 1 << 22
#: Dimensions that have centres of their own, by rows; others have one centre each.
DIMENSIONS = 16
#: Share of the sample's true neighbours that lie with the centres visited.
COVERED = 0.95
#: Bits of a query's coordinates, estimates computed exactly before the bound applies (times k), and scores kept by a worker.
PLANES, FIRST, FLOORS = 4, 8, 200_000

ROWS = "dim int, centre int, vec_id long, vector binary"
BLOCKS = "dim int, centre int, block int, ids binary, vectors binary, codes binary, scalars binary, middle binary"


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """The first ``dim`` rows of a random rotation of whole words' worth of dimensions, the same everywhere."""
    bits = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, a row of words a vector; scalars) of vectors: length over alignment, the error's deviation for a unit query, bits set."""
    rotated = vectors.astype(np.float64) @ rotation(vectors.shape[1])
    bits = rotated.shape[1]
    length = np.sqrt((rotated**2).sum(1))
    align = np.where(length > 0, np.clip(np.abs(rotated).sum(1) / (np.maximum(length, 1e-300) * np.sqrt(bits)), 1e-9, 1.0), 1.0)
    error = length * np.sqrt(np.maximum(0, 1 - align**2)) / align / np.sqrt(bits - 1)
    words = np.packbits(rotated > 0, axis=1).view("<u8")
    return words, np.stack([length / (align * np.sqrt(bits)), error, np.bitwise_count(words).sum(1)]).astype(np.float32)


@dataclass
class Asking:
    """Queries ready to meet codes: rotated, rounded to ``PLANES`` bits a coordinate, one bit plane after the other."""

    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, queries: np.ndarray) -> Asking:
        rotated = queries @ rotation(queries.shape[1])
        low = rotated.min(1)
        step = np.maximum((rotated.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
        rounded = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.uint8)
        planes = np.stack([np.packbits(rounded >> j & 1, axis=1).view("<u8") for j in range(PLANES)])
        return cls(planes, low, step, rotated.sum(1))

    def estimates(self, codes: np.ndarray, scalars: np.ndarray, of: slice) -> np.ndarray:
        """Estimated inner products of some of the queries with coded vectors, from population counts."""
        columns = np.ascontiguousarray(codes.T)
        planes = self.planes[:, of]
        kind = np.uint16 if 64 * len(columns) << PLANES < 1 << 16 else np.uint32
        counts, step = np.zeros((planes.shape[1], len(codes)), kind), 1 << 13
        for a in range(0, len(codes), step):  # a piece of this size stays in a core's cache
            part = counts[:, a : a + step]
            for j in range(PLANES - 1, -1, -1):
                part <<= 1
                for w in range(len(columns)):
                    part += np.bitwise_count(planes[j, :, w, None] & columns[w, a : a + step])
        inside = self.step[of, None].astype(np.float32) * counts + self.low[of, None].astype(np.float32) * scalars[2]
        return (2 * inside - self.total[of, None].astype(np.float32)) * scalars[0]


def nearest(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, middle: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: dict[int, float]) -> list[tuple[np.ndarray, ...]]:
    """(query, candidate, exact inner product) arrays of each query's best in one block, ties to smaller ids.

    ``floors`` has the k-th best score that a query is known to have; it is raised by what is found.
    """
    exact, reach = queries.astype(np.float64), float(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max(initial=0)))
    asking, lengths, shift = Asking.of(exact), np.sqrt((exact**2).sum(1)), exact @ middle.astype(np.float64)
    out = []
    for a in range(0, len(query_ids), 16):
        part = asking.estimates(codes, scalars, slice(a, a + 16)) + shift[a : a + 16, None].astype(np.float32)
        for q in range(a, min(a + 16, len(query_ids))):
            estimate, own = part[q - a], int(query_ids[q])
            floor = floors.get(own, -np.inf)
            # The slack covers the rounding of single precision.
            slack = 1e-5 * lengths[q] * reach
            if len(ids) <= FIRST * k:
                pick = np.arange(len(ids))
            else:
                first = np.zeros(0, int)
                if floor == -np.inf:
                    first = np.argpartition(-estimate, FIRST * k)[: FIRST * k]
                    first = first[ids[first] != own]
                    floor = np.partition(vectors[first].astype(np.float64) @ exact[q], -k)[-k]
                pick = np.flatnonzero(estimate >= (floor - slack) - BOUND * lengths[q] * scalars[1])
                pick = np.union1d(pick, first)  # k of the first reach the floor, whatever their estimates
                pick = pick[vectors[pick] @ queries[q] >= floor - slack]
            pick = pick[ids[pick] != own]
            score = (vectors[pick].astype(np.float64) * exact[q]).sum(1)
            best = np.lexsort((ids[pick], -score))[:k]
            if len(best) == k:
                floors[own] = max(floors.get(own, -np.inf), float(score[best[-1]]))
            out.append((np.full(len(best), own), ids[pick[best]], score[best]))
        if len(floors) > FLOORS:
            floors.clear()
    return out


@dataclass
class Centres:
    """Coarse centres by dimension, and how many of them a query visits."""

    of: dict[int, tuple[np.ndarray, int]]
    #: By dimension, centres of centres, and where each one's begin; dimensions with few centres have none.
    above: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def split(self, vectors: np.ndarray, visit: bool) -> np.ndarray:
        """The nearest centre of each vector; or the centres that it visits as a query, by inner product."""
        if vectors.shape[1] not in self.of:
            return np.zeros((len(vectors), 1), np.int32)
        centres, visits = self.of[vectors.shape[1]]
        if visit:
            step = max(1, HELD // len(centres))
            parts = [np.argsort(-(vectors[i : i + step].astype(np.float64) @ centres.T), axis=1, kind="stable")[:, :visits] for i in range(0, len(vectors), step)]
            return np.concatenate(parts).astype(np.int32)
        if vectors.shape[1] not in self.above:
            return nearest_centre(vectors, centres).astype(np.int32)[:, None]
        tops, starts = self.above[vectors.shape[1]]
        top, out = nearest_centre(vectors, tops), np.zeros(len(vectors), np.int32)
        for t in np.unique(top):
            own = top == t
            out[own] = starts[t] + nearest_centre(vectors[own], centres[starts[t] : starts[t + 1]])
        return out[:, None]


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step, least = max(1, HELD // len(centres)), (centres**2).sum(1) / 2
    parts = [(vectors[i : i + step].astype(np.float64) @ centres.T - least).argmax(1) for i in range(0, len(vectors), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def means(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of a sample by k-means."""
    centres = sample[:n].copy()
    for _ in range(10):
        nearest_ = nearest_centre(sample, centres)
        sums, counts = np.zeros_like(centres), np.bincount(nearest_, minlength=len(centres))
        np.add.at(sums, nearest_, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def centres_of(sample: np.ndarray, n: int, k: int) -> tuple[np.ndarray, int]:
    """``n`` centres of a sample, and the visits that find ``COVERED`` of its own neighbours."""
    sample = sample[np.random.default_rng(1).permutation(len(sample))].astype(np.float64)
    centres = means(sample, n)
    return centres, visits_of(sample, centres, nearest_centre(sample, centres), k)


def visits_of(sample: np.ndarray, centres: np.ndarray, nearest_: np.ndarray, k: int) -> int:
    """Of centres by inner product, how many a query visits to find ``COVERED`` of its ``k`` neighbours in a sample, whose nearest centres are known.
    Neighbours in the whole table are nearer than in a sample, so more are found there.
    """
    k, found = min(k, len(sample) - 1), []
    for i in range(0, min(500, len(sample)), 50):
        asked = sample[i : i + 50]
        both = asked @ sample.T
        both[np.arange(len(asked)), i + np.arange(len(asked))] = -np.inf
        near = np.argpartition(-both, k - 1, axis=1)[:, :k] if k else np.zeros((len(asked), 0), int)
        order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
        found.append(np.take_along_axis(rank, nearest_[near], 1))
    found = np.concatenate(found) if found else np.zeros((0, 0))
    return int(np.quantile(found, COVERED, method="higher")) + 1 if found.size else len(centres)


def centres_under(vectors: DataFrame, dim: int, n: int, sample: np.ndarray, tops: np.ndarray, k: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(centres, visits, where each of ``tops`` begins its own): each has about as many under it as its ``n`` rows ask for, fitted by Spark on a
    bounded number of rows of each.
    """
    spark = vectors.sparkSession
    nearest_ = nearest_centre(sample, tops)
    rows = np.maximum(1, np.bincount(nearest_, minlength=len(tops)) * n // len(sample))
    wanted = np.clip(rows // ROWS_A_CENTRE, 1, UNDER)
    share = [int(min(1 << 30, (int(w) * ROWS_UNDER << 30) // int(r))) for w, r in zip(wanted, rows, strict=True)]
    shared = spark.sparkContext.broadcast(Centres({dim: (tops, 1)}))
    picked = vectors.where(F.size("embedding") == dim).mapInArrow(_split(shared, "<f8", False), ROWS)
    place = F.pmod(F.xxhash64("vec_id", F.lit("under")), F.lit(1 << 30))
    picked = picked.where(place < F.element_at(F.lit(share), F.col("centre") + 1))

    def under(table: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(table["vector"].to_pylist()), "<f8").reshape(-1, dim)
        at = table["centre"][0].as_py()
        found = means(own[np.random.default_rng(at).permutation(len(own))], min(int(wanted[at]), len(own)))
        return pa.table({"centre": pa.array([at] * len(found), pa.int32()), "vector": pa.array([v.tobytes() for v in found], pa.binary())})

    found = picked.groupBy("centre").applyInArrow(under, "centre int, vector binary").toArrow()  # UNDER x CENTRES rows at most
    owner = found["centre"].to_numpy()
    order = np.argsort(owner, kind="stable")
    own = np.frombuffer(b"".join(found["vector"].to_pylist()), "<f8").reshape(-1, dim)[order]
    parts = [own[owner[order] == t] if (owner == t).any() else tops[t : t + 1] for t in range(len(tops))]
    centres, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    level = Centres({dim: (centres, 1)}, {dim: (tops, starts)})
    sample = sample[np.random.default_rng(1).permutation(len(sample))].astype(np.float64)
    return centres, visits_of(sample, centres, level.split(sample, False).ravel(), k), starts


def fit(vectors: DataFrame, k: int = K) -> Centres:
    """Centres for ``vectors`` (vec_id, embedding), fitted on a sample of bounded size that is drawn evenly over all rows; where the rows ask for more
    than ``CENTRES``, in two levels.
    """
    sizes = vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()
    out, above = {}, {}
    for dim, n in sizes:
        wanted = min(CENTRES, n // ROWS_A_CENTRE)
        if wanted < 2:
            continue
        rows = min(SAMPLE_ROWS, SAMPLE_VALUES // dim)
        place = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30))
        picked = vectors.where((F.size("embedding") == dim) & (place < min(1 << 30, (rows << 30) // n))).select("embedding").limit(2 * rows).toArrow()  # the share gives about `rows`; a vec_id that repeats very often might give more
        sample = picked["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        if wanted < len(sample):
            out[dim] = centres_of(sample, wanted, k)
            if n // ROWS_A_CENTRE > CENTRES:
                tops = out[dim][0]
                centres, visits, starts = centres_under(vectors, dim, n, sample, tops, k)
                out[dim], above[dim] = (centres, visits), (tops, starts)
    return Centres(out, above)


def _split(shared, kind: str, visit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            flat, ids, starts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind), batch.column(0).to_numpy(), np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                vectors = flat[starts[rows, None] + np.arange(dim)]
                centres = shared.value.split(vectors, visit)
                raw = [v.tobytes() for v in vectors]
                for i in range(0, len(rows), max(1, 65536 // centres.shape[1])):  # visits multiply the rows
                    own = slice(i, i + max(1, 65536 // centres.shape[1]))
                    n = centres.shape[1]
                    columns = [np.full(centres[own].size, dim, np.int32), centres[own].ravel(), np.repeat(ids[rows[own]], n)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([r for r in raw[own] for _ in range(n)], pa.binary())], names=["dim", "centre", "vec_id", "vector"])

    return run


def _blocks(shared, size: int, kind: str, k: int | None):
    """Rows that arrive by (dim, centre, part) as blocks. With ``k``, candidates are coded."""

    def close(dim: int, centre: int, block: int, ids: list[int], raw: list[bytes]) -> pa.RecordBatch:
        ids, vectors = np.array(ids, "<i8"), np.frombuffer(b"".join(raw), kind).reshape(-1, dim)
        codes, scalars, middle = np.zeros(0, "<u8"), np.zeros(0, np.float32), np.zeros(dim)
        if k:
            # Of equal vectors, k + 1 with the smallest ids: the others come after k others in any query's order.
            order = np.lexsort((ids, np.unique(vectors.view(np.void(vectors.itemsize * dim).dtype).ravel(), return_inverse=True)[1]))
            _, first, of = np.unique(vectors[order], axis=0, return_index=True, return_inverse=True)
            run = np.arange(len(order)) - np.minimum.reduceat(np.arange(len(order)), np.sort(first))[np.searchsorted(np.sort(first), np.arange(len(order)), "right") - 1]
            order = order[run <= k]
            ids, vectors = ids[order], vectors[order]
            if dim in shared.value.of:
                middle = shared.value.of[dim][0][centre]
            codes, scalars = encode(vectors - middle)
        cols = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, codes, scalars, middle.astype("<f8"))]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (dim, centre, block)), *cols], names=["dim", "centre", "block", "ids", "vectors", "codes", "scalars", "middle"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, raw = None, [], []
        for batch in batches:
            for *key, vec_id, vector in zip(*(batch.column(c).to_pylist() for c in ("dim", "centre", "block", "vec_id", "vector")), strict=True):
                if key != now or len(ids) >= 2 * size:
                    if ids:
                        yield close(*now, ids, raw)
                    now, ids, raw = key, [], []
                ids.append(vec_id)
                raw.append(vector)
        if ids:
            yield close(*now, ids, raw)

    return run


def _search(kind: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, float] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, query_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8")
                vectors, queries = np.frombuffer(row["vectors"], kind).reshape(-1, dim), np.frombuffer(row["queries"], kind).reshape(-1, dim)
                codes, scalars = np.frombuffer(row["codes"], "<u8").reshape(len(ids), -1), np.frombuffer(row["scalars"], np.float32).reshape(3, -1)
                found = nearest(ids, vectors, codes, scalars, np.frombuffer(row["middle"], "<f8"), query_ids, queries, k, floors)
                cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _dealt(rows: DataFrame, size: int, shared, kind: str, k: int | None, label: str) -> DataFrame:
    """Stored blocks of about ``size`` rows; a centre with many rows has many blocks, each made by a task of its own."""
    counts = rows.groupBy("dim", "centre").agg(F.count("*").alias("n"))  # at most a row a centre and dimension
    rows = rows.join(F.broadcast(counts), ["dim", "centre"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("n") / size)).cast("int")).drop("n")
    sorted_ = rows.repartition("dim", "centre", "block").sortWithinPartitions("dim", "centre", "block")
    return _shared.store(sorted_.mapInArrow(_blocks(shared, size, kind, k), BLOCKS), label)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the largest inner product with each query.

    Both have vec_id and embedding. Rows of the query's own id are no candidates. Vectors that are null, empty, zero or
    hold a null or non-finite component take no part, nor do rows without an id or candidates of another dimension than the query. Repeated
    candidates are candidates of their own; of a repeated query id the smallest vector asks. Ties go to smaller ids.
    Scores are exact in double precision (numbers other than single-precision ones are read as doubles); which rows are
    found depends on the error bound and the centres visited. Other columns are ignored.
    """
    spark = vectors.sparkSession
    _shared.bounded_batches(spark)
    single = all(dict(df.dtypes)["embedding"] == "array<float>" for df in (vectors, queries))
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    vectors, queries = (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) for df in (vectors, queries))
    shared = spark.sparkContext.broadcast(fit(vectors, k))
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    candidates = _dealt(_shared.store(vectors.mapInArrow(_split(shared, kind, False), ROWS), "assigned"), CANDIDATES, shared, kind, k, "vectors")
    asking = _dealt(_shared.store(asked.mapInArrow(_split(shared, kind, True), ROWS), "visits"), QUERIES, shared, kind, None, "queries")
    # Blocks of a centre meet in groups of a few, so that no centre is searched in one task.
    groups = lambda df, name: df.groupBy("dim", "centre").agg(F.ceil((F.max("block") + 1) / MEETING).cast("int").alias(name))
    sides = F.broadcast(groups(candidates, "n_c").join(groups(asking, "n_q"), ["dim", "centre"]))  # at most a row a centre and dimension
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = candidates.join(sides, ["dim", "centre"]).select("dim", "centre", "ids", "vectors", "codes", "scalars", "middle", (F.col("block") % F.col("n_c")).alias("c"), every(F.col("n_q")).alias("q"))
    right = asking.join(sides, ["dim", "centre"]).select("dim", "centre", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), (F.col("block") % F.col("n_q")).alias("q"), every(F.col("n_c")).alias("c"))
    found = left.join(right, ["dim", "centre", "c", "q"]).drop("centre", "c", "q").mapInArrow(_search(kind, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _shared.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
