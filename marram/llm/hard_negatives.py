"""Hard negatives by product quantisation with stored residual norms, exact.

Vectors are whole numbers. Each is cut into short parts; a part is replaced by the nearest of 256 codewords, fitted on a
bounded sample, and the length of what is left is stored beside the code. Of an anchor, a table has each codeword's
product with its part: the sum of looked-up products is a score's estimate, and by Cauchy-Schwarz the true score is
off by at most the sum, over parts, of the anchor part's length times the stored length. Only candidates whose interval can
still change an anchor's list are reranked, by whole-number products; so the lists are exact whatever the codewords are.

First an anchor meets the rows of its own label, for its positives. Their scores then bound windows of scores, and the
rows of other labels compete for each window's first places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared
from .ann import usable

POSITIVES, NEGATIVES = 5, 5
#: Percent of a positive's score that a negative's must reach at least.
LEAST = 80
#: Dimensions a part, codewords, rows that codewords are fitted on, rounds of fitting, dimensions that have codewords, by rows.
PART, WORDS, SAMPLE_ROWS, ROUNDS, DIMENSIONS = 2, 256, 4096, 6, 16
#: Rows of a block of candidates and of anchors, blocks of either side that meet in one group of a join.
CANDIDATES, ANCHORS, MEETING = 8192, 256, 4
#: Candidates reranked first to know how good a list is, anchors whose estimates are made at once, and lists that a worker knows the last score of.
FIRST, AT_ONCE, FLOORS = 64, 8, 400_000
#: Whole numbers are held within these bounds: longer ones are cut.
MOST = 1 << 62

BLOCKS = "dim int, label long, block int, n int, ids binary, ints binary, wide boolean"
CODED = BLOCKS + ", codes binary, residuals binary"
FOUND = "anchor_id long, positive int, vec_id long, score long"


@dataclass
class Codebooks:
    """Codewords by dimension: an array (parts, words, numbers a part)."""

    of: dict[int, np.ndarray] = field(default_factory=dict)

    def encode(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths of what is left), a column a part; without codewords for the dimension, no columns."""
        words = self.of.get(ints.shape[1])
        if words is None:
            return np.zeros((len(ints), 0), np.uint8), np.zeros((len(ints), 0), np.float32)
        parts = parted(ints)
        codes, left = np.zeros((len(ints), len(words)), np.uint8), np.zeros((len(ints), len(words)), np.float32)
        for m, own in enumerate(words):
            near = (parts[:, m] @ own.T - (own**2).sum(1) / 2).argmax(1)
            codes[:, m] = near
            # Rounded up, so that single precision never shortens a bound.
            left[:, m] = np.nextafter(np.sqrt(((parts[:, m] - own[near]) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))
        return codes, left


def parted(ints: np.ndarray) -> np.ndarray:
    """Vectors as doubles in parts of ``PART`` numbers, the last filled up with zeros."""
    n, dim = ints.shape
    m = -(-dim // PART)
    out = np.zeros((n, m * PART))
    out[:, :dim] = ints
    return out.reshape(n, m, PART)


def codewords(sample: np.ndarray) -> np.ndarray:
    """The codewords of each part, by k-means over a sample of vectors."""
    parts, out = parted(sample), []
    for m in range(parts.shape[1]):
        own = parts[:, m]
        words = np.unique(own, axis=0)
        if len(words) > WORDS:
            words = words[np.random.default_rng(m).permutation(len(words))[:WORDS]]
            for _ in range(ROUNDS):
                near = (own @ words.T - (words**2).sum(1) / 2).argmax(1)
                n = np.bincount(near, minlength=len(words))
                sums = np.stack([np.bincount(near, own[:, k], minlength=len(words)) for k in range(PART)], 1)
                words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        out.append(np.concatenate([words, np.repeat(words[:1], WORDS - len(words), axis=0)]))
    return np.stack(out)


def fit(rows: DataFrame) -> Codebooks:
    """Codewords for ``rows`` (vec_id, dim, ints), fitted on ``SAMPLE_ROWS`` rows of each of the ``DIMENSIONS`` most frequent dimensions,
    drawn evenly; vectors of others are all reranked.
    """
    out = Codebooks()
    for dim, n in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect():
        place = F.pmod(F.xxhash64("vec_id", F.lit("codewords")), F.lit(1 << 30))
        picked = rows.where((F.col("dim") == dim) & (place < min(1 << 30, (SAMPLE_ROWS << 30) // n))).select("ints").limit(2 * SAMPLE_ROWS).toArrow()
        if dim and len(picked):
            out.of[dim] = codewords(picked["ints"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
    return out


def products(ints: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of rows with an anchor as whole numbers, exact; those beyond a long's range are cut to it."""
    if len(ints) == 0 or int(np.abs(ints).max(initial=0)) * int(np.abs(anchor).max(initial=0)) * ints.shape[1] < 1 << 62:
        return ints.astype(np.int64) @ anchor.astype(np.int64)
    exact = ints.astype(object) @ anchor.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in exact], np.int64)


@dataclass
class Block:
    """Candidates of one label: smallest ids first among equal vectors."""

    ids: np.ndarray
    ints: np.ndarray
    codes: np.ndarray
    residuals: np.ndarray

    def intervals(self, words: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated scores, how far they may be off), a row an anchor."""
        parts = parted(anchors)
        tables = np.einsum("qmd,mwd->qmw", parts, words)
        sums = np.zeros((len(anchors), len(self.ids)))
        for m in range(len(words)):
            sums += tables[:, m][:, self.codes[:, m]]
        lengths = np.sqrt((parts**2).sum(2))
        off = lengths @ self.residuals.T.astype(np.float64)
        reach = np.abs(tables).max(2).sum(1)[:, None]
        return sums, off + 1e-12 * (reach + off) * len(words)  # the slack covers the rounding of doubles


def compete(block: Block, books: Codebooks, anchor_ids: np.ndarray, anchors: np.ndarray, windows: list[list[tuple[int, int, int]]], k: int, floors: dict) -> list[tuple[np.ndarray, ...]]:
    """The block's best ``k`` of each anchor's windows as arrays (anchor, window, candidate, score): higher scores first, ties to smaller ids.

    A window is (its number, least score, most score). ``floors`` has the k-th best score that a window is known to have; what is found
    raises it.
    """
    out, words = [], books.of.get(anchors.shape[1])
    for a in range(0, len(anchor_ids), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        if words is None:
            sums, off = np.zeros((len(anchors[part]), len(block.ids))), np.full((len(anchors[part]), len(block.ids)), np.inf)
        else:
            sums, off = block.intervals(words, anchors[part])
        low, high = (np.clip(x, -(2.0**63), 2.0**63) for x in (sums - off, sums + off))  # scores are cut to this range too
        for q in range(a, min(a + AT_ONCE, len(anchor_ids))):
            own, anchor, j = int(anchor_ids[q]), anchors[q], q - a
            others = block.ids != own
            known = np.zeros(len(block.ids), bool)
            scores = np.zeros(len(block.ids), np.int64)

            def rerank(pick: np.ndarray, known=known, scores=scores, anchor=anchor) -> None:
                pick = pick[~known[pick]]
                scores[pick], known[pick] = products(block.ints[pick], anchor), True

            needed = []
            for number, least, most in windows[q]:
                floor = floors.get((own, number), least)
                can = others & (low[j] <= most) & (high[j] >= floor)
                pick = np.flatnonzero(can)
                if len(pick) > FIRST:
                    first = pick[np.argpartition(np.abs(sums[j, pick] - min(most, float(high[j, pick].max()))), FIRST)[:FIRST]]
                    rerank(first)
                    got = scores[first]
                    got = got[(got >= least) & (got <= most)]
                    if len(got) >= k:
                        floor = max(floor, int(np.partition(got, -k)[-k]))
                        pick = pick[high[j, pick] >= floor]
                needed.append(pick)
            if needed:
                rerank(np.unique(np.concatenate(needed)))
            for (number, least, most), pick in zip(windows[q], needed, strict=True):
                pick = pick[(scores[pick] >= floors.get((own, number), least)) & (scores[pick] <= most)]
                best = pick[np.lexsort((block.ids[pick], -scores[pick]))[:k]]
                if len(best) == k:
                    floors[own, number] = max(floors.get((own, number), least), int(scores[best[-1]]))
                out.append((np.full(len(best), own), np.full(len(best), number, np.int32), block.ids[best], scores[best]))
        if len(floors) > FLOORS:
            floors.clear()
    return out


def _blocks(shared, size: int, k: int):
    """Rows that arrive by (dim, label, block) as blocks of at most twice ``size``; with codebooks (``shared``), candidates are coded and of equal vectors only those that can be among the first ``k`` stay."""

    def close(key: tuple[int, int, int], rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids, ints = np.array([i for i, _ in rows], "<i8"), np.stack([x for _, x in rows])
        columns = {}
        if shared is not None:
            order = np.lexsort((ids, np.unique(ints, axis=0, return_inverse=True)[1].ravel())) if ints.shape[1] else np.argsort(ids, kind="stable")
            ids, ints = ids[order], ints[order]
            new = np.append(True, (ints[1:] != ints[:-1]).any(1))
            run = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            ids, ints = ids[run <= k], ints[run <= k]  # one more, since an anchor is no candidate of its own
            columns = dict(zip(("codes", "residuals"), shared.value.encode(ints), strict=True))
        wide = bool(np.abs(ints).max(initial=0) >= 1 << 15)
        columns = {"ids": ids, "ints": ints.astype("<i8" if wide else "<i2")} | columns
        head = [pa.array([x], t) for x, t in zip((*key, len(ids)), (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        body = {c: pa.array([x.tobytes()], pa.binary()) for c, x in columns.items()}
        return pa.RecordBatch.from_arrays([*head, body.pop("ids"), body.pop("ints"), pa.array([wide]), *body.values()], names=["dim", "label", "block", "n", "ids", "ints", "wide", *body])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "label", "block")), strict=True))
            flat, offsets = batch.column("ints").flatten().to_numpy(), np.append(0, np.cumsum(batch.column("ints").value_lengths().to_numpy()))
            for i, (key, vec_id) in enumerate(zip(keys, batch.column("vec_id").to_pylist(), strict=True)):
                if key != now or len(rows) >= 2 * size:
                    if rows:
                        yield close(now, rows)
                    now, rows = key, []
                rows.append((vec_id, flat[offsets[i] : offsets[i + 1]].copy()))
        if rows:
            yield close(now, rows)

    return run


def _matrix(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    n, dim = row[f"{prefix}n"], row["dim"]
    return np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(row[f"{prefix}ints"], "<i8" if row[f"{prefix}wide"] else "<i2").reshape(n, dim)


def _meet(shared, k: int):
    """Blocks of candidates meet blocks of anchors; an anchor's windows come with it, or it has one window of all scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, ints = _matrix(row)
                parts = -(-row["dim"] // PART) if row["dim"] in shared.value.of else 0
                block = Block(ids, ints, np.frombuffer(row["codes"], np.uint8).reshape(len(ids), parts), np.frombuffer(row["residuals"], np.float32).reshape(len(ids), parts))
                anchor_ids, anchors = _matrix(row, "a_")
                windows = [[(0, -(1 << 63), (1 << 63) - 1)] for _ in anchor_ids]
                if row["a_scores"] is not None:
                    scores, sizes = np.frombuffer(row["a_scores"], "<i8").tolist(), np.frombuffer(row["a_sizes"], "<i4").tolist()
                    windows, at = [], 0
                    for n in sizes:
                        windows.append([(i, -(-LEAST * s // 100), s) for i, s in enumerate(scores[at : at + n]) if s >= 0])  # of a score below zero LEAST percent are more than all
                        at += n
                found = compete(block, shared.value, anchor_ids, anchors, windows, k, floors)
                if found:
                    cols = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "positive", "vec_id", "score"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the positives' scores of each anchor of a block, from rows (dim, label, block, anchors as an array of structs)."""
    for batch in batches:
        for row in batch.to_pylist():
            own = sorted(row["rows"], key=lambda r: r["vec_id"])
            ints = np.array([r["ints"] for r in own], "<i8").reshape(len(own), row["dim"])
            scores = np.array([s for r in own for s in r["scores"]], "<i8")
            columns = {"ids": np.array([r["vec_id"] for r in own], "<i8"), "ints": ints, "scores": scores, "sizes": np.array([len(r["scores"]) for r in own], "<i4")}
            body = [pa.array([x.tobytes()], pa.binary()) for x in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), pa.array([row["label"]], pa.int64()), pa.array([row["block"]], pa.int32()), pa.array([len(own)], pa.int32()), *body[:2], pa.array([True]), *body[2:]], names=["dim", "label", "block", "n", "ids", "ints", "wide", "scores", "sizes"])


def numbered(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, ints) of the rows that take part: each component x as floor(256 * x)."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = usable(F.col("embedding")) | F.coalesce(F.forall("embedding", lambda x: F.coalesce(x == 0, F.lit(False))), F.lit(False))  # zero vectors take part here
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * 256).cast("long"))))
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", "label", F.size("embedding").alias("dim"), whole.alias("ints"))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the number of a block of about ``size`` rows of one dimension and label, however many they are."""
    counts = rows.groupBy("dim", "label").agg(F.count("*").alias("n"))
    n = F.ceil(F.col("n") / size)
    return rows.join(F.broadcast(counts), ["dim", "label"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "ints"), n).cast("int")).drop("n")


def _meeting(candidates: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of both sides with equal ``keys``, dealt to groups of a few blocks of either: a grid of tasks, none of which grows."""
    groups = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / MEETING).cast("int").alias(name))
    sides = F.broadcast(groups(candidates, "n_c").join(groups(anchors, "n_a"), keys))  # at most a row a dimension and label
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    place = lambda n, *by: F.pmod(F.xxhash64(*by), n).cast("int")
    left = candidates.join(sides, keys).withColumn("c", place(F.col("n_c"), "label", "block", "ids")).withColumn("a", every(F.col("n_a"))).drop("n_c", "n_a", "block")
    right = anchors.join(sides, keys).withColumn("a", place(F.col("n_a"), "label", "block", "ids")).withColumn("c", every(F.col("n_c"))).drop("n_c", "n_a", "block")
    right = right.select(*keys, "a", "c", *[F.col(c).alias(f"a_{c}") for c in right.columns if c not in {*keys, "a", "c"}])
    return left.join(right, [*keys, "a", "c"]).drop("a", "c")


def mine(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first ``POSITIVES`` rows of
    the same label, the first ``NEGATIVES`` rows of other labels with LEAST * positive_score <= 100 * score <= 100 * positive_score.

    Both tables have vec_id, label, embedding. Rows without an id, a label or a vector, or with a null or non-finite component take
    no part; zero and empty vectors do. Components are floor(256 * x) as whole numbers (within 2**62), scores whole numbers
    (cut to a long's range); higher ones come first, ties by smaller vec_id. Only vectors of one dimension meet. Rows of
    the anchor's own id are no candidates; of a repeated anchor id the smallest (label, vector) asks; repeated candidates are
    candidates of their own, as often as lists are long. Anchors without positives, and positives without negatives (such as
    those of scores below zero), have no rows; empty tables give an empty one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    _shared.bounded_batches(spark)
    rows, asked = numbered(vectors), numbered(anchors)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("label", "ints", "dim")).alias("x")).select("vec_id", "x.*")
    shared = spark.sparkContext.broadcast(fit(rows))
    dealt = lambda df, size: _dealt(df, size).repartition("dim", "label", "block").sortWithinPartitions("dim", "label", "block")
    most = max(POSITIVES, NEGATIVES)
    candidates = _shared.store(dealt(rows, CANDIDATES).mapInArrow(_blocks(shared, CANDIDATES, most), CODED), "coded")
    asking = _shared.store(dealt(asked, ANCHORS).mapInArrow(_blocks(None, ANCHORS, most), BLOCKS), "anchors")

    none = F.lit(None).cast("binary")
    own = _meeting(candidates, asking.withColumns({"scores": none, "sizes": none}), ["dim", "label"])
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = own.mapInArrow(_meet(shared, POSITIVES), FOUND).withColumn("positive", F.row_number().over(order) - 1).where(F.col("positive") < POSITIVES)
    positives = _shared.store(best, "positives")

    scores = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "score"))), lambda x: x["score"]).alias("scores"))
    grouped = _dealt(asked.join(scores, "vec_id"), ANCHORS).groupBy("dim", "label", "block").agg(F.collect_list(F.struct("vec_id", "ints", "scores")).alias("rows"))
    bounded = _shared.store(grouped.mapInArrow(_windows, BLOCKS + ", scores binary, sizes binary"), "windows")
    other = _meeting(candidates, bounded, ["dim"]).where("label <> a_label")
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "vec_id")
    negatives = other.mapInArrow(_meet(shared, NEGATIVES), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    pairs = positives.select("anchor_id", "positive", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.select("anchor_id", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["anchor_id", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_residual_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _shared.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(vectors, vectors.where("vec_id % 100 = 0"))


OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
