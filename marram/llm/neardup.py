"""Near duplicates by min-max hashing: both ends of every permutation are kept.

A document is the set of its word shingles. Each of ``PERMUTATIONS`` permutations gives two signature values,
the smallest and the largest, so hash evaluations are half of MinHash's for a signature as long. A band is
three permutations (six values); documents that share a band are candidates, and candidates are linked only
if their full sets are similar enough. With 48 bands a pair of similarity 0.8 is missed with a chance of
about 5e-7.

Documents with equal sets form one class, so copies never meet pair by pair. In a bucket of the bands one
member, the centre, is compared with the rest; a bucket whose members are then all in one component is
done. In any other, members outside the bucket's main component are compared with all, block by block: an odd sketch
(the parity of the shingles that fall on each bit) bounds from below how far two sets differ, and a pair is formed only
where the sketches and the shingles that both share with others allow a link. Documents that have too many shingles for
themselves drop out first; a big bucket is split by shingles that few of its members have. No bucket is capped, and no
link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, components

#: Words in a shingle and least similarity in percent, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80
PERMUTATIONS, BAND = 144, 3
#: Words whose hashes a worker keeps.
KEPT = 200_000
#: Ids that are broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Buckets of more members are split by their rare shingles; members of a block, about; bytes of a sketch.
BIG, BLOCK, SKETCH = 64, 256, 128


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Words are what ASCII white space leaves, A-Z lower-cased; a text of fewer words than ``size`` is one shingle,
    one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_shared.kept("shingle words", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    rolled = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mix(rolled))


@lru_cache(None)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(0, 2**31, (n, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, (n, 1)).astype(np.uint32)


def signature(hashes: np.ndarray, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest) value of a set under each permutation."""
    a, b = _permutations(permutations)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
    for i in range(0, len(x), 512):
        y = a * x[i : i + 512] + b
        np.minimum(low, y.min(1), out=low)
        np.maximum(high, y.max(1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key a band of ``band`` permutations, as signed numbers."""
    both = (low.astype(np.uint64) << np.uint64(32) | high).reshape(-1, band)
    key = np.arange(len(both), dtype=np.uint64)
    for k in range(band):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + both[:, k])
    return key.view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, sets, keys = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, size)
                n.append(len(own))
                sets.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                keys.append(bands(*signature(own)) if len(own) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sets, pa.binary()), lists], names=["doc_id", "n_shingles", "set_hash", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(map(sketch, sets), pa.binary())], names=["node", "hashes", "sketch"])

    return run


def sketch(hashes: np.ndarray) -> bytes:
    """The odd sketch of a set; two sketches never differ in more bits than their sets differ in members."""
    counts = np.bincount(hashes.view(np.uint64).astype(np.uint32) % (8 * SKETCH), minlength=8 * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


MEMBERS = "array<struct<node:bigint,root:bigint,n:bigint,common:bigint,sketch:binary>>"


def _able(percent: int):
    """Pairs (a < b) of two blocks of a bucket that may be linked: sketches and common shingles allow it, components differ."""

    def columns(members: pa.ListArray, row: int) -> tuple[np.ndarray, ...]:
        fields = members[row].values
        bits = np.frombuffer(b"".join(fields.field("sketch").to_pylist()), np.uint64).reshape(len(fields), -1)
        return *(fields.field(c).to_numpy() for c in ("node", "root", "n", "common")), bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for row in range(batch.num_rows):
                (node, root, n, common, bits), (node_b, root_b, n_b, common_b, bits_b) = (columns(batch.column(c), row) for c in (0, 1))
                apart = np.zeros((len(node), len(node_b)), np.int64)
                for k in range(bits.shape[1]):
                    apart += np.bitwise_count(bits[:, k, None] ^ bits_b[:, k])
                both, shared = n[:, None] + n_b, np.minimum(common[:, None], common_b)
                able = (root[:, None] != root_b) & ((100 + percent) * apart <= (100 - percent) * both) & (100 * shared >= percent * (both - shared))
                i, j = np.nonzero(able)
                found.append(np.stack([np.minimum(node[i], node_b[j]), np.maximum(node[i], node_b[j])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def _similar(n_both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * n_both >= percent * (n_a + n_b - n_both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a < b), those whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    found = _shared.skew_join(_shared.skew_join(pairs, b, "b", "a"), a, "a", "b")
    return found.where(_similar(both, F.size("of_a"), F.size("of_b"), percent)).select("a", "b")


def _possible(common_a: Column, common_b: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets may be similar enough, by how many of their shingles other sets have too: no more can be in both."""
    return _similar(F.least(common_a, common_b), n_a, n_b, percent)


def _hopeful(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (bucket, node, n, common) that may have a link: a set can be linked only if ``percent`` of it occurs in others.

    ``common`` counts a set's shingles that another candidate has too. That leaves out, exactly and without a pair
    being formed, all that only share a passage.
    """
    once = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = once.groupBy("node").agg(F.count("*").alias("own"))
    rows = buckets.join(own, "node", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return rows.where(100 * F.col("common") >= percent * F.col("n"))


def _rooted(rows: DataFrame, root: DataFrame | None) -> DataFrame:
    """``rows`` with the present component of their node as ``root``."""
    rows = rows.drop("root")
    if root is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _split(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Big buckets, whose centre has met all members, are split into buckets by single shingles that few members have.

    Call a shingle frequent if over ``BIG`` members of big buckets have it. For A and B to be similar enough they must
    have ceil(p (|A| + |B|) / (1 + p)) shingles in common, p being the least similarity, and no more of these are
    frequent than the smaller number of frequent ones in A and B. If that is too few they share a rare shingle, and so a
    bucket of at most ``BIG`` members. Members for which it can be enough stay in the old bucket; of the centre's
    component, only those for which it can be enough with a member outside.
    """
    columns = ("bucket", "node", "n", "common", "root")
    own = F.max(F.when(F.col("node") == F.col("centre"), F.col("root"))).alias("home")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most"), own).where("least <> most")
    rows = _shared.store(_shared.skew_join(rows, sizes.select("bucket", "members", "home"), "bucket", "node"), "members")
    big = rows.where(F.col("members") > BIG)
    facts = big.groupBy("node").agg(*[F.max(c).alias(c) for c in ("n", "common", "root")])
    held = _shared.store(sets.join(facts, "node").select("node", F.explode("hashes").alias("h")).distinct(), "held")
    frequent = held.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > BIG).select("h")
    rare = _shared.store(_shared.skew_join(held, frequent, "h", "node", "left_anti"), "rare")
    facts = facts.join(rare.groupBy("node").agg(F.count("*").alias("rare")), "node", "left").withColumn("frequent", F.col("n") - F.coalesce("rare", F.lit(0)))
    # Most shingles that a partner may have for the frequent ones to suffice.
    facts = _shared.store(facts.withColumn("most_n", F.floor((100 + percent) * F.col("frequent") / percent) - F.col("n")), "facts")
    old = _shared.store(big.join(facts.select("node", "most_n"), "node").withColumn("out", F.coalesce(F.col("root") != F.col("home"), F.lit(True))), "old-buckets")
    bounds = old.groupBy("bucket").agg(F.min("n").alias("least_n"), F.max("most_n").alias("of_all"), F.max(F.when(F.col("out"), F.col("most_n"))).alias("of_out"))
    stay = _shared.skew_join(old, bounds, "bucket", "node").where((F.col("most_n") >= F.col("least_n")) & (F.col("n") <= F.when(F.col("out"), F.col("of_all")).otherwise(F.col("of_out"))))
    new = _shared.store(rare.join(facts, "node").select(F.xxhash64("h", F.lit("rare")).alias("bucket"), "node", "n", "common", "root"), "new-buckets")
    shared = new.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    return rows.where(F.col("members") <= BIG).select(*columns).union(stay.select(*columns)).union(_shared.skew_join(new, shared, "bucket", "node").select(*columns))


def _across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of ``rows`` (bucket, node, n, common, root) in different components that may be linked.

    Members outside a bucket's most frequent component meet all members. Blocks of about ``BLOCK`` members meet, each
    pair of blocks in a row of its own, so that a hot bucket is spread over tasks.
    """
    counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket")
    counts = counts.agg(F.sum("c").alias("members"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("home")).where("members > most")
    rows = _shared.skew_join(rows, counts, "bucket", "node").join(sets.select("node", "sketch").distinct(), "node")
    rows = _shared.store(rows.select("bucket", "members", "most", "home", F.struct(*[F.col(c).cast("long").alias(c) for c in ("node", "root", "n", "common")], "sketch").alias("m")), "meeting")
    deal = lambda count: F.pmod(F.xxhash64("m.node"), F.ceil(count / BLOCK))
    every = rows.groupBy("bucket", deal(F.col("members")).alias("part")).agg(F.collect_list("m").alias("all"))
    outside = F.col("members") - F.col("most")
    out = rows.where("m.root <> home").groupBy("bucket", deal(outside).alias("own"), "members").agg(F.collect_list("m").alias("out"))
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / BLOCK) - 1)))
    met = out.join(every, ["bucket", "part"]).select(F.col("out").cast(MEMBERS), F.col("all").cast(MEMBERS))
    return met.mapInArrow(_able(percent), "a long, b long").distinct()


def _near(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents whose id is in ``nodes`` (node)."""
    small = nodes.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(nodes) if small else nodes, docs["doc_id"] == nodes["node"], "left_semi")


def classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) of all documents, rep being the smallest doc_id with an equal set (itself for an empty
    one); and (bucket, node, n), the bands of one document of each class. Both are stored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = _shared.store(texts.mapInArrow(_signatures(size), "doc_id long, n_shingles long, set_hash binary, bands array<long>"), "signatures")
    facts = signed.select("doc_id", "n_shingles", "set_hash")
    copied = facts.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    member = _shared.store(_shared.skew_join(facts, copied, "set_hash", "doc_id", "left").select("doc_id", "n_shingles", "set_hash", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    others = member.where("doc_id <> rep").select("doc_id", "set_hash").distinct()
    small = others.count() <= BROADCAST_IDS
    reps = signed.where("doc_id IS NOT NULL AND n_shingles > 0").join(F.broadcast(others) if small else others, ["doc_id", "set_hash"], "left_anti")
    keyed = _shared.store(reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")), "bands")
    _shared.drop(signed)
    return member.drop("set_hash"), keyed


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    Documents with ``percent`` of their united shingles in common are linked; component_id is the smallest doc_id
    reachable, kept marks that document. Null and empty texts have no shingles and are linked with nothing.
    Repeated rows of a document are rows with its component; a row without a doc_id has the component of an equal text,
    if any. Other columns are ignored.
    """
    _shared.bounded_batches(docs.sparkSession)
    member, keyed = classes(docs, size)
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("bucket")
    every = _shared.store(_shared.skew_join(keyed, shared, "bucket", "node").distinct(), "buckets")
    texts = _near(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), every.select("node").distinct())
    sets = _shared.store(texts.mapInArrow(_sets(size), "node long, hashes array<long>, sketch binary"), "shingle-sets")
    buckets = _shared.store(_hopeful(every, sets, percent), "hopeful")
    # The centre has the smallest share of shingles of its own: in a group of copies, it is the nearest to its origin.
    share, c = F.floor(20 * (F.col("n") - F.col("common")) / F.col("n")), F.struct("node", "n", "common")
    centre = F.min(F.struct(share.alias("share"), F.xxhash64("node").alias("h"), c.alias("c")))["c"].alias("c")
    chosen = buckets.groupBy("bucket").agg(centre, F.min("node").alias("least"), F.max("node").alias("most"), F.min("n").alias("least_n"), F.max("common").alias("most_common")).where("least <> most")
    able = _possible(F.col("common"), F.col("most_common"), F.col("n"), F.col("least_n"), percent)
    open_ = _shared.store(_shared.skew_join(buckets, chosen.drop("least", "most"), "bucket", "node").where(able).drop("least_n", "most_common"), "open")
    met = open_.where((F.col("node") != F.col("c.node")) & _possible(F.col("common"), F.col("c.common"), F.col("n"), F.col("c.n"), percent))
    pairs = _shared.store(met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct(), "pairs")
    links = _shared.store(_verified(pairs, sets, percent), "verified")
    root = None if links.isEmpty() else components.components(links)
    rows = _shared.store(_split(_rooted(open_.select("bucket", "node", "n", "common", F.col("c.node").alias("centre")), root), sets, percent), "split")
    more = _shared.store(_across(rows, sets, percent), "pairs")
    further = _shared.store(_verified(more, sets, percent), "verified")
    if not further.isEmpty():
        root = components.joined(root, further)
    _shared.drop(keyed, every, sets, buckets, open_, pairs, rows, more)
    if root is None:
        root = docs.sparkSession.createDataFrame([], "node long, root long")
    out = _shared.skew_join(member, root.withColumnRenamed("node", "rep"), "rep", "doc_id", "left")
    component = F.coalesce("root", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id, unchanged.

    Rows without a doc_id cannot be told apart and stay.
    """
    gone = _shared.store(link(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")), "near-duplicates")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op1_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(_shared.read(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


OP1_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
