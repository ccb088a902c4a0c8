"""Benchmark decontamination by suffix arrays over the training text.

Training texts are gathered in shards of about ``SHARD_WORDS`` words. A shard holds its words as numbers and its
suffix array: every position, sorted by all the words that follow it in its document. Shards are stored once. Test
items come in passes of bounded size; in each, every test suffix is binary-searched in every shard (all suffixes in
step), which yields each verbatim occurrence and its place, and each occurrence is followed to its end: the longest
matches. Items of equal words are one, and equal windows are searched once. Results belong to a text's digest, so copies of a text need no search of their own in a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import _shared

WINDOW = 10
#: Words of test items that are searched in one pass and sent to the executors; more items take more passes.
PASS_WORDS = 2_000_000
#: Places of items that meet places of texts at once.
AT_ONCE = 1 << 20
#: Words of a shard, about; a longer text is cut into pieces that overlap by a window.
SHARD_WORDS = 1 << 20
#: Rows of found matches, and ids of affected texts, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 1_000_000

#: Word characters are ASCII letters and digits and all of code points over 127; the rest parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SHARDS = "starts binary, firsts binary, digests binary, vocabulary binary, ids binary, suffixes binary"
RUNS = "h1 long, h2 long, names array<string>, line long, shift long, begin long, end long"


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@F.arrow_udf(LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())


def digest(text: Column) -> tuple[Column, Column]:
    """Two hashes with seeds of their own."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """All positions of ``ids`` (not negative), in the order of the suffixes that begin there.

    Prefix doubling: suffixes are sorted by their first three words; groups of equals are sorted on by the ranks of
    what follows, twice as many words known each time, until none are left.
    """
    n = len(ids)
    padded = np.append(ids.astype(np.int64) + 1, [0, 0])
    key = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2:]
    order = np.argsort(key, kind="stable")
    rank, open_, known = np.full(n + 1, -1, np.int64), np.arange(n), 3
    key = key[order]
    while len(open_):
        heads = np.append(True, key[1:] != key[:-1])
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(heads, np.arange(len(open_)), 0))]
        open_ = open_[~(heads & np.append(heads[1:], True))]
        at = order[open_]
        key = rank[at] * (n + 2) + rank[np.minimum(at + known, n)] + 1
        again = np.argsort(key, kind="stable")
        order[open_], key, known = at[again], key[again], 2 * known
    return order


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers under 2**24, all low bytes first: that compresses well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    out = np.zeros((len(planes) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(planes, np.uint8).reshape(3, -1).T
    return out.view("<u4").ravel().astype(np.int32)


class _Shard:
    """Texts of a shard under way: words are numbered as they come, every piece of a text ends with a number of its own."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []
        self.of: list[tuple[int, int, int]] = []  # digest, and the place of a piece's first word in its text
        self.seen: set[tuple[int, int]] = set()
        self.words = 0

    def row(self) -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(p) + 1 for p in self.pieces)])
        ids = np.zeros(starts[-1], np.int64)
        for k, (a, p) in enumerate(zip(starts.tolist(), self.pieces, strict=False)):
            ids[a : a + len(p)], ids[a + len(p)] = p + len(self.pieces), k
        of = np.array(self.of, "<i8").reshape(-1, 3)
        columns = [starts[:-1].astype("<i8").tobytes(), of[:, 2].tobytes(), of[:, :2].tobytes(), b" ".join(self.vocabulary), _planes(ids), _planes(suffix_array(ids))]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=[c.split()[0] for c in SHARDS.split(", ")])


def _shards(window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for h1, h2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (h1, h2) in shard.seen:
                    continue
                shard.seen.add((h1, h2))
                words = words_of(text.as_py())
                for first in range(0, max(1, len(words) - window + 1) if words else 0, size):
                    piece = words[first : first + size + window - 1]
                    if shard.words and shard.words + len(piece) > size:
                        yield shard.row()
                        shard = _Shard()
                        shard.seen.add((h1, h2))
                    number = shard.vocabulary.setdefault
                    shard.pieces.append(np.fromiter((number(w, len(shard.vocabulary)) for w in piece), np.int64, len(piece)))
                    shard.of.append((h1, h2, first))
                    shard.words += len(piece) + 1
        if shard.words:
            yield shard.row()

    return run


class Suffixes:
    """Test suffixes that begin a window, ready to be searched: distinct word numbers and window lengths, and where in which items each occurs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, lines_before: int = 0):
        self.window, self.vocabulary, self.lines_before = window, {}, lines_before
        equal: dict[tuple[int, ...], list[str]] = {}
        for name, words in items:
            equal.setdefault(tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), []).append(name)
        self.names = [sorted(set(names)) for names in equal.values()]
        starts, lengths, of, at, ids = [], [], [], [], []
        for line, own in enumerate(equal):
            for k in range(max(1, len(own) - window + 1) if own else 0):
                starts.append(len(ids) + k)
                lengths.append(min(window, len(own)))
                of.append(line)
                at.append(k)
            ids += [*own, 0]
        ids = np.array(ids + [0] * window, np.int32)
        lengths = np.array(lengths, np.int32)
        rows = ids[np.array(starts, int)[:, None] + np.arange(window)] if starts else np.zeros((0, window), np.int32)
        rows = np.where(np.arange(window) < lengths[:, None], rows, 0)  # a short window's zeros set it apart
        self.rows, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        order = np.argsort(which.ravel(), kind="stable")
        self.first = np.searchsorted(which.ravel()[order], np.arange(len(self.rows) + 1))
        self.of, self.at = np.array(of, np.int64)[order], np.array(at, np.int64)[order]
        self.lengths = (self.rows > 0).sum(1).astype(np.int64)
        self.inside = np.arange(window) < self.lengths[:, None]

    def _bound(self, ids: np.ndarray, suffixes: np.ndarray, rows: np.ndarray, inside: np.ndarray, upper: bool) -> np.ndarray:
        """For every test suffix, the first place in the suffix array whose words do not come before it (upper: come after it)."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(suffixes), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            follow = ids[suffixes[mid][:, None] + np.arange(self.window)]
            differ = (follow != rows[open_]) & inside[open_]
            first, k = differ.argmax(1), np.arange(len(open_))
            before = np.where(differ[k, first], follow[k, first] < rows[open_, first], upper)
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        return lo

    def search(self, vocabulary: list[bytes], ids: np.ndarray, suffixes: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences in a shard: positions, and which distinct window begins there. At a place there is one of each length at most."""
        number = np.full(len(self.vocabulary) + 1, -1, np.int32)
        known = np.fromiter((self.vocabulary.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
        number[known[known > 0]] = np.flatnonzero(known > 0) + pieces
        rows = number[self.rows]
        asked = np.flatnonzero(((rows >= 0) | ~self.inside).all(1))  # a word that the shard lacks cannot match
        rows, inside = rows[asked], self.inside[asked]
        padded = np.append(ids, np.full(self.window, -1, np.int32))
        lo, hi = (self._bound(padded, suffixes, rows, inside, upper) for upper in (False, True))
        n = hi - lo
        suffix = np.repeat(asked, n)
        return suffixes[np.arange(len(suffix)) + np.repeat(lo - (np.cumsum(n) - n), n)].astype(np.int64), suffix


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: Suffixes = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                starts, firsts, digests, vocabulary, ids, suffixes = (c[r].as_py() for c in batch.columns)
                starts, firsts, digests = np.frombuffer(starts, "<i8"), np.frombuffer(firsts, "<i8"), np.frombuffer(digests, "<i8").reshape(-1, 2)
                position, suffix = test.search(vocabulary.split(b" "), _numbers(ids), _numbers(suffixes), len(starts))
                order = np.argsort(position, kind="stable")
                position, suffix = position[order], suffix[order]
                n = np.diff(test.first)[suffix]
                for chunk in np.split(np.arange(len(position)), np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE)) + 1):
                    # Every place of the window in items; a match that goes over chunks is put together later.
                    own = n[chunk]
                    place = np.arange(own.sum()) + np.repeat(test.first[suffix[chunk]] - (np.cumsum(own) - own), own)
                    at, length = np.repeat(position[chunk], own), np.repeat(test.lengths[suffix[chunk]], own)
                    piece = np.searchsorted(starts, at, "right") - 1
                    begin = at - starts[piece] + firsts[piece]
                    line, shift = test.of[place], begin - test.at[place]
                    # Windows at consecutive places of a text and an item are one match.
                    order = np.lexsort((begin, shift, line, piece))
                    piece, begin, line, shift, length = piece[order], begin[order], line[order], shift[order], length[order]
                    head = np.append(True, (np.diff(piece) != 0) | (np.diff(line) != 0) | (np.diff(shift) != 0) | (np.diff(begin) != 1))[: len(begin)]
                    tail = np.append(head[1:], True)[: len(begin)]
                    names = pa.array([test.names[i] for i in line[head]], pa.list_(pa.string()))
                    columns = [*map(pa.array, digests[piece[head]].T), names, *map(pa.array, (line[head] + test.lines_before, shift[head], begin[head], (begin + length)[tail]))]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUNS.split(", ")])

    return run


def _passes(benchmark: DataFrame, window: int) -> Iterator[Suffixes]:
    """Test items in passes of bounded size; none are ever all on the driver if they are many."""
    items, n, lines = [], 0, 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).distinct().toLocalIterator():
        words = words_of(row[1])
        items.append((row[0], words))
        n += len(words)
        if n >= PASS_WORDS:
            yield Suffixes(items, window, lines)
            lines += len(items)
            items, n = [], 0
    yield Suffixes(items, window, lines)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The texts of ``docs`` in which an item occurs, by digest (h1, h2): a struct ``found`` of the union of hit spans (hit_from, hit_to),
    n_hit, distinct items by name, and the longest match (of equals, the first in the text, then the smallest item).
    """
    spark = docs.sparkSession
    _shared.bounded_batches(spark)
    text = F.col("text").cast("string")
    h1, h2 = digest(text)
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")).where("text IS NOT NULL")
    shards, runs = _shared.store(texts.mapInArrow(_shards(window, SHARD_WORDS), SHARDS), "suffix-arrays", "zstd"), None
    for test in _passes(benchmark, window):
        found = _shared.store(shards.mapInArrow(_search(spark.sparkContext.broadcast(test)), RUNS), "runs")
        runs = found if runs is None else runs.unionByName(found)
    _shared.drop(shards)
    # A match that goes over the pieces of a very long text is put together again.
    by = Window.partitionBy("h1", "h2", "line", "shift").orderBy("begin")
    opens = F.when(F.col("begin") <= F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    pieces = runs.distinct().withColumn("opens", opens).withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("h1", "h2", "names", "line", "shift", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).withColumn("item", F.col("names")[0])
    longest = F.min(F.struct((F.col("begin") - F.col("end")).alias("n"), F.col("begin"), F.col("item"), (F.col("begin") - F.col("shift")).alias("item_from")))
    spans = F.array_sort(F.collect_set(F.struct(F.col("begin").alias("a"), F.col("end").alias("b"))))
    texts = whole.groupBy("h1", "h2").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("items"), longest.alias("longest"))
    return texts.select("h1", "h2", F.struct(F.col("spans.a").alias("hit_from"), F.col("spans.b").alias("hit_to"), _covered(F.col("spans")).alias("n_hit"), "items", (-F.col("longest.n")).alias("longest_words"), F.col("longest.begin").alias("longest_from"), F.col("longest.item").alias("longest_item"), F.col("longest.item_from").alias("longest_item_from")).alias("found"))


def _covered(spans: Column) -> Column:
    """Places in the union of spans (a, b), which are sorted."""

    def add(acc: Column, span: Column) -> Column:
        begin = F.greatest(span["a"], acc["end"])
        return F.struct((acc["n"] + F.greatest(span["b"] - begin, F.lit(0))).alias("n"), F.greatest(acc["end"], span["b"]).alias("end"))

    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), add)["n"]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and a struct ``_found``: n_words, n_hit, hit spans (hit_from, hit_to), items, and the longest match.

    Null and empty texts have no words and no hits; an item of fewer words than ``window`` counts whole; an
    item without words never occurs, one without an item_id is named by the empty string. Several benchmark rows of one
    item_id are one item that occurs where any of them does. Repeated rows of ``docs`` are judged alike. A column of
    ``docs`` named ``_found`` is replaced; all others are kept, whatever their names.
    """
    docs = docs.drop("_found")
    text = F.col("text").cast("string")
    found = _shared.store(matches(docs, benchmark, window), "matches")
    small = found.count() <= BROADCAST_ROWS and (found.agg(F.sum(F.size("found.hit_from"))).first()[0] or 0) <= 10 * BROADCAST_ROWS
    a, b, at = _shared.free(docs, "_h1", "_h2", "_match")
    found = found.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("found").alias(at))
    h1, h2 = digest(text)
    out = docs.withColumns({a: h1, b: h2}).join(F.broadcast(found) if small else found, [a, b], "left")
    match, none = F.col(at), F.lit(0).cast("long")
    empty = lambda c, kind: F.coalesce(match[c], F.array().cast(f"array<{kind}>")).alias(c)
    whole = F.struct(
        _n_words(text).alias("n_words"), F.coalesce(match["n_hit"], none).alias("n_hit"), empty("hit_from", "bigint"), empty("hit_to", "bigint"), empty("items", "string"),
        F.coalesce(match["longest_words"], none).alias("longest_words"), *[match[c].alias(c) for c in ("longest_from", "longest_item", "longest_item_from")],
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], whole.alias("_found"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no test item occurs, unchanged, with all their columns; null and empty texts stay."""
    gone = _shared.store(matches(docs, benchmark, window).select("h1", "h2"), "contaminated")
    small = gone.count() <= BROADCAST_IDS
    h1, h2 = digest(F.col("text").cast("string"))
    a, b = _shared.free(docs, "_h1", "_h2")
    gone = gone.select(F.col("h1").alias(a), F.col("h2").alias(b))
    kept = docs.withColumns({a: h1, b: h2}).join(F.broadcast(gone) if small else gone, [a, b], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, _shared.read(spark, sf_dir, "benchmark"))
    items = F.col("_found.items")
    return found.select("doc_id", "_found.n_words", "_found.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("_found.n_hit") > 0).alias("contaminated"))


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
o AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
