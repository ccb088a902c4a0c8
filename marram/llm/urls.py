"""URL filters: prefix rules, and exact block lists in a cascade of Bloom filters.

Level 1 of a cascade encodes the listed keys. Over the corpus's complete universe of keys, those not listed
that pass it are encoded in level 2, those listed that pass level 2 in level 3, and so on until none is left:
the level at which a key first fails tells exactly whether it is listed. Pages are then judged by the filters
alone, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: (verdict, host, path prefix): the longest that fits decides.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Domains that are blocked with all their subdomains where no rule fits.
BLOCKED_DOMAINS = [f"{name}.example.{tld}" for name in ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets") for tld in ("com", "net", "org")]

#: Bits of a cascade's levels that are sent to the executors, about (16 MB). A longer list is split into several cascades by the hash of the
#: key; so many of them are asked in one pass over the pages.
MOST_BITS, A_PASS = 1 << 27, 8
#: Each level halves what is left, so these serve 2**64 keys. Beyond is only a pair of keys that share 128 bits of hashes: an error, not a wrong answer.
MOST_LEVELS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    """Bit positions of keys in a level, a row each; every level hashes anew."""
    a, b = _mix(h1 + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), _mix(h2 + np.uint64(level))
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * (b[:, None] | np.uint64(1))) % np.uint64(bits)


class Cascade:
    """Levels of (hashes, bits, words); ``listed(h1, h2)`` is exact for keys of the universe it was built over."""

    def __init__(self):
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        hashes, bits, words = self.levels[level]
        at = _positions(h1, h2, level, hashes, bits)
        return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(1)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(h1), len(self.levels) % 2 == 1), np.arange(len(h1))
        for level in range(len(self.levels)):
            ok = self.passes(level, h1[open_], h2[open_])
            out[open_[~ok]] = level % 2 == 1  # fails an odd level: in the set of the level before
            open_ = open_[ok]
        return out


def hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes with seeds of their own."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _u64(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _level_positions(level: int, hashes_: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(_u64(batch.column(0)), _u64(batch.column(1)), level, hashes_, bits).ravel()
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    return run


def _passing(shared, level: int):
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h1, h2 in batches:
            yield pa.array(shared.value.passes(level, _u64(h1), _u64(h2)))

    return F.arrow_udf(run, "boolean").asNondeterministic()


def flagged(universe: DataFrame, listed: DataFrame) -> DataFrame:
    """(h1, h2, listed) of the distinct keys of ``universe`` (key). Only these take up room, however long the list is."""
    keys = universe.select(F.col("key")).where(F.col("key").isNotNull()).distinct()
    marked = keys.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    return marked.select(*[h.alias(n) for h, n in zip(hashes(F.col("key")), ("h1", "h2"), strict=True)], F.coalesce("listed", F.lit(False)).alias("listed"))


def _first_level(n: int, others: int) -> int:
    """Hashes of level 1, which lets about as many others pass as there are listed keys over sqrt 2; later levels half."""
    return max(1, round(-math.log2(min(0.5, max(1e-6, n * math.sqrt(0.5) / max(1, others))))))


def build(sets: DataFrame) -> Cascade:
    """The cascade of the listed keys of ``sets`` (h1, h2, listed), exact for all of its keys."""
    spark, cascade = sets.sparkSession, Cascade()
    inside, outside = sets.where("listed"), sets.where("NOT listed")
    n, others = inside.count(), outside.count()
    for level in range(MOST_LEVELS):
        if not n:
            return cascade
        k = _first_level(n, others) if not level else 1
        bits = max(64, math.ceil(n * k / math.log(2)))
        masks = inside.select("h1", "h2").mapInArrow(_level_positions(level, k, bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
        words = np.zeros(bits // 64 + 1, np.uint64)
        got = masks.toArrow()  # a row a word of this level
        words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
        cascade.levels.append((k, bits, words))
        passing = _passing(spark.sparkContext.broadcast(cascade), level)
        false = _shared.store(outside.where(passing("h1", "h2")), "false-positives")
        inside, outside, others, n = false, inside, n, false.count()
    raise RuntimeError("two keys share both hashes")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, on, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(prefix)
        rule, verdict = F.when(fits, on + prefix).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _any_listed(shared):
    """Whether any key of a row (its hashes, and the cascade that each is dealt to) is listed, by the cascades (number, cascade) at hand."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h1, h2, deal in batches:
            lengths = np.diff(h1.offsets.to_numpy())
            row, at = np.repeat(np.arange(len(lengths)), lengths), deal.flatten().to_numpy(zero_copy_only=False)
            h1, h2, out = _u64(h1.flatten()), _u64(h2.flatten()), np.zeros(len(lengths), bool)
            for k, cascade in shared.value:
                own = np.flatnonzero(at == k)
                out[row[own[cascade.listed(h1[own], h2[own])]]] = True
            yield pa.array(out)

    return F.arrow_udf(run, "boolean").asNondeterministic()


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """All columns of ``pages`` (page_id, url, ...) and host, path, rule, verdict.

    The longest rule that fits decides; without one, a page is blocked if its host or a parent domain is in
    ``listed`` (key), else allowed. Null URLs and those without ``://`` have an empty host and path and are
    allowed. Repeated rows are judged alike. Columns named like those four are replaced; all others are kept.
    """
    spark = pages.sparkSession
    _shared.bounded_batches(spark)
    host, path = parts(F.col("url").cast("string"))
    found = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    hosts = found.select("host").distinct()
    sets = _shared.store(flagged(hosts.select(F.explode(domains(F.col("host"))).alias("key")), listed), "universe")
    n, others = sets.where("listed").count(), sets.where("NOT listed").count()
    # All levels after the first have some three bits a listed key together.
    cascades = max(1, math.ceil(n * (_first_level(n, others) + 3) / math.log(2) / MOST_BITS))
    (blocked,) = _shared.free(found, "_blocked")
    found = found.withColumn(blocked, F.lit(False))
    dealt = lambda h: F.pmod(F.xxhash64(h), F.lit(cascades)).cast("int")
    keys = domains(F.col("host"))
    h1, h2 = F.transform(keys, lambda k: hashes(k)[0]), F.transform(keys, lambda k: hashes(k)[1])
    if cascades > 1:
        sets = _shared.store(sets.withColumn("deal", dealt("h1")), "dealt-keys")
    earlier = None
    for first in range(0, cascades, A_PASS):
        some = range(first, min(first + A_PASS, cascades))
        built = [(k, build(sets.where(F.col("deal") == k).drop("deal") if cascades > 1 else sets)) for k in some]
        found = found.withColumn(blocked, F.col(blocked) | _any_listed(spark.sparkContext.broadcast(built))(h1, h2, F.transform(h1, dealt)))
        if cascades > A_PASS:  # only one pass's cascades are on the executors at a time
            found = _shared.store(found, "judged")
            if earlier is not None:
                _shared.drop(earlier)
            earlier = found
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col(blocked), "block").otherwise("allow"))
    return found.withColumns({"rule": rule, "verdict": verdict}).drop(blocked)


def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in BLOCKED_DOMAINS], "key string")
    pages = _shared.read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_CASES = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in enumerate(_LONGEST_FIRST))

OP2_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT page_id, host, path, CASE{_CASES.format(*[h + p for _, h, p in _LONGEST_FIRST])} END AS rule, CASE{_CASES.format(*[v for v, _, _ in _LONGEST_FIRST])} END AS said,
  {" OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in BLOCKED_DOMAINS)} AS listed FROM p)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
