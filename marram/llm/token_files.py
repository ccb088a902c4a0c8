"""Token-id files in Simple-8b: ids in 64-bit words, ascending doc_id, read back by vectorised decoding.

A file image (little-endian) holds: magic ``MS8B``, version, ids a block, then as 64-bit numbers the counts
of documents, ids, blocks, words and escapes; doc_ids; ids of each document; each block's first word; the
words; the escaped values. A word's top four bits select how many ids of how many bits it packs; selector 0
is an escape, whose payload numbers an entry of the escape table, for values of more than 60 bits. Every
block starts on a word of its own, so it can be decoded alone.

Images are rows of a Parquet table (segment, n_docs, n_ids, payload): only Spark's own writers reach every store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared, tokens

END_ID = 1
#: Stands for a null doc_id in a file.
NO_ID = -(1 << 63)
#: Ids in a block, and ids after which a file image is closed (documents stay whole).
BLOCK, IMAGE_IDS = 256, 1 << 18
#: (ids in a word, bits of each) by selector; selector 0 is the escape. Fixed by the Simple-8b layout.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([c for c, _ in SELECTORS])
_MAGIC = b"MS8B\x01\x00\x00\x00"

IMAGES = "segment long, n_docs long, n_ids long, payload binary"


def _pack_blocks(v: np.ndarray, escaped: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids ``v`` (uint64) and how many words each block of them takes."""
    blocks = -(-len(v) // BLOCK)
    span = BLOCK + max(c for c, _ in SELECTORS)
    width = np.zeros((blocks, span), np.uint8)  # past a block's end all fits
    bits = np.zeros(blocks * BLOCK, np.uint8)
    small = v < 1 << 53
    bits[: len(v)][small] = np.frexp(v[small].astype(float))[1]
    bits[: len(v)][~small] = [int(x).bit_length() for x in v[~small]]
    width[:, :BLOCK] = bits.reshape(blocks, BLOCK)
    # Widest of 1, 2, 4, ... ids from each place on; any count is two of these that overlap.
    widest, k = {1: width}, 1
    while 2 * k <= max(c for c, _ in SELECTORS):
        widest[2 * k] = width = np.maximum(width[:, :-k], width[:, k:])
        k *= 2
    best = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(SELECTORS) - 1, 0, -1):  # the selector that packs most ids is set last
        c, b = SELECTORS[s]
        k = 1 << (c.bit_length() - 1)
        best[np.maximum(widest[k][:, :BLOCK], widest[k][:, c - k : c - k + BLOCK]) <= b] = s
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(v) - (blocks - 1) * BLOCK
    at, rows, starts = np.zeros(blocks, int), np.arange(blocks), []
    while len(rows := rows[at[rows] < sizes[rows]]):  # all blocks take one word a round
        starts.append(rows * BLOCK + at[rows])
        at[rows] += _COUNTS[best[rows, at[rows]]]
    starts = np.sort(np.concatenate(starts))
    chosen = best.reshape(-1)[starts]
    padded = np.zeros(blocks * BLOCK + span, np.uint64)
    padded[: len(v)] = v
    ends = np.minimum((starts // BLOCK + 1) * BLOCK, len(v))
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        c, b = SELECTORS[s]
        own = np.flatnonzero(chosen == s)
        if s == 0:
            words[own] |= np.arange(len(escaped), len(escaped) + len(own), dtype=np.uint64)
            escaped.extend(padded[starts[own]].tolist())
        elif b:
            at = starts[own, None] + np.arange(c)
            values = np.where(at < ends[own, None], padded[at], np.uint64(0))
            words[own] |= np.bitwise_or.reduce(values << (np.arange(c, dtype=np.uint64) * np.uint64(b)), axis=1)
    return words, np.bincount(starts // BLOCK, minlength=blocks)


def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file image of documents whose ids follow one another in ``ids``."""
    ids, escaped, words, counts = ids.astype(np.uint64), [], [], []
    for i in range(0, len(ids), 512 * BLOCK):
        w, n = _pack_blocks(ids[i : i + 512 * BLOCK], escaped)
        words.append(w)
        counts.append(n)
    words = np.concatenate([*words, np.zeros(0, np.uint64)])
    counts = np.concatenate([*counts, np.zeros(0, int)])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
    head = np.array([len(doc_ids), len(ids), len(counts), len(words), len(escaped)], "<i8")
    parts = (head, np.asarray(doc_ids, "<i8"), np.asarray(lengths, "<i8"), first.astype("<i8"), words.astype("<u8"), np.array(escaped, "<u8"))
    return _MAGIC + BLOCK.to_bytes(8, "little") + b"".join(p.tobytes() for p in parts)


def decode(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids as uint64) of a file image."""
    if image[:8] != _MAGIC:
        raise ValueError("not a token-id file")
    block = int.from_bytes(image[8:16], "little")
    docs, n, blocks, n_words, n_escaped = np.frombuffer(image, "<i8", 5, 16).tolist()
    at, out = 56, []
    for kind, k in (("<i8", docs), ("<i8", docs), ("<i8", blocks), ("<u8", n_words), ("<u8", n_escaped)):
        out.append(np.frombuffer(image, kind, k, at))
        at += 8 * k
    doc_ids, lengths, first, words, escaped = out
    ids = np.zeros(n, np.uint64)
    selector = (words >> np.uint64(60)).astype(int)
    count = _COUNTS[selector]
    before = np.cumsum(count) - count
    of = np.repeat(np.arange(blocks), np.diff(np.append(first, n_words)))
    start = of * block + before - before[first][of] if n_words else before
    end = np.minimum((of + 1) * block, n)
    for s in np.unique(selector):
        c, b = SELECTORS[s]
        own = np.flatnonzero(selector == s)
        payload = words[own] & np.uint64((1 << 60) - 1)
        if s == 0:
            ids[start[own]] = escaped[payload.astype(int)]
        elif b:
            values = payload[:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(b)) & np.uint64((1 << b) - 1)
            to = start[own, None] + np.arange(c)
            inside = to < end[own, None]
            ids[to[inside]] = values[inside]
    return doc_ids, lengths, ids


def _images(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, end = tokens.encoder(path).encode, end_id.to_bytes(4, "little")
        segment, doc_ids, parts, n = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> pa.RecordBatch:
            image = encode(np.array(doc_ids), np.array([len(p) // 4 for p in parts]), np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pylist([{"segment": segment, "n_docs": len(doc_ids), "n_ids": n, "payload": image}], pa.schema([("segment", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                parts.append(encode_text(text or "") + end)
                n += len(parts[-1]) // 4
                if n >= IMAGE_IDS:
                    yield close()
                    segment, doc_ids, parts, n = segment + 1, [], [], 0
        if doc_ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the token ids of all documents as file images under ``path``, doc_ids ascending over the segments.

    A null text is empty: its document is the end id alone. Rows that repeat a doc_id lie together, ordered by
    their text's hash; rows without a doc_id come first.
    """
    _shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_images(vocabulary, end_id), IMAGES).write.parquet(path)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids, lengths, ids = decode(image.as_buffer().to_pybytes())
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            cols = [np.full(len(doc_ids), segment), doc_ids, ends - lengths, lengths, np.array(crcs, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["segment", "doc_id", "at", "n_tokens", "ids_crc32"])


def summarize(spark: SparkSession, path: str) -> DataFrame:
    """Read the files under ``path``: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = spark.read.schema(IMAGES).parquet(path)
    docs = files.select("segment", "payload").mapInArrow(_summaries, "segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    # Ids before a segment: of the parts before its own, then of the segments before it in its part.
    sizes = files.select("segment", "n_ids", F.shiftright("segment", 32).alias("part"))
    to_here = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(to_here), F.lit(0)).alias("before_part"))
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select("segment", (F.col("before_part") + F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).alias("before"))
    return docs.join(starts, "segment").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{_shared.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(_shared.read(spark, sf_dir, "documents"), path, tokens.public_path("word_bpe_49k.json"))
    return summarize(spark, path)
