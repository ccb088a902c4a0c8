import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from marram.llm import packing, token_files, tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXTS = [None, "", " ", "a", "It's  a   test.", " lead\ttab\n\nnl \r\n x ", "We'll DON'T 'quoted' 12345 3.14 ½²", "Zażółć gęślą jaźń — naïve café…", "语言 モデル テスト", "<|endoftext|> and <|startoftext|>", "x" * 5000, "na\u0301ive \u00a0nbsp \u2003em ***stars*** a=\u0338b", "THE The the", "\x1c\x85 odd\x0b", "word " * 3000, "İstanbul ΣΑΣ ß", "a\ud7ff b", "ªº µm 5€ ×÷ \xad x"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_word_by_word_equals_the_library(name):
    plain, own, rng = Tokenizer.from_file(tokens.public_path(name)), tokens.TextEncoder(tokens.public_path(name)), random.Random(5)
    assert own.kind
    alphabet = list(" '.,-*aZé9\n\t \r½ªÿ×\xad€—") + ["the", " 's", "ing", "'LL", "'d", "  ", "日本", "<|endoftext|>", "\u0301"]
    more = ["".join(rng.choices(alphabet[: -3 * (k % 2) or None], k=rng.randrange(60))) for k in range(5000)]
    for text in [t or "" for t in TEXTS] + more:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 10)
    own = tokens.TextEncoder(tokens.public_path("byte_bpe_50k.json"))
    text = " ".join(f"w{i}" for i in range(200))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.words) + len(own.words.aside) <= 10


def test_plan_places_every_item_once():
    rng = random.Random(1)
    for capacity in (1, 7, 32, 100):
        for _ in range(60):
            histogram = {n: rng.choice([1, 2, 5, 1000]) for n in range(1, capacity + 1) if rng.random() < 0.4}
            bins, seen = defaultdict(list), defaultdict(list)
            for length, a, b, first, offset, per in packing.plan_best_fit(histogram, capacity):
                for k in range(a, b):
                    seen[length].append(k)
                    bins[first + (k - a) // per].append((offset + (k - a) % per * length, length))
            assert {n: sorted(k) == list(range(histogram[n])) for n, k in seen.items()} == dict.fromkeys(histogram, True)
            for items in bins.values():
                at = 0
                for offset, length in sorted(items):
                    assert offset == at
                    at += length
                assert at <= capacity
            assert len(bins) == simple_best_fit(histogram, capacity)


def simple_best_fit(histogram, capacity):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


def test_pack_edge_cases(spark):
    path = tokens.public_path("byte_bpe_50k.json")
    docs = table(spark, TEXTS + ["same text"] * 300).withColumn("length", F.lit("clash")).withColumn("_cell", F.lit(1))
    rows = packing.pack(docs, path, capacity=64).collect()
    plain, pieces, sequences = Tokenizer.from_file(path), defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, t in enumerate(TEXTS + ["same text"] * 300):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = [pieces[d][k] for k in range(len(pieces[d]))]
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and sum(p.length for p in own) == len(ids)
        assert all(p.length == 64 for p in own[1:]) and (len(own) == 1) == (len(ids) <= 64)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert packing.pack(table(spark, []), path).collect() == []


def test_ranking_in_cells(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 5)
    rows = packing.place(spark.range(1000).selectExpr("id AS doc_id", "0 AS piece", "IF(id < 400, 10L, 1 + id % 10) AS length"), 10).collect()
    assert len(rows) == 1000 and len({(r.sequence_id, r.offset) for r in rows}) == 1000


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    cases = [np.zeros(0, np.uint64), np.zeros(1000, np.uint64), np.array([2**64 - 1, 0, 2**60, 2**60 - 1, 2**53, 1], np.uint64), rng.integers(0, 49408, 150_000).astype(np.uint64), (rng.integers(0, 2**62, 5000) >> rng.integers(0, 62, 5000)).astype(np.uint64)]
    for ids in cases:
        lengths = np.array([len(ids) // 2, len(ids) - len(ids) // 2])
        image = token_files.encode(np.array([7, 9]), lengths, ids)
        doc_ids, got_lengths, got = token_files.decode(image)
        assert doc_ids.tolist() == [7, 9] and (got_lengths == lengths).all() and (got == ids).all()
    assert len(token_files.encode(np.array([1]), np.array([100_000]), np.arange(100_000) % 30_000)) < 2.2 * 100_000


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "IMAGE_IDS", 500)
    path = tokens.public_path("word_bpe_49k.json")
    texts = TEXTS + ["copy of a text"] * 50
    docs = table(spark, texts).withColumn("segment", F.lit("clash")).orderBy(F.rand(3))
    token_files.write(docs, str(tmp_path / "t"), path)
    rows = sorted(token_files.summarize(spark, str(tmp_path / "t")).collect())
    plain, start = Tokenizer.from_file(path), 0
    for row, text in zip(rows, texts, strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write(table(spark, []), str(tmp_path / "e"), path)
    assert token_files.summarize(spark, str(tmp_path / "e")).collect() == []
    again = docs.union(docs.where("doc_id = 3"))
    token_files.write(again, str(tmp_path / "r"), path)
    assert token_files.summarize(spark, str(tmp_path / "r")).count() == len(texts) + 1


def test_rows_without_id(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (None, "a a"), (None, None), (1, "c")], "doc_id long, text string")
    token_files.write(docs, str(tmp_path / "n"), tokens.public_path("word_bpe_49k.json"))
    rows = token_files.summarize(spark, str(tmp_path / "n")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2] and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    placed = packing.pack(docs, tokens.public_path("byte_bpe_50k.json")).collect()
    assert len(placed) == 4 and len({(r.sequence_id, r.offset) for r in placed}) == 4
