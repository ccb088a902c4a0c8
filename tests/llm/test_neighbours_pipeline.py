import random
import re
import zlib

import corpus_pipeline
import numpy as np
from marram.llm import ann, langid, secret_scan, tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((900, 48)).astype(np.float32)
    vectors[100:160] = vectors[100]  # ties
    rows = [(i, v.tolist(), "c") for i, v in enumerate(vectors)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 48), (2003, [float("nan")] * 48), (2004, [float("inf")] + [1.0] * 47), (2005, [None] + [1.0] * 47), (2006, [1.0, 2.0]), (2008, [3.0, 1.0]), (2020, [1.0])]
    df = spark.createDataFrame(rows + [(i, v, "c") for i, v in odd], "vec_id long, embedding array<float>, block string")
    monkeypatch.setattr(ann, "CANDIDATES", 200)
    monkeypatch.setattr(ann, "QUERIES", 7)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0 OR vec_id = 2006")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert {q for q in got if q < 1000} == set(range(0, 900, 20)) and got[2006] == {1: (2008, 5.0)} and 2000 not in got and 2020 not in got
    found = 0
    for q in range(0, 900, 20):
        scores = (vectors.astype(float) * vectors[q].astype(float)).sum(1)
        order = np.lexsort((np.arange(900), -scores))
        best = [i for i in order.tolist() if i != q][:20]
        mine = [got[q][k] for k in range(1, 21)]
        assert all(abs(s - scores[i]) < 1e-9 for i, s in mine)
        found += len({i for i, _ in mine} & set(best))
    assert found / (45 * 20) > 0.98
    assert [i for i, _ in (got[100][k] for k in range(1, 21))] == list(range(101, 121))


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = [(r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert rows == [(1, 1, 1.0), (2, 1, 1.0), (3, 2, -1.0)]
    assert ann.search(df.limit(0), df).collect() == [] and ann.search(df, df.limit(0)).collect() == []


def test_estimates_from_population_counts_stay_near_the_bits_own():
    rng = np.random.default_rng(1)
    for dim in (64, 100):
        v, q = rng.standard_normal((4000, dim)), rng.standard_normal((3, dim))
        codes, scalars = ann.encode(v)
        signs = np.unpackbits(codes.view(np.uint8), axis=1) * 2.0 - 1
        plain = (q @ ann.rotation(dim)) @ signs.T * scalars[0]
        counted = ann.Asking.of(q).estimates(codes, scalars, slice(0, 3))
        asking, unit = ann.Asking.of(q), np.linalg.norm(q, axis=1)[:, None] * scalars[1]
        rounding = asking.step[:, None] * scalars[2] * scalars[0]  # half a step for each bit set, twice
        assert (np.abs(counted - plain) <= rounding * (1 + 1e-3) + 1e-3).all()
        assert (np.abs(counted - q @ v.T) / unit < 3).mean() > 0.99


def test_clustered_vectors_visit_few_centres_and_copies_do_not_multiply(spark, monkeypatch):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((40, 32)) * 3
    vectors = (middles[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 32)) / 4).astype(np.float32)
    vectors[500:1500] = vectors[500]  # a third are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(ann, "ROWS_A_CENTRE", 100)
    monkeypatch.setattr(ann, "CANDIDATES", 150)
    monkeypatch.setattr(ann, "QUERIES", 20)
    centres, visits = ann.fit(df, 20).of[32]
    assert len(centres) == 30 and visits <= 12
    got = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    found = 0
    for q in range(0, 3000, 100):
        scores = vectors.astype(float) @ vectors[q].astype(float)
        best = [i for i in np.lexsort((np.arange(3000), -scores)).tolist() if i != q][:20]
        found += len({i for i, _ in got[q].values()} & set(best))
        if 500 <= q < 1500:
            assert [got[q][k][0] for k in range(1, 21)] == best
    assert found / (30 * 20) > 0.95


def test_centres_in_two_levels_grow_with_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(ann, "ROWS_A_CENTRE", 40)
    monkeypatch.setattr(ann, "CENTRES", 6)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 500)
    monkeypatch.setattr(ann, "CANDIDATES", 100)
    monkeypatch.setattr(ann, "QUERIES", 20)
    met = {}
    for n in (2000, 4000):
        middles = rng.standard_normal((n // 40, 32)) * 3
        vectors = (middles[rng.integers(0, n // 40, n)] + rng.standard_normal((n, 32)) / 4).astype(np.float32)
        vectors[: n // 3] = vectors[0] + rng.standard_normal((n // 3, 32)).astype(np.float32) / 9  # a centre with a third of the rows
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
        centres = ann.fit(df, 20)
        (own, visits), (tops, starts) = centres.of[32], centres.above[32]
        assert len(tops) == 6 and len(own) == starts[-1] and n / 40 * 0.6 < len(own) < n / 40 * 1.2
        assert (centres.split(vectors, False)[:, 0] < len(own)).all() and centres.split(vectors[:3], True).shape == (3, visits)
        met[n] = visits / len(own)
        got, found = {}, 0
        for r in ann.search(df, df.where("vec_id % 100 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        for q in range(0, n, 100):
            scores = vectors.astype(float) @ vectors[q].astype(float)
            found += len(got[q] & set([i for i in np.lexsort((np.arange(n), -scores)).tolist() if i != q][:20]))
        assert found / (n / 100 * 20) > 0.9
    assert met[4000] < 0.5


def test_every_query_gets_k_rows(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((500, 64)).astype(np.float32)
    codes, scalars = ann.encode(vectors)
    for bound in (ann.BOUND, 0.0, -3.0):
        monkeypatch.setattr(ann, "BOUND", bound)
        found = ann.nearest(np.arange(500), vectors, codes, scalars, np.zeros(64), np.arange(0, 500, 5), vectors[::5], 20, {})
        assert [len(ids) for _, ids, _ in found] == [20] * 100 and all(q[0] not in ids for q, ids, _ in found)


def test_whole_numbers_are_read_as_doubles(spark):
    df = spark.createDataFrame([(0, [2**40 + 1, 1]), (20, [1, 0]), (3, [2**40, 9])], "vec_id long, embedding array<long>")
    rows = [(r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 20")).orderBy("rank").collect()]
    assert rows == [(0, float(2**40 + 1)), (3, float(2**40))]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    syllables = ["ka", "to", "ri", "mu", "ne", "so"]

    def prose(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))

    item = prose(14)
    rows = [(i, prose(60)) for i in range(60)]
    rows += [(100, rows[5][1]), (101, rows[6][1] + " extra"), (102, f"{prose(20)} {item} {prose(20)}"), (103, "9 9 9 !"), (104, None), (105, f"{prose(40)} password=abcdefgh12345")]
    table = [(i, t, "aa" if t else None, "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    state, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path)).cache()
        assert state.dtypes == docs.dtypes
        left.append({r.doc_id for r in state.collect()})
    every = {i for i, _ in rows}
    assert left == [every - {103, 104}, every - {103, 104, 100, 101}, every - {103, 104, 100, 101, 102}, every - {103, 104, 100, 101, 102}]
    assert "[SECRET]" in state.where("doc_id = 105").first().text
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == left[-1] and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_stages_on_empty_tables_and_further_columns(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _language string, _spans int, _found int, _h1 int, _gone int"
    prose = ["kato rimu neka toka mune rika", "tori kamu nerito kaka mumu toto", "rineka tomu kato ririka munemu"]
    rows = [(i, f"{prose[i % 3]} {prose[i % 2]} {i} {'to' * (i % 4)}", "aa", "s", 1, "x", 2, 3, 4, 5) for i in range(12)] + [(None, None, None, None, None, None, None, None, None, None)] * 2
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (rows, []):
        state = spark.createDataFrame(table, kinds)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, str(tmp_path))
            assert state.columns == spark.createDataFrame([], kinds).columns
        assert {(r._language, r._spans, r._found, r._h1, r._gone) for r in state.collect()} == ({("x", 2, 3, 4, 5)} if table else set())
        assert (corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path)).count() > 0) == bool(table)


def brute_near_duplicates(texts):
    """Smallest id of each group, all pairs of five-word sets compared."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}


def brute_clean(texts, items):
    """Documents without a window of ten words of an item."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    lengths = {len(w) for w in windows}
    return {d for d, t in texts.items() if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in lengths for i in range(len(w) - n + 1))}


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - length)
    return len(rooms)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before kept: copies, near copies in chains, passages of test items, secrets, junk and nulls."""
    rng = random.Random(21)
    syllables = ["ka", "to", "ri", "mu", "ne", "so", "la", "vi"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items, texts = [prose(14), prose(11), prose(6), None, ""], [prose(rng.choice([30, 60, 90])) for _ in range(120)]
    for k in range(70):  # chains of copies that move away from their origin word by word
        words = texts[rng.randrange(len(texts))].split(" ")
        for _ in range(rng.choice([0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words).upper() if k % 9 == 0 else " ".join(words))
    for k in range(20):
        own = items[k % 3].split(" ")
        a = rng.randrange(max(1, len(own) - 9))
        texts.append(f"{prose(20)} {' '.join(own[a : a + rng.choice([5, 9, 10, 14])])} {prose(20)}")
    texts += [f"{prose(30)} api_key={''.join(rng.choices('abcXYZ019', k=16))} {prose(10)}" for _ in range(5)] + [prose(4000), prose(3), "7 7 7", "!", "", None, None]
    order = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, "aa" if t else None, "s", len(t or "")) for i, t in zip(order, texts, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = lambda df: {r.doc_id: r.text for r in df.collect()}
    states, state = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path)).cache()
        states.append(kept(state))
    first, second, third, fourth = states
    models = langid.fit(docs.select("doc_id", "text", "lang"))
    scorer, want = langid.Scorer(models), {}
    for i, t in zip(order, texts, strict=True):
        entropy, sizes = scorer.entropies([t])
        if sizes[0] and models.excess(entropy[:, 0], np.zeros(1, int), sizes)[0] <= models.limit:
            want[i] = t
    assert first == want and len(first) >= len(texts) - 10 and not any(t is None or not re.search("[a-z]", t.lower()) for t in first.values())
    assert second == {i: first[i] for i in brute_near_duplicates(first)} and len(second) < len(first) - 20
    assert third == {i: second[i] for i in brute_clean(second, items)} and len(third) < len(second) - 5
    spans = {r.doc_id: r._spans for r in secret_scan.scan(docs.where(F.col("doc_id").isin(list(third))), secret_scan.learn(docs.where(F.col("doc_id").isin(list(third))))).collect()}
    written = {}
    for i, t in third.items():
        out, at = "", 0
        for s in sorted(spans[i], key=lambda s: s.start):
            if s.start >= at:
                out += t[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        written[i] = out + t[at:]
    assert fourth == written and sum("[SECRET]" in t for t in fourth.values()) == 5
    plain, pieces, sequences = Tokenizer.from_file(tokens.public_path("byte_bpe_50k.json")), [], {}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for i, t in fourth.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for r in rows:
        pieces.append(r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert {r.doc_id for r in rows} == set(fourth) and len(sequences) == best_fit(pieces, 1024)
