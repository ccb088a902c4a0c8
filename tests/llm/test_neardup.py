import random

import numpy as np
import pytest
from marram.llm import components, neardup


def naive(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n ", "one", "ONE", "one two", "One Two", "é É", "a b c d", "a b c d e"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 5, 20, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append((rng.choice([" ", "\n", "  "])).join(copy))
    passage = " ".join(rng.choices(words, k=40))
    texts += [f"{' '.join(rng.choices(words, k=15))} {passage} {' '.join(rng.choices(words, k=rng.randrange(1, 15)))}" for _ in range(30)]
    texts += ["same text many times over"] * 20 + ["x " * 30_000, " ".join(rng.choices(words, k=20_000))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "big", "block"), [(4, 64, 256), (5, 2, 3)])
def test_links_equal_brute_force(spark, monkeypatch, size, big, block):
    monkeypatch.setattr(neardup, "BIG", big)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(size)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, rep int, bucket string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(docs, size).collect())
    assert got == naive(texts, size, 80)
    assert neardup.deduplicate(docs, size).count() == len({c for _, _, c in got})


def test_a_large_group_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BIG", 20)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(12)
    base, texts = [f"b{i}" for i in range(70)], []
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [copy[k]] * 2, [f"e{rng.randrange(9)}"], [f"u{rng.random()}"]])
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.link(docs, 4).collect())
    assert got == naive(texts, 4, 80)
    assert 1 < len({c for _, _, c in got}) < 160


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.link(docs).collect()) == [(1, 1), (2, 2), (2, 2), (3, 1), (3, 1)]
    assert neardup.link(docs.limit(0)).collect() == [] and neardup.deduplicate(docs.limit(0)).collect() == []


def test_signatures_keep_both_ends():
    low, high = neardup.signature(neardup.shingles("a b c d e f g h", 4))
    assert (low < high).all() and len(low) == neardup.PERMUTATIONS
    x, y = neardup.shingles(" ".join(map(str, range(100))), 4), neardup.shingles(" ".join(map(str, range(20, 120))), 4)
    a, b = neardup.signature(x, 3000), neardup.signature(y, 3000)
    estimate = ((a[0] == b[0]).mean() + (a[1] == b[1]).mean()) / 2
    assert abs(estimate - len(set(x) & set(y)) / len(set(x) | set(y))) < 0.05


def test_sketches_bound_the_difference():
    rng = random.Random(4)
    for _ in range(50):
        a = {rng.randrange(2**63) for _ in range(rng.randrange(1, 400))}
        b = set(rng.sample(sorted(a), len(a) // 2)) | {rng.randrange(2**63) for _ in range(rng.randrange(100))}
        x, y = (int.from_bytes(neardup.sketch(np.array(sorted(s), np.int64))) for s in (a, b))
        assert (x ^ y).bit_count() <= len(a ^ b)


def test_joined_components(spark):
    root = spark.createDataFrame([(2, 1), (3, 1), (11, 10)], "node long, root long")
    links = spark.createDataFrame([(3, 11), (0, 20), (2, 3)], "a long, b long")
    assert {r.node: r.root for r in components.joined(root, links).collect()} == {2: 1, 3: 1, 11: 1, 10: 1, 20: 0}


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (200, 202)] + [(300, 301)] * 3
    rng = random.Random(1)
    rng.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100), 201: 200, 202: 200, 301: 300}


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "x y z p q r"), (None, None)], "doc_id long, text string")
    rows = {(r.component_id, r.kept) for r in neardup.link(docs).collect()}
    assert rows == {(4, False), (4, True), (None, True)} and neardup.deduplicate(docs).count() == 4
