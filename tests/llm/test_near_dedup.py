import collections
import math
import random

import numpy as np

from larkspur.llm import near_dedup as nd


def corpus():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(900)]
    rows, k = [], 0
    for group in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 300))]
        rows.append((k, " ".join(base)))
        k += 1
        for _ in range(rng.choice([0, 1, 3, 40 if group == 7 else 2])):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            rows.append((k, " ".join(other)))
            k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "one two"), (k + 3, "One  TWO"), (k + 4, "alone here"), (k + 5, "x " * 3000)]
    return rows


def brute(rows, sketch, n):
    """Classes of all pairs: a text's weights as a row of one matrix."""
    idf, number = nd.log_idf(sketch, n), {}
    counts = []
    for _, text in rows:
        words = (text or "").lower().split()
        counts.append(collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {})
        for gram in counts[-1]:
            number.setdefault(gram, len(number))
    grams = [nd.shingles([" ".join(gram)], nd.WordHashes())[1][0] for gram in number]
    matrix = np.zeros((len(rows), len(grams)), np.float32)
    for k, one in enumerate(counts):
        at, tf = np.array([number[g] for g in one], np.int64), np.array(list(one.values()))
        if len(at):
            matrix[k, at] = np.exp(nd.levels(np.array(grams, np.uint64)[at], tf, idf) / nd.STEP)
    total, root = matrix.sum(axis=1), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        shared = np.minimum(matrix[i], matrix[i + 1 :]).sum(axis=1)
        both = total[i] + total[i + 1 :] - shared
        for j in i + 1 + np.flatnonzero(np.where(both > 0, shared >= (0.8 - 1e-6) * both, True)):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {key: rows[find(k)][0] for k, (key, _) in enumerate(rows)}


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 32)
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, rep string, hash int").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs).collect()}
    want = brute(rows, nd.frequencies(docs.select("doc_id", "text")), len(rows))
    assert got == want and len(set(want.values())) < len(want)


def test_estimates_follow_the_weighted_similarity():
    rng = np.random.default_rng(1)
    shingle = np.sort(rng.integers(0, 1 << 48, 400).astype(np.uint64))
    a, b = rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    wa, wb = np.exp(a / nd.STEP), np.exp(b / nd.STEP)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    alike = []
    for seed in range(12):
        draw = nd.Sampler(seed)
        x, y = (draw.signatures(np.zeros(400, np.int64), shingle, level, 1)[0] for level in (a, b))
        alike.append((x == y).mean())
    assert abs(np.mean(alike) - true) < 0.08


def test_empty_and_null(spark):
    schema = "doc_id long, text string"
    assert nd.near_classes(spark.createDataFrame([], schema)).collect() == []
    got = nd.near_classes(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, "A b")], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in got if r["doc_id"]) == [(3, 3, True), (3, 3, True), (4, 3, False)]
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]


def edited():
    """Groups of many texts, most pairs of which are a little under the limit, so that links are few."""
    rng = random.Random(11)
    rows = []
    for group in range(3):
        base = [f"g{group}w{k}" for k in range(500)]
        for _ in range(110):
            other = list(base)
            for slot in rng.sample(range(80), rng.randint(6, 9)):
                other[6 * slot + 3] = f"e{slot}"
            rows.append((len(rows), " ".join(other)))
    return rows


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 32)
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs).collect()}
    assert got == brute(rows, nd.frequencies(docs), len(rows))


def test_groups_of_400_texts_near_the_limit(spark):
    """At the shipped constants; most pairs are a little under the limit, so that few links hold the classes together."""
    rng, rows = random.Random(7), []
    for changed in (7, 9):
        base = [f"c{changed}w{k}" for k in range(500)]
        for _ in range(400):
            other = list(base)
            for slot in rng.sample(range(83), changed):
                other[6 * slot + 3] = f"e{slot}"
            rows.append((len(rows), " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs).collect()}
    want = brute(rows, nd.frequencies(docs), len(rows))
    assert got == want and 2 < len(set(want.values()))


def test_rows_that_share_an_id_but_not_the_text(spark):
    far, near = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, near), (2, far), (2, near), (3, far), (4, "alone")], "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]): r["kept"] for r in nd.near_classes(docs).collect()}
    assert got == {(1, 1): True, (2, 2): True, (2, 1): False, (3, 2): False, (4, 4): True}
    assert sorted((r["doc_id"], r["text"]) for r in nd.drop_near(docs).collect()) == sorted([(1, near), (2, far), (2, near), (4, "alone")])


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("k", "a b c"), ("j", "a b c"), (None, "")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["class_id"], r["kept"], r["n_words"]) for r in nd.near_classes(docs).collect())
    assert got == [("", None, True, 0), ("j", "j", True, 3), ("k", "j", False, 3)]


def test_the_sketch_counts_frequent_shingles():
    rng = np.random.default_rng(3)
    common, rare = rng.integers(0, 1 << 48, 20).astype(np.uint64), rng.integers(0, 1 << 48, 3_000_000).astype(np.uint64)
    sketch = np.zeros((nd.SKETCH_ROWS, 1 << (nd.SKETCH_BITS - 1)), np.int64)
    for row in range(nd.SKETCH_ROWS):
        held = np.bincount(nd.place(rare, row), minlength=1 << nd.SKETCH_BITS) + 20_000 * np.bincount(nd.place(common, row), minlength=1 << nd.SKETCH_BITS)
        sketch[row] = held[::2] - held[1::2]
    idf = nd.log_idf(sketch, 30_000)
    assert (nd.levels(common, np.ones(20), idf) == 0).all() and (nd.levels(rare[:5000], np.ones(5000), idf) == 2).mean() > 0.99


def test_block_similarities_equal_the_pairwise_ones():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 40, 200, 200):
        shingle = np.unique(rng.integers(0, 300, n).astype(np.uint32))
        sets.append(shingle.tobytes() + rng.integers(0, 20, len(shingle)).astype(np.uint16).tobytes())
    sets.append(sets[2])
    block = nd.Sets(sets)
    for k in range(len(sets)):
        for others in (np.arange(len(sets)), np.array([k])):
            assert np.allclose(block.similarities(k, others), [nd.jaccard(sets[k], sets[o]) for o in others], rtol=0, atol=1e-12)
