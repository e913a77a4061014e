"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words, lower-cased and without outer punctuation, and the first
``PREFIX`` letters of the longer ones, hashed into ``SPACE`` places; each counts once. The score
is the sigmoid of ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``, so pairs such as an insult with the
mention of a group have a weight of their own. The pair term takes linear time:
``(|sum v_i|^2 - sum |v_i|^2) / 2``.

Weights are learned in numpy from at most ``TRAIN_DOCS`` labelled texts outside fold 0; terms
found in fewer than ``MIN_DOCS`` of them have none. Terms as often in toxic texts as chance has it
(within ``SCREEN`` standard deviations) have no weight of their own but factors, since a pair may
tell what neither term does. There are far more of those than texts to learn from, so they are
learned after the others, without every ``HOLD``th text, and the epoch with the least loss on
those texts counts; where none is better than the first terms alone, the factors stay zero. The
model's size is bounded by SPACE.

Defined results. Null texts count as empty; an empty text has the score of w0 alone. Without
labels of both classes the score is the smoothed share of label 1 for every text. Null ids,
repeated rows and extra columns pass; a null id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold, small_batches, steps, table
from larkspur.llm.labelled import labelled_sample

TRAIN_DOCS = 12_000
SPACE = 1 << 20
MIN_DOCS = 4
#: Standard deviations by which a term's toxic texts must differ from their expected number.
SCREEN = 4.5
PREFIX = 4
#: One text in so many decides whether the screened terms' factors are kept.
HOLD = 10
FACTORS = 8
EPOCHS = 30
RATE = 0.3
L2 = 2e-5
#: Words that a worker remembers; it forgets them all when there are more.
REMEMBER = 300_000
OUTER = ".,!?;:#$%&*|\"'()[]{}<>-_/\\"


class Terms(dict):
    """word -> a row of ``found`` that holds its two places (-1: none)."""

    def __init__(self, places=None):
        super().__init__()
        self.places, self.found = places, []

    def __missing__(self, word: str) -> int:
        bare = word.lower().strip(OUTER)
        a = xxhash.xxh32_intdigest(bare) % SPACE if bare else -1
        b = xxhash.xxh32_intdigest(bare[:PREFIX], 1) % SPACE if len(bare) > PREFIX else -1
        if self.places is not None:
            a, b = (int(self.places[a]) if a >= 0 else -1), (int(self.places[b]) if b >= 0 else -1)
        self[word] = k = len(self.found)
        self.found.append((a, b))
        return k

    def of(self, texts: list[str], space: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) pairs, each once, ordered by text."""
        if len(self) > REMEMBER:
            self.clear()
            self.found = []
        rows, sizes = [], []
        for t in texts:
            words = t.split()
            sizes.append(len(words))
            rows.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        both = np.array(self.found, np.int64).reshape(-1, 2)[np.concatenate(rows)] if rows else np.zeros((0, 2), np.int64)
        doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        keys = np.concatenate((doc * space + both[:, 0], doc * space + both[:, 1]))[np.concatenate((both[:, 0], both[:, 1])) >= 0]
        keys = np.unique(keys)
        return keys // space, keys % space


def raw_score(model: dict, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = model["w0"] + np.bincount(doc, model["w"][place], n)
    v = model["v"][place]
    for f in range(v.shape[1]):
        s = np.bincount(doc, v[:, f], n)
        out += 0.5 * (s * s - np.bincount(doc, v[:, f] ** 2, n))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(doc: np.ndarray, place: np.ndarray, label: np.ndarray, seed: int = 1) -> dict:
    """A model from pairs ordered by document, with places in SPACE."""
    n = len(label)
    share = (label.sum() + 0.5) / (n + 1)
    places = np.full(SPACE, -1, np.int32)
    if n == 0 or label.min() == label.max():
        return {"places": places, "w0": float(np.log(share / (1 - share))), "w": np.zeros(1, np.float32), "v": np.zeros((1, FACTORS), np.float32)}
    seen = np.bincount(place, minlength=SPACE)
    apart = np.abs(np.bincount(place, label[doc], SPACE) - seen * share) >= SCREEN * np.sqrt(seen * share * (1 - share))
    often = np.flatnonzero(seen >= MIN_DOCS)
    strong = apart[often]
    places[often] = np.arange(len(often))
    place = places[place].astype(np.int64)
    doc, place = doc[place >= 0], place[place >= 0]
    size, ends = max(1, len(often)), np.searchsorted(doc, np.arange(n + 1))
    strong = strong if len(often) else np.zeros(1, bool)
    test, some = np.arange(n) % HOLD == HOLD - 1, strong[place]
    log_share = float(np.log(share / (1 - share)))

    def start(rng) -> dict:
        v = rng.normal(0, 0.01, (size, FACTORS))
        return {"w0": log_share, "g0": 1e-6, "w": np.zeros(size), "gw": np.full(size, 1e-6), "v": v * strong[:, None], "gv": np.full((size, FACTORS), 1e-2)}

    def first(rng, texts: np.ndarray) -> dict:
        m, own = start(rng), np.searchsorted(doc[some], np.arange(n + 1))
        for _ in range(EPOCHS):
            _epoch(m, rng.permutation(texts), place[some], own, label, strong)
        return m

    def loss(m: dict) -> float:
        held = test[doc]
        z = raw_score(m, doc[held], place[held], n)[test]
        return float(np.mean(np.logaddexp(0, z) - label[test] * z))

    best = None
    if not strong.all() and test.any() and len(often):
        rng, texts = np.random.default_rng(seed), np.flatnonzero(~test)
        m = first(rng, texts)
        least = loss(m)
        m["v"] += rng.normal(0, 0.01, m["v"].shape) * ~strong[:, None]
        for _ in range(EPOCHS):
            _epoch(m, rng.permutation(texts), place, ends, label, strong)
            now = loss(m)
            if now < least:
                least, best = now, {"w0": m["w0"], "w": m["w"].copy(), "v": m["v"].copy()}
    best = best or first(np.random.default_rng(seed), np.arange(n))
    return {"places": places, "w0": float(best["w0"]), "w": best["w"].astype(np.float32), "v": best["v"].astype(np.float32)}


def _epoch(m: dict, order: np.ndarray, place: np.ndarray, ends: np.ndarray, label: np.ndarray, weighted: np.ndarray) -> None:
    """One pass by AdaGrad over the texts in ``order``; only ``weighted`` terms have a weight of their own."""
    w, gw, v, gv = m["w"], m["gw"], m["v"], m["gv"]
    for lo in range(0, len(order), 256):
        picked = order[lo : lo + 256]
        sizes = ends[picked + 1] - ends[picked]
        local = np.repeat(np.arange(len(picked)), sizes)
        at = np.repeat(ends[picked] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        own, p = np.unique(place[at], return_inverse=True)
        vo = v[own]
        vp = vo[p]
        sums = np.stack([np.bincount(local, vp[:, f], len(picked)) for f in range(FACTORS)], axis=1)
        squares = np.bincount(local, (vp**2).sum(axis=1), len(picked))
        z = m["w0"] + np.bincount(local, w[own][p], len(picked)) + 0.5 * ((sums**2).sum(axis=1) - squares)
        d = (sigmoid(z) - label[picked]) / len(picked)
        m["g0"] += d.sum() ** 2
        m["w0"] -= RATE * d.sum() / np.sqrt(m["g0"])
        g = (np.bincount(p, d[local], len(own)) + L2 * w[own]) * weighted[own]
        gw[own] += g * g
        w[own] -= RATE * g / np.sqrt(gw[own])
        g = np.stack([np.bincount(p, d[local] * (sums[local, f] - vp[:, f]), len(own)) for f in range(FACTORS)], axis=1) + L2 * vo
        gv[own] += g * g
        v[own] -= 0.3 * RATE * g / np.sqrt(gv[own])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_DOCS) -> dict:
    """Only hashed terms come to the driver, of at most ``bound`` texts."""
    small_batches(docs.sparkSession)

    def rows(batches):
        terms = Terms()
        for batch in steps(batches):
            doc, place = terms.of(batch.column(1).to_pylist(), SPACE)
            lists = np.split(place.astype(np.int32), np.searchsorted(doc, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "places", "label"])

    found = labelled_sample(docs, labels, label, bound).mapInArrow(rows, "doc_id long, places array<int>, label int").toArrow().sort_by("doc_id")
    places, label_ = found.column("places").combine_chunks(), found.column("label").to_numpy().astype(np.float64)
    sizes = np.diff(np.asarray(places.offsets)) if len(label_) else np.zeros(0, np.int64)
    flat = np.asarray(places.flatten()).astype(np.int64) if len(label_) else np.zeros(0, np.int64)
    return fit(np.repeat(np.arange(len(label_)), sizes), flat, label_)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """A row per document: doc_id, score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        terms = Terms(m["places"])
        for batch in steps(batches):
            doc, place = terms.of(batch.column(1).to_pylist(), SPACE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(raw_score(m, doc, place, batch.num_rows)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


QUERY = "op2_toxicity"


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
